"""Operators of language-model data pipelines. Nothing outside this package imports it."""

#: The modules of this package with QUERIES and SQL.
QUERY_MODULES: list[str] = ["pathtide.llm.queries_peaks", "pathtide.llm.queries_text"]
