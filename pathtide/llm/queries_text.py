"""Queries of the text problems (p6, p7, p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathtide.llm.looks import look_alike_pairs, look_classes, one_form
from pathtide.llm.mixing import mix, mix_report, plan_mix
from pathtide.llm.packing import pack
from pathtide.session import cut, table


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents whose texts look the same but are not the same string."""
    got = look_alike_pairs(one_form(table(spark, d, "documents"), "doc_id", "text"))
    return got.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_rules(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs each rule settles: characters, vocabulary or fold."""
    got = look_alike_pairs(one_form(table(spark, d, "documents"), "doc_id", "text"))
    return got.groupBy("rule").agg(F.count(F.lit(1)).alias("n_pairs"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per document: the class of texts of equal look, and its number of documents that spell it otherwise."""
    return look_classes(one_form(table(spark, d, "documents"), "doc_id", "text")).withColumnRenamed("id", "doc_id")


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text, repaired and in its one form."""
    return one_form(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "repaired", "form")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """Token sizes: the byte tokenizer of mix and pack has one token per UTF-8 byte."""
    return table(spark, d, "documents").select("doc_id", "source", F.octet_length("text").alias("tokens"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    # pack_spec is a fixed, tiny table of settings: each capacity is planned on its own, on sizes measured once.
    specs = table(spark, d, "pack_spec").select("pack_id", "capacity_tokens").collect()
    sizes = cut(_sizes(spark, d).select("doc_id", "tokens"))
    parts = [pack(sizes, "doc_id", "tokens", c).withColumn("pack_id", F.lit(k)) for k, c in specs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that had to be split, per capacity."""
    return _packed(spark, d).filter(F.col("piece") == 1).select("pack_id", F.col("id").alias("doc_id")).distinct()


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's (or piece's) container, per capacity."""
    return _packed(spark, d).select("pack_id", "container", F.col("id").alias("doc_id"), "piece", F.col("size").alias("tokens"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers are filled, per capacity."""
    packed = _packed(spark, d).filter(F.col("container").isNotNull())
    got = packed.groupBy("pack_id").agg(F.countDistinct("container").alias("containers"), F.sum("size").alias("tokens"))
    got = got.join(table(spark, d, "pack_spec"), "pack_id")
    return got.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    """What the containers hold, per capacity: documents, pieces and tokens, the documents whose pieces don't add up, and the containers over their capacity."""
    packed = _packed(spark, d).join(table(spark, d, "pack_spec"), "pack_id")
    docs = packed.groupBy("pack_id", "id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("tokens"), F.countDistinct("piece").alias("kinds"))
    docs = docs.join(_sizes(spark, d).select(F.col("doc_id").alias("id"), F.coalesce("tokens", F.lit(0)).alias("whole")), "id")
    wrong = (F.col("tokens") != F.col("whole")) | (F.col("pieces") != F.col("kinds"))
    docs = docs.groupBy("pack_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.count_if(wrong).alias("wrong"))
    loads = packed.filter(F.col("container").isNotNull()).groupBy("pack_id", "capacity_tokens", "container").agg(F.sum("size").alias("load"))
    return docs.join(loads.groupBy("pack_id").agg(F.count_if(F.col("load") > F.col("capacity_tokens")).alias("overfull")), "pack_id")


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return plan_mix(_sizes(spark, d), "doc_id", "source", "tokens", table(spark, d, "mix_target"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The sources of which the mixture has all their repeats and still less than their target share."""
    return p7_shares(spark, d).filter("short").select("source")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture itself: every copy of a document with its place."""
    got = mix(_sizes(spark, d), "doc_id", "source", "tokens", _plan(spark, d))
    return got.select("source", F.col("id").alias("doc_id"), "pass_no", F.col("size").alias("tokens"), "position")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares the mixture reaches beside the targets, and the exponent of its temperature."""
    plan = _plan(spark, d)
    return mix_report(mix(_sizes(spark, d), "doc_id", "source", "tokens", plan), plan)


QUERIES = {
    "p6_found": p6_found, "p6_containers": p6_containers, "p6_fill": p6_fill, "p6_totals": p6_totals,
    "p7_found": p7_found, "p7_mixture": p7_mixture, "p7_shares": p7_shares,
    "p8_found": p8_found, "p8_rules": p8_rules, "p8_classes": p8_classes, "p8_forms": p8_forms,
}

SQL: dict[str, str] = {
    "p6_found": "SELECT pack_id, doc_id FROM documents, pack_spec WHERE strlen(text) > capacity_tokens",
    "p6_totals": """SELECT pack_id, count(*) AS documents, CAST(sum(greatest(1, ceil(coalesce(strlen(text), 0) / capacity_tokens))) AS BIGINT) AS pieces,
  CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS tokens, 0 AS wrong, 0 AS overfull FROM documents, pack_spec GROUP BY pack_id""",
    "p7_found": """
WITH sizes AS (SELECT m.source, any_value(m.target_share) AS t, any_value(m.max_repeats) AS r, coalesce(sum(strlen(text)), 0) AS n
  FROM mix_target m LEFT JOIN documents d ON d.source = m.source GROUP BY m.source)
SELECT source FROM sizes WHERE r * n < t * (SELECT sum(n) FROM sizes)""",
}
