"""Queries of the similar-pairs and top-N problems (p3, p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathtide.llm.setjoin import class_links, set_records, similar_classes, similar_pairs
from pathtide.llm.sites import link_sites
from pathtide.llm.topn import top_n
from pathtide.session import table

#: Least Jaccard similarity of two peaks' node sets.
NODE_SIMILARITY = 0.7
#: Peaks kept per sample and chromosome.
BEST = 3


def _node_sets(spark: SparkSession, d: str) -> DataFrame:
    peaks = table(spark, d, "graph_peaks").filter(F.col("unique_id") != "None")
    return peaks.select("unique_id", F.transform("region_paths", F.abs).alias("nodes"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of peaks with sufficiently equal node sets."""
    got = similar_pairs(_node_sets(spark, d), "unique_id", "nodes", NODE_SIMILARITY)
    return got.select(F.col("id_a").alias("unique_id_a"), F.col("id_b").alias("unique_id_b"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per peak: the class of peaks with the same node set, and its number of similar peaks."""
    records = set_records(_node_sets(spark, d), "unique_id", "nodes")
    return class_links(records, similar_classes(records, NODE_SIMILARITY)).withColumnRenamed("id", "unique_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The best peaks of every sample and chromosome."""
    return top_n(table(spark, d, "graph_peaks"), ["sample_id", "chromosome"], "average_q_value", "peak_id", BEST)


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """The matches of graph and linear peaks, each with its confidence."""
    return link_sites(*(table(spark, d, t) for t in ("graph_peaks", "nodes", "samples", "linear_peaks", "linear_runs")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The matching pairs of graph and linear peaks."""
    return p5_links(spark, d).select("peak_id", "lp_id")


QUERIES = {"p3_found": p3_found, "p3_classes": p3_classes, "p4_found": p4_found, "p5_found": p5_found, "p5_links": p5_links}

_SETS = """
WITH sets AS (SELECT DISTINCT unique_id AS u, list_sort(list_distinct(list_transform(region_paths, lambda x: abs(x)))) AS s FROM graph_peaks
  WHERE unique_id IS NOT NULL AND unique_id <> 'None' AND len(region_paths) > 0),
items AS (SELECT u, len(s) AS l, unnest(s) AS x FROM sets),
shared AS (SELECT a.u AS ua, b.u AS ub, a.l AS la, b.l AS lb, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.u <> b.u GROUP BY ALL),
links AS (SELECT ua, ub FROM shared WHERE 10 * c >= 7 * (la + lb - c))"""

SQL = {
    "p3_found": _SETS + " SELECT ua AS unique_id_a, ub AS unique_id_b FROM links WHERE ua < ub",
    "p3_classes": _SETS + """, classes AS (SELECT s, min(u) AS class_id FROM sets GROUP BY s),
counted AS (SELECT ua, count(*) AS n FROM links GROUP BY ua)
SELECT u AS unique_id, class_id, coalesce(n, 0) AS n_links FROM sets JOIN classes USING (s) LEFT JOIN counted ON ua = u""",
    "p4_found": """
WITH peaks AS (SELECT DISTINCT sample_id, chromosome, peak_id, average_q_value FROM graph_peaks
  WHERE chromosome IS NOT NULL AND average_q_value IS NOT NULL AND NOT isnan(average_q_value)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id, chromosome ORDER BY average_q_value DESC, peak_id) AS place FROM peaks)
SELECT sample_id, chromosome, peak_id FROM ranked WHERE place <= 3""",
}
