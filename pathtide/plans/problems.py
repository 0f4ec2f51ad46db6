"""Queries of the general training-data problems (p1, p2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathtide.operators.periods import merge_periods
from pathtide.session import table
from pathtide.sources.rejects import parse_lines, split_rejects


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse_lines(table(spark, d, "raw_peak_lines"), table(spark, d, "linear_runs"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The damaged lines, each with its reason."""
    return split_rejects(_parsed(spark, d))[1].select("line_id", "reason")


def p1_valid(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines as typed peaks."""
    return split_rejects(_parsed(spark, d))[0]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Periods of at least two linear peaks, and every gap, per run and chromosome."""
    got = merge_periods(table(spark, d, "linear_peaks"), ["run_id", "chromosome"], "start_pos", "end_pos", "lp_id")
    return got.filter((F.col("kind") == "gap") | (F.col("n_members") >= 2)).drop("n_members")


QUERIES = {"p1_found": p1_found, "p1_valid": p1_valid, "p2_found": p2_found}

SQL = {
    "p2_found": """
WITH rows_ AS (SELECT DISTINCT lp_id, run_id, chromosome, start_pos, end_pos FROM linear_peaks
  WHERE chromosome IS NOT NULL AND end_pos > start_pos),
marked AS (SELECT *, CASE WHEN start_pos <= max(end_pos) OVER (PARTITION BY run_id, chromosome ORDER BY start_pos, end_pos, lp_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS head FROM rows_ WHERE run_id IS NOT NULL),
numbered AS (SELECT *, sum(head) OVER (PARTITION BY run_id, chromosome ORDER BY start_pos, end_pos, lp_id) AS island FROM marked),
periods AS (SELECT run_id, chromosome, min(start_pos) AS a, max(end_pos) AS b, count(*) AS n FROM numbered GROUP BY run_id, chromosome, island),
nexts AS (SELECT *, lead(a) OVER (PARTITION BY run_id, chromosome ORDER BY a) AS nxt FROM periods)
SELECT run_id, chromosome, 'period' AS kind, a AS start_pos, b AS end_pos FROM nexts WHERE n >= 2
UNION ALL SELECT run_id, chromosome, 'gap', b, nxt FROM nexts WHERE nxt IS NOT NULL""",
}
