"""Base relations of the queries, and the same as SQL fragments.

Reads are the distinct called intervals of graph_peaks: each is a path of signed nodes with a start
and an end offset, like an aligned read. Steps are their nodes, clipped, on the flat axis on which a
node lies at [node_index, node_index + node_size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathtide.session import cut, no_broadcast, table


def reads(spark: SparkSession, d: str) -> DataFrame:
    """read_id, sample_id, s, e, rp (signed nodes), q, uid; each peak once, with at least one node."""
    own = table(spark, d, "graph_peaks").filter(F.size("region_paths") > 0)
    own = own.select(F.col("peak_id").alias("read_id"), "sample_id", F.col("start_off").alias("s"), F.col("end_off").alias("e"), F.col("region_paths").alias("rp"), F.col("average_q_value").alias("q"), F.col("unique_id").alias("uid"))
    return own.dropDuplicates(["read_id"])


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").withColumnRenamed("node_size", "size")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct edges: chrom, src, dst."""
    return table(spark, d, "edges").dropDuplicates()


def clip(size: Column) -> tuple[Column, Column]:
    """The forward range [lo, hi) of a step within its node; a reverse step counts from the node's far end."""
    a = F.when(F.col("i") == 0, F.col("s")).otherwise(0)
    b = F.when(F.col("i") == F.col("n") - 1, F.col("e")).otherwise(size)
    return F.when(F.col("node") > 0, a).otherwise(size - b), F.when(F.col("node") > 0, b).otherwise(size - a)


def steps(spark: SparkSession, d: str, places: DataFrame | None = None) -> DataFrame:
    """read_id, sample_id, i, n, node (signed), node_id, chrom, size, node_index, path_offset, lo, hi, a, b (flat range), q.

    ``places`` are the nodes to join, those of the data where none are given.
    """
    each = reads(spark, d).select("read_id", "sample_id", "s", "e", "q", F.size("rp").alias("n"), F.posexplode("rp").alias("i", "node")).withColumn("node_id", F.abs("node"))
    at = each.join(nodes(spark, d) if places is None else places, "node_id")
    lo, hi = clip(F.col("size"))
    at = at.withColumn("lo", lo).withColumn("hi", hi)
    return at.withColumn("a", F.col("node_index") + F.col("lo")).withColumn("b", F.col("node_index") + F.col("hi"))


def steps_once(spark: SparkSession, d: str, *columns: str | Column) -> DataFrame:
    """``columns`` of the steps, written, for queries that go over them more than once: one join with the nodes, and no broadcast of many."""
    places = nodes(spark, d)
    return cut(steps(spark, d, no_broadcast(places, places.count())).select(*columns))


def linear(spark: SparkSession, d: str) -> DataFrame:
    """Usable linear peaks, each once: lp_id, run_id, chrom (spelt like the nodes), a, b, score (null: none)."""
    own = table(spark, d, "linear_peaks").filter((F.col("end_pos") > F.col("start_pos")) & F.col("chromosome").isNotNull())
    score = F.when((F.col("score") >= 0) & ~F.isnan("score"), F.col("score"))
    return own.select("lp_id", "run_id", spelling(F.col("chromosome")).alias("chrom"), F.col("start_pos").alias("a"), F.col("end_pos").alias("b"), score.alias("score")).dropDuplicates(["lp_id"])


def spelling(name: Column) -> Column:
    """A run's spelling of a chromosome, as the nodes have it: chr1, chrX, scf0012."""
    bare = F.regexp_replace(F.lower(name), "^chr", "")
    scaffold = F.concat(F.lit("scf"), F.lpad(F.regexp_replace(bare, "^scf0*", ""), 4, "0"))
    return F.when(bare.startswith("scf"), scaffold).otherwise(F.concat(F.lit("chr"), F.upper(bare)))


def signature(word: Column) -> Column:
    """The letters and digits of a word in order: equal for swapped letters, case and dashes."""
    return F.array_join(F.array_sort(F.split(F.regexp_replace(F.lower(word), "[^a-z0-9]", ""), "")), "")


READS = """reads AS (SELECT peak_id AS read_id, any_value(sample_id) AS sample_id, any_value(start_off) AS s, any_value(end_off) AS e,
  any_value(region_paths) AS rp, any_value(average_q_value) AS q, any_value(unique_id) AS uid
  FROM graph_peaks WHERE len(region_paths) > 0 GROUP BY peak_id)"""

STEPS = READS + """,
listed AS (SELECT read_id, sample_id, s, e, q, len(rp) AS n, unnest(range(len(rp))) AS i, unnest(rp) AS node FROM reads),
placed AS (SELECT l.*, abs(node) AS node_id, chrom, node_size AS size, node_index, path_offset,
  CASE WHEN i = 0 THEN s ELSE 0 END AS ra, CASE WHEN i = n - 1 THEN e ELSE node_size END AS rb
  FROM listed l JOIN nodes ON nodes.node_id = abs(l.node)),
clipped AS (SELECT *, CASE WHEN node > 0 THEN ra ELSE size - rb END AS lo, CASE WHEN node > 0 THEN rb ELSE size - ra END AS hi FROM placed),
steps AS (SELECT *, node_index + lo AS a, node_index + hi AS b FROM clipped)"""

EDGES = "edge AS (SELECT DISTINCT chrom, src, dst FROM edges)"

LINEAR = """spelt AS (SELECT lp_id, any_value(run_id) AS run_id, regexp_replace(lower(any_value(chromosome)), '^chr', '') AS bare, any_value(start_pos) AS a, any_value(end_pos) AS b,
  any_value(CASE WHEN score >= 0 AND NOT isnan(score) THEN score END) AS score FROM linear_peaks
  WHERE end_pos > start_pos AND chromosome IS NOT NULL GROUP BY lp_id),
linear AS (SELECT lp_id, run_id, CASE WHEN bare LIKE 'scf%' THEN 'scf' || lpad(regexp_replace(bare, '^scf0*', ''), 4, '0') ELSE 'chr' || upper(bare) END AS chrom, a, b, score FROM spelt)"""


def runs_sql(name: str, ranges: str, keys: str = "chrom") -> str:
    """CTEs that end in ``name``(keys, start_pos, end_pos, value): coverage of ranges (keys, a, b), 0 left out."""
    return f"""{name}_e AS (SELECT {keys}, a AS idx, 1 AS d FROM {ranges} WHERE a < b UNION ALL SELECT {keys}, b, -1 FROM {ranges} WHERE a < b),
{name}_p AS (SELECT {keys}, idx, sum(d) AS d FROM {name}_e GROUP BY {keys}, idx HAVING sum(d) <> 0),
{name}_r AS (SELECT {keys}, idx AS start_pos, lead(idx) OVER (PARTITION BY {keys} ORDER BY idx) AS end_pos,
  CAST(sum(d) OVER (PARTITION BY {keys} ORDER BY idx) AS BIGINT) AS value FROM {name}_p),
{name} AS (SELECT * FROM {name}_r WHERE end_pos IS NOT NULL AND value <> 0)"""


def islands_sql(name: str, runs: str, keys: str = "chrom", value: str = "value") -> str:
    """CTEs that end in ``name``: touching runs of equal value as one."""
    return f"""{name}_m AS (SELECT *, CASE WHEN start_pos = lag(end_pos) OVER w AND {value} IS NOT DISTINCT FROM lag({value}) OVER w THEN 0 ELSE 1 END AS head
  FROM {runs} WINDOW w AS (PARTITION BY {keys} ORDER BY start_pos)),
{name}_n AS (SELECT *, sum(head) OVER (PARTITION BY {keys} ORDER BY start_pos) AS island FROM {name}_m),
{name} AS (SELECT {keys}, min(start_pos) AS start_pos, max(end_pos) AS end_pos, any_value({value}) AS {value} FROM {name}_n GROUP BY {keys}, island)"""
