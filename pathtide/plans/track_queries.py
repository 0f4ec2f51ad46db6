"""Queries on tracks, reads and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathtide.operators.joins import asof_join
from pathtide.operators.scan import scan, sharded
from pathtide.operators.tracks import coalesce_runs, coverage, range_events, step_runs, threshold, track_totals
from pathtide.plans.base import EDGES, LINEAR, READS, STEPS, edges, islands_sql, linear, nodes, reads, runs_sql, steps, steps_once
from pathtide.session import cut

#: Least coverage of a significant run.
CUTOFF = 3


def _graph_track(spark: SparkSession, d: str) -> DataFrame:
    return coverage(steps(spark, d), ["chrom"], "a", "b")


def graph_positions(spark: SparkSession, d: str) -> DataFrame:
    """Flat position of every read's start: a reverse read starts at its first node's far end."""
    return steps(spark, d).filter("i = 0").select("read_id", "chrom", F.when(F.col("node") > 0, F.col("a")).otherwise(F.col("b")).alias("position"))


def direct_pileup(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of the reads, unextended, on the flat axis."""
    return _graph_track(spark, d)


def linear_pileup(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of the linear peaks on the linear axis."""
    return coverage(linear(spark, d), ["chrom"], "a", "b")


def _strand_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs with both strands' coverage, va and vb, of one pass over the steps."""
    s = steps(spark, d).filter("a < b").select("chrom", "a", "b", (F.col("node") > 0).cast("int").alias("f"))
    ends = F.array(*[F.struct(F.col(c).alias("idx"), (F.col("f") * k).alias("va"), ((1 - F.col("f")) * k).alias("vb")) for c, k in (("a", 1), ("b", -1))])
    return step_runs(s.select("chrom", F.inline(ends)), ["chrom"], ["va", "vb"]).filter("va <> 0 or vb <> 0")


def merged_strands(spark: SparkSession, d: str) -> DataFrame:
    """Forward minus reverse coverage: a binary function over two tracks."""
    return coalesce_runs(_strand_runs(spark, d).withColumn("value", F.col("va") - F.col("vb")), ["chrom"])


def track_maximum(spark: SparkSession, d: str) -> DataFrame:
    """Pointwise maximum of forward and reverse coverage."""
    return coalesce_runs(_strand_runs(spark, d).withColumn("value", F.greatest("va", "vb")), ["chrom"])


def scaled_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Both strands' coverage per read count: the larger set is scaled down by the ratio."""
    strand = F.when(F.col("node") > 0, "forward").when(F.col("node") < 0, "reverse").alias("strand")
    s = steps_once(spark, d, strand, "chrom", "a", "b", (F.col("i") == 0).alias("first")).filter("strand is not null")
    # One pass for both strands: the strand is a key of the track.
    both = coverage(s, ["strand", "chrom"], "a", "b")
    n = s.filter("first").agg(F.count_if(F.col("strand") == "forward").alias("nf"), F.count_if(F.col("strand") == "reverse").alias("nr"))
    least = F.least("nf", "nr")
    factor = F.when(F.col("strand") == "forward", least / F.col("nf")).otherwise(least / F.col("nr"))
    return both.crossJoin(F.broadcast(n)).select("strand", "chrom", "start_pos", "end_pos", F.round(F.col("value") * factor, 6).alias("value"))


def threshold_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs with a coverage of at least the cutoff."""
    return threshold(_graph_track(spark, d), ["chrom"], CUTOFF)


def asof_node_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The linear path's node under every linear peak's middle."""
    path = nodes(spark, d).filter("path_offset is not null").select("chrom", "node_id", "path_offset", "size")
    middles = linear(spark, d).select("lp_id", "chrom", F.expr("(a + b) div 2").alias("middle"))
    got = asof_join(middles, path, ["chrom"], "middle", "path_offset", ["node_id", "size", "path_offset"])
    return got.filter("middle < path_offset + size").select("lp_id", "node_id", (F.col("middle") - F.col("path_offset")).cast("long").alias("offset"))


def event_sort(spark: SparkSession, d: str) -> DataFrame:
    """Node ends, coverage changes and node starts of each chromosome in order, counted; ends come first at equal positions."""
    n = nodes(spark, d)
    ends = n.select("chrom", (F.col("node_index") + F.col("size")).alias("idx"), F.lit(0).alias("code"))
    starts = n.select("chrom", F.col("node_index").alias("idx"), F.lit(2).alias("code"))
    # The scan goes over the events twice, so the coverage is written.
    track = cut(coverage(steps_once(spark, d, "chrom", "a", "b"), ["chrom"], "a", "b").select("chrom", F.col("start_pos").alias("idx")))
    each = sharded(ends.unionByName(track.withColumn("code", F.lit(1))).unionByName(starts), ["chrom"], "idx")
    # Counted within the shards, which needs no further shuffle.
    each = each.groupBy("chrom", "shard", "idx", "code").agg(F.count(F.lit(1)).alias("n"))
    return scan(each, ["chrom"], ["idx", "code"], sums={"upto": "n"}).select("chrom", "idx", "code", F.col("upto").cast("long").alias("upto"))


def pileup_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean coverage of each chromosome's graph."""
    sizes = nodes(spark, d).groupBy("chrom").agg(F.sum("size").alias("bp"))
    totals = track_totals(_graph_track(spark, d), ["chrom"])
    return sizes.join(totals, "chrom", "left").select("chrom", "bp", F.coalesce("covered", F.lit(0)).alias("covered"), F.round(F.coalesce("integral", F.lit(0)) / F.col("bp"), 9).alias("mean"))


def node_counts(spark: SparkSession, d: str) -> DataFrame:
    """Reads over each signed node."""
    return steps(spark, d).groupBy("chrom", "node").agg(F.countDistinct("read_id").alias("n_reads"))


def touched_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes any read goes through."""
    return steps(spark, d).select("chrom", "node_id").distinct()


def count_unique_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads, and distinct reads by path and start, per sample."""
    got = reads(spark, d).groupBy("sample_id", "rp", "s").agg(F.count(F.lit(1)).alias("n"))
    return got.groupBy("sample_id").agg(F.sum("n").alias("n_reads"), F.count(F.lit(1)).alias("n_unique"))


def read_length(spark: SparkSession, d: str) -> DataFrame:
    """Median length of the reads per sample, in base pairs."""
    sizes = steps(spark, d).groupBy("sample_id", "read_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("bp"))
    return sizes.groupBy("sample_id").agg(F.floor(F.percentile("bp", 0.5)).alias("median_bp"), F.count(F.lit(1)).alias("n_reads"))


def first_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads without later copies of the same path and start in the sample: the lowest id stays."""
    return reads(spark, d).groupBy("sample_id", "rp", "s").agg(F.min("read_id").alias("read_id")).select("sample_id", "read_id")


def coverage_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Base pairs of each coverage."""
    return _graph_track(spark, d).groupBy("value").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("bp"))


def node_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Coverage along the linear path only: runs of path nodes projected to path offsets."""
    s = steps(spark, d).filter("path_offset is not null")
    s = s.select("chrom", (F.col("path_offset") + F.col("lo")).alias("a"), (F.col("path_offset") + F.col("hi")).alias("b"))
    return coverage(s, ["chrom"], "a", "b")


def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes have how many ways in and out."""
    e = edges(spark, d)
    out, into = e.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("n_out")), e.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("n_in"))
    got = nodes(spark, d).select("node_id", "chrom").join(out, "node_id", "left").join(into, "node_id", "left").na.fill(0, ["n_in", "n_out"])
    return got.groupBy("chrom", "n_in", "n_out").agg(F.count(F.lit(1)).alias("n_nodes"))


def best_value_runs(spark: SparkSession, d: str) -> DataFrame:
    """For every position that reads cover, the number of samples there, as runs."""
    s = steps(spark, d).filter("lo < hi").select("chrom", "sample_id", F.col("a").alias("start_pos"), F.col("b").alias("end_pos"))
    per = step_runs(range_events(s, ["chrom", "sample_id"], "start_pos", "end_pos"), ["chrom", "sample_id"], ["diff"]).filter("diff > 0")
    merged = coalesce_runs(per.select("chrom", "sample_id", "start_pos", "end_pos", F.lit(1).alias("value")), ["chrom", "sample_id"])
    return coverage(merged, ["chrom"], "start_pos", "end_pos")


_W = "WITH "
_COVER = _W + STEPS + ", " + runs_sql("cover", "steps") + "\n"
_STRANDS = _W + STEPS + """, fs AS (SELECT * FROM steps WHERE node > 0), rs AS (SELECT * FROM steps WHERE node < 0),
ev AS (SELECT chrom, a AS idx, 1 AS da, 0 AS db FROM fs WHERE a < b UNION ALL SELECT chrom, b, -1, 0 FROM fs WHERE a < b
  UNION ALL SELECT chrom, a, 0, 1 FROM rs WHERE a < b UNION ALL SELECT chrom, b, 0, -1 FROM rs WHERE a < b),
pt AS (SELECT chrom, idx, sum(da) AS da, sum(db) AS db FROM ev GROUP BY chrom, idx HAVING sum(da) <> 0 OR sum(db) <> 0),
two AS (SELECT chrom, idx AS start_pos, lead(idx) OVER w AS end_pos, CAST(sum(da) OVER w AS BIGINT) AS va, CAST(sum(db) OVER w AS BIGINT) AS vb FROM pt WINDOW w AS (PARTITION BY chrom ORDER BY idx)),
both_ AS (SELECT chrom, start_pos, end_pos, {f} AS value FROM two WHERE end_pos IS NOT NULL AND (va <> 0 OR vb <> 0)), """ + islands_sql("merged", "both_") + "\nSELECT chrom, start_pos, end_pos, value FROM merged"

QUERIES = {f.__name__: f for f in (
    graph_positions, direct_pileup, linear_pileup, merged_strands, track_maximum, scaled_tracks, threshold_runs, asof_node_lookup, event_sort, pileup_mean,
    node_counts, touched_nodes, count_unique_reads, read_length, first_reads, coverage_histogram, node_boundaries, graph_degrees, best_value_runs,
)}

SQL = {
    "graph_positions": _W + STEPS + " SELECT read_id, chrom, CASE WHEN node > 0 THEN a ELSE b END AS position FROM steps WHERE i = 0",
    "direct_pileup": _COVER + "SELECT * FROM cover",
    "linear_pileup": _W + LINEAR + ", " + runs_sql("cover", "linear") + " SELECT * FROM cover",
    "merged_strands": _STRANDS.replace("{f}", "va - vb"),
    "track_maximum": _STRANDS.replace("{f}", "greatest(va, vb)"),
    "scaled_tracks": _W + STEPS + ", fs AS (SELECT * FROM steps WHERE node > 0), rs AS (SELECT * FROM steps WHERE node < 0), " + runs_sql("f", "fs") + ", " + runs_sql("r", "rs") + """,
n AS (SELECT count(*) FILTER (WHERE node > 0) AS nf, count(*) FILTER (WHERE node < 0) AS nr FROM steps WHERE i = 0)
SELECT 'forward' AS strand, chrom, start_pos, end_pos, round(value * (least(nf, nr) / nf), 6) AS value FROM f, n
UNION ALL SELECT 'reverse', chrom, start_pos, end_pos, round(value * (least(nf, nr) / nr), 6) FROM r, n""",
    "threshold_runs": _COVER.rstrip() + f", high AS (SELECT chrom, start_pos, end_pos, true AS value FROM cover WHERE value >= {CUTOFF}), " + islands_sql("runs", "high") + " SELECT chrom, start_pos, end_pos FROM runs",
    "asof_node_lookup": _W + LINEAR + """, m AS (SELECT lp_id, chrom, (a + b) // 2 AS middle FROM linear),
path AS (SELECT chrom, node_id, path_offset, node_size AS size FROM nodes WHERE path_offset IS NOT NULL)
SELECT lp_id, node_id, middle - path_offset AS "offset" FROM m ASOF JOIN path ON m.chrom = path.chrom AND m.middle >= path.path_offset WHERE middle < path_offset + size""",
    "event_sort": _COVER.rstrip() + """, each AS (SELECT chrom, node_index + node_size AS idx, 0 AS code FROM nodes UNION ALL SELECT chrom, start_pos, 1 FROM cover UNION ALL SELECT chrom, node_index, 2 FROM nodes),
c AS (SELECT chrom, idx, code, count(*) AS n FROM each GROUP BY ALL)
SELECT chrom, idx, code, CAST(sum(n) OVER (PARTITION BY chrom ORDER BY idx, code) AS BIGINT) AS upto FROM c""",
    "pileup_mean": _COVER.rstrip() + """, t AS (SELECT chrom, sum(value * (end_pos - start_pos)) AS i, CAST(sum(end_pos - start_pos) AS BIGINT) AS covered FROM cover GROUP BY chrom),
z AS (SELECT chrom, CAST(sum(node_size) AS BIGINT) AS bp FROM nodes GROUP BY chrom)
SELECT chrom, bp, coalesce(covered, 0) AS covered, round(coalesce(i, 0) / bp, 9) AS mean FROM z LEFT JOIN t USING (chrom)""",
    "node_counts": _W + STEPS + " SELECT chrom, node, count(DISTINCT read_id) AS n_reads FROM steps GROUP BY chrom, node",
    "touched_nodes": _W + STEPS + " SELECT DISTINCT chrom, node_id FROM steps",
    "count_unique_reads": _W + READS + " SELECT sample_id, count(*) AS n_reads, count(DISTINCT (rp, s)) AS n_unique FROM reads GROUP BY sample_id",
    "read_length": _W + STEPS + ", z AS (SELECT sample_id, read_id, sum(hi - lo) AS bp FROM steps GROUP BY ALL) SELECT sample_id, CAST(floor(quantile_cont(bp, 0.5)) AS BIGINT) AS median_bp, count(*) AS n_reads FROM z GROUP BY sample_id",
    "first_reads": _W + READS + " SELECT sample_id, min(read_id) AS read_id FROM reads GROUP BY sample_id, rp, s",
    "coverage_histogram": _COVER + "SELECT value, CAST(sum(end_pos - start_pos) AS BIGINT) AS bp FROM cover GROUP BY value",
    "node_boundaries": _W + STEPS + ", o AS (SELECT chrom, path_offset + lo AS a, path_offset + hi AS b FROM steps WHERE path_offset IS NOT NULL), " + runs_sql("cover", "o") + " SELECT * FROM cover",
    "graph_degrees": _W + EDGES + """, o AS (SELECT src AS node_id, count(*) AS n_out FROM edge GROUP BY src), i AS (SELECT dst AS node_id, count(*) AS n_in FROM edge GROUP BY dst)
SELECT chrom, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, count(*) AS n_nodes FROM nodes LEFT JOIN o USING (node_id) LEFT JOIN i USING (node_id) GROUP BY ALL""",
    "best_value_runs": _W + STEPS + ", " + runs_sql("per", "steps", "chrom, sample_id") + ", ones AS (SELECT chrom, sample_id, start_pos, end_pos, 1 AS value FROM per), "
    + islands_sql("one", "ones", "chrom, sample_id") + ", spans AS (SELECT chrom, start_pos AS a, end_pos AS b FROM one), " + runs_sql("cover", "spans") + " SELECT * FROM cover",
}
