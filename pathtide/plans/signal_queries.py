"""Queries from reads to called peaks: extension, background, p- and q-values, regions, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathtide.operators.graph import blocks, components, extend_both_ways, extend_reads, linear_map, path_positions
from pathtide.operators.joins import attach, overlap_join
from pathtide.operators.segments import fill_holes, internal_fill, max_paths, peak_scores, segment_scores, segments
from pathtide.operators.stats import background, p_track, q_values
from pathtide.operators.tracks import coalesce_runs, coverage, threshold
from pathtide.plans.base import EDGES, LINEAR, STEPS, edges, islands_sql, linear, nodes, reads, runs_sql, steps
from pathtide.plans.graph_sql import LMAP, called_sql, graph_background_sql, holes_sql, paths_sql
from pathtide.plans.track_queries import CUTOFF
from pathtide.session import cut, free
from pathtide.sources.formats import read_tracks

#: Base pairs a read is extended by, the fragment length, the scales of the background, the q-value cutoff, the longest hole filled.
EXTENSION, FRAGMENT, SCALES, Q_CUTOFF, HOLE = 60, 200, [200, 1000, 10000], 0.05, 30
LEVEL = 1.301029995663981  # -log10(Q_CUTOFF)


def _ends(own: DataFrame) -> DataFrame:
    """Where forward reads end: read_id, node_id, offset."""
    return own.filter("i = n - 1 and node > 0").select("read_id", "node_id", F.col("hi").alias("offset"))


def _ends_reverse(own: DataFrame) -> DataFrame:
    """Where reverse reads end, counted from the node's far end."""
    return own.filter("i = n - 1 and node < 0").select("read_id", "node_id", (F.col("size") - F.col("lo")).alias("offset"))


def read_extension(spark: SparkSession, d: str) -> DataFrame:
    """Forward reads extended along all branches: how far into each node they reach."""
    return extend_reads(_ends(steps(spark, d)), nodes(spark, d), edges(spark, d), EXTENSION)


def read_extension_reverse(spark: SparkSession, d: str) -> DataFrame:
    """Reverse reads extended against the edges; reach is counted from the node's end."""
    return extend_reads(_ends_reverse(steps(spark, d)), nodes(spark, d), _turned(edges(spark, d)), EXTENSION)


def _turned(links: DataFrame) -> DataFrame:
    return links.select("chrom", F.col("dst").alias("src"), F.col("src").alias("dst"))


def _extended(own: DataFrame, graph: DataFrame, links: DataFrame) -> DataFrame:
    """Flat ranges (chrom, node_id, a, b) of the reads' steps and of their extensions."""
    ends = _ends(own).withColumn("way", F.lit(1)).unionByName(_ends_reverse(own).withColumn("way", F.lit(-1)))
    walked = extend_both_ways(ends, graph, links, EXTENSION)
    reached = walked.join(ends.withColumnRenamed("offset", "from_"), ["read_id", "way", "node_id"], "left")
    reached = reached.join(graph.select("node_id", "chrom", "node_index"), "node_id")
    lo, end = F.coalesce("from_", F.lit(0)), F.col("node_index") + F.col("size")
    a = F.when(F.col("way") > 0, F.col("node_index") + lo).otherwise(end - F.col("reach"))
    b = F.when(F.col("way") > 0, F.col("node_index") + F.col("reach")).otherwise(end - lo)
    both = own.select("chrom", "node_id", "a", "b").unionByName(reached.select("chrom", "node_id", a.alias("a"), b.alias("b")))
    out = cut(both.filter("a < b"))
    free(walked)
    return out


def sample_pileup(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of the reads and their extensions, both strands."""
    return coverage(_extended(*_base(spark, d)), ["chrom"], "a", "b")


def _base(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps, nodes and edges, each written once for the many stages that read them."""
    own = steps(spark, d).select("read_id", "i", "n", "node", "node_id", "chrom", "size", "lo", "hi", "a", "b")
    return cut(own), cut(nodes(spark, d).select("chrom", "node_id", "size", "node_index")), cut(edges(spark, d))


def graph_linear_map(spark: SparkSession, d: str) -> DataFrame:
    """Every node's stretch of the longest path's axis."""
    return linear_map(nodes(spark, d).select("chrom", "node_id", "size"), edges(spark, d))


def graph_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks between the nodes all paths go through."""
    return blocks(nodes(spark, d).select("chrom", "node_id", "size"), edges(spark, d)).groupBy("chrom", "block").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("size").alias("bp"), F.min("node_id").alias("first_node"))


def linear_positions(spark: SparkSession, d: str) -> DataFrame:
    """Every read's start on the longest path's axis."""
    at = steps(spark, d).filter("i = 0").select("read_id", "chrom", "node_id", F.when(F.col("node") > 0, F.col("lo")).otherwise(F.col("hi")).alias("offset"))
    got = at.join(graph_linear_map(spark, d).drop("chrom"), "node_id")
    return got.select("read_id", "chrom", (F.col("lin_start") + F.col("offset") * (F.col("lin_end") - F.col("lin_start")) / F.col("size")).alias("position"))


def _linear_stretches(spark: SparkSession, d: str) -> tuple[DataFrame, float]:
    """The linear peaks' stretches, written once, and the least background: their number * fragment / length of the linear paths."""
    own = cut(linear(spark, d).select("chrom", "a", "b"))
    return own, own.count() * FRAGMENT / _path_bp(spark, d)


def background_linear(spark: SparkSession, d: str) -> DataFrame:
    """Multi-scale background of the linear peaks' starts on the linear axis."""
    own, least = _linear_stretches(spark, d)
    got = background(own.select("chrom", F.col("a").alias("at")), FRAGMENT, SCALES, F.lit(least))
    return got.select("chrom", "start_pos", "end_pos", F.round("lam", 6).alias("lam"))


def _linear_p(spark: SparkSession, d: str) -> DataFrame:
    own, least = _linear_stretches(spark, d)
    # The sample against the wide scale of itself, as without a control.
    lam = background(own.select("chrom", F.col("a").alias("at")), FRAGMENT, SCALES[-1:], F.lit(least)).withColumn("lam", F.round("lam", 6))
    return cut(p_track(coverage(own, ["chrom"], "a", "b"), lam, F.lit(1.0), F.lit(1.0)))


def p_values(spark: SparkSession, d: str) -> DataFrame:
    """p-values of the linear coverage over its background."""
    return _linear_p(spark, d).select("chrom", "start_pos", "end_pos", "k", "lam", F.round("p", 6).alias("p"))


def p_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Base pairs of each p-value, shown to six places."""
    return _linear_p(spark, d).groupBy(F.round("p", 6).alias("p")).agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("bp"))


def _path_bp(spark: SparkSession, d: str) -> int:
    return nodes(spark, d).filter("path_offset is not null").agg(F.sum("size")).first()[0] or 1


def q_mapping(spark: SparkSession, d: str) -> DataFrame:
    """The q-value of every p-value, over all chromosomes."""
    return q_values(_linear_p(spark, d), _path_bp(spark, d)).withColumn("p", F.round("p", 6))


def _with_q(p: DataFrame, total_bp: int) -> DataFrame:
    """chrom, start_pos, end_pos, value: the q-value of each run; a p that very many runs share is joined in parts."""
    q = cut(q_values(p, total_bp).select("p", F.col("q").alias("value")))
    return attach(p.select("chrom", "start_pos", "end_pos", "p"), q, ["p"], ["chrom", "start_pos"]).drop("p")


def q_track(spark: SparkSession, d: str) -> DataFrame:
    """q-values along the linear axis; touching runs of one q are merged."""
    return coalesce_runs(_with_q(_linear_p(spark, d), _path_bp(spark, d)), ["chrom"]).withColumnRenamed("value", "q")


def resume_significant(spark: SparkSession, path: str, total_bp: int, chromosomes: list[str] | None = None) -> DataFrame:
    """Significant runs from the p-value tracks (chrom, start_pos, end_pos, p) an earlier run wrote, over all chromosomes or some."""
    return threshold(_with_q(read_tracks(spark, path, chromosomes), total_bp), ["chrom"], LEVEL)


def significant_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose q-value passes the cutoff."""
    return threshold(q_track(spark, d).withColumnRenamed("q", "value"), ["chrom"], LEVEL)


def _touched(ranges: DataFrame, graph: DataFrame) -> DataFrame:
    """Nodes that ranges lie on: chrom, node_id, node_index, node_end."""
    seen = ranges.select("node_id").distinct()
    return cut(graph.join(seen, "node_id", "left_semi").select("chrom", "node_id", "node_index", (F.col("node_index") + F.col("size")).alias("node_end")))


def _background_on_graph(own: DataFrame, graph: DataFrame, links: DataFrame, touched: DataFrame) -> tuple[DataFrame, float]:
    """Background of the reads' starts, on the flat axis of the touched nodes (chrom, start_pos, end_pos, lam), and its least value."""
    lmap = cut(linear_map(graph.select("chrom", "node_id", "size"), links))
    at = own.filter("i = 0").select("read_id", "node_id", F.when(F.col("node") > 0, F.col("lo")).otherwise(F.col("hi")).alias("offset"))
    pos = F.floor(F.col("lin_start") + F.col("offset") * (F.col("lin_end") - F.col("lin_start")) / F.col("size"))
    starts = cut(at.join(lmap, "node_id").select("chrom", pos.alias("at")))
    n, length = starts.count(), lmap.groupBy("chrom").agg(F.max("lin_end").alias("l")).agg(F.sum("l")).first()[0]
    least = n * FRAGMENT / length if length else 0.0
    lam = cut(background(starts, FRAGMENT, SCALES[-1:], F.lit(least)))
    hit = touched.drop("chrom").join(lmap, "node_id")
    both = overlap_join(hit, lam, ["chrom"], ("lin_start", "lin_end"), ("start_pos", "end_pos"))
    scale = (F.col("lin_end") - F.col("lin_start")) / F.col("size")
    a = F.col("node_index") + F.floor((F.greatest("lin_start", "start_pos") - F.col("lin_start")) / scale)
    b = F.when(F.col("end_pos") >= F.col("lin_end"), F.col("node_end")).otherwise(F.col("node_index") + F.floor((F.col("end_pos") - F.col("lin_start")) / scale))
    out = cut(both.select("chrom", a.alias("start_pos"), b.alias("end_pos"), "lam").filter("start_pos < end_pos"))
    free(lmap, starts, lam)
    return out, least


def background_to_graph(spark: SparkSession, d: str) -> DataFrame:
    """The reads' background, from the linear map back to the nodes."""
    own, graph, links = _base(spark, d)
    return _background_on_graph(own, graph, links, _touched(_extended(own, graph, links), graph))[0]


def called_peaks(spark: SparkSession, d: str) -> DataFrame:
    """The whole way from reads to peaks: pileup, background, p, q, regions, holes, paths, scores."""
    own, graph, links = _base(spark, d)
    ranges = _extended(own, graph, links)
    touched = _touched(ranges, graph)
    # All that follows the background lies on touched nodes.
    part = touched.select("chrom", "node_id", (F.col("node_end") - F.col("node_index")).cast("int").alias("size"), "node_index")
    lam, least = _background_on_graph(own, graph, links, touched)
    sample = cut(coverage(ranges, ["chrom"], "a", "b"))
    free(ranges)
    p = cut(p_track(sample, lam, F.lit(1.0), F.lit(1.0), F.lit(least)))
    free(sample, lam)
    q = cut(_with_q(p, graph.agg(F.sum("size")).first()[0] or 1))
    significant = cut(threshold(q, ["chrom"], LEVEL))
    free(p)
    filled = cut(fill_holes(significant, part, links, touched, HOLE))
    direct = cut(coverage(own, ["chrom"], "a", "b"))
    found = max_paths(filled, part, links, direct)
    peaks = cut(found.withColumn("id", F.xxhash64("region_paths", "start_off")))
    free(significant, filled, direct, found, own, links)
    scored = peak_scores(peaks, part, q).filter(F.col("bp") >= EXTENSION)
    return scored.select("chrom", "start_off", "end_off", "region_paths", F.lit(1).alias("direction"), F.col("score").alias("average_q_value"), F.col("is_ambiguous").cast("int").alias("is_ambigous"), F.col("is_diff").cast("int").alias("is_diff"), "bp")


def _active(spark: SparkSession, d: str) -> DataFrame:
    return threshold(coverage(steps(spark, d), ["chrom"], "a", "b"), ["chrom"], CUTOFF)


def segment_classes(spark: SparkSession, d: str) -> DataFrame:
    """Covered segments of nodes, by the node borders they touch."""
    return segments(_active(spark, d), nodes(spark, d)).select("chrom", "node_id", "a", "b", "kind")


def segment_totals(spark: SparkSession, d: str) -> DataFrame:
    """The reads' integral over each segment."""
    got = segment_scores(cut(segments(_active(spark, d), nodes(spark, d))), coverage(steps(spark, d), ["chrom"], "a", "b"))
    return got.select("node_id", "a", "b", "score")


def hole_cleaning_internal(spark: SparkSession, d: str) -> DataFrame:
    """Covered runs with short holes inside nodes filled."""
    return internal_fill(_active(spark, d), nodes(spark, d), HOLE)


def hole_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """Covered runs with short holes filled, also across nodes."""
    touched = steps(spark, d).select("chrom", "node_id").distinct()
    return fill_holes(cut(_active(spark, d)), nodes(spark, d), edges(spark, d), touched, HOLE)


def region_components(spark: SparkSession, d: str) -> DataFrame:
    """Connected components of the nodes that at least the cutoff of reads go through: node_id, component."""
    seen = steps(spark, d).groupBy("node_id").agg(F.countDistinct("read_id").alias("n")).filter(F.col("n") >= CUTOFF).select(F.col("node_id").alias("id"))
    seen = cut(seen)
    links = edges(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b")).join(seen.withColumnRenamed("id", "a"), "a").join(seen.withColumnRenamed("id", "b"), "b")
    return components(seen, links).withColumnRenamed("id", "node_id")


def region_paths(spark: SparkSession, d: str) -> DataFrame:
    """The best path through each covered region."""
    return max_paths(_active(spark, d), nodes(spark, d), edges(spark, d), coverage(steps(spark, d), ["chrom"], "a", "b"))


def peak_maxima(spark: SparkSession, d: str) -> DataFrame:
    """The highest coverage on every peak's own path, and its length."""
    # The steps are worked out once, for the coverage and for the paths it is looked up on.
    own = cut(steps(spark, d).select("read_id", "chrom", "a", "b"))
    cover = cut(coverage(own, ["chrom"], "a", "b"))
    over = overlap_join(own, cover, ["chrom"], ("a", "b"), ("start_pos", "end_pos"))
    top = over.groupBy("read_id").agg(F.max("value").alias("score"))
    size = own.groupBy("read_id").agg(F.sum(F.col("b") - F.col("a")).alias("bp"))
    return size.join(top, "read_id", "left").select("read_id", "bp", F.coalesce("score", F.lit(0)).alias("score"))


def linear_path_index(spark: SparkSession, d: str) -> DataFrame:
    """The linear path's nodes in order."""
    return path_positions(nodes(spark, d))


QUERIES = {f.__name__: f for f in (
    read_extension, read_extension_reverse, sample_pileup, graph_linear_map, graph_blocks, linear_positions, background_linear, p_values, p_histogram,
    q_mapping, q_track, significant_runs, background_to_graph, called_peaks, segment_classes, segment_totals, hole_cleaning_internal, hole_cleaning,
    region_components, region_paths, peak_maxima, linear_path_index,
)}

_R = "WITH RECURSIVE "
_FLOW = STEPS + ", " + EDGES + f""",
f0 AS (SELECT read_id, node_id, size, hi + {EXTENSION} AS rem FROM steps WHERE i = n - 1 AND node > 0),
f AS (SELECT * FROM f0 UNION SELECT f.read_id, e.dst, x.node_size, f.rem - f.size FROM f JOIN edge e ON e.src = f.node_id JOIN nodes x ON x.node_id = e.dst WHERE f.rem > f.size),
b0 AS (SELECT read_id, node_id, size, size - lo + {EXTENSION} AS rem FROM steps WHERE i = n - 1 AND node < 0),
b AS (SELECT * FROM b0 UNION SELECT b.read_id, e.src, x.node_size, b.rem - b.size FROM b JOIN edge e ON e.dst = b.node_id JOIN nodes x ON x.node_id = e.src WHERE b.rem > b.size),
fx AS (SELECT read_id, node_id, least(max(rem), any_value(size)) AS reach FROM f GROUP BY read_id, node_id),
bx AS (SELECT read_id, node_id, least(max(rem), any_value(size)) AS reach FROM b GROUP BY read_id, node_id)"""
_ACTIVE = "WITH " + STEPS + ", " + runs_sql("cover", "steps") + f", high AS (SELECT chrom, start_pos, end_pos, true AS value FROM cover WHERE value >= {CUTOFF}), " + islands_sql("act", "high")
_SEG = """, seg AS (SELECT n.chrom, n.node_id, node_index, node_size AS size, greatest(start_pos, node_index) AS a, least(end_pos, node_index + node_size) AS b
  FROM act JOIN nodes n ON n.chrom = act.chrom AND start_pos < node_index + node_size AND node_index < end_pos),
kinds AS (SELECT *, CASE WHEN a = node_index AND b = node_index + size THEN 'full' WHEN a = node_index THEN 'start' WHEN b = node_index + size THEN 'end' ELSE 'internal' END AS kind FROM seg)"""
_N = f"(SELECT count(*) FROM linear) * {FRAGMENT} / (SELECT sum(node_size) FROM nodes WHERE path_offset IS NOT NULL)"


def _lam_sql(name: str, scales: list[int]) -> str:
    halves = [s // 2 for s in scales]
    events = " UNION ALL ".join(f"SELECT chrom, a {s} {h} AS idx, {', '.join(('1' if s == '-' else '-1') if j == k else '0' for j in range(len(halves)))} FROM linear" for k, h in enumerate(halves) for s in "-+")
    cols = ", ".join(f"n{j}" for j in range(len(halves)))
    sums = ", ".join(f"sum(n{j}) AS n{j}" for j in range(len(halves)))
    acc = ", ".join(f"sum(n{j}) OVER w AS v{j}" for j in range(len(halves)))
    lam = ", ".join(f"v{j} / CAST({2 * h / FRAGMENT} AS DOUBLE)" for j, h in enumerate(halves))
    return f"""{name}_e(chrom, idx, {cols}) AS ({events}),
{name}_p AS (SELECT chrom, idx, {sums} FROM {name}_e GROUP BY chrom, idx HAVING {' OR '.join(f'sum(n{j}) <> 0' for j in range(len(halves)))}),
{name}_w AS (SELECT chrom, idx AS start_pos, lead(idx) OVER w AS end_pos, {acc} FROM {name}_p WINDOW w AS (PARTITION BY chrom ORDER BY idx)),
{name} AS (SELECT chrom, start_pos, end_pos, round(greatest({_N}, {lam}), 6) AS lam FROM {name}_w WHERE end_pos IS NOT NULL)"""


_P = "WITH " + LINEAR + ", " + runs_sql("cover", "linear") + ", " + _lam_sql("bg", SCALES[-1:]) + """,
ev AS (SELECT chrom, start_pos AS idx, value AS v, CAST(0 AS DECIMAL(28, 9)) AS l FROM cover UNION ALL SELECT chrom, end_pos, -value, 0 FROM cover
  UNION ALL SELECT chrom, start_pos, 0, CAST(lam AS DECIMAL(28, 9)) FROM bg UNION ALL SELECT chrom, end_pos, 0, -CAST(lam AS DECIMAL(28, 9)) FROM bg),
pt AS (SELECT chrom, idx, sum(v) AS v, sum(l) AS l FROM ev GROUP BY chrom, idx HAVING sum(v) <> 0 OR sum(l) <> 0),
rn AS (SELECT chrom, idx AS start_pos, lead(idx) OVER w AS end_pos, sum(v) OVER w AS k, sum(l) OVER w AS lam FROM pt WINDOW w AS (PARTITION BY chrom ORDER BY idx)),
pos AS (SELECT chrom, start_pos, end_pos, CAST(k AS DOUBLE) AS k, round(CAST(lam AS DOUBLE), 6) AS lam FROM rn WHERE end_pos IS NOT NULL AND k > 0),
pairs AS (SELECT DISTINCT k, lam, CAST(k AS BIGINT) AS ki FROM pos),
tail AS (SELECT k, lam, CASE WHEN k >= lam THEN -(list_max(list_transform(range(ki + 1, ki + 200), lambda i: -lam + i * ln(lam) - lgamma(i + 1)))
    + ln(list_sum(list_transform(range(ki + 1, ki + 200), lambda i: exp((-lam + i * ln(lam) - lgamma(i + 1)) - (-lam + (ki + 1) * ln(lam) - lgamma(ki + 2))))))) / ln(10)
  ELSE -log10(1 - list_sum(list_transform(range(0, ki + 1), lambda i: exp(-lam + i * ln(lam) - lgamma(i + 1))))) END AS raw FROM pairs),
pv AS (SELECT chrom, start_pos, end_pos, pos.k, pos.lam, least(1000.0, raw) AS p FROM pos JOIN tail ON pos.k = tail.k AND pos.lam = tail.lam)"""
_Q = _P + """, pr AS (SELECT chrom, start_pos, end_pos, p FROM pv),
per AS (SELECT p, CAST(sum(end_pos - start_pos) AS BIGINT) AS bp FROM pr GROUP BY p),
raw AS (SELECT p, bp, row_number() OVER (ORDER BY p DESC) AS place, p + log10(1 + coalesce(sum(bp) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  - log10((SELECT sum(node_size) FROM nodes WHERE path_offset IS NOT NULL)) AS q FROM per),
qm AS (SELECT p, bp, round(min(CASE WHEN place = 1 THEN greatest(q, 0) ELSE q END) OVER (ORDER BY p DESC), 6) AS q FROM raw),
qr AS (SELECT chrom, start_pos, end_pos, q FROM pr JOIN qm USING (p)), """ + islands_sql("qt", "qr", "chrom", "q")

_EXT = """ext AS (SELECT chrom, a, b FROM steps
  UNION ALL SELECT x.chrom, x.node_index + coalesce(s.hi, 0), x.node_index + reach FROM fx JOIN nodes x USING (node_id) LEFT JOIN steps s ON s.read_id = fx.read_id AND s.node_id = fx.node_id AND s.i = s.n - 1 AND s.node > 0
  UNION ALL SELECT x.chrom, x.node_index + node_size - reach, x.node_index + node_size - coalesce(s.size - s.lo, 0) FROM bx JOIN nodes x USING (node_id) LEFT JOIN steps s ON s.read_id = bx.read_id AND s.node_id = bx.node_id AND s.i = s.n - 1 AND s.node < 0)"""
_LAM_G = _R + _FLOW + ", " + _EXT + ", " + LMAP + ", " + graph_background_sql(FRAGMENT, SCALES[-1])
_ACT = _R + STEPS + ", " + EDGES + ", " + runs_sql("cover", "steps") + f", high AS (SELECT chrom, start_pos, end_pos, true AS value FROM cover WHERE value >= {CUTOFF}), " + islands_sql("act", "high")

SQL = {
    "graph_blocks": "WITH " + EDGES + """, o AS (SELECT src AS node_id, max(dst) AS far FROM edge GROUP BY src),
c AS (SELECT chrom, node_id, node_size, CASE WHEN coalesce(max(far) OVER (PARTITION BY chrom ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= node_id THEN 1 ELSE 0 END AS is_cut
  FROM nodes LEFT JOIN o USING (node_id)),
b AS (SELECT *, CAST(sum(is_cut) OVER (PARTITION BY chrom ORDER BY node_id) AS BIGINT) AS block FROM c)
SELECT chrom, block, count(*) AS n_nodes, CAST(sum(node_size) AS BIGINT) AS bp, min(node_id) AS first_node FROM b GROUP BY chrom, block""",
    "read_extension": _R + _FLOW + " SELECT * FROM fx",
    "read_extension_reverse": _R + _FLOW + " SELECT * FROM bx",
    "sample_pileup": _R + _FLOW + ", " + _EXT + ", " + runs_sql("pile", "ext") + " SELECT * FROM pile",
    "graph_linear_map": _R + EDGES + ", " + LMAP + " SELECT * FROM lmap",
    "linear_positions": _R + STEPS + ", " + EDGES + ", " + LMAP + """ SELECT read_id, s.chrom, lin_start + CASE WHEN node > 0 THEN lo ELSE hi END * CAST(lin_end - lin_start AS DOUBLE) / s.size AS position
FROM steps s JOIN lmap m ON m.node_id = s.node_id WHERE i = 0""",
    "background_to_graph": _LAM_G + " SELECT * FROM lam_g",
    "hole_cleaning": _ACT + ", " + holes_sql("filled", "act", "steps", HOLE) + " SELECT chrom, start_pos, end_pos FROM filled",
    "region_paths": _ACT + ", " + paths_sql("best", "act", "cover") + " SELECT * FROM best",
    "called_peaks": _LAM_G + ", " + runs_sql("pile", "ext") + ", " + runs_sql("cover", "steps") + ", " + called_sql(EXTENSION, LEVEL, HOLE) + " SELECT * FROM called",
    "background_linear": "WITH " + LINEAR + ", " + _lam_sql("bg", SCALES) + " SELECT * FROM bg",
    "p_values": _P + " SELECT * REPLACE (round(p, 6) AS p) FROM pv",
    "p_histogram": _P + " SELECT round(p, 6) AS p, CAST(sum(end_pos - start_pos) AS BIGINT) AS bp FROM pv GROUP BY 1",
    "q_mapping": _Q + " SELECT * REPLACE (round(p, 6) AS p) FROM qm",
    "q_track": _Q + " SELECT * FROM qt",
    "significant_runs": _Q + f", hi AS (SELECT chrom, start_pos, end_pos, true AS value FROM qt WHERE q >= {LEVEL}), " + islands_sql("sig", "hi") + " SELECT chrom, start_pos, end_pos FROM sig",
    "segment_classes": _ACTIVE + _SEG + " SELECT chrom, node_id, a, b, kind FROM kinds",
    "segment_totals": _ACTIVE + _SEG + """ SELECT node_id, a, b, CAST(sum(value * (least(b, end_pos) - greatest(a, start_pos))) AS BIGINT) AS score
FROM seg JOIN cover ON cover.chrom = seg.chrom AND start_pos < b AND a < end_pos GROUP BY ALL""",
    "hole_cleaning_internal": _ACTIVE + f""", gaps AS (SELECT chrom, end_pos AS x, lead(start_pos) OVER (PARTITION BY chrom ORDER BY start_pos) AS y FROM act
  UNION ALL SELECT chrom, 0, min(start_pos) FROM act GROUP BY chrom),
fill AS (SELECT g.chrom, greatest(x, node_index) AS x, least(y, node_index + node_size) AS y FROM gaps g JOIN nodes n ON n.chrom = g.chrom AND x < node_index + node_size AND node_index < y
  WHERE y IS NOT NULL AND x > node_index AND y < node_index + node_size AND y - x <= {HOLE}),
both_ AS (SELECT chrom, start_pos, end_pos, true AS value FROM act UNION ALL SELECT chrom, x, y, true FROM fill), """ + islands_sql("done", "both_") + " SELECT chrom, start_pos, end_pos FROM done",
    "region_components": _R + STEPS + ", " + EDGES + f""", seen AS (SELECT node_id FROM steps GROUP BY node_id HAVING count(DISTINCT read_id) >= {CUTOFF}),
link AS (SELECT src AS a, dst AS b FROM edge WHERE src IN (SELECT node_id FROM seen) AND dst IN (SELECT node_id FROM seen)),
two AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT node_id AS id, node_id AS hit FROM seen UNION SELECT reach.id, two.b FROM reach JOIN two ON two.a = reach.hit)
SELECT id AS node_id, min(hit) AS component FROM reach GROUP BY id""",
    "peak_maxima": "WITH " + STEPS + ", " + runs_sql("cover", "steps") + """, own AS (SELECT read_id, chrom, a, b FROM steps),
z AS (SELECT read_id, CAST(sum(b - a) AS BIGINT) AS bp FROM own GROUP BY read_id),
t AS (SELECT read_id, max(value) AS score FROM own JOIN cover ON cover.chrom = own.chrom AND start_pos < b AND a < end_pos WHERE a < b GROUP BY read_id)
SELECT read_id, bp, coalesce(score, 0) AS score FROM z LEFT JOIN t USING (read_id)""",
    "linear_path_index": """SELECT chrom, node_id, path_offset, row_number() OVER w - 1 AS place, lead(node_id) OVER w AS next_node FROM nodes
WHERE path_offset IS NOT NULL WINDOW w AS (PARTITION BY chrom ORDER BY path_offset)""",
}
