"""Queries on pairs of peaks, variants, regions and the sub-graphs of peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathtide.operators.joins import asof_join, overlap_join
from pathtide.operators.scan import ranked
from pathtide.operators.sequences import best_hits, interval_sequences, linear_sequences, matrix_hits
from pathtide.operators.tracks import coverage, threshold
from pathtide.operators.walks import border_values
from pathtide.plans.base import EDGES, LINEAR, READS, STEPS, edges, islands_sql, linear, nodes, reads, runs_sql, steps
from pathtide.plans.peak_queries import OVERLAP, WINDOW, _letters, _projected, _sets, motif_hits, motif_locations, shift_lags, summits
from pathtide.plans.peak_queries import SQL as PEAK_SQL
from pathtide.plans.signal_queries import peak_maxima
from pathtide.plans.signal_queries import SQL as SIGNAL_SQL
from pathtide.plans.track_queries import CUTOFF
from pathtide.session import cut

#: What positions are shifted by, the lags smoothed over on either side, rows of a bin of the range join that are joined in one part.
SHIFT, HALF_WINDOW, HOT_BIN = 1000, 25, 20_000
#: Weights of A, C, G and T at each position of a motif, and the least sum of a hit.
MATRIX = [[1.0, -1.5, -1.0, -0.5], [-2.0, 1.5, -1.0, 0.5], [-1.0, -0.5, 1.5, -2.0], [0.5, -1.0, -1.5, 1.0], [1.0, 0.5, -1.0, -1.0], [-1.0, -1.0, 1.0, 0.5]]
LEAST_SCORE = 4.0


def _axis(spark: SparkSession, d: str) -> DataFrame:
    """Length of every chromosome's linear path: chrom, bp."""
    return nodes(spark, d).filter("path_offset is not null").groupBy("chrom").agg(F.max(F.col("path_offset") + F.col("size")).alias("bp"))


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    """The graph's letters: node_id, chrom, path_offset, sequence. The tables hold none; each is given by the node's id and the place."""
    n = nodes(spark, d)
    return n.select("node_id", "chrom", "path_offset", _letters(F.col("node_id"), F.lit(0).cast("long"), F.col("size").cast("long")).alias("sequence"))


def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a graph peak and a linear peak of one factor that overlap by enough base pairs."""
    ours, theirs = _sets(spark, d)
    placed = ours.join(_projected(spark, d).select(F.col("read_id").alias("id"), "chrom", "a", "b"), "id").filter("factor is not null")
    a = placed.select("factor", "chrom", F.col("id").alias("read_id"), F.col("a").alias("ga"), F.col("b").alias("gb"))
    b = theirs.select("factor", "chrom", F.col("id").alias("lp_id"), F.col("a").alias("la"), F.col("b").alias("lb"))
    both = overlap_join(a, b, ["factor", "chrom"], ("ga", "gb"), ("la", "lb"), hot=HOT_BIN)
    return both.select("read_id", "lp_id", (F.least("gb", "lb") - F.greatest("ga", "la")).alias("bp")).filter(F.col("bp") >= OVERLAP)


def contained_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Peaks whose nodes are all on the linear path and in its order (or, reversed, against it)."""
    s = steps(spark, d).select("read_id", "i", "node", "path_offset")
    before = F.lag("path_offset").over(Window.partitionBy("read_id").orderBy("i"))
    s = s.withColumn("rises", (F.col("path_offset") > before) == (F.col("node") > 0))
    got = s.groupBy("read_id").agg(F.bool_and(F.col("path_offset").isNotNull()).alias("on_path"), F.bool_and(F.coalesce("rises", F.lit(True))).alias("in_order"), F.min(F.signum("node")).alias("lo"), F.max(F.signum("node")).alias("hi"))
    return got.filter("on_path and in_order and lo = hi").select("read_id")


def reversed_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Every peak read from its other end: offsets count from the far ends of the last and first node."""
    s = steps(spark, d).groupBy("read_id").agg(F.max(F.when(F.col("i") == 0, F.col("size"))).alias("first"), F.max(F.when(F.col("i") == F.col("n") - 1, F.col("size"))).alias("last"))
    got = reads(spark, d).join(s, "read_id").filter("first is not null and last is not null")
    return got.select("read_id", (F.col("last") - F.col("e")).alias("start_off"), (F.col("first") - F.col("s")).alias("end_off"), F.transform(F.reverse("rp"), lambda x: -x).alias("region_paths"))


def shifted_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Linear peaks counted from a region's start, clamped to the path; those before the region are left out."""
    got = linear(spark, d).join(_axis(spark, d), "chrom")
    a, b = F.greatest(F.col("a") - SHIFT, F.lit(0)), F.least(F.col("b"), F.col("bp")) - SHIFT
    return got.select("lp_id", "chrom", a.alias("start_pos"), b.alias("end_pos")).filter("start_pos < end_pos")


def super_summits(spark: SparkSession, d: str) -> DataFrame:
    """Windows around the summits that go on along the linear path beyond the peak, as nodes with offsets."""
    at = summits(spark, d).join(linear(spark, d).select("lp_id", "chrom"), "lp_id").join(_axis(spark, d), "chrom")
    at = at.select("lp_id", "chrom", F.greatest(F.col("summit") - WINDOW, F.lit(0)).alias("a"), F.least(F.col("summit") + WINDOW, F.col("bp")).alias("b"))
    path = nodes(spark, d).filter("path_offset is not null").select("chrom", "node_id", "path_offset", (F.col("path_offset") + F.col("size")).alias("path_end"))
    both = overlap_join(at, path, ["chrom"], ("a", "b"), ("path_offset", "path_end"))
    got = both.groupBy("lp_id", "a", "b").agg(F.array_sort(F.collect_list(F.struct("path_offset", "node_id"))).alias("p"))
    first, last = F.element_at("p", 1).path_offset, F.element_at("p", -1).path_offset
    return got.select("lp_id", F.greatest(F.col("a") - first, F.lit(0)).alias("start_off"), (F.col("b") - last).alias("end_off"), F.transform("p", lambda x: x.node_id).alias("region_paths"))


def linear_peak_sequences(spark: SparkSession, d: str) -> DataFrame:
    """The letters of every linear peak along the linear path."""
    return linear_sequences(linear(spark, d), _sequences(spark, d).filter("path_offset is not null"), "lp_id")


def matrix_best_hits(spark: SparkSession, d: str) -> DataFrame:
    """The best hit of a weight matrix in every peak's sequence, on either strand."""
    seqs = interval_sequences(steps(spark, d), _sequences(spark, d))
    return best_hits(matrix_hits(seqs, "read_id", MATRIX, LEAST_SCORE), "read_id")


def diff_binding(spark: SparkSession, d: str) -> DataFrame:
    """Peaks whose best motif hit lies on several nodes that reads also pass by: the best other way between the hit's first and last node.

    Nodes score the base pairs reads cover on them. The way leaves out the hit's own nodes and takes
    covered nodes only; of ways of equal score the smaller one by its nodes. Ids rise along edges, so
    a walk is over when it reaches or passes the last node.
    """
    s = cut(steps(spark, d).select("read_id", "i", "node_id", "lo", "hi"))
    hits = matrix_best_hits(spark, d).select("read_id", "start", "stop")
    upto = F.sum(F.col("hi") - F.col("lo")).over(Window.partitionBy("read_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    on = s.withColumn("upto", upto).join(hits, "read_id").filter((F.col("start") <= F.col("upto")) & (F.col("upto") - (F.col("hi") - F.col("lo")) < F.col("stop")))
    motif = on.groupBy("read_id").agg(F.array_sort(F.collect_set("node_id")).alias("own")).filter(F.size("own") > 1)
    scores = cut(s.groupBy("node_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("bp")).filter("bp > 0"))
    main = motif.select("read_id", F.explode(F.slice("own", 2, F.size("own") - 2)).alias("node_id")).join(scores, "node_id").groupBy("read_id").agg(F.sum("bp").alias("main_bp"))
    motif = cut(motif.join(main, "read_id", "left").select("read_id", "own", F.element_at("own", -1).alias("last"), F.coalesce("main_bp", F.lit(0)).alias("main_bp")))
    e = cut(edges(spark, d).select("src", "dst"))
    covered = scores.select(F.col("node_id").alias("dst"), "bp")
    front = motif.select("read_id", F.element_at("own", 1).alias("at"), F.lit(0).cast("long").alias("bp"), F.array().cast("array<bigint>").alias("way"))
    found = []
    while True:
        on = front.join(e.withColumnRenamed("src", "at"), "at").join(motif.select("read_id", "own", "last"), "read_id")
        found.append(cut(on.filter((F.col("dst") == F.col("last")) & (F.size("way") > 0)).select("read_id", "bp", "way")))
        on = on.filter((F.col("dst") < F.col("last")) & ~F.array_contains("own", F.col("dst"))).withColumnRenamed("bp", "sum").join(covered, "dst")
        best = F.min(F.struct((-(F.col("sum") + F.col("bp"))).alias("k"), F.concat("way", F.array("dst")).alias("way"))).alias("b")
        front = cut(on.groupBy("read_id", F.col("dst").alias("at")).agg(best).select("read_id", "at", (-F.col("b.k")).alias("bp"), F.col("b.way").alias("way")))
        if front.isEmpty():
            break
    ways = found[0]
    for f in found[1:]:
        ways = ways.unionByName(f)
    got = ways.groupBy("read_id").agg(F.min(F.struct((-F.col("bp")).alias("k"), "way")).alias("b")).join(motif, "read_id")
    return got.select("read_id", F.col("own").alias("motif_nodes"), F.col("b.way").alias("other_way"), "main_bp", (-F.col("b.k")).alias("other_bp"))


def peaks_by_start(spark: SparkSession, d: str) -> DataFrame:
    """Every peak's place along its chromosome's linear path, by start and id."""
    own = _projected(spark, d).select("chrom", "read_id", "a", (-F.col("a")).alias("back"))
    return ranked(own, ["chrom"], "back", "read_id", float(1 << 16)).select("chrom", "read_id", "a", "place")


def motif_by_node(spark: SparkSession, d: str) -> DataFrame:
    """How many peaks' first motif hit begins on each node, by strand."""
    return motif_locations(spark, d).groupBy("node_id", "strand").agg(F.count(F.lit(1)).alias("n"))


def linear_with_motif(spark: SparkSession, d: str) -> DataFrame:
    """Linear peaks that overlap a graph peak of their factor with the motif, and the lowest such graph peak."""
    hits = motif_hits(spark, d).select("read_id")
    return overlap_pairs(spark, d).join(hits, "read_id", "left_semi").groupBy("lp_id").agg(F.min("read_id").alias("read_id"), F.count(F.lit(1)).alias("n"))


def topological_check(spark: SparkSession, d: str) -> DataFrame:
    """Edges per chromosome, and those that don't lead to a higher node: the graph operators need none of these."""
    e = edges(spark, d)
    return e.groupBy("chrom").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("src") >= F.col("dst")).alias("n_falling"))


def starts_in_regions(spark: SparkSession, d: str) -> DataFrame:
    """How many reads begin in each covered region, by strand."""
    s = steps(spark, d)
    regions = threshold(coverage(s, ["chrom"], "a", "b"), ["chrom"], CUTOFF)
    starts = s.filter("i = 0 and lo < hi").select("chrom", (F.col("node") > 0).alias("forward"), F.when(F.col("node") > 0, F.col("a")).otherwise(F.col("b") - 1).alias("at"))
    got = asof_join(starts, regions, ["chrom"], "at", "start_pos", ["start_pos", "end_pos"]).filter("at < end_pos")
    return got.groupBy("chrom", "start_pos", "end_pos").agg(F.count_if("forward").alias("n_forward"), F.count_if(~F.col("forward")).alias("n_reverse"))


def peak_table(spark: SparkSession, d: str) -> DataFrame:
    """Peaks with their score, highest coverage and the size of their own sub-graph: nodes, and edges between them."""
    own = steps(spark, d).select("read_id", "node_id").distinct()
    out = own.join(edges(spark, d).select(F.col("src").alias("node_id"), "dst"), "node_id")
    inside = out.join(own.select("read_id", F.col("node_id").alias("dst")), ["read_id", "dst"]).groupBy("read_id").agg(F.count(F.lit(1)).alias("n_edges"))
    sizes = own.groupBy("read_id").agg(F.count(F.lit(1)).alias("n_nodes")).join(inside, "read_id", "left").na.fill(0, ["n_edges"])
    scores = reads(spark, d).filter(F.col("q").isNotNull() & ~F.isnan("q")).select("read_id", "q")
    return scores.join(peak_maxima(spark, d).withColumnRenamed("score", "most"), "read_id").join(sizes, "read_id")


def variant_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Variants as a table of places on the linear path: SNPs and insertions are off-path nodes, deletions edges that pass over path nodes.

    A SNP's node has a path node beside it of the same size and with the same way in. pos is where
    the path node before it ends.
    """
    n, e = nodes(spark, d), edges(spark, d)
    on = n.filter("path_offset is not null").select(F.col("node_id").alias("src"), (F.col("path_offset") + F.col("size")).alias("pos"))
    ways = e.join(on, "src").join(n.select(F.col("node_id").alias("dst"), "size", "path_offset"), "dst")
    off = ways.filter("path_offset is null")
    beside = ways.filter("path_offset is not null").select("src", F.col("dst").alias("ref_node"), "size").groupBy("src", "size").agg(F.min("ref_node").alias("ref_node"))
    points = off.join(beside, ["src", "size"], "left").select("chrom", "pos", F.col("dst").alias("node_id"), F.col("size").cast("long").alias("bp"), "ref_node", F.when(F.col("ref_node").isNull(), "ins").otherwise("snp").alias("kind"))
    gaps = ways.filter("path_offset > pos").select("chrom", "pos", F.lit(None).cast("long").alias("node_id"), (F.col("path_offset") - F.col("pos")).alias("bp"), F.col("dst").alias("ref_node"), F.lit("del").alias("kind"))
    return points.unionByName(gaps)


def insertion_check(spark: SparkSession, d: str) -> DataFrame:
    """Off-path nodes between path nodes that are covered: whether twice their mean exceeds the mean of the values before and behind them."""
    s = steps(spark, d)
    n = nodes(spark, d)
    cover = cut(coverage(s, ["chrom"], "a", "b"))
    edge_values = cut(border_values(n, cover))
    inner = n.filter("path_offset is null").select("chrom", "node_id", "size", "node_index", (F.col("node_index") + F.col("size")).alias("node_end"))
    both = overlap_join(inner, cover, ["chrom"], ("node_index", "node_end"), ("start_pos", "end_pos"))
    mean = both.groupBy("node_id", "size").agg((F.sum(F.col("value") * (F.least("node_end", "end_pos") - F.greatest("node_index", "start_pos"))) / F.first("size")).alias("mean"))
    e = edges(spark, d)
    before = e.join(edge_values.select(F.col("node_id").alias("src"), "last_value"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.max("last_value").alias("before"))
    behind = e.join(edge_values.select(F.col("node_id").alias("dst"), "first_value"), "dst").groupBy(F.col("src").alias("node_id")).agg(F.max("first_value").alias("behind"))
    got = mean.join(before, "node_id").join(behind, "node_id")
    return got.select("node_id", F.round("mean", 6).alias("mean"), "before", "behind", (F.col("mean") * 2 > (F.col("before") + F.col("behind")) / 2).alias("valid"))


def extended_ends(spark: SparkSession, d: str) -> DataFrame:
    """Peaks that begin or end off the linear path, carried on to the next path node: the last position before, the first behind."""
    s = steps(spark, d)
    e = edges(spark, d)
    on = n_path = nodes(spark, d).filter("path_offset is not null").select("node_id", "size")
    into = e.join(on.select(F.col("node_id").alias("src"), "size"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.min(F.struct("src", "size")).alias("p"))
    out = e.join(n_path.select(F.col("node_id").alias("dst")), "dst").groupBy(F.col("src").alias("node_id")).agg(F.max("dst").alias("next_node"))
    forward = s.filter("node > 0")
    first = forward.filter("i = 0").join(into, "node_id", "left")
    off = F.col("path_offset").isNull() & F.col("p").isNotNull()
    first = first.select("read_id", F.when(off, F.col("p.src")).otherwise(F.col("node_id")).alias("first_node"), F.when(off, F.col("p.size") - 1).otherwise(F.col("lo")).cast("long").alias("start_off"))
    last = forward.filter("i = n - 1").join(out, "node_id", "left")
    off = F.col("path_offset").isNull() & F.col("next_node").isNotNull()
    last = last.select("read_id", F.when(off, F.col("next_node")).otherwise(F.col("node_id")).alias("last_node"), F.when(off, F.lit(1)).otherwise(F.col("hi")).cast("long").alias("end_off"))
    return first.join(last, "read_id")


def lag_summits(spark: SparkSession, d: str) -> DataFrame:
    """Local maxima of the lag profile after a Savitzky-Golay filter of order 2: where its first derivative falls through 0.

    The derivative at a place is the slope of the parabola fitted to its window, sum(k * y) / sum(k²).
    Beyond the ends the profile is mirrored at its first and last value.
    """
    lags = spark.range(301).withColumnRenamed("id", "lag").join(shift_lags(spark, d), "lag", "left").select("lag", F.coalesce("n_pairs", F.lit(0)).alias("y"))
    ends = lags.agg(F.max(F.when(F.col("lag") == 0, F.col("y"))).alias("y0"), F.max(F.when(F.col("lag") == 300, F.col("y"))).alias("y1"))
    # One row, beside 301.
    both = lags.crossJoin(ends)
    low = both.filter(f"lag between 1 and {HALF_WINDOW}").select((-F.col("lag")).alias("lag"), (F.col("y0") - F.abs(F.col("y") - F.col("y0"))).alias("y"))
    high = both.filter(f"lag between {300 - HALF_WINDOW} and 299").select((600 - F.col("lag")).alias("lag"), (F.col("y1") + F.abs(F.col("y") - F.col("y1"))).alias("y"))
    w = Window.orderBy("lag").rowsBetween(-HALF_WINDOW, HALF_WINDOW)
    slope = (F.sum(F.col("lag") * F.col("y")).over(w) - F.col("lag") * F.sum("y").over(w)) / (HALF_WINDOW * (HALF_WINDOW + 1) * (2 * HALF_WINDOW + 1) / 3)
    got = lags.unionByName(low).unionByName(high).withColumn("slope", slope).filter("lag between 0 and 300")
    falls = F.signum(F.lead("slope").over(Window.orderBy("lag"))) - F.signum("slope") <= -1
    return got.select("lag", F.col("y").alias("n_pairs"), F.round("slope", 9).alias("slope"), F.coalesce(falls, F.lit(False)).alias("is_summit"))


QUERIES = {f.__name__: f for f in (
    overlap_pairs, contained_peaks, reversed_intervals, shifted_peaks, super_summits, linear_peak_sequences, matrix_best_hits, diff_binding, peaks_by_start, motif_by_node, linear_with_motif, topological_check, starts_in_regions,
    peak_table, variant_nodes, insertion_check, extended_ends, lag_summits,
)}

_S, _L = "WITH " + STEPS, "WITH " + LINEAR
_PRJ = """, prj AS (SELECT read_id, sample_id, chrom, min(path_offset + lo) AS a, max(path_offset + hi) AS b FROM steps WHERE path_offset IS NOT NULL AND lo < hi GROUP BY ALL)"""
_AXIS = "axis AS (SELECT chrom, max(path_offset + node_size) AS bp FROM nodes WHERE path_offset IS NOT NULL GROUP BY chrom)"
_SIG = "array_to_string(list_sort(string_split(regexp_replace(lower({}), '[^a-z0-9]', '', 'g'), '')), '')"
_FACTORS = f""", known AS (SELECT DISTINCT upper(factor) AS factor FROM samples WHERE factor IS NOT NULL),
alike AS (SELECT {_SIG.format('factor')} AS letters, min(factor) AS alike FROM known GROUP BY 1 HAVING count(*) = 1),
rl AS (SELECT run_id, any_value(regexp_extract(replace(upper(run_label), '-', ''), '[A-Z]{{2,}}[0-9]+', 0)) AS named FROM linear_runs GROUP BY run_id),
rf AS (SELECT run_id, coalesce(k.factor, alike, named) AS factor FROM (SELECT *, {_SIG.format('named')} AS letters FROM rl) r LEFT JOIN known k ON k.factor = r.named LEFT JOIN alike USING (letters)),
sf AS (SELECT sample_id, any_value(upper(factor)) AS factor FROM samples GROUP BY sample_id)"""
_LETTERS = "array_to_string(list_transform(range({lo}, {hi}), lambda x: substr('ACGT', CAST(1 + (node_id * 7 + x * x) % 4 AS INT), 1)), '')"
_W = HALF_WINDOW


def _matrix_sql() -> str:
    """Best hits of MATRIX by arithmetic on every window of both strands."""
    width = len(MATRIX)

    def weight(row: list[float], turned: bool) -> str:
        letters = "TGCA" if turned else "ACGT"
        return " ".join(f"WHEN '{c}' THEN {v}" for c, v in zip(letters, row, strict=True))

    plus = " + ".join(f"CASE substr(sequence, k + {j}, 1) {weight(MATRIX[j], False)} END" for j in range(width))
    minus = " + ".join(f"CASE substr(sequence, k + {width - 1 - j}, 1) {weight(MATRIX[j], True)} END" for j in range(width))
    seqs = PEAK_SQL["interval_sequence"].rsplit(" SELECT read_id, sequence FROM seqs", 1)[0]
    return f"""{seqs}, places AS (SELECT read_id, sequence, unnest(range(1, length(sequence) - {width} + 2)) AS k FROM seqs),
scored AS (SELECT read_id, CAST(k AS INT) AS start, CAST(k + {width - 1} AS INT) AS stop, '+' AS strand, CAST({plus} AS DOUBLE) AS score FROM places
  UNION ALL SELECT read_id, CAST(k AS INT), CAST(k + {width - 1} AS INT), '-', CAST({minus} AS DOUBLE) FROM places)
SELECT * FROM scored WHERE score >= {LEAST_SCORE} QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY score DESC, start, strand) = 1"""


SQL = {
    "overlap_pairs": _S + _PRJ + ", " + LINEAR + _FACTORS + f""" SELECT read_id, lp_id, CAST(least(p.b, l.b) - greatest(p.a, l.a) AS BIGINT) AS bp
FROM prj p JOIN sf USING (sample_id) JOIN rf ON rf.factor = sf.factor JOIN linear l ON l.run_id = rf.run_id AND l.chrom = p.chrom AND l.a < p.b AND p.a < l.b WHERE least(p.b, l.b) - greatest(p.a, l.a) >= {OVERLAP}""",
    "contained_peaks": _S + """, w AS (SELECT read_id, node, path_offset, path_offset > lag(path_offset) OVER (PARTITION BY read_id ORDER BY i) AS up FROM steps)
SELECT read_id FROM w GROUP BY read_id HAVING bool_and(path_offset IS NOT NULL) AND bool_and(coalesce(up = (node > 0), true)) AND min(sign(node)) = max(sign(node))""",
    "reversed_intervals": _S + """, z AS (SELECT read_id, max(size) FILTER (WHERE i = 0) AS first, max(size) FILTER (WHERE i = n - 1) AS last FROM steps GROUP BY read_id)
SELECT read_id, last - e AS start_off, first - s AS end_off, list_transform(list_reverse(rp), lambda x: -x) AS region_paths FROM reads JOIN z USING (read_id) WHERE first IS NOT NULL AND last IS NOT NULL""",
    "shifted_peaks": _L + ", " + _AXIS + f""" SELECT lp_id, chrom, greatest(a - {SHIFT}, 0) AS start_pos, least(b, bp) - {SHIFT} AS end_pos FROM linear JOIN axis USING (chrom)
WHERE greatest(a - {SHIFT}, 0) < least(b, bp) - {SHIFT}""",
    "super_summits": PEAK_SQL["summits"].rsplit("SELECT lp_id, summit, greatest", 1)[0].rstrip() + ", " + _AXIS + f""",
win AS (SELECT lp_id, chrom, greatest(summit - {WINDOW}, 0) AS wa, least(summit + {WINDOW}, bp) AS wb FROM hit JOIN (SELECT lp_id, chrom FROM linear) USING (lp_id) JOIN axis USING (chrom))
SELECT lp_id, greatest(any_value(wa) - min(path_offset), 0) AS start_off, any_value(wb) - max(path_offset) AS end_off, list(node_id ORDER BY path_offset) AS region_paths
FROM win JOIN nodes n ON n.chrom = win.chrom AND path_offset IS NOT NULL AND wa < path_offset + node_size AND path_offset < wb AND wa < wb GROUP BY lp_id""",
    "linear_peak_sequences": _L + f""" SELECT lp_id, string_agg({_LETTERS.format(lo='greatest(a, path_offset) - path_offset', hi='least(b, path_offset + node_size) - path_offset')}, '' ORDER BY path_offset) AS sequence
FROM linear l JOIN nodes n ON n.chrom = l.chrom AND path_offset IS NOT NULL AND a < path_offset + node_size AND path_offset < b GROUP BY lp_id""",
    "matrix_best_hits": _matrix_sql(),
    "diff_binding": _matrix_sql().replace("WITH ", "WITH RECURSIVE ", 1).replace("\nSELECT * FROM scored", ", edge AS (SELECT DISTINCT chrom, src, dst FROM edges),\nbest_ AS (SELECT * FROM scored", 1) + """),
acc AS (SELECT read_id, node_id, hi - lo AS bp, sum(hi - lo) OVER (PARTITION BY read_id ORDER BY i) AS upto FROM steps),
motif AS (SELECT read_id, list_sort(list_distinct(list(node_id))) AS own FROM acc JOIN best_ USING (read_id) WHERE start <= upto AND upto - bp < stop GROUP BY read_id HAVING len(list_distinct(list(node_id))) > 1),
scores AS (SELECT node_id, CAST(sum(hi - lo) AS BIGINT) AS bp FROM steps GROUP BY node_id HAVING sum(hi - lo) > 0),
main AS (SELECT read_id, CAST(sum(bp) AS BIGINT) AS main_bp FROM (SELECT read_id, unnest(own[2:len(own) - 1]) AS node_id FROM motif) JOIN scores USING (node_id) GROUP BY read_id),
w AS (SELECT read_id, own, own[1] AS spot, CAST(0 AS BIGINT) AS bp, CAST([] AS BIGINT[]) AS way FROM motif
  UNION ALL SELECT read_id, own, dst, w.bp + s.bp, list_append(way, dst) FROM w JOIN edge ON src = spot JOIN scores s ON s.node_id = dst WHERE dst < own[len(own)] AND NOT list_contains(own, dst)),
fin AS (SELECT read_id, own, bp, way FROM w JOIN edge ON src = spot AND dst = own[len(own)] WHERE len(way) > 0)
SELECT read_id, own AS motif_nodes, way AS other_way, coalesce(main_bp, 0) AS main_bp, bp AS other_bp FROM fin LEFT JOIN main USING (read_id)
QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY bp DESC, way) = 1""",
    "topological_check": "WITH " + EDGES + " SELECT chrom, count(*) AS n_edges, count(*) FILTER (WHERE src >= dst) AS n_falling FROM edge GROUP BY chrom",
    "starts_in_regions": _S + ", " + runs_sql("cover", "steps") + f""", high AS (SELECT chrom, start_pos, end_pos, true AS value FROM cover WHERE value >= {CUTOFF}), {islands_sql("act", "high")},
st AS (SELECT chrom, node > 0 AS forward, CASE WHEN node > 0 THEN a ELSE b - 1 END AS spot FROM steps WHERE i = 0 AND lo < hi)
SELECT act.chrom, start_pos, end_pos, count(*) FILTER (WHERE forward) AS n_forward, count(*) FILTER (WHERE NOT forward) AS n_reverse FROM st JOIN act ON act.chrom = st.chrom AND spot >= start_pos AND spot < end_pos GROUP BY ALL""",
    "variant_nodes": "WITH " + EDGES + """, ways AS (SELECT e.chrom, src, dst, p.path_offset + p.node_size AS pos, x.node_size AS size, x.path_offset FROM edge e JOIN nodes p ON p.node_id = src AND p.path_offset IS NOT NULL JOIN nodes x ON x.node_id = dst),
beside AS (SELECT src, size, min(dst) AS ref_node FROM ways WHERE path_offset IS NOT NULL GROUP BY ALL)
SELECT chrom, pos, dst AS node_id, CAST(size AS BIGINT) AS bp, ref_node, CASE WHEN ref_node IS NULL THEN 'ins' ELSE 'snp' END AS kind FROM ways LEFT JOIN beside USING (src, size) WHERE path_offset IS NULL
UNION ALL SELECT chrom, pos, NULL, path_offset - pos, dst, 'del' FROM ways WHERE path_offset > pos""",
    "insertion_check": _S + ", " + EDGES + ", " + runs_sql("cover", "steps") + """, m AS (SELECT node_id, sum(value * (least(node_index + node_size, end_pos) - greatest(node_index, start_pos))) / any_value(node_size) AS mean
  FROM nodes n JOIN cover c ON c.chrom = n.chrom AND start_pos < node_index + node_size AND node_index < end_pos WHERE path_offset IS NULL GROUP BY node_id),
v AS (SELECT node_id, coalesce((SELECT value FROM cover c WHERE c.chrom = n.chrom AND start_pos <= node_index AND node_index < end_pos), 0) AS f,
  coalesce((SELECT value FROM cover c WHERE c.chrom = n.chrom AND start_pos <= node_index + node_size - 1 AND node_index + node_size - 1 < end_pos), 0) AS l FROM nodes n),
b AS (SELECT dst AS node_id, max(l) AS before FROM edge JOIN v ON v.node_id = src GROUP BY dst), h AS (SELECT src AS node_id, max(f) AS behind FROM edge JOIN v ON v.node_id = dst GROUP BY src)
SELECT node_id, round(mean, 6) AS mean, before, behind, mean * 2 > (before + behind) / 2 AS valid FROM m JOIN b USING (node_id) JOIN h USING (node_id)""",
    "extended_ends": _S + ", " + EDGES + """, i_ AS (SELECT dst AS node_id, min(src) AS src FROM edge JOIN nodes p ON p.node_id = src WHERE p.path_offset IS NOT NULL GROUP BY dst),
o_ AS (SELECT src AS node_id, max(dst) AS nxt FROM edge JOIN nodes p ON p.node_id = dst WHERE p.path_offset IS NOT NULL GROUP BY src),
f AS (SELECT read_id, CASE WHEN s.path_offset IS NULL AND src IS NOT NULL THEN src ELSE s.node_id END AS first_node, CAST(CASE WHEN s.path_offset IS NULL AND src IS NOT NULL THEN p.node_size - 1 ELSE lo END AS BIGINT) AS start_off
  FROM steps s LEFT JOIN i_ USING (node_id) LEFT JOIN nodes p ON p.node_id = src WHERE i = 0 AND node > 0),
l AS (SELECT read_id, CASE WHEN path_offset IS NULL AND nxt IS NOT NULL THEN nxt ELSE node_id END AS last_node, CAST(CASE WHEN path_offset IS NULL AND nxt IS NOT NULL THEN 1 ELSE hi END AS BIGINT) AS end_off
  FROM steps LEFT JOIN o_ USING (node_id) WHERE i = n - 1 AND node > 0)
SELECT * FROM f JOIN l USING (read_id)""",
    "lag_summits": PEAK_SQL["shift_lags"].replace("\nSELECT r.position", ", raw AS (SELECT r.position", 1) + f"""),
y AS (SELECT range AS lag, coalesce(n_pairs, 0) AS y FROM range(301) LEFT JOIN raw ON raw.lag = range),
e AS (SELECT max(y) FILTER (WHERE lag = 0) AS y0, max(y) FILTER (WHERE lag = 300) AS y1 FROM y),
padded AS (SELECT lag, y FROM y UNION ALL SELECT -lag, y0 - abs(y - y0) FROM y, e WHERE lag BETWEEN 1 AND {_W} UNION ALL SELECT 600 - lag, y1 + abs(y - y1) FROM y, e WHERE lag BETWEEN {300 - _W} AND 299),
d AS (SELECT lag, y, CAST(sum(lag * y) OVER w - lag * sum(y) OVER w AS DOUBLE) / {_W * (_W + 1) * (2 * _W + 1) / 3} AS slope FROM padded WINDOW w AS (ORDER BY lag ROWS BETWEEN {_W} PRECEDING AND {_W} FOLLOWING)),
i AS (SELECT * FROM d WHERE lag BETWEEN 0 AND 300)
SELECT lag, y AS n_pairs, round(slope, 9) AS slope, coalesce(sign(lead(slope) OVER (ORDER BY lag)) - sign(slope) <= -1, false) AS is_summit FROM i""",
}
SQL["peak_table"] = "WITH " + STEPS + ", " + EDGES + ", pm AS (" + SIGNAL_SQL["peak_maxima"] + """),
own AS (SELECT DISTINCT read_id, node_id FROM steps),
ed AS (SELECT o.read_id, count(*) AS n_edges FROM own o JOIN edge ON src = o.node_id JOIN own t ON t.read_id = o.read_id AND t.node_id = dst GROUP BY o.read_id),
z AS (SELECT read_id, count(*) AS n_nodes FROM own GROUP BY read_id)
SELECT read_id, q, bp, score AS most, n_nodes, coalesce(n_edges, 0) AS n_edges FROM (SELECT read_id, q FROM reads WHERE q IS NOT NULL AND NOT isnan(q)) JOIN pm USING (read_id) JOIN z USING (read_id) LEFT JOIN ed USING (read_id)"""
SQL["peaks_by_start"] = _S + _PRJ + " SELECT chrom, read_id, a, row_number() OVER (PARTITION BY chrom ORDER BY a, read_id) AS place FROM prj"
SQL["motif_by_node"] = "SELECT node_id, strand, count(*) AS n FROM (" + PEAK_SQL["motif_locations"] + ") GROUP BY ALL"
SQL["linear_with_motif"] = "SELECT lp_id, min(read_id) AS read_id, count(*) AS n FROM (" + SQL["overlap_pairs"] + ") WHERE read_id IN (SELECT read_id FROM (" + PEAK_SQL["motif_hits"] + ")) GROUP BY lp_id"
