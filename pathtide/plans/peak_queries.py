"""Queries on sets of peaks: overlaps, projections, sequences, motifs, comparisons, variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathtide.operators.joins import asof_join, attach, overlap_join
from pathtide.operators.matching import greedy_matches, similar_intervals
from pathtide.operators.periods import merge_periods
from pathtide.operators.scan import ranked
from pathtide.operators.tracks import coverage
from pathtide.plans.base import EDGES, LINEAR, READS, STEPS, edges, linear, nodes, reads, runs_sql, signature, steps
from pathtide.session import cut, table

#: Mismatching base pairs of similar peaks, base pairs of an overlap, half width of a summit window, consensus of the motif, best peaks of a report,
#: base pairs between starts of one call, width of a place.
MISMATCH, OVERLAP, WINDOW, MOTIF, BEST, NEAR, PLACE = 15, 50, 30, "GTAC", 100, 5, 100


def _good(spark: SparkSession, d: str) -> DataFrame:
    """Reads with a usable q."""
    return reads(spark, d).filter(F.col("q").isNotNull() & ~F.isnan("q"))


def _projected(spark: SparkSession, d: str) -> DataFrame:
    """read_id, sample_id, chrom, a, b: from the first to the last path position of the read's on-path steps."""
    on = steps(spark, d).filter("path_offset is not null and lo < hi")
    a, b = F.col("path_offset") + F.col("lo"), F.col("path_offset") + F.col("hi")
    return on.groupBy("read_id", "sample_id", "chrom").agg(F.min(a).alias("a"), F.max(b).alias("b"), F.min("node").alias("least"))


def peaks_to_linear(spark: SparkSession, d: str) -> DataFrame:
    """Peaks on the linear path: the stretch between their first and last position on it."""
    return _projected(spark, d).select("read_id", "chrom", "a", "b")


def project_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Peaks as stranded linear intervals; wholly reverse paths are on the minus strand."""
    return _projected(spark, d).select("read_id", "chrom", "a", "b", F.when(F.col("least") < 0, "-").otherwise("+").alias("strand"))


def linear_to_graph(spark: SparkSession, d: str) -> DataFrame:
    """Linear peaks as paths of the linear path's nodes: start offset, end offset, nodes."""
    path = nodes(spark, d).filter("path_offset is not null").select("chrom", "node_id", "path_offset", (F.col("path_offset") + F.col("size")).alias("path_end"))
    both = overlap_join(linear(spark, d).select("lp_id", "chrom", "a", "b"), path, ["chrom"], ("a", "b"), ("path_offset", "path_end"))
    got = both.groupBy("lp_id", "a", "b").agg(F.array_sort(F.collect_list(F.struct("path_offset", "node_id"))).alias("p"))
    return got.select("lp_id", F.greatest(F.col("a") - F.element_at("p", 1).path_offset, F.lit(0)).alias("start_off"), (F.col("b") - F.element_at("p", -1).path_offset).alias("end_off"), F.transform("p", lambda x: x.node_id).alias("region_paths"))


def on_linear_path(spark: SparkSession, d: str) -> DataFrame:
    """Whether all of a peak's nodes are on the linear path."""
    return steps(spark, d).groupBy("read_id").agg(F.count_if(F.col("path_offset").isNull()).alias("off_nodes"), F.sum(F.when(F.col("path_offset").isNull(), F.col("hi") - F.col("lo")).otherwise(0)).alias("off_bp"))


def linear_filter(spark: SparkSession, d: str) -> DataFrame:
    """Starts of reads that begin on the linear path, by strand."""
    got = steps(spark, d).filter("i = 0 and path_offset is not null")
    return got.select("read_id", "chrom", F.when(F.col("node") > 0, F.col("path_offset") + F.col("lo")).otherwise(F.col("path_offset") + F.col("hi")).alias("position"), F.when(F.col("node") > 0, "+").otherwise("-").alias("strand"))


def variant_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that are not steps of the linear path."""
    path = nodes(spark, d).filter("path_offset is not null").select("chrom", "node_id", "path_offset", (F.col("path_offset") + F.col("size")).alias("next_offset"))
    steps_ = path.select(F.col("chrom"), F.col("node_id").alias("src"), F.col("next_offset").alias("at")).join(path.select("chrom", F.col("node_id").alias("dst"), F.col("path_offset").alias("at")), ["chrom", "at"]).select("src", "dst")
    return edges(spark, d).join(steps_, ["src", "dst"], "left_anti").select("chrom", "src", "dst")


def split_by_node_range(spark: SparkSession, d: str) -> DataFrame:
    """Reads by the chromosome whose range of node ids holds their first node; others are unmapped."""
    ranges = nodes(spark, d).groupBy("chrom").agg(F.min("node_id").alias("lo"), F.max("node_id").alias("hi")).withColumn("axis", F.lit(0))
    first = reads(spark, d).select("read_id", F.abs(F.element_at("rp", 1)).alias("node_id"), F.lit(0).alias("axis"))
    # Ranges of different chromosomes are apart: the last one that begins at or before the node is the only one that may hold it.
    got = asof_join(first, ranges, ["axis"], "node_id", "lo", ["chrom", "hi"])
    return got.select("read_id", F.coalesce(F.when(F.col("node_id") <= F.col("hi"), F.col("chrom")), F.lit("unmapped")).alias("chrom"))


def peak_overlap_nodes(spark: SparkSession, d: str) -> DataFrame:
    """For every peak, the most samples and the most peaks that share one of its nodes."""
    s = steps(spark, d).select("read_id", "sample_id", "node_id").distinct()
    per = s.groupBy("node_id").agg(F.countDistinct("sample_id").alias("n_samples"), F.count(F.lit(1)).alias("n_reads"))
    return s.join(per, "node_id").groupBy("read_id", "sample_id").agg(F.max("n_samples").alias("most_samples"), F.max("n_reads").alias("most_reads"))


def interval_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Linear peaks that graph peaks overlap by enough base pairs: the base pairs, and how many graph peaks lie there at most."""
    cover = coverage(_projected(spark, d), ["chrom"], "a", "b")
    both = overlap_join(linear(spark, d).select("lp_id", "chrom", "a", "b"), cover, ["chrom"], ("a", "b"), ("start_pos", "end_pos"))
    got = both.groupBy("lp_id").agg(F.sum(F.least("b", "end_pos") - F.greatest("a", "start_pos")).alias("shared_bp"), F.max("value").alias("most_peaks"))
    return got.filter(F.col("shared_bp") >= OVERLAP)


def identical_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Peaks of which another sample has the very same interval."""
    same = reads(spark, d).groupBy("rp", "s", "e").agg(F.countDistinct("sample_id").alias("n_samples"), F.min("read_id").alias("first_id")).filter("n_samples > 1")
    return reads(spark, d).join(same, ["rp", "s", "e"]).select("read_id", "first_id", "n_samples")


def similar_peaks(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of intervals on the same path whose starts and ends lie within a few base pairs; first_id is the lesser one by (s, e, read_id)."""
    return similar_intervals(reads(spark, d).select("read_id", "s", "e", "rp"), MISMATCH)


def _run_factors(spark: SparkSession, d: str) -> DataFrame:
    """run_id and the factor its label names: a sample's one, also with swapped letters if only one has them; else the label's word."""
    known = table(spark, d, "samples").select(F.upper("factor").alias("factor")).filter("factor is not null").distinct()
    alike = known.groupBy(signature(F.col("factor")).alias("letters")).agg(F.min("factor").alias("alike"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    named = F.regexp_extract(F.regexp_replace(F.upper("run_label"), "-", ""), "[A-Z]{2,}[0-9]+", 0)
    runs = table(spark, d, "linear_runs").select("run_id", named.alias("named")).dropDuplicates(["run_id"]).withColumn("letters", signature(F.col("named")))
    got = runs.join(known.select(F.col("factor").alias("named"), F.col("factor").alias("same")), "named", "left").join(alike, "letters", "left")
    return got.select("run_id", F.coalesce("same", "alike", "named").alias("factor"))


def _sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All peaks of the two callers with their factor: id, factor, score (the least there is where unknown); linear ones with chrom, a, b."""
    factors = table(spark, d, "samples").select("sample_id", F.upper("factor").alias("factor")).dropDuplicates(["sample_id"])
    last = F.lit(float("-inf"))
    ours = reads(spark, d).join(factors, "sample_id", "left").select(F.col("read_id").alias("id"), "factor", F.coalesce(F.when(~F.isnan("q"), F.col("q")), last).alias("score"))
    theirs = linear(spark, d).join(_run_factors(spark, d), "run_id", "left")
    return ours, theirs.select(F.col("lp_id").alias("id"), "factor", "chrom", "a", "b", F.coalesce("score", last).alias("score"))


def _matches(spark: SparkSession, d: str, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One-to-one matching of the sets, by the graph peaks' stretches of the linear axis."""
    placed = ours.join(_projected(spark, d).select(F.col("read_id").alias("id"), "chrom", "a", "b"), "id")
    return greedy_matches(placed, theirs, ["factor", "chrom"])


def peak_set_matching(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one matching of the two callers' peaks of a factor, best scores first and unknown ones last."""
    return _matches(spark, d, *_sets(spark, d))


def peak_compare_report(spark: SparkSession, d: str) -> DataFrame:
    """Totals, shared and unique peaks of both callers per factor, of all peaks."""
    ours, theirs = _sets(spark, d)
    m = _matches(spark, d, ours, theirs).select(F.col("id_a").alias("id"), F.lit(1).alias("hit"))
    own = ours.join(m, "id", "left").select("factor", F.lit(1).alias("g"), F.lit(0).alias("l"), F.coalesce("hit", F.lit(0)).alias("hit"))
    both = own.unionByName(theirs.select("factor", F.lit(0).alias("g"), F.lit(1).alias("l"), F.lit(0).alias("hit")))
    got = both.groupBy("factor").agg(F.sum("g").alias("total_graph"), F.sum("l").alias("total_linear"), F.sum("hit").alias("shared"))
    return got.select("factor", "total_graph", "total_linear", "shared", (F.col("total_graph") - F.col("shared")).alias("unique_graph"), (F.col("total_linear") - F.col("shared")).alias("unique_linear"))


def peak_composition(spark: SparkSession, d: str) -> DataFrame:
    """Mean length, nodes per base pair and share of base pairs off the linear path, per sample."""
    s = steps(spark, d).withColumn("bp", F.col("hi") - F.col("lo"))
    got = s.groupBy("sample_id").agg(F.countDistinct("read_id").alias("n_peaks"), F.sum("bp").alias("bp"), F.count(F.lit(1)).alias("n_nodes"), F.sum(F.when(F.col("path_offset").isNull(), F.col("bp")).otherwise(0)).alias("off_bp"))
    return got.select("sample_id", "n_peaks", "bp", F.round(F.col("bp") / F.col("n_peaks"), 6).alias("mean_bp"), F.round(F.col("n_nodes") / F.col("bp"), 6).alias("nodes_per_bp"), F.round(F.col("off_bp") / F.col("bp"), 6).alias("off_share"))


def summits(spark: SparkSession, d: str) -> DataFrame:
    """Windows around the summit of every linear peak: the middle of its positions with the most coverage."""
    cover = coverage(linear(spark, d), ["chrom"], "a", "b")
    both = overlap_join(linear(spark, d).select("lp_id", "chrom", "a", "b"), cover, ["chrom"], ("a", "b"), ("start_pos", "end_pos"))
    part = both.select("lp_id", "a", "b", "value", F.greatest("a", "start_pos").alias("x"), F.least("b", "end_pos").alias("y"))
    tops = part.groupBy("lp_id", "a", "b").agg(F.max("value").alias("top")).withColumnsRenamed({"a": "pa", "b": "pb"})
    best = part.join(tops, "lp_id").filter(F.col("value") == F.col("top")).withColumn("len", F.col("y") - F.col("x"))
    w = Window.partitionBy("lp_id").orderBy("x")
    best = best.withColumn("upto", F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("len").over(Window.partitionBy("lp_id")))
    middle = F.expr("all div 2")
    at = best.filter((middle >= F.col("upto") - F.col("len")) & (middle < F.col("upto"))).withColumn("summit", F.col("x") + middle - (F.col("upto") - F.col("len")))
    return at.select("lp_id", "summit", F.greatest(F.col("summit") - WINDOW, F.col("pa")).alias("start_pos"), F.least(F.col("summit") + WINDOW, F.col("pb")).alias("end_pos"))


def linear_summits(spark: SparkSession, d: str) -> DataFrame:
    """Linear peaks cut to a window around their middle."""
    m = F.expr("(a + b) div 2")
    return linear(spark, d).select("lp_id", F.greatest(m - WINDOW, F.col("a")).alias("start_pos"), F.least(m + WINDOW, F.col("b")).alias("end_pos"))


def _letters(node: Column, lo: Column, hi: Column) -> Column:
    """A node's letters from lo to hi: its id and the place decide each one."""
    return F.when(hi > lo, F.array_join(F.transform(F.sequence(lo, hi - 1), lambda i: F.substr(F.lit("ACGT"), (1 + (node * 7 + i * i) % 4).cast("int"), F.lit(1))), "")).otherwise("")


def interval_sequence(spark: SparkSession, d: str) -> DataFrame:
    """The letters along every peak's path; reverse steps are complemented backwards."""
    s = steps(spark, d).select("read_id", "i", "node", _letters(F.col("node_id"), F.col("lo").cast("long"), F.col("hi").cast("long")).alias("t"))
    t = F.when(F.col("node") < 0, F.reverse(F.translate("t", "ACGT", "TGCA"))).otherwise(F.col("t"))
    got = s.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("i", t.alias("t")))).alias("p"))
    return got.select("read_id", F.array_join(F.transform("p", lambda x: x.t), "").alias("sequence"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Motif hits: read_id, start (from 1), n hits."""
    got = interval_sequence(spark, d)
    return got.select("read_id", F.instr("sequence", MOTIF).alias("start"), ((F.length("sequence") - F.length(F.replace("sequence", F.lit(MOTIF), F.lit("")))) / len(MOTIF)).cast("long").alias("n_hits")).filter("start > 0")


def motif_hits(spark: SparkSession, d: str) -> DataFrame:
    """First place and number of the consensus motif in every peak's sequence that has it."""
    return _hits(spark, d)


def motif_semi(spark: SparkSession, d: str) -> DataFrame:
    """Peaks with the motif."""
    return reads(spark, d).join(_hits(spark, d), "read_id", "left_semi").select("read_id")


def motif_anti(spark: SparkSession, d: str) -> DataFrame:
    """Peaks without the motif."""
    return reads(spark, d).join(_hits(spark, d), "read_id", "left_anti").select("read_id")


def motif_contingency(spark: SparkSession, d: str) -> DataFrame:
    """Peaks by ambiguity, two bindings and motif."""
    own = table(spark, d, "graph_peaks").filter(F.size("region_paths") > 0).select(F.col("peak_id").alias("read_id"), "is_ambigous", "is_diff").dropDuplicates(["read_id"])
    got = own.join(_hits(spark, d), "read_id", "left")
    return got.groupBy("is_ambigous", "is_diff").agg(F.count("n_hits").alias("with_motif"), F.count_if(F.col("n_hits").isNull()).alias("without_motif"))


def motif_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Share of peaks with the motif among the best 1, 2, ... peaks of each sample, by falling q."""
    got = _good(spark, d).join(_hits(spark, d), "read_id", "left").select("sample_id", "read_id", "q", F.col("n_hits").isNotNull().cast("int").alias("hit"))
    got = ranked(got, ["sample_id"], "q", "read_id", 1.0, {"hits": F.col("hit")})
    return got.select("sample_id", "read_id", "place", F.round(F.col("hits") / F.col("place"), 9).alias("share"))


def motif_locations(spark: SparkSession, d: str) -> DataFrame:
    """The node and offset where each peak's first motif hit begins; on strand - the offset counts from the node's far end."""
    begin = F.when(F.col("node") > 0, F.col("lo")).otherwise(F.col("size") - F.col("hi"))
    s = steps(spark, d).select("read_id", "i", "node_id", begin.alias("begin"), (F.col("hi") - F.col("lo")).alias("bp"), F.when(F.col("node") > 0, "+").otherwise("-").alias("strand"))
    w = Window.partitionBy("read_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("upto", F.sum("bp").over(w)).join(_hits(spark, d), "read_id")
    at = F.col("start") - 1 - (F.col("upto") - F.col("bp"))
    return s.filter((at >= 0) & (F.col("start") - 1 < F.col("upto"))).select("read_id", "node_id", (F.col("begin") + at).cast("long").alias("offset"), "strand")


def best_motif(spark: SparkSession, d: str) -> DataFrame:
    """The peak with the highest q among those with most motif hits, per sample."""
    got = _good(spark, d).join(_hits(spark, d), "read_id")
    best = got.groupBy("sample_id").agg(F.max(F.struct("n_hits", "q", (-F.col("read_id")).alias("r"))).alias("b"))
    return best.select("sample_id", F.col("b.n_hits").alias("n_hits"), F.col("b.q").alias("q"), (-F.col("b.r")).alias("read_id"))


def top_peaks(spark: SparkSession, d: str) -> DataFrame:
    """The best peaks of all samples, by q: a report of fixed length."""
    return _good(spark, d).orderBy(F.desc("q"), "read_id").limit(BEST).select("read_id", "sample_id", "q")


def concat_peaks(spark: SparkSession, d: str) -> DataFrame:
    """All peaks of all chromosomes, numbered by falling q within their sample: peak0, peak1, ..."""
    got = ranked(_good(spark, d).select("sample_id", "read_id", "q"), ["sample_id"], "q", "read_id", 1.0)
    return got.select("sample_id", "read_id", "q", F.concat(F.lit("peak"), (F.col("place") - 1).cast("string")).alias("name"))


def within_regions(peaks: DataFrame, regions: DataFrame) -> DataFrame:
    """``peaks`` (chrom, a, b) that lie wholly within one of the disjoint ``regions`` (chrom, region_start, region_end)."""
    got = asof_join(peaks, regions, ["chrom"], "a", "region_start", ["region_end"])
    return got.filter("b <= region_end").drop("region_end")


def region_filter(spark: SparkSession, d: str) -> DataFrame:
    """Linear peaks wholly within a region: of each chromosome, the first half of its path."""
    half = F.expr("max(path_offset + size) div 2").alias("region_end")
    regions = nodes(spark, d).filter("path_offset is not null").groupBy("chrom").agg(half).withColumn("region_start", F.lit(0).cast("long"))
    return within_regions(linear(spark, d).select("lp_id", "chrom", "a", "b"), regions)


def identical_calls(spark: SparkSession, d: str) -> DataFrame:
    """Linear peaks whose very interval other runs call too: on how many runs, and the first of them."""
    li = linear(spark, d)
    same = li.groupBy("chrom", "a", "b").agg(F.countDistinct("run_id").alias("n_runs"), F.min("lp_id").alias("first_id")).filter("n_runs > 1")
    return attach(li.select("lp_id", "chrom", "a", "b"), same, ["chrom", "a", "b"], ["lp_id"]).select("lp_id", "first_id", "n_runs")


def first_of_place(spark: SparkSession, d: str) -> DataFrame:
    """Linear peaks without later ones of the run at the same start: the lowest id stays."""
    return linear(spark, d).groupBy("run_id", "chrom", "a").agg(F.min("lp_id").alias("lp_id"), F.count(F.lit(1)).alias("n"))


def alignment_compare(spark: SparkSession, d: str) -> DataFrame:
    """Starts of linear and graph calls, per chromosome: in both within 5 base pairs, apart within a place's width, or in one only.

    Every start is held against all of the other side. n counts the graph's starts (of linear_only
    the linear ones); graph_calls and linear_calls count the calls at all starts of the kind.
    """
    g = _projected(spark, d).groupBy("chrom", F.col("a").alias("ga")).agg(F.count(F.lit(1)).alias("calls"))
    li = linear(spark, d).groupBy("chrom", F.col("a").alias("la")).agg(F.count(F.lit(1)).alias("calls"))
    g, li = cut(g), cut(li)
    # Starts are distinct, so that a start meets no more than two places' width of others.
    lo, hi = (F.col("ga") - PLACE + 1).alias("lo"), (F.col("ga") + PLACE).alias("hi")
    both = overlap_join(g.select("chrom", "ga", lo, hi), li.select("chrom", "la", (F.col("la") + 1).alias("le")), ["chrom"], ("lo", "hi"), ("la", "le"), width=4 * PLACE)
    both = cut(both.select("chrom", "ga", "la", F.abs(F.col("ga") - F.col("la")).alias("off")))

    def side(own: DataFrame, at: str, only: str) -> DataFrame:
        got = own.join(both.groupBy("chrom", at).agg(F.min("off").alias("off")), ["chrom", at], "left")
        kind = F.when(F.col("off").isNull(), only).when(F.col("off") <= NEAR, "same").otherwise("apart")
        return got.select("chrom", kind.alias("kind"), F.lit(at).alias("side"), "calls")

    own, graph = side(g, "ga", "graph_only").unionByName(side(li, "la", "linear_only")), F.col("side") == "ga"
    calls = lambda which: F.sum(F.when(which, F.col("calls")).otherwise(0))
    return own.groupBy("chrom", "kind").agg(F.count_if(graph | (F.col("kind") == "linear_only")).alias("n"), calls(graph).alias("graph_calls"), calls(~graph).alias("linear_calls"))


def alignment_sets(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that forward reads touch and reverse reads don't, the other way round, and common ones."""
    s = steps(spark, d)
    f, r = s.filter("node > 0").select("node_id").distinct(), s.filter("node < 0").select("node_id").distinct()
    tag = lambda df, k: df.select("node_id", F.lit(k).alias("kind"))
    return tag(f.intersect(r), "both").unionByName(tag(f.exceptAll(r), "forward")).unionByName(tag(r.exceptAll(f), "reverse"))


def reads_on_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Linear calls on every graph peak's stretch: their number and mean score."""
    p = _projected(spark, d).select("read_id", "chrom", F.col("a").alias("pa"), F.col("b").alias("pb"))
    lp = linear(spark, d).select("lp_id", "chrom", "a", "b", F.col("score").cast("decimal(18,6)").alias("score"))
    both = overlap_join(p, lp, ["chrom"], ("pa", "pb"), ("a", "b"))
    return both.groupBy("read_id").agg(F.count(F.lit(1)).alias("n_calls"), F.round(F.avg("score").cast("double"), 6).alias("mean_score"))


def variants_in_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Off-path nodes on every peak: how many variants it goes through, and their base pairs."""
    return steps(spark, d).filter("path_offset is null").groupBy("read_id", "chrom").agg(F.countDistinct("node_id").alias("n_variants"), F.sum("size").alias("bp"))


def variant_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Runs of off-path nodes with touching flat positions."""
    off = nodes(spark, d).filter("path_offset is null").select("chrom", "node_index", (F.col("node_index") + F.col("size")).alias("node_end"))
    got = merge_periods(off, ["chrom"], "node_index", "node_end").filter("kind = 'period'")
    return got.select("chrom", "start_pos", "end_pos", F.col("n_members").alias("n_variants"))


def haplotype_step(spark: SparkSession, d: str) -> DataFrame:
    """The successor most reads take from each node; the smaller node on ties."""
    n = steps(spark, d).groupBy("node_id").agg(F.countDistinct("read_id").alias("n"))
    e = edges(spark, d).join(n.withColumnRenamed("node_id", "dst"), "dst", "left").na.fill(0, ["n"])
    best = e.groupBy("src").agg(F.max(F.struct("n", (-F.col("dst")).alias("d"))).alias("b"))
    return best.select("src", (-F.col("b.d")).alias("dst"), F.col("b.n").alias("n_reads"))


def genotype_match(spark: SparkSession, d: str) -> DataFrame:
    """How many of a chromosome's common variants (called in two samples or more) each sample has, and whether it has all."""
    s = steps(spark, d).filter("path_offset is null").select("sample_id", "chrom", "node_id").distinct()
    want = s.groupBy("chrom", "node_id").agg(F.count(F.lit(1)).alias("n"))
    common = want.filter("n >= 2").select("chrom", "node_id")
    per = s.join(common, ["chrom", "node_id"]).groupBy("sample_id", "chrom").agg(F.count(F.lit(1)).alias("has"))
    total = common.groupBy("chrom").agg(F.count(F.lit(1)).alias("all_"))
    return per.join(total, "chrom").select("sample_id", "chrom", "has", (F.col("has") == F.col("all_")).alias("complete"))


def haplotype_summary(spark: SparkSession, d: str) -> DataFrame:
    """The commonest path between equal ends, the commonest one among the calls that don't take it, and how often these and all paths are called."""
    r = reads(spark, d).select(F.element_at("rp", 1).alias("first"), F.element_at("rp", -1).alias("last"), F.array_join("rp", ",").alias("path"))
    per = cut(r.groupBy("first", "last", "path").agg(F.count(F.lit(1)).alias("n")))
    commonest = F.min(F.struct((-F.col("n")).alias("k"), "path")).alias("c")
    best = per.groupBy("first", "last").agg(F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("n_paths"), commonest)
    best = best.filter("n_all > 1").select("first", "last", "n_all", "n_paths", (-F.col("c.k")).alias("n_best"), F.col("c.path").alias("path"))
    rest = per.join(best.select("first", "last", "path"), ["first", "last", "path"], "left_anti").groupBy("first", "last").agg(commonest)
    rest = rest.select("first", "last", (-F.col("c.k")).alias("n_second"), F.col("c.path").alias("second_path"))
    return best.join(rest, ["first", "last"], "left").withColumn("n_second", F.coalesce("n_second", F.lit(0)))


def forbes(spark: SparkSession, d: str) -> DataFrame:
    """Observed over expected co-occurrence of graph and linear calls on 100 base pair bins, per chromosome."""
    g = _projected(spark, d).select("chrom", F.floor(F.col("a") / 100).alias("bin")).distinct().withColumn("g", F.lit(1))
    li = linear(spark, d).select("chrom", F.floor(F.col("a") / 100).alias("bin")).distinct().withColumn("l", F.lit(1))
    bins = nodes(spark, d).filter("path_offset is not null").groupBy("chrom").agg(F.ceil(F.max(F.col("path_offset") + F.col("size")) / 100).alias("n_bins"))
    both = g.join(li, ["chrom", "bin"], "full").groupBy("chrom").agg(F.count("g").alias("n_g"), F.count("l").alias("n_l"), F.count_if(F.col("g").isNotNull() & F.col("l").isNotNull()).alias("n_both"))
    return both.join(bins, "chrom").filter("n_g > 0 and n_l > 0").select("chrom", F.round(F.col("n_both") / (F.col("n_g") * F.col("n_l") / F.col("n_bins")), 6).alias("forbes"))


def diplo_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of the off-path share of peaks in 100 bins, with its running total."""
    share = steps(spark, d).groupBy("read_id").agg(F.sum(F.when(F.col("path_offset").isNull(), F.col("hi") - F.col("lo")).otherwise(0)).alias("off"), F.sum(F.col("hi") - F.col("lo")).alias("bp")).filter("bp > 0")
    per = share.groupBy(F.expr("least(99, off * 100 div bp)").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # At most 100 rows.
    return per.withColumn("upto", F.sum("n").over(Window.orderBy("bin")))


def report_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Peaks and mean length in nodes per factor and sample, per factor, and of all."""
    own = reads(spark, d).join(table(spark, d, "samples").select("sample_id", "factor"), "sample_id")
    got = own.rollup("factor", "sample_id").agg(F.count(F.lit(1)).alias("n_peaks"), F.round(F.avg(F.size("rp")), 6).alias("mean_nodes"))
    return got


def shift_lags(spark: SparkSession, d: str) -> DataFrame:
    """Cross-correlation of forward and reverse starts on the linear path: pairs at each lag up to 300."""
    p = linear_filter(spark, d)
    f = p.filter("strand = '+'").select("chrom", F.col("position").alias("fp"), (F.col("position") + 301).alias("fe"))
    r = p.filter("strand = '-'").groupBy("chrom", F.col("position").alias("rp")).agg(F.count(F.lit(1)).alias("n")).withColumn("re", F.col("rp") + 1)
    both = overlap_join(f, r, ["chrom"], ("fp", "fe"), ("rp", "re"))
    return both.groupBy((F.col("rp") - F.col("fp")).alias("lag")).agg(F.sum("n").alias("n_pairs"))


QUERIES = {f.__name__: f for f in (
    peaks_to_linear, project_alignments, linear_to_graph, on_linear_path, linear_filter, variant_edges, split_by_node_range, peak_overlap_nodes, interval_intersection,
    identical_peaks, similar_peaks, peak_set_matching, peak_compare_report, peak_composition, summits, linear_summits, interval_sequence, motif_hits, motif_semi, motif_anti,
    motif_contingency, motif_enrichment, motif_locations, best_motif, top_peaks, concat_peaks, region_filter, identical_calls, first_of_place, alignment_compare, alignment_sets, reads_on_peaks,
    variants_in_intervals, variant_clusters, haplotype_step, genotype_match, haplotype_summary, forbes, diplo_histogram, report_rollup, shift_lags,
)}

_S, _RD, _L = "WITH " + STEPS, "WITH " + READS, "WITH " + LINEAR
_PRJ = """, prj AS (SELECT read_id, sample_id, chrom, min(path_offset + lo) AS a, max(path_offset + hi) AS b, min(node) AS least FROM steps WHERE path_offset IS NOT NULL AND lo < hi GROUP BY ALL)"""
_SEQ = """, seqs AS (SELECT read_id, string_agg(t, '' ORDER BY i) AS sequence FROM (SELECT read_id, i, CASE WHEN node < 0 THEN reverse(translate(t, 'ACGT', 'TGCA')) ELSE t END AS t
  FROM (SELECT read_id, i, node, coalesce(array_to_string(list_transform(range(lo, hi), lambda x: substr('ACGT', CAST(1 + (node_id * 7 + x * x) % 4 AS INT), 1)), ''), '') AS t FROM steps)) GROUP BY read_id),
hits AS (SELECT read_id, instr(sequence, '""" + MOTIF + """') AS start, CAST((length(sequence) - length(replace(sequence, '""" + MOTIF + "', ''))) // " + str(len(MOTIF)) + " AS BIGINT) AS n_hits FROM seqs WHERE instr(sequence, '" + MOTIF + "') > 0)"
_GOOD = ", good AS (SELECT * FROM reads WHERE q IS NOT NULL AND NOT isnan(q))"
_PATH = "path AS (SELECT chrom, node_id, path_offset, node_size AS size FROM nodes WHERE path_offset IS NOT NULL)"

SQL = {
    "peaks_to_linear": _S + _PRJ + " SELECT read_id, chrom, a, b FROM prj",
    "project_alignments": _S + _PRJ + " SELECT read_id, chrom, a, b, CASE WHEN least < 0 THEN '-' ELSE '+' END AS strand FROM prj",
    "linear_to_graph": _L + ", " + _PATH + """ SELECT lp_id, greatest(any_value(a) - min(path_offset), 0) AS start_off, any_value(b) - max(path_offset) AS end_off, list(node_id ORDER BY path_offset) AS region_paths
FROM linear l JOIN path p ON p.chrom = l.chrom AND a < path_offset + size AND path_offset < b GROUP BY lp_id""",
    "on_linear_path": _S + " SELECT read_id, count(*) FILTER (WHERE path_offset IS NULL) AS off_nodes, CAST(sum(CASE WHEN path_offset IS NULL THEN hi - lo ELSE 0 END) AS BIGINT) AS off_bp FROM steps GROUP BY read_id",
    "linear_filter": _S + " SELECT read_id, chrom, path_offset + CASE WHEN node > 0 THEN lo ELSE hi END AS position, CASE WHEN node > 0 THEN '+' ELSE '-' END AS strand FROM steps WHERE i = 0 AND path_offset IS NOT NULL",
    "variant_edges": "WITH " + EDGES + ", " + _PATH + " SELECT chrom, src, dst FROM edge e WHERE NOT EXISTS (SELECT 1 FROM path a JOIN path b ON a.chrom = b.chrom AND a.path_offset + a.size = b.path_offset WHERE a.node_id = e.src AND b.node_id = e.dst)",
    "split_by_node_range": _RD + ", r AS (SELECT chrom, min(node_id) AS lo, max(node_id) AS hi FROM nodes GROUP BY chrom) SELECT read_id, coalesce(chrom, 'unmapped') AS chrom FROM reads LEFT JOIN r ON abs(rp[1]) BETWEEN lo AND hi",
    "peak_overlap_nodes": _S + """, s AS (SELECT DISTINCT read_id, sample_id, node_id FROM steps), per AS (SELECT node_id, count(DISTINCT sample_id) AS n_samples, count(*) AS n_reads FROM s GROUP BY node_id)
SELECT read_id, sample_id, max(n_samples) AS most_samples, max(n_reads) AS most_reads FROM s JOIN per USING (node_id) GROUP BY ALL""",
    "interval_intersection": _S + _PRJ + ", " + LINEAR + ", " + runs_sql("cover", "prj") + f""" SELECT lp_id, CAST(sum(least(b, end_pos) - greatest(a, start_pos)) AS BIGINT) AS shared_bp, max(value) AS most_peaks
FROM linear l JOIN cover c ON c.chrom = l.chrom AND start_pos < b AND a < end_pos GROUP BY lp_id HAVING sum(least(b, end_pos) - greatest(a, start_pos)) >= {OVERLAP}""",
    "identical_peaks": _RD + ", same AS (SELECT rp, s, e, count(DISTINCT sample_id) AS n_samples, min(read_id) AS first_id FROM reads GROUP BY rp, s, e HAVING count(DISTINCT sample_id) > 1) SELECT read_id, first_id, n_samples FROM reads JOIN same USING (rp, s, e)",
    "similar_peaks": _RD + f""" SELECT b.read_id, a.read_id AS first_id FROM reads a JOIN reads b ON a.rp = b.rp AND (a.s, a.e, a.read_id) < (b.s, b.e, b.read_id)
AND abs(a.s - b.s) <= {MISMATCH} AND abs(a.e - b.e) <= {MISMATCH}""",
    "peak_composition": _S + """ SELECT sample_id, count(DISTINCT read_id) AS n_peaks, CAST(sum(hi - lo) AS BIGINT) AS bp, round(sum(hi - lo) / count(DISTINCT read_id), 6) AS mean_bp, round(count(*) / sum(hi - lo), 6) AS nodes_per_bp,
round(sum(CASE WHEN path_offset IS NULL THEN hi - lo ELSE 0 END) / sum(hi - lo), 6) AS off_share FROM steps GROUP BY sample_id""",
    "summits": _L + ", " + runs_sql("cover", "linear") + f""", part AS (SELECT lp_id, a, b, value, greatest(a, start_pos) AS x, least(b, end_pos) AS y FROM linear l JOIN cover c ON c.chrom = l.chrom AND start_pos < b AND a < end_pos),
best AS (SELECT *, y - x AS len FROM part QUALIFY value = max(value) OVER (PARTITION BY lp_id)),
acc AS (SELECT *, sum(len) OVER (PARTITION BY lp_id ORDER BY x) AS upto, sum(len) OVER (PARTITION BY lp_id) // 2 AS mid FROM best),
hit AS (SELECT lp_id, a, b, CAST(x + mid - (upto - len) AS BIGINT) AS summit FROM acc WHERE mid >= upto - len AND mid < upto)
SELECT lp_id, summit, greatest(summit - {WINDOW}, a) AS start_pos, least(summit + {WINDOW}, b) AS end_pos FROM hit""",
    "linear_summits": _L + f" SELECT lp_id, greatest((a + b) // 2 - {WINDOW}, a) AS start_pos, least((a + b) // 2 + {WINDOW}, b) AS end_pos FROM linear",
    "interval_sequence": _S + _SEQ + " SELECT read_id, sequence FROM seqs",
    "motif_hits": _S + _SEQ + " SELECT read_id, start, n_hits FROM hits",
    "motif_semi": _S + _SEQ + " SELECT read_id FROM reads WHERE read_id IN (SELECT read_id FROM hits)",
    "motif_anti": _S + _SEQ + " SELECT read_id FROM reads WHERE read_id NOT IN (SELECT read_id FROM hits)",
    "motif_contingency": _S + _SEQ + """, own AS (SELECT peak_id AS read_id, any_value(is_ambigous) AS is_ambigous, any_value(is_diff) AS is_diff FROM graph_peaks WHERE len(region_paths) > 0 GROUP BY peak_id)
SELECT is_ambigous, is_diff, count(n_hits) AS with_motif, count(*) - count(n_hits) AS without_motif FROM own LEFT JOIN hits USING (read_id) GROUP BY ALL""",
    "motif_enrichment": _S + _SEQ + _GOOD + """ SELECT sample_id, read_id, row_number() OVER w AS place, round(sum(CASE WHEN n_hits IS NULL THEN 0 ELSE 1 END) OVER w / row_number() OVER w, 9) AS share
FROM good LEFT JOIN hits USING (read_id) WINDOW w AS (PARTITION BY sample_id ORDER BY q DESC, read_id ROWS UNBOUNDED PRECEDING)""",
    "motif_locations": _S + _SEQ + """, acc AS (SELECT read_id, node, node_id, CASE WHEN node > 0 THEN lo ELSE size - hi END AS begin_, hi - lo AS bp, sum(hi - lo) OVER (PARTITION BY read_id ORDER BY i) AS upto FROM steps)
SELECT read_id, node_id, CAST(begin_ + start - 1 - (upto - bp) AS BIGINT) AS "offset", CASE WHEN node > 0 THEN '+' ELSE '-' END AS strand FROM acc JOIN hits USING (read_id) WHERE start - 1 >= upto - bp AND start - 1 < upto""",
    "best_motif": _S + _SEQ + _GOOD + " SELECT sample_id, n_hits, q, read_id FROM good JOIN hits USING (read_id) QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY n_hits DESC, q DESC, read_id) = 1",
    "top_peaks": _RD + _GOOD + f" SELECT read_id, sample_id, q FROM good ORDER BY q DESC, read_id LIMIT {BEST}",
    "concat_peaks": _RD + _GOOD + " SELECT sample_id, read_id, q, 'peak' || (row_number() OVER (PARTITION BY sample_id ORDER BY q DESC, read_id) - 1) AS name FROM good",
    "region_filter": _L + ", " + _PATH + ", ends AS (SELECT chrom, max(path_offset + size) AS bp FROM path GROUP BY chrom) SELECT lp_id, chrom, a, b FROM linear JOIN ends USING (chrom) WHERE b * 2 <= bp",
    "identical_calls": _L + """, same AS (SELECT chrom, a, b, count(DISTINCT run_id) AS n_runs, min(lp_id) AS first_id FROM linear GROUP BY chrom, a, b HAVING count(DISTINCT run_id) > 1)
SELECT lp_id, first_id, n_runs FROM linear JOIN same USING (chrom, a, b)""",
    "first_of_place": _L + " SELECT run_id, chrom, a, min(lp_id) AS lp_id, count(*) AS n FROM linear GROUP BY run_id, chrom, a",
    "alignment_compare": _S + _PRJ + ", " + LINEAR + f""", g AS (SELECT chrom, a, count(*) AS calls FROM prj GROUP BY ALL), l AS (SELECT chrom, a, count(*) AS calls FROM linear GROUP BY ALL),
m AS (SELECT g.chrom, g.a AS ga, l.a AS la, abs(g.a - l.a) AS off FROM g JOIN l ON l.chrom = g.chrom AND l.a > g.a - {PLACE} AND l.a < g.a + {PLACE}),
own AS (SELECT g.chrom, 'graph_only' AS only_, min(off) AS off, true AS graph, any_value(g.calls) AS calls FROM g LEFT JOIN m ON m.chrom = g.chrom AND ga = g.a GROUP BY g.chrom, g.a
  UNION ALL SELECT l.chrom, 'linear_only', min(off), false, any_value(l.calls) FROM l LEFT JOIN m ON m.chrom = l.chrom AND la = l.a GROUP BY l.chrom, l.a),
k AS (SELECT chrom, graph, calls, CASE WHEN off IS NULL THEN only_ WHEN off <= {NEAR} THEN 'same' ELSE 'apart' END AS kind FROM own)
SELECT chrom, kind, count(*) FILTER (WHERE graph OR kind = 'linear_only') AS n, CAST(sum(CASE WHEN graph THEN calls ELSE 0 END) AS BIGINT) AS graph_calls, CAST(sum(CASE WHEN graph THEN 0 ELSE calls END) AS BIGINT) AS linear_calls FROM k GROUP BY chrom, kind""",
    "alignment_sets": _S + """, f AS (SELECT DISTINCT node_id FROM steps WHERE node > 0), r AS (SELECT DISTINCT node_id FROM steps WHERE node < 0)
SELECT node_id, CASE WHEN f.node_id IS NULL THEN 'reverse' WHEN r.node_id IS NULL THEN 'forward' ELSE 'both' END AS kind FROM f FULL JOIN r USING (node_id)""",
    "reads_on_peaks": _S + _PRJ + ", " + LINEAR + """ SELECT read_id, count(*) AS n_calls, round(CAST(sum(CAST(score AS DECIMAL(18, 6))) AS DOUBLE) / nullif(count(score), 0), 6) AS mean_score
FROM prj p JOIN linear l ON l.chrom = p.chrom AND l.a < p.b AND p.a < l.b GROUP BY read_id""",
    "variants_in_intervals": _S + " SELECT read_id, chrom, count(DISTINCT node_id) AS n_variants, CAST(sum(size) AS BIGINT) AS bp FROM steps WHERE path_offset IS NULL GROUP BY read_id, chrom",
    "variant_clusters": """WITH o AS (SELECT chrom, node_index AS a, node_index + node_size AS b FROM nodes WHERE path_offset IS NULL),
m AS (SELECT *, CASE WHEN a = lag(b) OVER (PARTITION BY chrom ORDER BY a) THEN 0 ELSE 1 END AS head FROM o), n AS (SELECT *, sum(head) OVER (PARTITION BY chrom ORDER BY a) AS island FROM m)
SELECT chrom, min(a) AS start_pos, max(b) AS end_pos, count(*) AS n_variants FROM n GROUP BY chrom, island""",
    "haplotype_step": _S + ", " + EDGES + """, n AS (SELECT node_id, count(DISTINCT read_id) AS n FROM steps GROUP BY node_id)
SELECT src, dst, coalesce(n, 0) AS n_reads FROM edge LEFT JOIN n ON n.node_id = dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY coalesce(n, 0) DESC, dst) = 1""",
    "genotype_match": _S + """, s AS (SELECT DISTINCT sample_id, chrom, node_id FROM steps WHERE path_offset IS NULL), c AS (SELECT chrom, node_id FROM s GROUP BY ALL HAVING count(*) >= 2),
t AS (SELECT chrom, count(*) AS n FROM c GROUP BY chrom) SELECT sample_id, chrom, count(*) AS has, count(*) = any_value(n) AS complete FROM s JOIN c USING (chrom, node_id) JOIN t USING (chrom) GROUP BY sample_id, chrom""",
    "haplotype_summary": _RD + """, p AS (SELECT rp[1] AS first, rp[len(rp)] AS last, array_to_string(rp, ',') AS path, count(*) AS n FROM reads GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY first, last ORDER BY n DESC, path) AS place FROM p)
SELECT first, last, CAST(sum(n) AS BIGINT) AS n_all, count(*) AS n_paths, max(n) AS n_best, any_value(path) FILTER (WHERE place = 1) AS path,
  coalesce(any_value(n) FILTER (WHERE place = 2), 0) AS n_second, any_value(path) FILTER (WHERE place = 2) AS second_path FROM k GROUP BY first, last HAVING sum(n) > 1""",
    "forbes": _S + _PRJ + ", " + LINEAR + ", " + _PATH + """, g AS (SELECT DISTINCT chrom, a // 100 AS bin FROM prj), l AS (SELECT DISTINCT chrom, a // 100 AS bin FROM linear),
z AS (SELECT chrom, ceil(max(path_offset + size) / 100) AS n_bins FROM path GROUP BY chrom), ng AS (SELECT chrom, count(*) AS n_g FROM g GROUP BY chrom), nl AS (SELECT chrom, count(*) AS n_l FROM l GROUP BY chrom),
nb AS (SELECT chrom, count(*) AS n_both FROM g JOIN l USING (chrom, bin) GROUP BY chrom)
SELECT chrom, round(coalesce(n_both, 0) / (n_g * n_l / n_bins), 6) AS forbes FROM ng JOIN nl USING (chrom) JOIN z USING (chrom) LEFT JOIN nb USING (chrom)""",
    "diplo_histogram": _S + """, t AS (SELECT read_id, sum(CASE WHEN path_offset IS NULL THEN hi - lo ELSE 0 END) AS off, sum(hi - lo) AS bp FROM steps GROUP BY read_id),
h AS (SELECT CAST(least(99, off * 100 // bp) AS BIGINT) AS bin, count(*) AS n FROM t WHERE bp > 0 GROUP BY 1) SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS upto FROM h""",
    "report_rollup": _RD + " SELECT factor, sample_id, count(*) AS n_peaks, round(avg(len(rp)), 6) AS mean_nodes FROM reads JOIN samples USING (sample_id) GROUP BY ROLLUP (factor, sample_id)",
    "shift_lags": _S + """, p AS (SELECT chrom, path_offset + CASE WHEN node > 0 THEN lo ELSE hi END AS position, node FROM steps WHERE i = 0 AND path_offset IS NOT NULL)
SELECT r.position - f.position AS lag, count(*) AS n_pairs FROM p f JOIN p r ON f.chrom = r.chrom AND f.node > 0 AND r.node < 0 AND r.position BETWEEN f.position AND f.position + 300 GROUP BY 1""",
}
