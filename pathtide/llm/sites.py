"""Binding sites called on a graph and on the linear axis, matched without a shared key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathtide.llm.linkage import Comparison, block, fit
from pathtide.operators.joins import lookup
from pathtide.plans.base import signature
from pathtide.session import cut

#: Width of a position block. Starts or ends are near within a share of the graph call's length and the slack: the levels of
#: agreement, of which the loosest is the reach of the position passes.
BLOCK_WIDTH, NEARNESS, SLACK = 2048, (0.05, 0.18, 0.4), 10
#: Parts a hot key of the label passes is spread over.
SPREAD = 8
#: Least posterior of a match.
CONFIDENCE = 0.5


def chromosome_key(name: Column) -> Column:
    """One spelling of a chromosome: lower case, without ``chr``, numbers without leading zeros."""
    bare = F.regexp_replace(F.lower(F.trim(name)), "^chr(omosome)?_?", "")
    return F.regexp_replace(bare, "^([a-z]*)0+(?=[0-9])", "$1")


def graph_calls(peaks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each graph peak once, on the linear axis: peak_id, sample_id, chrom, gs, ge, q.

    Ends on nodes off the path are placed from the nearest node of the peak that is on it. Peaks
    without nodes, without a sample or wholly off the path take no part.
    """
    own = peaks.filter((F.size("region_paths") > 0) & F.col("peak_id").isNotNull() & F.col("sample_id").isNotNull())
    own = own.select("peak_id", "sample_id", "start_off", "end_off", "region_paths", F.col("average_q_value").alias("q")).dropDuplicates(["peak_id"])
    each = own.select("peak_id", F.posexplode("region_paths").alias("i", "signed")).withColumn("node_id", F.abs("signed"))
    placed = each.join(nodes.select("node_id", "chrom", "node_size", "path_offset"), "node_id")
    # Forward order: a reverse path lists its nodes from the far end.
    step = F.struct(F.when(F.col("signed") < 0, -F.col("i")).otherwise(F.col("i")).alias("i"), F.col("node_size").cast("long").alias("n"), F.col("path_offset").alias("o"))
    path = placed.groupBy("peak_id").agg(F.array_sort(F.collect_list(step)).alias("p"), F.min("chrom").alias("chrom"), F.min("signed").alias("least"))
    before = F.aggregate("p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("o")), lambda a, x: F.struct(F.when(a.o.isNull() & x.o.isNull(), a.n + x.n).otherwise(a.n).alias("n"), F.coalesce(a.o, x.o).alias("o")))
    after = F.aggregate("p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("o")), lambda a, x: F.struct(F.when(x.o.isNotNull(), F.lit(0).cast("long")).otherwise(a.n + x.n).alias("n"), F.coalesce(x.o + x.n, a.o).alias("o")))
    first, last = F.element_at("p", 1).n, F.element_at("p", -1).n
    path = path.select("peak_id", "chrom", "least", before.alias("b"), after.alias("a"), first.alias("first"), last.alias("last")).filter(F.col("b.o").isNotNull())
    got = own.drop("region_paths").join(path, "peak_id")
    back = F.col("least") < 0
    from_start = F.when(back, F.col("first") - F.col("end_off")).otherwise(F.col("start_off"))
    to_end = F.when(back, F.col("last") - F.col("start_off")).otherwise(F.col("end_off"))
    gs = F.col("b.o") - F.col("b.n") + from_start
    ge = F.col("a.o") + F.col("a.n") - F.col("last") + to_end
    got = got.select("peak_id", "sample_id", chromosome_key(F.col("chrom")).alias("chrom"), gs.alias("gs"), F.greatest(ge, gs + 1).alias("ge"), "q")
    return got.filter(F.col("gs").isNotNull() & F.col("ge").isNotNull())


def linear_calls(peaks: DataFrame) -> DataFrame:
    """Each usable linear peak: lp_id, run_id, lchrom, ls, le, score."""
    got = peaks.filter((F.col("end_pos") > F.col("start_pos")) & F.col("chromosome").isNotNull() & F.col("run_id").isNotNull() & F.col("lp_id").isNotNull())
    return got.select("lp_id", "run_id", chromosome_key(F.col("chromosome")).alias("lchrom"), F.col("start_pos").alias("ls"), F.col("end_pos").alias("le"), "score")


def run_labels(runs: DataFrame) -> DataFrame:
    """What a run's free label may name: words, their signatures, replicate, and the rest as tissue."""
    words = F.filter(F.split(F.lower("run_label"), "[^a-z0-9-]+"), lambda w: w != "")
    got = runs.filter(F.col("run_id").isNotNull()).select("run_id", words.alias("words"), F.col("n_reads_approx").cast("double").alias("run_reads"), F.col("called_at").alias("run_at"))
    plain = F.transform("words", lambda w: F.regexp_replace(w, "-", ""))
    got = got.withColumn("words", plain)
    number = F.filter("words", lambda w: w.rlike("^(r|rep)?[0-9]+$"))
    got = got.withColumn("run_replicate", F.when(F.size(number) > 0, F.regexp_extract(F.get(number, F.size(number) - 1), "([0-9]+)$", 1).cast("int")))
    named = F.filter("words", lambda w: w.rlike("^[a-z]{2,}[0-9]+$") & ~w.rlike("^(r|rep)[0-9]+$"))
    got = got.withColumn("signatures", F.transform(named, lambda w: F.array_join(F.array_sort(F.split(w, "")), "")))
    rest = F.array_join(F.filter("words", lambda w: ~w.rlike("[0-9]")), "")
    return got.withColumn("named", named).withColumn("run_tissue", F.when(rest != "", rest))


def run_sample_candidates(runs: DataFrame, samples: DataFrame) -> DataFrame:
    """Pairs of a run and a sample that may belong together, with the agreement levels of their labels.

    A word of the label has the factor's letters, and besides the replicate, the tissue's first
    letter or the month (called in that of the sequencing or the next) is the same; a run that tells
    none of these is paired by the factor alone. A label that garbles the factor is paired by
    tissue, replicate and month together. Whatever a pass finds is judged by the comparisons alone.
    """
    own = run_labels(runs)
    factor = F.regexp_replace(F.lower("factor"), "[^a-z0-9]", "")
    tissue = F.regexp_replace(F.lower("tissue"), "[^a-z0-9]", "")
    kept = samples.filter(F.col("sample_id").isNotNull()).select("sample_id", factor.alias("s_factor"), tissue.alias("s_tissue"), F.col("replicate").alias("s_replicate"), F.col("n_reads").cast("double").alias("s_reads"), F.col("sequenced_at").alias("s_at"))
    month = lambda c: F.floor(F.unix_timestamp(c) / (30 * 86400))
    months = F.array(month("run_at"), month("run_at") - 1)
    silent = F.col("run_replicate").isNull() & F.col("run_tissue").isNull() & F.col("run_at").isNull()
    words, letters = F.col("signatures"), signature(F.col("s_factor"))
    passes = [
        ([words, F.col("run_replicate")], [letters, F.col("s_replicate")]),
        ([words, F.substring("run_tissue", 1, 1)], [letters, F.substring("s_tissue", 1, 1)]),
        ([words, months], [letters, month("s_at")]),
        ([F.when(silent, words)], [letters]),
        ([F.substring("run_tissue", 1, 3), F.col("run_replicate"), months], [F.substring("s_tissue", 1, 3), F.col("s_replicate"), month("s_at")]),
    ]
    got = block(own, kept, passes, spread=SPREAD).dropDuplicates(["run_id", "sample_id"])
    short = F.concat(F.lit("^"), F.array_join(F.split("run_tissue", ""), ".*"))
    ratio, days = F.col("run_reads") / F.col("s_reads"), (F.unix_timestamp("run_at") - F.unix_timestamp("s_at")) / 86400
    levels = [
        Comparison("factor", [F.array_contains("named", F.col("s_factor")), F.array_contains("signatures", signature(F.col("s_factor")))], F.col("s_factor").isNull()),
        Comparison("tissue", [F.col("run_tissue") == F.col("s_tissue"), F.rlike("s_tissue", short)], F.col("run_tissue").isNull() | F.col("s_tissue").isNull()),
        Comparison("replicate", [F.col("run_replicate") == F.col("s_replicate")], F.col("run_replicate").isNull() | F.col("s_replicate").isNull()),
        Comparison("reads", [F.abs(ratio - 1) <= 0.1, F.abs(ratio - 1) <= 0.3], ratio.isNull()),
        Comparison("days", [days.between(0, 35), days.between(-2, 90)], days.isNull()),
    ]
    return got.select("run_id", "sample_id", *[c.level() for c in levels])


LABEL_COMPARISONS = {"factor": 2, "tissue": 2, "replicate": 1, "reads": 2, "days": 2}


def _site_pairs(calls: DataFrame, owners: DataFrame, linear: DataFrame, n_owners: int) -> DataFrame:
    """Pairs of a graph call and a linear call of a candidate run whose starts or ends lie within reach of each other.

    Two position passes in one join: a linear call is listed in the block of its start and in that
    of its end, and a pair counts in the block of the start if the starts are near, else in that of
    the end, so that no pair comes twice. The smaller side is widened by its candidate runs; the
    linear calls, the largest table, are moved once, and what was delivered again is left out where
    it arrives.
    """
    block_of = lambda c: F.floor(F.col(c) / BLOCK_WIDTH)
    near = (F.greatest(F.col("ge") - F.col("gs"), F.lit(1)) * NEARNESS[-1] + SLACK).cast("long")
    left = lookup(calls, owners, ["sample_id"], n_owners, ["peak_id"]).withColumn("near", near)
    left = left.withColumn("spot", F.explode(F.sequence(F.floor((F.col("gs") - F.col("near")) / BLOCK_WIDTH), F.floor((F.col("ge") + F.col("near")) / BLOCK_WIDTH))))
    right = linear_calls(linear).withColumnRenamed("lchrom", "chrom").withColumn("spot", F.explode(F.array_distinct(F.array(block_of("ls"), block_of("le")))))
    keys = ["run_id", "chrom", "spot"]
    right = right.repartition(*keys).dropDuplicates([*keys, "lp_id"])
    at_start, at_end = F.abs(F.col("ls") - F.col("gs")) <= F.col("near"), F.abs(F.col("le") - F.col("ge")) <= F.col("near")
    return left.join(right, keys).filter((at_start & (F.col("spot") == block_of("ls"))) | (~at_start & at_end & (F.col("spot") == block_of("le"))))


def link_sites(peaks: DataFrame, nodes: DataFrame, samples: DataFrame, linear: DataFrame, runs: DataFrame, least: float = CONFIDENCE) -> DataFrame:
    """Matches of graph peaks and linear peaks that call the same site in the same sample.

    Result: peak_id, lp_id, run_id, sample_id, confidence (the posterior, at least ``least``: of the
    run's and sample's match times that of the calls' match). Each peak_id and lp_id counts once. A run belongs to the one sample its pairs speak for most; within
    it a linear peak has one graph peak and a graph peak one linear peak a run, by confidence. Rows
    with nulls in ids, positions or paths take no part; unknown scores or labels count for neither
    side. Empty tables give no matches.
    """
    labels = cut(run_sample_candidates(runs, samples))
    calls = cut(graph_calls(peaks, nodes))
    n_labels = labels.count()
    size = F.greatest(F.col("ge") - F.col("gs"), F.lit(1))
    ds, de = F.abs(F.col("ls") - F.col("gs")), F.abs(F.col("le") - F.col("ge"))
    known = (F.col("score") >= 0) & ~F.isnan("score") & (F.col("q") > 0) & ~F.isnan("q")
    apart = F.abs(F.ln(F.greatest("score", F.lit(1e-3)) / F.greatest("q", F.lit(1e-3))))
    near = lambda d: [d <= size * share + SLACK for share in NEARNESS]
    geometry = [
        Comparison("start", near(ds)),
        Comparison("end", near(de)),
        Comparison("score", [apart <= 0.15, apart <= 0.35, apart <= 0.8], ~F.coalesce(known, F.lit(False))),
    ]
    pairs = _site_pairs(calls, labels.select("run_id", "sample_id"), linear, n_labels)
    pairs = cut(pairs.select("peak_id", "lp_id", "run_id", "sample_id", *[c.level() for c in geometry], (ds + de).cast("int").alias("off")))
    # A run and a sample are linked first: by their labels, and by what all their pairs say together, the share of the sample's peaks met closely.
    met = pairs.groupBy("run_id", "sample_id").agg(F.count_if((F.col("c_start") <= 1) & (F.col("c_end") <= 1)).alias("met"))
    held = calls.groupBy("sample_id").agg(F.count(F.lit(1)).alias("held"))
    share = F.coalesce("met", F.lit(0)) / F.col("held")
    support = Comparison("support", [share >= 0.3, share >= 0.15, share >= 0.05])
    owners = labels.join(held, "sample_id").join(met, ["run_id", "sample_id"], "left")
    owners = cut(owners.select("run_id", "sample_id", support.level(), *[f"c_{n}" for n in LABEL_COMPARISONS]))
    told = [Comparison(n, [F.lit(True)] * k) for n, k in LABEL_COMPARISONS.items()] + [support]
    owners = cut(owners.select("run_id", "sample_id", fit(owners, told).posterior().alias("owned")))
    # Then the calls themselves, by their geometry, as far as their run and sample are linked.
    compared = lookup(pairs, owners, ["run_id", "sample_id"], n_labels, ["peak_id", "lp_id"])
    scored = compared.withColumn("confidence", F.col("owned") * fit(compared, geometry, able="owned", prior=1.0).posterior())
    best = scored.groupBy("run_id", "sample_id").agg(F.sum("confidence").alias("weight"))
    best = best.groupBy("run_id").agg(F.max_by("sample_id", F.struct("weight", (-F.col("sample_id")).alias("k"))).alias("sample_id"))
    got = lookup(scored.filter(F.col("confidence") >= least), cut(best), ["run_id", "sample_id"], n_labels, ["peak_id", "lp_id"])
    got = got.select("peak_id", "lp_id", "run_id", "sample_id", "confidence", "off")
    for side in (["lp_id"], ["peak_id", "run_id"]):
        w = Window.partitionBy(*side).orderBy(F.desc("confidence"), "off", "peak_id", "lp_id")
        got = got.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")
    return got.select("peak_id", "lp_id", "run_id", "sample_id", "confidence")
