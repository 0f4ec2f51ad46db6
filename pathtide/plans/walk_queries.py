"""Queries on walks: haplotypes, variant-aware paths, the fragment length model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathtide.operators.graph import components
from pathtide.operators.walks import haplotype_paths, smooth, tag_windows, variant_aware_paths
from pathtide.plans.base import edges, nodes, steps, steps_once
from pathtide.plans.peak_queries import _good, _hits, linear_filter, shift_lags
from pathtide.plans.track_queries import CUTOFF
from pathtide.session import cut, no_broadcast

#: Width of a tag window; highest distance and fold of paired windows.
TAG_WINDOW, PAIR_REACH, PAIR_FOLD = 600, 1000, 2
LAGS, HALF = 300, 5


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return steps(spark, d).groupBy("node_id").agg(F.countDistinct("read_id").alias("n"))


def haplotype_path(spark: SparkSession, d: str) -> DataFrame:
    """The path most reads take through each chromosome, from its first node."""
    return haplotype_paths(edges(spark, d), _counts(spark, d))


def haplotype_sequence(spark: SparkSession, d: str) -> DataFrame:
    """How the haplotype path differs from the linear one: off-path nodes taken and their base pairs, per chromosome."""
    got = haplotype_path(spark, d).select("node_id").join(nodes(spark, d), "node_id")
    off = F.col("path_offset").isNull()
    return got.groupBy("chrom").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("size").alias("bp"), F.count_if(off).alias("n_variants"), F.sum(F.when(off, F.col("size")).otherwise(0)).alias("variant_bp"))


def ref_max_path(spark: SparkSession, d: str) -> DataFrame:
    """Variant-aware paths through the regions that enough reads go through.

    Off-path nodes with an on-path sister (same way in, same size) are SNPs, other off-path nodes are
    insertions; edges that pass over path nodes are deletions.
    """
    s = steps_once(spark, d, "read_id", "node_id", "chrom", "a", "b")
    seen = cut(s.groupBy("node_id").agg(F.countDistinct("read_id").alias("n")).filter(F.col("n") >= CUTOFF).select("node_id"))
    some = no_broadcast(seen, seen.count())
    n, e = nodes(spark, d), cut(edges(spark, d).select("src", "dst").distinct())
    n, n_edges = no_broadcast(n, n.count()), e.count()
    links = cut(e.join(some.withColumnRenamed("node_id", "src"), "src").join(some.withColumnRenamed("node_id", "dst"), "dst").select("src", "dst"))
    regions = components(seen.withColumnRenamed("node_id", "id"), links.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("id", "node_id")
    own = cut(n.join(some, "node_id"))
    own = no_broadcast(own, own.count())
    is_off = F.col("path_offset").isNull()
    # The ways into the off-path nodes seen; the sisters, seen or not, have the same way in.
    into = cut(e.join(own.filter(is_off).select(F.col("node_id").alias("dst"), "size"), "dst"))
    near = e.join(no_broadcast(into.select("src").distinct(), n_edges), "src")
    on = near.join(n.filter(~is_off).select(F.col("node_id").alias("dst"), "size"), "dst").select("src", "size").distinct()
    off = into.join(no_broadcast(on, n_edges), ["src", "size"]).select(F.col("dst").alias("node_id")).distinct()
    flagged = own.join(no_broadcast(off, n_edges).withColumn("sister", F.lit(True)), "node_id", "left")
    flagged = flagged.select("node_id", "chrom", "size", "node_index", (is_off & F.col("sister").isNotNull()).alias("snp"), (is_off & F.col("sister").isNull()).alias("ins"))
    # Deletions among the nodes seen: both ends on the path, and no step of it.
    path = own.filter(~is_off).select("node_id", "chrom", F.col("path_offset").alias("at"), (F.col("path_offset") + F.col("size")).alias("next"))
    ends = links.join(path.select(F.col("node_id").alias("src"), F.col("chrom").alias("own"), "next"), "src").join(path.select(F.col("node_id").alias("dst"), "chrom", "at"), "dst")
    step = F.coalesce((F.col("own") == F.col("chrom")) & (F.col("next") == F.col("at")), F.lit(False))
    gaps = cut(ends.groupBy("src", "dst").agg(F.max(step).alias("step")).filter("not step").select("src", "dst"))
    return variant_aware_paths(flagged, links, gaps, regions, s.select("chrom", F.col("a").alias("start_pos"), F.col("b").alias("end_pos"), F.lit(1).alias("value")))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return tag_windows(linear_filter(spark, d).select("chrom", "strand", F.col("position").alias("at")), ["chrom", "strand"], TAG_WINDOW)


def shift_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of read starts by strand."""
    return _windows(spark, d)


def shift_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a forward and a reverse window that may flank one site: reverse behind forward, near, with alike counts."""
    w = cut(_windows(spark, d))
    a = w.filter("strand = '+'").select("chrom", F.col("centre").alias("fc"), F.col("n_tags").alias("fn"))
    b = w.filter("strand = '-'").select("chrom", F.col("centre").alias("rc"), F.col("n_tags").alias("rn"))
    a = a.withColumn("bin", F.explode(F.array(F.floor(F.col("fc") / PAIR_REACH), F.floor(F.col("fc") / PAIR_REACH) + 1)))
    both = a.join(b.withColumn("bin", F.floor(F.col("rc") / PAIR_REACH)), ["chrom", "bin"]).filter((F.col("rc") > F.col("fc")) & (F.col("rc") - F.col("fc") < PAIR_REACH))
    both = both.filter((F.col("fn") <= PAIR_FOLD * F.col("rn")) & (F.col("rn") <= PAIR_FOLD * F.col("fn")))
    return both.select("chrom", "fc", "rc", "fn", "rn")


def shift_estimate(spark: SparkSession, d: str) -> DataFrame:
    """The smoothed lag profile and its local maxima: the best positive one is the fragment length."""
    lags = spark.range(LAGS + 1).withColumnRenamed("id", "lag").join(shift_lags(spark, d), "lag", "left").select("lag", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"))
    got = smooth(lags, "lag", "n_pairs", HALF)
    w = Window.orderBy("lag")  # as many rows as there are lags
    top = (F.col("smoothed") > F.lag("smoothed").over(w)) & (F.col("smoothed") > F.lead("smoothed").over(w))
    return got.withColumn("is_maximum", F.coalesce(top, F.lit(False))).select("lag", "n_pairs", F.round("smoothed", 9).alias("smoothed"), "is_maximum")


def motif_regression(spark: SparkSession, d: str) -> DataFrame:
    """Logistic regression of the motif's presence on peak features: one coefficient a row."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    shape = steps(spark, d).groupBy("read_id").agg(F.sum(F.col("hi") - F.col("lo")).cast("double").alias("bp"), F.count(F.lit(1)).cast("double").alias("n_nodes"), F.count_if(F.col("path_offset").isNull()).cast("double").alias("n_off"))
    rows = _good(spark, d).select("read_id", F.least("q", F.lit(1000.0)).alias("q")).join(shape, "read_id").join(_hits(spark, d), "read_id", "left").withColumn("label", F.col("n_hits").isNotNull().cast("double"))
    names = ["q", "bp", "n_nodes", "n_off"]
    ready = cut(rows.select("label", *names))
    model = LogisticRegression(regParam=0.0, maxIter=50).fit(VectorAssembler(inputCols=names, outputCol="features").transform(ready))
    return spark.createDataFrame([*zip(names, map(float, model.coefficients)), ("intercept", float(model.intercept))], "feature string, coefficient double")


QUERIES = {f.__name__: f for f in (haplotype_path, haplotype_sequence, ref_max_path, shift_windows, shift_pairs, shift_estimate, motif_regression)}

# A walk of thousands of steps is slow as recursive SQL, and the others are greedy or fitted: they are tested on small fixtures.
SQL: dict[str, str] = {}
