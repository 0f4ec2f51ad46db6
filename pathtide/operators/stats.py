"""Background, p-values and q-values of tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathtide.functions.poisson import poisson_p
from pathtide.operators.scan import scan, sharded
from pathtide.operators.tracks import range_events, step_runs
from pathtide.session import cut

KEYS = ["chrom"]


def background(starts: DataFrame, fragment: int, extensions: list[int], least: Column) -> DataFrame:
    """Multi-scale background on a linear axis: runs (chrom, start_pos, end_pos, lam), at least ``least``.

    starts: chrom, at. Each scale counts the starts within half of it on either side, per fragment
    length: the halves are cut to whole positions and the count is divided by 2 * half / fragment.
    The highest scale counts at each position.
    """
    halves = [e // 2 for e in extensions]
    events = None
    for k, h in enumerate(halves):
        wide = starts.select("chrom", (F.col("at") - h).alias("x"), (F.col("at") + h).alias("y"), *[F.lit(1 if j == k else 0).alias(f"w{j}") for j in range(len(halves))])
        both = F.array(*[F.struct(F.col(c).alias("idx"), *[(F.col(f"w{j}") * s).alias(f"n{j}") for j in range(len(halves))]) for c, s in (("x", 1), ("y", -1))])
        part = wide.select("chrom", F.inline(both))
        events = part if events is None else events.unionByName(part)
    runs = step_runs(events, KEYS, [f"n{j}" for j in range(len(halves))])
    lam = F.greatest(least, *[F.col(f"n{j}") / (2 * h / fragment) for j, h in enumerate(halves)])
    return runs.select("chrom", "start_pos", "end_pos", lam.alias("lam"))


def p_track(sample: DataFrame, lam: DataFrame, sample_scale: Column, lam_scale: Column, least: Column | None = None) -> DataFrame:
    """p-values in -log10 of a sample track (value) over a background track (lam) on one axis.

    Runs where the sample is 0 have p = 0 and are left out. ``least`` is the background where its
    track has no run or a lower value. The tail is worked out once for every
    distinct pair of count and background.
    """
    es = range_events(sample, KEYS, "start_pos", "end_pos", F.col("value").cast("decimal(20,0)"), "v").withColumn("l", F.lit(0).cast("decimal(28,9)"))
    el = range_events(lam, KEYS, "start_pos", "end_pos", F.col("lam").cast("decimal(28,9)"), "l").withColumn("v", F.lit(0).cast("decimal(20,0)"))
    both = step_runs(es.unionByName(el), KEYS, ["v", "l"]).filter("v > 0")
    both = both.select("chrom", "start_pos", "end_pos", (F.col("v").cast("double") * sample_scale).alias("k"), F.round(F.greatest(F.col("l").cast("double"), F.lit(0.0) if least is None else least) * lam_scale, 6).alias("lam"))
    pairs = both.select("k", "lam").distinct().withColumn("p", poisson_p("k", "lam"))
    return both.join(pairs, ["k", "lam"]).select("chrom", "start_pos", "end_pos", "k", "lam", "p")


def q_values(p: DataFrame, total_bp: Column | int, clip_all: bool = False, step: float = 0.01) -> DataFrame:
    """p to q: p, bp, q. The rank of a p is the number of base pairs with a higher one, over all chromosomes.

    Ranks and the running minimum are worked out in stretches of ``step`` of the p-values, with one
    summary row a stretch. The first q is at least 0, with ``clip_all`` every one; q never rises as
    p falls. q is rounded to six places.
    """
    per = p.groupBy("p").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("bp")).withColumn("down", -F.col("p"))
    got = scan(sharded(cut(per), [], "down", step), [], "down", sums={"upto": "bp"})
    before = F.col("upto") - F.col("bp")
    total = F.lit(total_bp) if isinstance(total_bp, int) else total_bp
    raw = F.col("p") + F.log10(1 + before) - F.log10(total)
    got = got.select("p", "bp", "down", F.when(F.lit(clip_all) | (before == 0), F.greatest(raw, F.lit(0.0))).otherwise(raw).alias("raw"))
    got = scan(sharded(cut(got), [], "down", step), [], "down", mins={"q": "raw"})
    return got.select("p", "bp", F.round("q", 6).alias("q"))
