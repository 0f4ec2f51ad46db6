"""Walks that go on by one fixed choice a node, found by doubling jumps instead of step by step."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathtide.operators.joins import asof_join
from pathtide.operators.scan import scan, sharded
from pathtide.operators.tracks import range_events
from pathtide.session import cut, no_broadcast


def follow(choice: DataFrame, starts: DataFrame) -> DataFrame:
    """All (walk, at) on the walks from ``starts`` (walk, at) along ``choice`` (at, to), each once, with its step number from 0.

    In round k everything found so far is sent 2^k choices on, so the rounds grow with the logarithm
    of the longest walk. A walk ends where there is no choice; choices must not go in circles.
    """
    found = cut(starts.select("walk", "at", F.lit(0).cast("long").alias("step")))
    jump, length = cut(choice.select("at", "to")), 1
    while True:
        new = found.join(jump, "at").select("walk", F.col("to").alias("at"), (F.col("step") + length).alias("step"))
        new = cut(new)
        if new.isEmpty():
            return found
        found = cut(found.unionByName(new))
        jump = cut(jump.select("at", F.col("to").alias("mid")).join(jump.select(F.col("at").alias("mid"), "to"), "mid").select("at", "to"))
        length *= 2


def haplotype_paths(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """The naive haplotype path of each chromosome: chrom, node_id, step.

    From the first node without a way in, always on to the successor most reads go through (the
    smaller node on ties). counts: node_id, n.
    """
    weighted = edges.join(counts.select(F.col("node_id").alias("dst"), "n"), "dst", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    choice = weighted.groupBy(F.col("src").alias("at")).agg((-F.max(F.struct("n", (-F.col("dst")).alias("d"))).d).alias("to"))
    first = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_anti").groupBy("chrom").agg(F.min("src").alias("at"))
    return follow(choice, first.select(F.col("chrom").alias("walk"), "at")).select(F.col("walk").alias("chrom"), F.col("at").alias("node_id"), "step")


def border_values(nodes: DataFrame, track: DataFrame) -> DataFrame:
    """The track's value on each node's first and last position: node_id, first_value, last_value; 0 where it has no run."""
    ends = nodes.select("node_id", "chrom", F.inline(F.array(F.struct(F.col("node_index").alias("p"), F.lit("first").alias("side")), F.struct((F.col("node_index") + F.col("size") - 1).alias("p"), F.lit("last").alias("side")))))
    at = asof_join(ends, track, ["chrom"], "p", "start_pos", ["end_pos", "value"])
    value = F.when(F.col("p") < F.col("end_pos"), F.col("value")).otherwise(0)
    pick = lambda s: F.max(F.when(F.col("side") == s, value)).alias(f"{s}_value")
    return at.groupBy("node_id").agg(pick("first"), pick("last"))


def border_sums(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """As :func:`border_values`, for runs of whole values that may overlap and then add up: the events are summed up to each border in one scan."""
    ends = F.array(F.struct(F.col("node_index").alias("idx"), F.lit(1).alias("side")), F.struct((F.col("node_index") + F.col("size") - 1).alias("idx"), F.lit(2).alias("side")))
    asked = nodes.select("chrom", "node_id", F.inline(ends), F.lit(0).cast("long").alias("diff"))
    events = range_events(runs, ["chrom"], "start_pos", "end_pos", F.col("value")).groupBy("chrom", "idx").agg(F.sum("diff").cast("long").alias("diff")).filter("diff <> 0")
    # The scan reads its input twice. At a border's position, its events come first.
    both = cut(events.withColumns({"node_id": F.lit(-1).cast("long"), "side": F.lit(0)}).unionByName(asked))
    got = scan(sharded(both, ["chrom"], "idx"), ["chrom"], ["idx", "side", "node_id"], sums={"value": "diff"})
    pick = lambda k, s: F.max(F.when(F.col("side") == k, F.col("value"))).alias(f"{s}_value")
    return got.filter("side > 0").groupBy("node_id").agg(pick(1, "first"), pick(2, "last"))


def variant_aware_paths(nodes: DataFrame, edges: DataFrame, deletions: DataFrame, regions: DataFrame, track: DataFrame) -> DataFrame:
    """A greedy path through each region that prefers the reference: component, path (node ids in order).

    nodes: node_id, chrom, size, node_index, snp, ins (booleans); deletions: src, dst; regions:
    node_id, component; track: runs of whole values, which add up where runs overlap. From a region's first node that is no variant, each step takes the reference
    successor with the highest value at its start; a SNP with a strictly higher value goes before
    it; an insertion with at least half the value goes before these; a deletion goes before all if
    the choice so far is at most half of both the current node's last value and the deletion's.
    Ties go to the larger node.
    """
    # Only the regions' nodes have a value that counts.
    own = cut(nodes.select("node_id", "chrom", "size", "node_index", "snp", "ins").join(no_broadcast(regions, regions.count()), "node_id"))
    many = own.count()
    values = cut(border_sums(own, track).join(no_broadcast(own, many).select("node_id", "snp", "ins", "component"), "node_id"))
    to = values.select(F.col("node_id").alias("dst"), F.col("component"), F.col("first_value").cast("double").alias("v"), "snp", "ins")
    out = values.select(F.col("node_id").alias("src"), F.col("component").alias("c"), F.col("last_value").cast("double").alias("here"))
    ways = edges.select("src", "dst").join(no_broadcast(to, many), "dst").join(no_broadcast(out, many), "src").filter(F.col("c") == F.col("component"))
    gone = no_broadcast(deletions.select("src", "dst").distinct(), deletions.count())
    ways = ways.join(gone.withColumn("gap", F.lit(True)), ["src", "dst"], "left")
    kind = F.when(F.col("gap").isNotNull(), "d").when(F.col("ins"), "i").when(F.col("snp"), "s").otherwise("r")
    none = F.struct(F.lit(-1.0).alias("v"), F.lit(-1).cast("long").alias("dst"))
    best = [F.coalesce(F.max(F.when(kind == k, F.struct("v", "dst"))), none).alias(k) for k in "rsid"]
    got = ways.groupBy("src", "here").agg(*best)
    plain = F.when(F.col("s.v") > F.col("r.v"), F.col("s")).otherwise(F.col("r"))
    got = got.withColumn("a", plain)
    got = got.withColumn("a", F.when(F.col("i.v") >= F.col("a.v") / 2, F.col("i")).otherwise(F.col("a")))
    cut_short = (F.col("a.v") <= F.col("here") / 2) & (F.col("a.v") <= F.col("d.v") / 2)
    got = got.withColumn("a", F.when(cut_short, F.col("d")).otherwise(F.col("a")))
    choice = got.select(F.col("src").alias("at"), F.col("a.dst").alias("to")).filter("to >= 0")
    first = values.groupBy("component").agg(F.coalesce(F.min(F.when(~F.col("snp") & ~F.col("ins"), F.col("node_id"))), F.min("node_id")).alias("at"))
    walked = follow(choice, first.select(F.col("component").alias("walk"), "at"))
    # A region's path is as long as the region.
    return walked.groupBy(F.col("walk").alias("component")).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "at"))), lambda x: x.at).alias("path"))


def tag_windows(tags: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Tumbling windows over sorted tags: keys, start, n_tags, centre.

    The first tag of a key opens a window; a window takes the tags up to ``width`` positions from
    its start, the next tag opens the next one. tags: keys, at. centre is the mean position of the
    window's tags, cut to a whole number.
    """
    spots = cut(tags.groupBy(*keys, "at").agg(F.count(F.lit(1)).alias("n")))
    # The next window's start: the first tag at or behind at + width, an as-of join on the turned axis.
    turned = spots.select(*keys, (-F.col("at")).alias("back"), F.col("at").alias("to"))
    asked = spots.select(*keys, F.col("at").alias("own"), (-(F.col("at") + width)).alias("p"))
    nxt = asof_join(asked, turned, keys, "p", "back", ["to"]).filter("to is not null")
    key = F.struct(*keys)
    choice = nxt.select(F.struct(*keys, F.col("own").alias("at")).alias("at"), F.struct(*keys, F.col("to").alias("at")).alias("to"))
    first = spots.groupBy(*keys).agg(F.min("at").alias("at")).select(key.alias("walk"), F.struct(*keys, "at").alias("at"))
    opened = follow(choice, first).select(*[F.col(f"walk.{k}").alias(k) for k in keys], F.col("at.at").alias("start"))
    inside = asof_join(spots, opened, keys, "at", "start", ["start"])
    got = inside.groupBy(*keys, "start").agg(F.sum("n").alias("n_tags"), F.sum(F.col("at") * F.col("n")).alias("s"))
    return got.select(*keys, "start", "n_tags", F.expr("s div n_tags").alias("centre"))


def window_weights(kind: str, half: int) -> list[float]:
    """Weights of a window of 2 * half + 1 places: flat, bartlett, hanning, hamming or blackman."""
    n = 2 * half
    turn = lambda k, times=1: math.cos(2 * math.pi * times * k / n)
    shapes = {
        "flat": lambda k: 1.0, "bartlett": lambda k: 1 - abs(2 * k / n - 1), "hanning": lambda k: 0.5 - 0.5 * turn(k),
        "hamming": lambda k: 0.54 - 0.46 * turn(k), "blackman": lambda k: 0.42 - 0.5 * turn(k) + 0.08 * turn(k, 2),
    }
    return [shapes[kind](k) for k in range(n + 1)]


def smooth(rows: DataFrame, at: str, value: str, half: int, kind: str = "flat") -> DataFrame:
    """Weighted moving average over 2 * half + 1 neighbours with mirrored ends, for a short, gapless profile such as a lag histogram."""
    n = rows.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    # One row.
    both = rows.crossJoin(F.broadcast(n))
    mirrored = both.select(F.col(at), F.col(value), F.explode(F.array(F.col(at), 2 * F.col("lo") - F.col(at), 2 * F.col("hi") - F.col(at))).alias("x"), "lo", "hi")
    mirrored = mirrored.filter(((F.col("x") >= F.col("lo") - half) & (F.col("x") <= F.col("hi") + half))).dropDuplicates(["x"])
    w = Window.orderBy("x").rowsBetween(-half, half)
    if kind == "flat":
        average = F.avg(value).over(w)
    else:
        weights = window_weights(kind, half)
        parts = F.zip_with(F.collect_list(F.col(value).cast("double")).over(w), F.array(*map(F.lit, weights)), lambda v, c: F.coalesce(v * c, F.lit(0.0)))
        average = F.aggregate(parts, F.lit(0.0), lambda x, y: x + y) / sum(weights)
    got = mirrored.withColumn("smoothed", average).filter((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
    return got.select(F.col("x").alias(at), F.col(value), "smoothed")


class NotEnoughPairs(ValueError):
    """Too few pairs of windows to tell a fragment length from."""


#: Pairs below which there is no estimate, pairs below which it is unsure, and the length no estimate may reach.
FEWEST_PAIRS, FEW_PAIRS, LONGEST = 100, 500, 1000


def fragment_length(pairs: DataFrame, profile: DataFrame) -> int:
    """The best positive local maximum of a smoothed lag ``profile`` (lag, smoothed, is_maximum), guarded by the number of ``pairs``.

    The profile is as short as its lags. Raises NotEnoughPairs below ``FEWEST_PAIRS`` or where there
    is no maximum, ValueError from ``LONGEST`` on, and warns below ``FEW_PAIRS``.
    """
    n = pairs.count()
    if n < FEWEST_PAIRS:
        raise NotEnoughPairs(f"{n} pairs, at least {FEWEST_PAIRS} are needed")
    if n < FEW_PAIRS:
        warnings.warn(f"only {n} pairs: the fragment length is unsure", stacklevel=2)
    best = profile.filter("is_maximum and lag > 0").orderBy(F.desc("smoothed"), "lag").select("lag").first()
    if best is None:
        raise NotEnoughPairs("the lag profile has no maximum")
    if best[0] >= LONGEST:
        raise ValueError(f"a fragment length of {best[0]} is beyond belief")
    return int(best[0])
