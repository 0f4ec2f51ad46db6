"""Step functions on an axis: events, runs, and what is done with them.

A track is a table of half-open runs (keys, start_pos, end_pos, value). Events are (keys, idx and
one difference per value). All scans are sharded, see :mod:`pathtide.operators.scan`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathtide.operators.scan import SHARD_WIDTH, scan, sharded
from pathtide.session import cut


def range_events(ranges: DataFrame, keys: list[str], start: str, end: str, weight: Column | None = None, name: str = "diff") -> DataFrame:
    """Two events a range: its weight at the start, minus its weight at the end. Empty ranges give none."""
    w = F.lit(1) if weight is None else weight
    both = F.array(F.struct(F.col(start).alias("idx"), w.alias(name)), F.struct(F.col(end).alias("idx"), (-w).alias(name)))
    return ranges.filter(F.col(start) < F.col(end)).select(*keys, F.inline(both))


def step_runs(events: DataFrame, keys: list[str], values: list[str], width: int = SHARD_WIDTH) -> DataFrame:
    """Runs (keys, start_pos, end_pos, values) between neighbouring change points of the summed events.

    The axis outside the first and last change point has value 0 and gives no run.
    """
    points = events.groupBy(*keys, "idx").agg(*[F.sum(v).alias(f"_d_{v}") for v in values])
    points = points.filter(" or ".join(f"_d_{v} <> 0" for v in values))
    points = sharded(points, keys, "idx", width)
    runs = scan(points, keys, "idx", sums={v: f"_d_{v}" for v in values}, after={"end_pos": "idx"}).filter(F.col("end_pos").isNotNull())
    return runs.select(*keys, F.col("idx").alias("start_pos"), "end_pos", *values)


def coalesce_runs(runs: DataFrame, keys: list[str], value: str = "value", width: int = SHARD_WIDTH) -> DataFrame:
    """Merges touching runs of equal value; gaps between runs stay gaps."""
    # Each scan reads its input twice, so what comes before it is written once.
    own = cut(runs.select(*keys, "start_pos", "end_pos", value))
    marked = scan(sharded(own, keys, "start_pos", width), keys, "start_pos", before={"_pe": "end_pos", "_pv": value})
    head = F.col("_pe").isNull() | (F.col("_pe") < F.col("start_pos")) | ~F.col("_pv").eqNullSafe(F.col(value))
    # An island goes from its first run to the end of the run before the next island's first one.
    heads = cut(marked.filter(head).select(*keys, "start_pos", "_pe", value))
    heads = scan(sharded(heads, keys, "start_pos", width), keys, "start_pos", after={"_ne": "_pe"})
    ends = own.groupBy(*keys).agg(F.max("end_pos").alias("_last"))
    last = heads.filter("_ne is null").join(ends, keys)
    out = heads.filter("_ne is not null").select(*keys, "start_pos", F.col("_ne").alias("end_pos"), value)
    return out.unionByName(last.select(*keys, "start_pos", F.col("_last").alias("end_pos"), value))


def coverage(ranges: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Runs of the number of ranges over each position; runs of 0 are left out."""
    runs = step_runs(range_events(ranges, keys, start, end), keys, ["diff"])
    return runs.filter("diff <> 0").select(*keys, "start_pos", "end_pos", F.col("diff").alias("value"))


def merge_tracks(a: DataFrame, b: DataFrame, keys: list[str], func: Callable[[Column, Column], Column]) -> DataFrame:
    """func(value of a, value of b) at every position either track covers, 0 where one has no run.

    Full outer merge of two step functions; touching runs of equal result are one.
    """
    ea = range_events(a, keys, "start_pos", "end_pos", F.col("value"), "va").withColumn("vb", F.lit(0))
    eb = range_events(b, keys, "start_pos", "end_pos", F.col("value"), "vb").withColumn("va", F.lit(0))
    runs = step_runs(ea.unionByName(eb), keys, ["va", "vb"])
    runs = runs.withColumn("value", func(F.col("va"), F.col("vb"))).filter((F.col("va") != 0) | (F.col("vb") != 0))
    return coalesce_runs(runs, keys)


def threshold(track: DataFrame, keys: list[str], cutoff: float) -> DataFrame:
    """Merged runs on which the track is at least ``cutoff``."""
    runs = track.filter(F.col("value") >= cutoff).select(*keys, "start_pos", "end_pos", F.lit(True).alias("value"))
    return coalesce_runs(runs, keys).drop("value")


def track_totals(track: DataFrame, keys: list[str]) -> DataFrame:
    """Integral and covered length per key."""
    size = F.col("end_pos") - F.col("start_pos")
    return track.groupBy(*keys).agg(F.sum(F.col("value") * size).alias("integral"), F.sum(size).alias("covered"))
