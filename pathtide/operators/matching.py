"""Pairs of intervals: one-to-one matching of two sets, and similar ones of one set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathtide.operators.joins import overlap_join
from pathtide.session import cut

#: Most intervals of a cell that are compared in one block.
BLOCK = 512


def greedy_matches(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (id_a, id_b) of overlapping intervals, each id at most once; sides: keys, id, a, b, score.

    In the order of falling score (then id) each interval of ``ours`` takes, of the free ones of
    ``theirs`` it overlaps, the one of the highest score (then lowest id). The walk is done in
    rounds: a pair is settled when the partner is the best one left for the interval and the
    interval is the first in order among those left for the partner - no earlier one can then take
    it. Every round settles at least the first interval left of every region. Ids are unique within
    a side; rows without a score take no part.
    """
    a = ours.filter(F.col("score").isNotNull()).select(*keys, F.col("id").alias("id_a"), F.col("a").alias("a0"), F.col("b").alias("a1"), F.col("score").alias("sa"))
    b = theirs.filter(F.col("score").isNotNull()).select(*keys, F.col("id").alias("id_b"), F.col("a").alias("b0"), F.col("b").alias("b1"), F.col("score").alias("sb"))
    left = cut(overlap_join(a, b, keys, ("a0", "a1"), ("b0", "b1")).select("id_a", "id_b", "sa", "sb"))
    done = []
    while not left.isEmpty():
        choice = left.groupBy("id_a").agg(F.max(F.struct("sb", (-F.col("id_b")).alias("k"))).k.alias("k")).select("id_a", (-F.col("k")).alias("id_b"))
        first = left.groupBy("id_b").agg(F.max(F.struct("sa", (-F.col("id_a")).alias("k"))).k.alias("k")).select("id_b", (-F.col("k")).alias("id_a"))
        settled = cut(choice.join(first, ["id_a", "id_b"]))
        done.append(settled)
        left = cut(left.join(settled.select("id_a"), "id_a", "left_anti").join(settled.select("id_b"), "id_b", "left_anti"))
    out = ours.sparkSession.createDataFrame([], a.join(b, keys).select("id_a", "id_b").schema)
    for part in done:
        out = out.unionByName(part)
    return out


def similar_intervals(own: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """All pairs (read_id, first_id) on an equal path with starts and ends at most ``most`` apart; ``own``: read_id, s, e, rp.

    Each pair comes once, first_id being the lesser by (s, e, read_id). A path's intervals are put
    in cells of ``most`` + 1 starts by as many ends; the lesser one looks into its own and the next
    cell by start and the three around it by end. Cells with very many intervals are split into
    blocks of about ``block``.
    """
    width = most + 1
    # A path is known by its least id; most have one interval only.
    paths = own.groupBy("rp").agg(F.min("read_id").alias("path"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    cell = [F.floor(F.col(c) / width).alias(f"c{c}") for c in ("s", "e")]
    own = cut(own.join(paths, "rp").select("path", "read_id", "s", "e", *cell))
    keys = ["path", "cs", "ce"]
    hot = cut(own.groupBy(*keys).count().filter(F.col("count") > block).select(*keys, F.ceil(F.col("count") / block).alias("blocks")))
    into = lambda df: df.join(hot, keys, "left").na.fill(1, ["blocks"])
    later = into(own).withColumn("block", F.pmod(F.xxhash64("read_id"), F.col("blocks"))).drop("blocks")
    first = own.select("path", F.col("read_id").alias("first_id"), F.col("s").alias("fs"), F.col("e").alias("fe"), F.explode(F.array(F.col("cs"), F.col("cs") + 1)).alias("cs"), "ce")
    first = first.withColumn("ce", F.explode(F.array(F.col("ce") - 1, F.col("ce"), F.col("ce") + 1)))
    first = into(first).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    near = (F.abs(F.col("s") - F.col("fs")) <= most) & (F.abs(F.col("e") - F.col("fe")) <= most)
    return first.join(later, [*keys, "block"]).filter(near & (F.struct("fs", "fe", "first_id") < F.struct("s", "e", "read_id"))).select("read_id", "first_id")
