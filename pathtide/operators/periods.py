"""Merging overlapping intervals into periods, and the gaps between them, in two levels.

Intervals are clipped to shards of the axis, merged within each shard, and only the pieces that
touch a shard's border are stitched along the whole axis. An entity with a third of all rows is
thereby spread over as many tasks as its axis has shards; a shard that alone has very many rows is
merged in blocks of them first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathtide.session import cut, sized_broadcast

#: Width of a shard on the interval axis, and the rows of one that are merged in one task.
SHARD_WIDTH, HOT_SHARD = 1 << 16, 1_000_000


def _tagged(df: DataFrame, keys: list[str], start: str, end: str, member: str | None, width: int) -> DataFrame:
    """Key columns k0.., bounds a < b, the member id m, and the first and last shard touched."""
    own = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    got = df.select(*own, F.col(start).cast("long").alias("a"), F.col(end).cast("long").alias("b"), (F.col(member) if member else F.lit(None).cast("long")).alias("m"))
    got = got.filter(F.col("a") < F.col("b")).dropna(subset=[f"k{i}" for i in range(len(keys))])
    first, last = F.expr(f"a - pmod(a, {width}L)"), F.expr(f"b - 1 - pmod(b - 1, {width}L)")
    return got.withColumn("s0", first).withColumn("s1", last)


def _pieces(rows: DataFrame, ks: list[str], width: int) -> DataFrame:
    """Clipped pieces (keys, shard, cs, ce, n, m): n is 1 on the piece with the interval's start.

    An interval gives a piece in its first and its last shard. The shards wholly inside it are
    not listed per interval: they are first merged to runs of shards per key, of which there are
    no more than the axis has shards, and each covered shard gives one piece.
    """
    ends = F.when(F.col("s0") == F.col("s1"), F.array(F.struct(F.col("s0").alias("shard"), F.col("a").alias("cs"), F.col("b").alias("ce"), F.lit(1).alias("n")))).otherwise(
        F.array(
            F.struct(F.col("s0").alias("shard"), F.col("a").alias("cs"), (F.col("s0") + width).alias("ce"), F.lit(1).alias("n")),
            F.struct(F.col("s1").alias("shard"), F.col("s1").alias("cs"), F.col("b").alias("ce"), F.lit(0).alias("n")),
        )
    )
    edge = rows.select(*ks, "m", F.inline(ends))
    inner = rows.filter(F.col("s1") - F.col("s0") > width).groupBy(*ks, "s0").agg(F.max("s1").alias("s1"))
    w = Window.partitionBy(*ks).orderBy("s0")
    runs = (
        inner.select(*ks, (F.col("s0") + width).alias("s0"), "s1")
        .withColumn("prev", F.max("s1").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("s0", F.greatest("s0", F.coalesce("prev", "s0")))
        .filter(F.col("s0") < F.col("s1"))
    )
    whole = runs.select(*ks, F.explode(F.sequence("s0", F.col("s1") - width, F.lit(width).cast("long"))).alias("shard"))
    none = F.lit(None).cast(rows.schema["m"].dataType).alias("m")
    return edge.unionByName(whole.select(*ks, none, "shard", F.col("shard").alias("cs"), (F.col("shard") + width).alias("ce"), F.lit(0).alias("n")))


def _islands(pieces: DataFrame, part: list[str]) -> DataFrame:
    """Merged pieces of each partition: ps, pe, n members, and the next island's start."""
    w = Window.partitionBy(*part).orderBy("cs", "ce")
    before, full = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = pieces.select(
        *part, "cs", "ce",
        F.max("ce").over(before).alias("reach"), F.sum("n").over(before).alias("seen"),
        F.max("ce").over(full).alias("all_reach"), F.sum("n").over(full).alias("all_seen"),
    ).filter(F.col("reach").isNull() | (F.col("cs") > F.col("reach")))
    return heads.select(
        *part, F.col("cs").alias("ps"),
        F.coalesce(F.lead("reach").over(w), "all_reach").alias("pe"),
        (F.coalesce(F.lead("seen").over(w), "all_seen") - F.coalesce("seen", F.lit(0))).alias("n"),
        F.lead("cs").over(w).alias("next_ps"),
    )


def merge_periods(df: DataFrame, keys: list[str], start: str, end: str, member: str | None = None, width: int = SHARD_WIDTH, hot: int = HOT_SHARD) -> DataFrame:
    """Continuous periods and the gaps between them, per ``keys``.

    Result: the key columns, kind (``period`` or ``gap``), start_pos, end_pos, n_members. Intervals
    are half-open; those that overlap or touch belong to one period. Rows with a null key or bound
    or an end not above the start take no part. With ``member``, rows that repeat a member id with
    the same key and bounds count once (null is a member like any other); without it every row
    counts. n_members is null for gaps. Other columns are ignored, whatever their names. An
    empty table gives an empty result.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    part = [*ks, "shard"]
    rows = _tagged(df, keys, start, end, member, width)
    pieces = _pieces(rows, ks, width)

    def merged(some: DataFrame, by: list[str]) -> DataFrame:
        # One exchange serves the removal of repeats and the windows after it.
        some = some.repartition(*by)
        return _islands(some.dropDuplicates([*by, "cs", "ce", "n", "m"]) if member else some, by)

    crowded = cut(pieces.groupBy(*part).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > hot))
    n_crowded = crowded.count()
    if n_crowded:
        marked = pieces.join(sized_broadcast(crowded, n_crowded), part, "left")
        dense = marked.filter("rows is not null").withColumn("block", F.pmod(F.xxhash64("m", "cs", "ce"), F.ceil(F.col("rows") / hot)))
        # Each block's islands are pieces of the shard in their turn.
        islands = merged(dense, [*part, "block"]).select(*part, F.col("ps").alias("cs"), F.col("pe").alias("ce"), "n")
        local = merged(marked.filter("rows is null"), part).unionByName(_islands(islands.repartition(*part), part))
    else:
        local = merged(pieces, part)
    # The islands feed three small outputs: written once, they are read with pruned columns.
    local = cut(local)
    at_border = (F.col("ps") == F.col("shard")) | (F.col("pe") == F.col("shard") + width)

    period = lambda a, b, n: F.struct(F.lit("period").alias("kind"), a.alias("x"), b.alias("y"), n.cast("long").alias("n"))
    gap = lambda a, b: F.struct(F.lit("gap").alias("kind"), a.alias("x"), b.alias("y"), F.lit(None).cast("long").alias("n"))
    none = F.lit(None)
    inside = local.select(
        *ks,
        F.inline(F.array_compact(F.array(
            F.when(~at_border, period(F.col("ps"), F.col("pe"), F.col("n"))).otherwise(none),
            F.when(F.col("next_ps").isNotNull(), gap(F.col("pe"), F.col("next_ps"))).otherwise(none),
        ))),
    )
    # Stitching: at most two islands and one summary row a shard go on to the whole axis.
    edge = local.filter(at_border).select(*ks, F.col("ps").alias("cs"), F.col("pe").alias("ce"), "n")
    stitched = _islands(edge, ks).select(*ks, F.lit("period").alias("kind"), F.col("ps").alias("x"), F.col("pe").alias("y"), F.col("n").cast("long").alias("n"))
    shards = local.groupBy(*part).agg(F.min("ps").alias("lo"), F.max("pe").alias("hi"))
    across = (
        shards.withColumn("nxt", F.lead("lo").over(Window.partitionBy(*ks).orderBy("shard")))
        .filter(F.col("nxt") > F.col("hi"))
        .select(*ks, F.lit("gap").alias("kind"), F.col("hi").alias("x"), F.col("nxt").alias("y"), F.lit(None).cast("long").alias("n"))
    )
    out = inside.unionByName(stitched).unionByName(across)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "kind", F.col("x").alias("start_pos"), F.col("y").alias("end_pos"), F.col("n").alias("n_members"))
