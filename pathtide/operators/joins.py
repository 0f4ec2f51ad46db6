"""Joins on positions - ranges that overlap, the last row at or before a position - and on keys that may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathtide.session import cut, sized_broadcast

#: Rows of one key, or of one bin and side, that are joined in one part.
PART = 4096
#: Width of a bin of the range join.
BIN = 1 << 12


def attach(rows: DataFrame, table: DataFrame, key: list[str], by: list[str], part: int = PART) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row or a few a key; rows without one are left out.

    The rows of a key with more than ``part`` of them are divided by their columns ``by``, and the
    key's rows of ``table`` go to every part.
    """
    hot = cut(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > part).select(*key, F.ceil(F.col("_n") / part).alias("_parts")))
    hot = sized_broadcast(hot, hot.count())
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(*by), parts)).drop("_parts")
    right = table.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return left.join(right, [*key, "_part"]).drop("_part")


def lookup(rows: DataFrame, table: DataFrame, key: list[str], n_rows: int, by: list[str], few: int = 100_000) -> DataFrame:
    """``rows`` joined with ``table`` of ``n_rows`` counted rows: broadcast if these are few, else with hot keys of ``rows`` divided by their columns ``by``."""
    return rows.join(sized_broadcast(table, n_rows, few), key) if n_rows <= few else attach(rows, table, key, by)


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], a_range: tuple[str, str], b_range: tuple[str, str], width: int = BIN, hot: int | None = None) -> DataFrame:
    """Pairs of rows with equal keys whose half-open ranges overlap, each pair once.

    Both sides are listed by the bins they touch and joined on key and bin; a pair is kept only in
    the bin where its overlap begins. With ``hot``, bins in which ``a`` has more rows than that are
    counted first and divided: every part meets all of the bin's rows of ``b``. The two tables'
    other column names must differ.
    """
    (a0, a1), (b0, b1) = a_range, b_range
    on = [*keys, "_bin"]

    def binned(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.filter(F.col(lo) < F.col(hi)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))

    left, right = binned(a, a0, a1), binned(b, b0, b1)
    if hot is not None:
        full = cut(left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot).select(*on, F.ceil(F.col("_n") / hot).alias("_parts")))
        n_full = full.count()
        if n_full:
            full, parts = sized_broadcast(full, n_full), F.coalesce("_parts", F.lit(1))
            left = left.join(full, on, "left").withColumn("_part", F.pmod(F.xxhash64(*a.columns), parts)).drop("_parts")
            right = right.join(full, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
            on = [*on, "_part"]
    joined = left.join(right, on)
    first = F.floor(F.greatest(a0, b0) / width)
    return joined.filter((F.col(a0) < F.col(b1)) & (F.col(b0) < F.col(a1)) & (F.col("_bin") == first)).drop("_bin", "_part")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, columns: list[str], width: int = 1 << 16) -> DataFrame:
    """``left`` with the ``columns`` of the last row of ``right`` at or before ``at``; null where there is none.

    A merge of both sides by position, in shards: a shard takes over the last right row of the
    shards before it. Right rows must be unique by key and position.
    """
    packed = F.struct(F.col(right_at).alias("_at"), *columns)
    kind = right.select(packed.alias("_v")).schema["_v"].dataType
    ls = left.select(*keys, F.col(at).alias("_p"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_v"), F.struct(*left.columns).alias("_row"))
    rs = right.select(*keys, F.col(right_at).alias("_p"), F.lit(0).alias("_side"), packed.alias("_v"), F.lit(None).cast(ls.schema["_row"].dataType).alias("_row"))
    both = ls.unionByName(rs).filter(F.col("_p").isNotNull()).withColumn("_shard", F.floor(F.col("_p") / width)).repartition(*keys, "_shard")
    within = Window.partitionBy(*keys, "_shard").orderBy("_p", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = both.groupBy(*keys, "_shard").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.col("_p"))).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*keys, "_shard", F.last("_last", ignorenulls=True).over(across).alias("_carry"))
    found = both.withColumn("_f", F.last("_v", ignorenulls=True).over(within)).filter("_side = 1").join(carry, [*keys, "_shard"])
    return found.withColumn("_f", F.coalesce("_f", "_carry")).select("_row.*", *[F.col(f"_f.{c}").alias(c) for c in columns])
