"""Prefix sums and neighbours along an axis, in two levels.

The axis of each key is cut into shards. Work within a shard is a window over (key, shard); across
shards only one summary row a shard goes on. A key with a third of all rows thus runs in as many
tasks as its axis has shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_WIDTH = 1 << 16


def sharded(df: DataFrame, keys: list[str], at: str, width: int = SHARD_WIDTH) -> DataFrame:
    """``df`` with the column ``shard``, partitioned by key and shard."""
    return df.withColumn("shard", F.floor(F.col(at) / width)).repartition(*keys, "shard")


def scan(df: DataFrame, keys: list[str], at: str | list[str], sums: dict[str, str] | None = None, before: dict[str, str] | None = None, after: dict[str, str] | None = None, mins: dict[str, str] | None = None) -> DataFrame:
    """Prefix sums, running minima and neighbours' values of a :func:`sharded` table, with one summary row a shard.

    ``sums`` maps new columns to the columns they sum up to and with the row (null counts as 0),
    ``mins`` to those whose least value so far they hold, ``before`` and ``after`` to the columns of
    the neighbour along the axis (null at the ends).
    ``at``, a column or a list of them that orders the rows and agrees with the shards' order, must
    be unique within a key.
    """
    order = [at] if isinstance(at, str) else at
    spot = F.struct(*order)
    sums, before, after, mins = sums or {}, before or {}, after or {}, mins or {}
    within = Window.partitionBy(*keys, "shard").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("shard")
    ends = [F.sum(v).alias(f"_t_{n}") for n, v in sums.items()] + [F.max_by(v, spot).alias(f"_b_{n}") for n, v in before.items()] + [F.min_by(v, spot).alias(f"_a_{n}") for n, v in after.items()] + [F.min(v).alias(f"_m_{n}") for n, v in mins.items()]
    edge = df.groupBy(*keys, "shard").agg(*ends).select(
        *keys, "shard",
        *[F.coalesce(F.sum(f"_t_{n}").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_t_{n}") for n in sums],
        *[F.lag(f"_b_{n}").over(across).alias(f"_b_{n}") for n in before],
        *[F.lead(f"_a_{n}").over(across).alias(f"_a_{n}") for n in after],
        *[F.min(f"_m_{n}").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_m_{n}") for n in mins],
    )
    out = df.select(
        "*", F.lag(F.lit(1)).over(within).isNull().alias("_first"), F.lead(F.lit(1)).over(within).isNull().alias("_last"),
        *[F.coalesce(F.sum(v).over(upto), F.lit(0)).alias(f"_s_{n}") for n, v in sums.items()],
        *[F.lag(v).over(within).alias(f"_l_{n}") for n, v in before.items()],
        *[F.lead(v).over(within).alias(f"_r_{n}") for n, v in after.items()],
        *[F.min(v).over(upto).alias(f"_n_{n}") for n, v in mins.items()],
    ).join(edge, [*keys, "shard"])
    return out.select(
        *df.columns,
        *[(F.col(f"_s_{n}") + F.col(f"_t_{n}")).alias(n) for n in sums],
        *[F.when(F.col("_first"), F.col(f"_b_{n}")).otherwise(F.col(f"_l_{n}")).alias(n) for n in before],
        *[F.when(F.col("_last"), F.col(f"_a_{n}")).otherwise(F.col(f"_r_{n}")).alias(n) for n in after],
        *[F.least(f"_n_{n}", f"_m_{n}").alias(n) for n in mins],
    )


def ranked(df: DataFrame, keys: list[str], score: str, tie: str, step: float, sums: dict[str, Column] | None = None, tie_step: int = 1 << 20) -> DataFrame:
    """``df`` with place (1 for the highest ``score``; the lower ``tie`` first on ties) and running sums in that order.

    The shards are stretches of the score of width ``step``, and within one score stretches of the
    tie of width ``tie_step``, so a key with very many rows is ranked in many tasks, also where
    most of them have one score. Scores must not be null or NaN, ties are whole numbers.
    """
    sums = {"place": F.lit(1), **(sums or {})}
    own = df.withColumn("_down", -F.col(score)).withColumns({f"_x_{n}": v for n, v in sums.items()})
    own = own.withColumn("_coarse", F.floor(F.col("_down") / step)).withColumn("_fine", F.floor(F.col(tie) / tie_step))
    # A stretch that holds several scores is one shard; a score that fills a stretch alone is cut by the tie.
    alone = own.groupBy(*keys, "_coarse").agg((F.min("_down") == F.max("_down")).alias("_alone"))
    own = own.join(alone, [*keys, "_coarse"]).withColumn("shard", F.struct("_coarse", F.when(F.col("_alone"), F.col("_fine")).otherwise(0).alias("_fine"))).repartition(*keys, "shard")
    got = scan(own, keys, ["_down", tie], sums={n: f"_x_{n}" for n in sums})
    return got.select(*df.columns, *[F.col(n).cast("long").alias(n) for n in sums])
