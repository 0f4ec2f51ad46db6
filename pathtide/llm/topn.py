"""The N best items of every group, by bisecting all groups' cutoffs at once.

Each item has an order-preserving code of its score and identifier. Every pass counts, for all open
groups together, the rows above a set of midpoints, keeps the one stretch the cutoff lies in, and
goes on with the rows of that stretch only. A group's state goes to its rows as a broadcast of
counted size, or else to every part of the rows, which are divided by their item: no group is ever
gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, LongType

from pathtide.session import cut, sized_broadcast

#: Stretches a pass divides each open group's range into.
STRETCHES = 64
#: Groups whose state is broadcast, and the parts of a group's rows where it is not.
BROADCAST, PARTS = 100_000, 32
_LEVELS = ["v0", "v1", "v2", "v3"]


@F.pandas_udf(LongType())
def _double_code(x: pd.Series) -> pd.Series:
    """Longs that rise with the doubles; both zeros are equal."""
    bits = (x.to_numpy(dtype=np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF)))


def _halves(code: Column) -> list[Column]:
    """A signed long as two halves of 32 bits that keep its order, each a long from 0 up."""
    return [F.shiftright(code, 32) + F.lit(2**31), code.bitwiseAND(F.lit(2**32 - 1))]


def _coded(df: DataFrame, group: list[str], score: str, item: str) -> DataFrame:
    gs = [f"g{i}" for i in range(len(group))]
    kind = df.schema[score].dataType
    got = df.select(*[F.col(g).alias(a) for g, a in zip(group, gs, strict=True)], F.col(score).alias("s"), F.col(item).cast("long").alias("i"))
    got = got.dropna(subset=[*gs, "s", "i"])
    if isinstance(kind, (DoubleType, FloatType)):
        got = got.filter(~F.isnan("s")).withColumn("s", F.col("s").cast("double"))
    got = got.groupBy(*gs, "i").agg(F.max("s").alias("s"))
    code = _double_code("s") if isinstance(kind, (DoubleType, FloatType)) else F.col("s").cast("long")
    got = got.withColumn("c", code)
    parts = _halves(F.col("c")) + _halves(F.bitwise_not("i"))
    return got.select(*gs, "i", *[p.alias(v) for p, v in zip(parts, _LEVELS, strict=True)])


def _at(level: Column, values: list[Column]) -> Column:
    out = values[-1]
    for k in range(len(values) - 2, -1, -1):
        out = F.when(level == k, values[k]).otherwise(out)
    return out


def _bounds() -> list[Column]:
    return [f(v).alias(f"{t}{k}") for k, v in enumerate(_LEVELS) for f, t in ((F.min, "lo"), (F.max, "hi"))]


def _open_at(lows: list[Column], highs: list[Column]) -> Column:
    """The first level on which rows still differ."""
    out = F.lit(3)
    for k in (2, 1, 0):
        out = F.when(lows[k] < highs[k], F.lit(k)).otherwise(out)
    return out


def _told(rows: DataFrame, state: DataFrame, gs: list[str], n_groups: int, few: int, how: str = "inner") -> DataFrame:
    """``rows`` with their group's row of ``state``."""
    if n_groups <= few:
        return rows.join(sized_broadcast(state, n_groups, few), gs, how)
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    divided = rows.withColumn("part", F.pmod(F.xxhash64("i"), F.lit(PARTS)).cast("int"))
    return divided.join(state.withColumn("part", parts), [*gs, "part"], how).drop("part")


def top_n(df: DataFrame, group: list[str], score: str, item: str, n: int, stretches: int = STRETCHES, few: int = BROADCAST) -> DataFrame:
    """The ``n`` items with the highest ``score`` of each group; on ties the lower ``item`` comes first.

    Result: the group columns and the item, unordered; a group with fewer items keeps them all.
    ``item`` is an integer id, ``score`` a double, float or integer. Rows with a null group column,
    item or score, or a NaN score, take no part. An item that is repeated in a group counts once,
    with its highest score. Infinite scores rank as such. An empty table or n = 0 gives no rows.
    """
    gs = [f"g{i}" for i in range(len(group))]
    names = [F.col(a).alias(g) for g, a in zip(group, gs, strict=True)]
    if n <= 0:
        return df.select(*group, F.col(item).cast("long").alias(item)).limit(0)
    rows = cut(_coded(df, group, score, item))
    lows, highs = [F.col(f"lo{k}") for k in range(4)], [F.col(f"hi{k}") for k in range(4)]
    # The first count: groups of n rows or fewer need no cutoff.
    state = rows.groupBy(*gs).agg(F.count(F.lit(1)).alias("n_rows"), *_bounds()).filter(F.col("n_rows") > n).withColumn("need", F.lit(n).cast("long"))
    state = cut(state.drop("n_rows"))
    left, open_rows, done = state.count(), rows, []
    while left:
        level = _open_at(lows, highs)
        lo, hi = _at(level, lows), _at(level, highs)
        step = F.expr(f"(w + {stretches} - 1) div {stretches}")
        asked = state.select(*gs, "need", level.alias("level"), lo.alias("lo"), (hi - lo + 1).alias("w"), *lows[:3]).withColumn("step", step)
        asked = asked.withColumnsRenamed({f"lo{k}": f"p{k}" for k in range(3)})
        placed = _told(open_rows, asked, gs, left, few)
        placed = placed.withColumn("digit", F.floor((_at(F.col("level"), [F.col(v) for v in _LEVELS]) - F.col("lo")) / F.col("step")))
        counts = placed.groupBy(*gs, "digit").agg(F.count(F.lit(1)).alias("n_rows"), F.first("need").alias("need"), F.first("level").alias("level"), F.first(F.col("lo") + F.col("digit") * F.col("step")).alias("edge"), *_bounds())
        above = F.sum("n_rows").over(Window.partitionBy(*gs).orderBy(F.desc("digit")).rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumn("above", F.coalesce(above, F.lit(0)))
        here = cut(counts.filter((F.col("above") < F.col("need")) & (F.col("need") <= F.col("above") + F.col("n_rows"))))
        met = F.col("need") == F.col("above") + F.col("n_rows")
        # A cutoff: equal to the rows' code on the levels before, at least the edge on this one.
        ends = [F.when(F.col("level") > k, F.col(f"lo{k}")).when(F.col("level") == k, F.col("edge")).otherwise(F.lit(0)).cast("long").alias(f"k{k}") for k in range(4)]
        done.append(here.filter(met).select(*gs, *ends))
        state = here.filter(~met).select(*gs, (F.col("need") - F.col("above")).alias("need"), *lows, *highs)
        left = state.count()
        if left:
            inside = F.lit(True)
            for k, v in enumerate(_LEVELS):
                inside = inside & F.col(v).between(lows[k], highs[k])
            open_rows = cut(_told(open_rows, state.drop("need"), gs, left, few).filter(inside).select(*gs, "i", *_LEVELS))
    if not done:
        return rows.select(*names, F.col("i").alias(item))
    cuts = done[0]
    for d in done[1:]:
        cuts = cuts.unionByName(d)
    cuts = cut(cuts)
    kept = _told(rows, cuts, gs, cuts.count(), few, "left")
    code, bar = F.struct(*_LEVELS), F.struct(*[F.coalesce(F.col(f"k{k}"), F.lit(0)).cast("long").alias(v) for k, v in enumerate(_LEVELS)])
    return kept.filter(code >= bar).select(*names, F.col("i").alias(item))
