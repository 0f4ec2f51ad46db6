"""Mixing sources to target shares of the total size, with capped repetition.

Weights are planned from one number per source. A source has its target share, at most what its
repetition limit allows. What sources at their limit leave over goes to the others by their token
shares raised to an exponent - a temperature - and no source gets more than its limit. The exponent
is bisected until these others are as diverse as their targets are, in entropy, or as near to that
as the limits allow. The weights are then realised as whole passes over a source and one partial pass,
taken block by block in a permuted order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathtide.session import sized_broadcast

#: Blocks a source's pass is cut into. Only the block in which the budget ends is read row by row.
BLOCKS = 4096
#: The highest exponent tried: there nearly all that is spread goes to the largest source.
HOTTEST = 8.0
_ROUNDS = 60


def powered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to the exponent and made to sum to 1; a share of 0 stays 0."""
    top = max(shares.values(), default=0.0)
    raw = {s: (q / top) ** exponent if q > 0 else 0.0 for s, q in shares.items()}
    total = sum(raw.values())
    return {s: x / total if total else 0.0 for s, x in raw.items()}


def entropy(shares: dict[str, float]) -> float:
    """In nats."""
    return -sum(p * math.log(p) for p in shares.values() if p > 0)


def bisected(diversity, wanted: float, low: float = 0.0, high: float = HOTTEST) -> float:
    """The exponent in [low, high] at which ``diversity``, which falls as the exponent rises, comes nearest to the wanted one."""
    if diversity(low) <= wanted:
        return low
    if diversity(high) >= wanted:
        return high
    for _ in range(_ROUNDS):
        mid = (low + high) / 2
        low, high = (mid, high) if diversity(mid) > wanted else (low, mid)
    return (low + high) / 2


def exponent_for_entropy(sizes: dict[str, float], wanted: float) -> float:
    """The exponent in [0, 1] whose powered shares come nearest to the wanted entropy; lower is flatter."""
    total = sum(sizes.values())
    if total <= 0:
        return 1.0
    shares = {s: n / total for s, n in sizes.items()}
    return bisected(lambda x: entropy(powered(shares, x)), wanted, 0.0, 1.0)


def spread(spare: float, shares: dict[str, float], room: dict[str, float], exponent: float) -> dict[str, float]:
    """``spare`` over the sources by powered shares, none beyond its room.

    Sources that would pass their room are filled, and the rest is spread again over the others
    with the same exponent; what is over when all are full stays unspent.
    """
    out = dict.fromkeys(shares, 0.0)
    free = {s for s in shares if room[s] > 0 and shares[s] > 0}
    while spare > 1e-15 and free:
        part = powered({s: shares[s] for s in free}, exponent)
        full = [s for s in free if spare * part[s] >= room[s] - out[s]]
        if not full:
            for s in free:
                out[s] += spare * part[s]
            break
        for s in full:
            spare -= room[s] - out[s]
            out[s] = room[s]
        free -= set(full)
    return out


def plan_weights(sizes: dict[str, int], targets: dict[str, float], repeats: dict[str, int], budget: float) -> tuple[dict[str, float], float]:
    """Each source's share of the budget, and the exponent by which what was left over is spread."""
    total = sum(sizes.values())
    limit = {s: repeats[s] * sizes[s] / budget if budget > 0 else 0.0 for s in sizes}
    base = {s: min(targets[s], limit[s]) for s in sizes}
    spare = max(0.0, min(1.0, sum(targets.values())) - sum(base.values()))
    shares = {s: n / total if total else 0.0 for s, n in sizes.items()}
    room = {s: limit[s] - base[s] for s in sizes}

    def mixed(exponent: float) -> dict[str, float]:
        extra = spread(spare, shares, room, exponent)
        return {s: base[s] + extra[s] for s in sizes}

    free = [s for s in sizes if room[s] > 1e-15 and shares[s] > 0]
    if spare <= 1e-15 or not free:
        return mixed(1.0), 1.0

    def diversity(weights: dict[str, float]) -> float:
        whole = sum(weights[s] for s in free)
        return entropy({s: weights[s] / whole for s in free}) if whole else 0.0

    exponent = bisected(lambda x: diversity(mixed(x)), diversity(targets))
    return mixed(exponent), exponent


def _listed(df: DataFrame, id_col: str, source_col: str, size_col: str, targets: DataFrame) -> tuple[DataFrame, list]:
    own = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(size_col).cast("long").alias("size"))
    own = own.filter((F.col("size") > 0) & F.col("source").isNotNull())
    wanted = targets.filter(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy("source")
    pair = F.struct(F.col("target_share").cast("double").alias("target_share"), F.coalesce(F.col("max_repeats"), F.lit(0)).cast("long").alias("max_repeats"))
    wanted = wanted.agg(F.max(pair).alias("t")).select("source", "t.*")
    sizes = own.groupBy("source").agg(F.sum("size").alias("tokens"))
    # As many rows as the target table has.
    rows = wanted.join(sizes, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens")).collect()
    return own, sorted(rows, key=lambda r: r["source"])


def plan_mix(df: DataFrame, id_col: str, source_col: str, size_col: str, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """The plan, one row per listed source: source, target_share, max_repeats, tokens, exponent, budget, total.

    targets: source, target_share, max_repeats. total, the budget of all, is ``budget`` tokens, by
    default those of all listed sources; budget is the source's own part of it. exponent is the one
    all sources share. A listed source without items has 0 tokens. Items with a null source or of no
    size, and targets with a null source or no share, take no part; null max_repeats allow none; a
    source listed twice counts once, with its larger share. An empty table gives sources with 0
    tokens.
    """
    _, rows = _listed(df, id_col, source_col, size_col, targets)
    sizes, repeats = {r["source"]: r["tokens"] for r in rows}, {r["source"]: r["max_repeats"] for r in rows}
    total = sum(sizes.values()) if budget is None else budget
    weights, exponent = plan_weights(sizes, {r["source"]: r["target_share"] for r in rows}, repeats, total)

    def own(s: str) -> int:
        most = repeats[s] * sizes[s]
        # At its limit a source gives its passes whole, whatever the fractions round to.
        return most if weights[s] * total >= most * (1 - 1e-12) else min(most, math.floor(weights[s] * total + 1e-6))

    out = [(r["source"], r["target_share"], r["max_repeats"], r["tokens"], exponent, own(r["source"]), total) for r in rows]
    return df.sparkSession.createDataFrame(out, "source string, target_share double, max_repeats long, tokens long, exponent double, budget long, total long")


def mix(df: DataFrame, id_col: str, source_col: str, size_col: str, plan: DataFrame, seed: int = 11, blocks: int = BLOCKS) -> DataFrame:
    """The mixture of :func:`plan_mix`: source, id, pass_no, size, position.

    Every source gives whole passes over its items and, from one more pass, as many items in permuted
    order as the budget left takes. position, in [0, 1), is where in its source's stream a copy lies:
    read in this order, any stretch of the mixture has the planned shares. No item comes more than
    max_repeats times.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(size_col).cast("long").alias("size")).filter("size > 0")
    asked = plan.filter("tokens > 0 and budget > 0").withColumn("passes", F.expr("budget div tokens")).withColumn("over", F.expr("budget % tokens"))
    n_sources = plan.count()
    rows = own.join(sized_broadcast(asked.select("source", "passes", "over", (F.col("budget") / F.col("tokens")).alias("rounds")), n_sources), "source")
    each = rows.withColumn("pass_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    fraction = (F.pmod(F.xxhash64("id", "pass_no", F.lit(seed)), F.lit(2**40)) / 2**40).alias("spot")
    each = each.withColumn("spot", fraction).withColumn("block", F.floor(F.col("spot") * blocks))
    whole = each.filter(F.col("pass_no") < F.col("passes"))
    partial = each.filter((F.col("pass_no") == F.col("passes")) & (F.col("over") > 0))
    sums = partial.groupBy("source", "block").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before)
    # At most ``blocks`` rows per listed source.
    placed = partial.join(sized_broadcast(sums, n_sources * blocks), ["source", "block"])
    inside = placed.filter(F.col("before") + F.col("n") <= F.col("over"))
    border = placed.filter((F.col("before") < F.col("over")) & (F.col("before") + F.col("n") > F.col("over")))
    run = F.sum("size").over(Window.partitionBy("source", "block").orderBy("spot", "id").rowsBetween(Window.unboundedPreceding, 0))
    border = border.withColumn("run", F.col("before") + run).filter(F.col("run") <= F.col("over"))
    # The partial pass may reach a little beyond its share of the pass.
    spot = F.least((F.col("pass_no") + F.col("spot")) / F.col("rounds"), F.lit(1 - 2.0**-40))
    cols = ["source", "id", "pass_no", "size", spot.alias("position")]
    return whole.select(*cols).unionByName(inside.select(*cols)).unionByName(border.select(*cols))


def mix_report(mixture: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan's columns with taken (tokens in the mixture), reached_share, repeats (taken / tokens) and short.

    short: the mixture has all that the source's repeats allow, and that is below its target share
    of the total (in whole tokens).
    """
    taken = mixture.groupBy("source").agg(F.sum("size").alias("taken"))
    got = plan.join(taken, "source", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    # One row a listed source.
    share = F.col("taken") / F.nullif(F.sum("taken").over(Window.partitionBy()), F.lit(0))
    got = got.withColumn("reached_share", F.coalesce(share, F.lit(0.0))).withColumn("repeats", F.coalesce(F.col("taken") / F.nullif(F.col("tokens"), F.lit(0)), F.lit(0.0)))
    most = F.col("max_repeats") * F.col("tokens")
    return got.withColumn("short", (F.col("taken") >= most) & (most < F.col("target_share") * F.col("total")))
