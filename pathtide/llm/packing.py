"""Packing items of varying size into containers of a fixed capacity.

The sizes form a histogram of at most ``capacity`` bars, however many items there are. Patterns of a
few sizes that fill a container are enumerated on a coarse grid, their repeat counts are fitted to
the histogram by non-negative least squares and rounded down to what the bars hold. A pattern's last
item is the largest left that fits, so that what the grid rounds away is used as well. The residual
bars are packed best-fit first, also into the room the patterns leave. The plan speaks of "the r-th
item of size s" only; items are numbered within their size by Spark and look their container up.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathtide.operators.scan import scan, sharded
from pathtide.session import cut, sized_broadcast

#: Bars of the grid on which patterns are enumerated.
GRID = 256
#: Items of one numbering block; blocks keep a size that a third of all items share in many tasks.
BLOCK_ITEMS = 100_000


def nnls(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, b: np.ndarray, n_columns: int, tolerance: float = 1e-9, most: int = 5000) -> np.ndarray:
    """x >= 0 that makes A @ x near b in the least squares; A is given by its entries, sorted by column.

    Accelerated projected gradient, started anew whenever it overshoots, on rows weighted by the
    inverse root of b and columns of length 1, until the residual no longer falls.
    """
    if not len(rows):
        return np.zeros(n_columns)
    weight = 1 / np.sqrt(np.maximum(b, 1))
    entries, wanted = values * weight[rows], b * weight
    length = np.sqrt(np.bincount(columns, entries**2, n_columns))
    entries = entries / length[columns]
    times = lambda x: np.bincount(rows, entries * x[columns], len(b))
    turned = lambda r: np.bincount(columns, entries * r[rows], n_columns)
    v = np.ones(n_columns)
    for _ in range(50):
        v = turned(times(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.02 * float(v @ turned(times(v))))
    x = y = np.zeros(n_columns)
    t, last = 1.0, math.inf
    for i in range(most):
        new = np.maximum(0.0, y - step * turned(times(y) - wanted))
        if (y - new) @ (new - x) > 0:
            t = 1.0
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
        if i % 50 == 49:
            left = float(np.linalg.norm(times(x) - wanted))
            if last - left < tolerance * max(1.0, float(np.linalg.norm(wanted))):
                break
            last = left
    return x / length


def patterns(bars: list[int], grid: int) -> list[tuple[tuple[int, int], ...]]:
    """What fills ``grid`` exactly: one or two sizes of ``bars``, each any number of times, or three different ones; as ((size, times), ...), sizes falling."""
    have = sorted(bars, reverse=True)
    known, out = set(have), []
    for i, a in enumerate(have):
        for k in range(1, grid // a + 1):
            rest = grid - k * a
            if not rest:
                out.append(((a, k),))
            out += [((a, k), (rest // m, m)) for m in range(1, rest + 1) if rest % m == 0 and rest // m < a and rest // m in known]
        out += [((a, 1), (b, 1), (grid - a - b, 1)) for b in have[i + 1:] if 0 < grid - a - b < b and grid - a - b in known]
    return out


def fitted(want: dict[int, int], grid: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """The patterns of the histogram ``want`` on the grid with how often each is repeated, rounded down; those with the largest sizes first."""
    bars = sorted(want)
    index = {b: i for i, b in enumerate(bars)}
    shapes = patterns(bars, grid)
    entries = [(index[b], j, k) for j, shape in enumerate(shapes) for b, k in shape]
    rows, columns, values = (np.array([e[i] for e in entries], dtype=np.int64) for i in range(3))
    repeats = np.floor(nnls(rows, columns, values, np.array([want[b] for b in bars], dtype=float), len(shapes)) + 1e-6).astype(np.int64)
    return sorted(((shapes[j], int(repeats[j])) for j in np.nonzero(repeats)[0]), key=lambda x: (-x[0][0][0], x[0]))


def plan_packing(histogram: dict[int, int], capacity: int, grid: int = GRID, fit: bool = True) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(slots, containers): slots are (size, first rank, items, first container, items a container).

    Item r of a slot goes to container first + (r - first rank) // items a container. Every item of
    the histogram has exactly one place and no container is over its capacity. The work depends on
    the number of different sizes, not on the number of items. Without ``fit`` all is packed best-fit.
    """
    left = {s: n for s, n in histogram.items() if n > 0 and 0 < s <= capacity}
    sizes = sorted(left)
    used = dict.fromkeys(left, 0)
    slots: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[list[int]]] = {}  # free space: [first container, containers] runs
    made = 0

    def take(size: int, items: int, first: int, each: int) -> None:
        slots.append((size, used[size], items, first, each))
        used[size] += items
        left[size] -= items
        if not left[size]:
            del left[size]
            sizes.pop(bisect_left(sizes, size))

    def chosen(shape: tuple[tuple[int, int], ...]) -> Counter | None:
        """Sizes for one container: the largest left of each bar, and at last the largest left that fits."""
        picked: Counter = Counter()
        for b in [b for b, k in shape for _ in range(k)][:-1]:
            s = next((s for s in by_bar[b] if left.get(s, 0) > picked[s]), None)
            if s is None:
                return None
            picked[s] += 1
        at = bisect_right(sizes, capacity - sum(s * k for s, k in picked.items())) - 1
        while at >= 0 and left[sizes[at]] <= picked[sizes[at]]:
            at -= 1
        if at < 0:
            return None
        picked[sizes[at]] += 1
        return picked

    by_bar: dict[int, list[int]] = {}
    for s in reversed(sizes):
        by_bar.setdefault(min(grid, math.ceil(s * grid / capacity)), []).append(s)
    for shape, todo in fitted({b: sum(left[s] for s in own) for b, own in by_bar.items()}, grid) if fit and left else []:
        while todo > 0 and (picked := chosen(shape)):
            # A run of equal containers at a time.
            runs = min(todo, *(left[s] // k for s, k in picked.items()))
            for s, k in picked.items():
                take(s, runs * k, made, k)
            free = capacity - sum(s * k for s, k in picked.items())
            if free:
                room.setdefault(free, []).append([made, runs])
            made += runs
            todo -= runs
    # Residual: largest size first, into the tightest room that holds it, else a new container.
    for s in sorted(left, reverse=True):
        while left.get(s, 0):
            fitting = [f for f in room if f >= s]
            if not fitting:
                each = capacity // s
                runs = max(1, left[s] // each)
                items = min(each * runs, left[s])
                each = min(each, items)
                take(s, items, made, each)
                if capacity - each * s:
                    room.setdefault(capacity - each * s, []).append([made, runs])
                made += runs
                continue
            free = min(fitting)
            first, runs = room[free].pop()
            if not room[free]:
                del room[free]
            each = min(free // s, left[s])
            now = min(runs, left[s] // each)
            take(s, each * now, first, each)
            if now < runs:
                room.setdefault(free, []).append([first + now, runs - now])
            if free - each * s:
                room.setdefault(free - each * s, []).append([first, now])
    return slots, made


def _lookup(slots: list[tuple[int, int, int, int, int]]):
    """A pandas function that finds each (size, rank)'s container by binary search in the sorted plan."""
    plan = np.array(sorted(slots), dtype=np.int64).reshape(-1, 5)
    span = int((plan[:, 1] + plan[:, 2]).max()) + 1 if len(plan) else 1
    keys = plan[:, 0] * span + plan[:, 1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size, rank = pdf["size"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64)
            at = plan[np.searchsorted(keys, size * span + rank, side="right") - 1] if len(pdf) else plan[:0]
            place = at[:, 3] + (rank - at[:, 1]) // at[:, 4] if len(pdf) else np.zeros(0, np.int64)
            yield pd.DataFrame({"id": pdf["id"], "piece": pdf["piece"], "size": size, "container": place})

    return run


def pack(df: DataFrame, id_col: str, size_col: str, capacity: int, grid: int = GRID) -> DataFrame:
    """Each item's container: id, piece, n_pieces, size (of the piece), container.

    An item larger than the capacity is cut into pieces: full ones with a container each, and a rest
    that is packed like any item (piece numbers from 0). No other item is split. Items of size 0 or
    less, or of null size, take no room: one row, container null. A null id is an id like any other;
    repeated rows are items of their own. An empty table gives no rows.
    """
    if capacity <= 0:
        raise ValueError("the capacity must be above 0")
    kind = df.schema[id_col].dataType.simpleString()
    own = df.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("full"))
    whole = F.expr(f"full div {capacity}L")
    rest = F.expr(f"full % {capacity}L")
    own = cut(own.withColumn("whole", F.when(F.col("full") > capacity, whole).otherwise(F.lit(0))).withColumn("rest", F.when(F.col("full") > capacity, rest).otherwise(F.col("full"))))
    items = own.filter(F.col("rest") > 0).select("id", F.col("whole").alias("piece"), F.col("rest").alias("size"))
    # The number of bars is bounded by the capacity, so the histogram may come to the driver.
    histogram = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, made = plan_packing(histogram, capacity, grid)
    blocks = max(1, math.ceil(sum(histogram.values()) / BLOCK_ITEMS))
    items = items.withColumn("block", F.pmod(F.xxhash64("id", "piece"), F.lit(blocks)))
    counts = items.groupBy("size", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("size", "block").orderBy("id", "piece")) - 1
    ranked = items.withColumn("rank", rank).join(sized_broadcast(before, len(histogram) * blocks), ["size", "block"])
    ranked = ranked.select("id", "piece", "size", (F.col("rank") + F.col("before")).alias("rank"))
    placed = ranked.mapInPandas(_lookup(slots), f"id {kind}, piece long, size long, container long") if slots else items.select("id", "piece", "size", F.lit(None).cast("long").alias("container"))
    # Full pieces: containers after the planned ones, numbered by block and within it.
    large = own.filter(F.col("whole") > 0).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks * 16)))
    base = large.groupBy("block").agg(F.sum("whole").alias("n"))
    base = scan(sharded(base.withColumn("axis", F.lit(0)), ["axis"], "block", 4096), ["axis"], "block", sums={"upto": "n"})
    base = base.select("block", (F.col("upto") - F.col("n")).alias("base"))
    within = F.coalesce(F.sum("whole").over(Window.partitionBy("block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    large = large.withColumn("within", within).join(sized_broadcast(base, blocks * 16), "block")
    full = large.select("id", "whole", "rest", (F.lit(made) + F.col("base") + F.col("within")).alias("first")).select(
        "id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("piece"), F.lit(capacity).cast("long").alias("size"), "first"
    )
    full = full.select("id", "piece", "size", (F.col("first") + F.col("piece")).alias("container"))
    none = own.filter(F.coalesce(F.col("full"), F.lit(0)) <= 0).select("id", F.lit(0).cast("long").alias("piece"), F.coalesce(F.col("full"), F.lit(0)).alias("size"), F.lit(None).cast("long").alias("container"))
    return placed.unionByName(full).unionByName(none)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, capacity_tokens, fill (share of the room that is used)."""
    got = packed.filter(F.col("container").isNotNull()).agg(F.countDistinct("container").alias("containers"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"))
    return got.withColumn("capacity_tokens", F.lit(capacity)).withColumn("fill", F.col("tokens") / (F.col("containers") * capacity))
