"""Probabilistic record linkage: blocking, agreement levels, expectation-maximisation, posterior.

Pairs come from several blocking passes. Each pair is described by one agreement level per
comparison; Spark counts how often each pattern of levels occurs, and from these counts alone - of
which there are no more than the product of the levels - the chances of every level among matches
and non-matches are estimated. The posterior of a pair is its confidence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Comparison:
    """Levels are tried in order, from full agreement to none; a pair that meets none has the last level.

    ``missing`` tells that a value isn't known: such a pair has no level and counts for neither side.
    """

    name: str
    levels: list[Column]
    missing: Column | None = None

    def level(self) -> Column:
        out = F.lit(len(self.levels))
        for k in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[k], F.lit(k)).otherwise(out)
        return (F.when(F.coalesce(self.missing, F.lit(True)), F.lit(-1)).otherwise(out) if self.missing is not None else out).alias(f"c_{self.name}")


@dataclass
class Model:
    """Chances of each level among matches (m) and non-matches (u), and the share of matches."""

    names: list[str]
    m: list[np.ndarray]
    u: list[np.ndarray]
    share: float

    def posterior(self) -> Column:
        """The chance that a pair with the columns c_<name> is a match."""
        odds = F.lit(float(np.log(self.share) - np.log1p(-self.share)))
        for name, m, u in zip(self.names, self.m, self.u, strict=True):
            part = F.lit(0.0)
            for k, (a, b) in enumerate(zip(m, u, strict=True)):
                part = F.when(F.col(f"c_{name}") == k, F.lit(float(np.log(a) - np.log(b)))).otherwise(part)
            odds = odds + part
        return 1 / (1 + F.exp(-odds))


def estimate(patterns: np.ndarray, counts: np.ndarray, names: list[str], sizes: list[int], rounds: int = 200, share: float = 0.5, able: np.ndarray | None = None, prior: float = 0.1) -> Model:
    """EM over pattern counts. patterns: (patterns, comparisons) levels from 0, -1 where unknown.

    It begins with matches agreeing on most comparisons and non-matches on none in particular, so
    that the matches are the agreeing side whatever their share. So many pairs of that beginning,
    ``prior`` a level, are added to what is counted: a level unseen so far keeps a chance above 0, and
    few pairs that all agree more or less aren't split into matches and others. ``able``, at most ``counts``, is how many
    of a pattern's pairs can be matches at all, as their owners' match tells; the share is of these.
    """
    k = len(names)
    hot = [np.array([patterns[:, j] == v for v in range(sizes[j])], dtype=float) for j in range(k)]
    able = counts if able is None else able
    total = max(float(able.sum()), 1e-9)
    m = [np.array([0.3**v for v in range(s)]) for s in sizes]
    m = [x / x.sum() for x in m]
    u = [np.full(s, 1.0 / s) for s in sizes]
    m_prior, u_prior = ([prior * len(x) * x for x in side] for side in (m, u))
    for _ in range(rounds):
        logit = np.log(share) - np.log1p(-share) + sum(h.T @ (np.log(a) - np.log(b)) for h, a, b in zip(hot, m, u, strict=True))
        p = 1 / (1 + np.exp(-np.clip(logit, -700, 700)))
        match = able * p
        other = counts - match
        new = float(np.clip(match.sum() / total, 1e-9, 1 - 1e-9))
        m, u = ([(h @ n + a) / (h @ n + a).sum() for h, a in zip(hot, added, strict=True)] for n, added in ((match, m_prior), (other, u_prior)))
        done, share = abs(new - share) < 1e-10, new
        if done:
            break
    return Model(names, m, u, share)


def block(left: DataFrame, right: DataFrame, passes: list[tuple[list[Column], list[Column]]], spread: int = 1) -> DataFrame:
    """Pairs of rows that share a key of any pass; a pair that shares several comes as often.

    A pass has the key columns of either side; a key column that is an array stands for each of its
    values. Rows with a null key take no part in a pass. A key's pairs are made in ``spread`` parts
    of the left rows, so that a hot key is work for many tasks. The two tables' column names must
    differ.
    """
    found = []
    for lk, rk in passes:
        sides = []
        for df, keys in ((left, lk), (right, rk)):
            own = df.columns
            for i, key in enumerate(keys):
                df = df.withColumn(f"_k{i}", key)
                if df.schema[f"_k{i}"].dataType.typeName() == "array":
                    df = df.withColumn(f"_k{i}", F.explode(F.array_distinct(f"_k{i}")))
            part = F.pmod(F.xxhash64(*own), F.lit(spread)) if not sides else F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long")))
            sides.append(df.select(*own, *[f"_k{i}" for i in range(len(keys))], part.alias("_part")))
        found.append(sides[0].join(sides[1], [*[f"_k{i}" for i in range(len(lk))], "_part"]).select(*left.columns, *right.columns))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def fit(compared: DataFrame, comparisons: list[Comparison], able: str | None = None, prior: float = 0.1) -> Model:
    """The model of the pairs in ``compared``, which has a column c_<name> for each comparison.

    ``able`` names a column with the chance that a pair's owners match at all.
    """
    names = [c.name for c in comparisons]
    n = F.count(F.lit(1)).cast("double")
    rows = compared.groupBy(*[f"c_{n}" for n in names]).agg(n.alias("n"), (F.sum(able) if able else n).alias("able")).collect()
    sizes = [len(c.levels) + 1 for c in comparisons]
    patterns = np.array([[r[f"c_{n}"] for n in names] for r in rows], dtype=np.int64).reshape(-1, len(names))
    return estimate(patterns, np.array([r["n"] for r in rows], dtype=float), names, sizes, able=np.array([r["able"] for r in rows], dtype=float), prior=prior)
