"""All pairs of records whose value sets overlap above a Jaccard threshold.

Records with the same set form one class first. Each class gets a minwise signature, cut into
bands; classes that share a band's bucket are candidates, and every candidate pair is verified on
the sets themselves.

The signature of a small set is its least hashes (bottom-k). Of two similar sets the g values in
common with the least hashes are among either one's size - least overlap + g least ones, so bands
of g of these miss no pair at all. A set with more such bands than ordinary ones gets the ordinary
signature: bands of independent minima, with a chance of at most ``miss`` to miss a pair at the
threshold. Buckets that very many classes share are divided by one more hash, or worked in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathtide.llm.classes import members_of_links
from pathtide.operators.joins import attach
from pathtide.session import cut, sized_broadcast

#: Classes a bucket may hold before it is divided.
HOT_BUCKET = 2_000
#: Hashes in a band of a small set, and the most that a hot bucket is divided to.
GRAIN, FINEST = 2, 5
_EPS = 1e-9
#: A class code ends in the size of its set, up to this.
_SIZES = 0xFFF


def bands_for(threshold: float, rows: int, miss: float) -> int:
    """Bands of ``rows`` hashes for which a pair at the threshold is missed with chance ``miss`` at most."""
    if threshold >= 1:
        return 1
    return max(1, math.ceil(math.log(miss) / math.log1p(-(threshold**rows))))


def least_overlap(size: int, threshold: float) -> int:
    """The fewest values a set of ``size`` has in common with any set similar to it."""
    return max(1, math.ceil(threshold * size - _EPS))


def small_bands(size: int, threshold: float, grain: int) -> int:
    """Bands of ``grain`` of the least hashes of a set of ``size``."""
    return math.comb(min(size, size - least_overlap(size, threshold) + grain), grain)


def largest_small(threshold: float, bands: int) -> int:
    """The largest size up to which a set has no more bands of its least hashes than ordinary ones."""
    size = 1
    while size < 10_000 and small_bands(size + 1, threshold, GRAIN) <= bands:
        size += 1
    return size


@lru_cache(maxsize=4096)
def _chosen(prefix: int, grain: int) -> np.ndarray:
    return np.array(list(combinations(range(prefix), grain)), dtype=np.int64).reshape(-1, grain)


_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _C1
    x = (x ^ (x >> np.uint64(33))) * _C2
    return x ^ (x >> np.uint64(33))


def _joined(values: np.ndarray, seed: int) -> np.ndarray:
    """One code for the hashes in each row of the last axis, in their order."""
    code = np.full(values.shape[:-1], seed, dtype=np.uint64)
    for r in range(values.shape[-1]):
        code = _mixed(code ^ values[..., r] + np.uint64(r))
    return code


def _small_buckets(sorted_hashes: np.ndarray, threshold: float, grain: int) -> list[np.ndarray]:
    """The bands of sets of one size: for each the columns (bucket, bucket of all but its last hash)."""
    size = sorted_hashes.shape[1]
    low = least_overlap(size, threshold)
    out = []
    # Sets that may have fewer values in common meet on all of them.
    for g in sorted({min(grain, low), grain}):
        if g > size:
            continue
        picked = sorted_hashes[:, _chosen(min(size, size - low + g), g)]
        out.append(np.stack([_joined(picked, g), _joined(picked[..., :-1], g - 1)], axis=-1))
    return out


def _large_buckets(flat: np.ndarray, starts: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    seeds = rng.integers(0, 2**63, size=bands * rows, dtype=np.uint64)
    out = np.empty((len(starts), bands), dtype=np.uint64)
    for b in range(bands):
        least = [np.minimum.reduceat(_mixed(flat ^ seeds[b * rows + r]), starts) for r in range(rows)]
        out[:, b] = _joined(np.stack(least, axis=-1), 1000 + b)
    return out


def _signer(threshold: float, bands: int, rows: int, seed: int, grain: int, small: int, large: bool):
    """An Arrow function: (code, items as hashes) to (code, bits, buckets, parents).

    bits has one bit a value, so that the bits in which two sets differ are no more than their
    different values. parents are the buckets one hash shorter. ``large`` adds the ordinary bands of
    the sets above ``small`` values.
    """
    salt = np.uint64(np.random.default_rng(seed + 1).integers(0, 2**63))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            items = batch.column("items")
            flat = np.asarray(items.flatten()).astype(np.int64).view(np.uint64)
            offsets = np.asarray(items.offsets).astype(np.int64) - items.offsets[0].as_py()
            starts, sizes = offsets[:-1], np.diff(offsets)
            hashes = _mixed(flat ^ salt)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (hashes >> np.uint64(58)), starts)
            found = []  # (row numbers, buckets, parents)
            for size in np.unique(sizes):
                if size > small / threshold:
                    continue
                own = np.nonzero(sizes == size)[0]
                ranked = np.sort(hashes[starts[own][:, None] + np.arange(size)], axis=1)
                for both in _small_buckets(ranked, threshold, grain):
                    found.append((np.repeat(own, both.shape[1]), both[..., 0].reshape(-1), both[..., 1].reshape(-1)))
            wide = np.nonzero(sizes > small)[0]
            if large and len(wide):
                own = np.concatenate([flat[starts[i]:starts[i] + sizes[i]] for i in wide])
                at = np.concatenate([[0], np.cumsum(sizes[wide])[:-1]])
                got = _large_buckets(own, at, bands, rows, seed).reshape(-1)
                found.append((np.repeat(wide, bands), got, got))
            if not found:
                continue
            row = np.concatenate([f[0] for f in found])
            order = np.argsort(row, kind="stable")
            bucket, parent = (np.concatenate([f[k] for f in found])[order].view(np.int64) for k in (1, 2))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (bucket, parent)]
            yield pa.RecordBatch.from_arrays([batch.column("code"), pa.array(bits.view(np.int64)), *lists], names=["code", "bits", "buckets", "parents"])

    return run


def set_records(df: DataFrame, id_col: str, set_col: str) -> DataFrame:
    """(id, items, c1, c2): the distinct non-null values of each record, and its class as a 128-bit code of the set.

    Records with a null id, or without any value, take no part. An id with several different sets
    takes part with each of them. A record delivered again comes again; those who list members
    count it once.
    """
    got = df.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.array_compact(F.col(set_col)))).alias("items"))
    got = got.filter(F.col("id").isNotNull() & (F.size("items") > 0))
    code: list[Column] = [F.xxhash64("items").alias("c1"), F.xxhash64(F.lit("second"), "items", F.size("items")).alias("c2")]
    return got.select("id", "items", *code)


def _met(a: DataFrame, b: DataFrame, on: list[str], threshold: float) -> DataFrame:
    """Pairs of codes a < b of one bucket that sizes and differing bits allow to be similar."""
    a = a.select(*on, F.col("code").alias("a"), F.col("bits").alias("xa"))
    b = b.select(*on, F.col("code").alias("b"), F.col("bits").alias("xb"))
    na, nb = F.col("a").bitwiseAND(F.lit(_SIZES)), F.col("b").bitwiseAND(F.lit(_SIZES))
    fits = (F.least(na, nb) + _EPS >= threshold * F.greatest(na, nb)) & (F.bit_count(F.col("xa").bitwiseXOR(F.col("xb"))) <= (1 - threshold) / (1 + threshold) * (na + nb) + _EPS)
    # A size that doesn't fit its field is unknown.
    return a.join(b, on).filter((F.col("a") < F.col("b")) & (fits | (F.greatest(na, nb) == _SIZES))).select("a", "b")


def _hot_buckets(each: DataFrame, hot: int) -> DataFrame:
    """Buckets with more than ``hot`` rows. Whole slots of buckets are counted first: a bucket in a slot that isn't hot isn't either."""
    slots = 1 << min(22, max(10, (each.count() * 16 // max(1, hot)).bit_length()))
    slot = F.pmod("bucket", F.lit(slots))
    full = cut(each.groupBy(slot.alias("slot")).count().filter(F.col("count") > hot).select("slot"))
    # No more slots than there are at all.
    near = each.withColumn("slot", slot).join(sized_broadcast(full, slots, slots), "slot", "left_semi")
    return cut(near.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot))


def _candidates(classes: DataFrame, threshold: float, rows: int, miss: float, seed: int, hot: int) -> DataFrame:
    """Distinct pairs of class codes a < b that share a bucket and may reach the threshold."""
    bands = bands_for(threshold, rows, miss)
    small = largest_small(threshold, bands)
    # Different sets of so few values can't reach the threshold: at best size / (size + 1).
    narrow = classes.filter(F.size("items") + _EPS >= threshold / (1 - threshold) if threshold < 1 else F.lit(False))
    narrow = narrow.select("code", F.transform("items", lambda x: F.xxhash64(x)).alias("items"))
    kind = "code long, bits long, buckets array<long>, parents array<long>"

    def signed(df: DataFrame, grain: int, large: bool) -> DataFrame:
        return df.mapInArrow(_signer(threshold, bands, rows, seed, grain, small, large), kind)

    each = cut(signed(narrow, GRAIN, True).drop("parents")).select("code", "bits", F.explode("buckets").alias("bucket"))
    found, grain = [], GRAIN
    while True:
        shared = _hot_buckets(each, hot)
        n_hot = shared.count()
        if not n_hot:
            found.append(_met(each, each, ["bucket"], threshold))
            break
        marked = each.join(sized_broadcast(shared, n_hot), "bucket", "left")
        found.append(_met(marked.filter("n is null"), marked.filter("n is null"), ["bucket"], threshold))
        warm = cut(marked.filter("n is not null"))
        # Sets in a hot bucket of more values than the band are told apart by one more hash of theirs.
        finer = grain < FINEST
        size = F.col("code").bitwiseAND(F.lit(_SIZES))
        stay = (F.ceil(size * threshold - _EPS) <= grain) | (size > small) if finer else F.lit(True)
        rest = warm.filter(stay).withColumn("salts", F.ceil(F.col("n") / hot).cast("int"))
        left = rest.withColumn("salt", F.pmod(F.xxhash64("code"), "salts").cast("int"))
        right = rest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        found.append(_met(left, right, ["bucket", "salt"], threshold))
        if not finer:
            break
        grain += 1
        again = narrow.join(warm.select("code").distinct(), "code", "left_semi")
        longer = signed(again, grain, False).select("code", "bits", F.explode(F.arrays_zip("buckets", "parents")).alias("p"))
        longer = longer.select("code", "bits", F.col("p.buckets").alias("bucket"), F.col("p.parents").alias("parent"))
        each = cut(longer.join(sized_broadcast(shared.select(F.col("bucket").alias("parent")), n_hot), "parent", "left_semi").select("code", "bits", "bucket"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    # Divided by one code of the pair, as the check of the sets needs it next.
    return out.repartition("a").dropDuplicates(["a", "b"])


def set_classes(records: DataFrame) -> DataFrame:
    """The distinct sets of :func:`set_records`: c1, c2, items, and code, of c1 and the set's size."""
    got = records.groupBy("c1", "c2").agg(F.first("items").alias("items"))
    size = F.least(F.size("items"), F.lit(_SIZES)).cast("long")
    return got.select("c1", "c2", "items", F.col("c1").bitwiseAND(F.lit(~_SIZES)).bitwiseOR(size).alias("code"))


def similar_classes(records: DataFrame, threshold: float, rows: int = 3, miss: float = 1e-7, seed: int = 7, hot: int = HOT_BUCKET) -> DataFrame:
    """Pairs of different classes of :func:`set_records` with Jaccard similarity of at least ``threshold``.

    Result: a1, a2, b1, b2 (class codes), common, union. Nothing is capped: a bucket with more than
    ``hot`` classes is divided or joined in salted blocks.
    """
    classes = cut(set_classes(records))
    found = _candidates(classes, threshold, rows, miss, seed, hot)
    a = classes.select(F.col("code").alias("a"), F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("items").alias("ia"))
    b = classes.select(F.col("code").alias("b"), F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("items").alias("ib"))
    both = found.join(a, "a").join(b, "b")
    common = both.withColumn("common", F.size(F.array_intersect("ia", "ib"))).withColumn("union", F.size("ia") + F.size("ib") - F.col("common"))
    return common.filter(F.col("common") + _EPS >= threshold * F.col("union")).select("a1", "a2", "b1", "b2", "common", "union")


def _both_ways(pairs: DataFrame) -> DataFrame:
    turned = pairs.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"), "common", "union")
    return pairs.unionByName(turned)


def similar_pairs(df: DataFrame, id_col: str, set_col: str, threshold: float, other: DataFrame | None = None, **how) -> DataFrame:
    """All pairs of different ids whose sets have a Jaccard similarity of at least ``threshold``.

    Result: id_a, id_b, similarity. Within one table id_a < id_b; with ``other`` (same column names)
    id_a is of ``df``, id_b of ``other``, and equal ids in both tables are a pair like any other.
    Records with a null id or no non-null value take no part; repeats of a record count once; an
    empty table gives no pairs. Other columns are ignored, whatever their names.
    """
    codes = ["c1", "c2"]
    records = [set_records(t, id_col, set_col) for t in (df, other) if t is not None]
    members = [cut(r.select("id", *codes).distinct()) for r in records]
    left, right = members[0], members[-1]
    if other is None:
        links = similar_classes(records[0], threshold, **how)
        alike = left.groupBy(*codes).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    else:
        links = _both_ways(similar_classes(records[0].unionByName(records[1]), threshold, **how))
        alike = left.select(*codes).distinct()
    links = links.select(*[F.col(f"{s}{k}").alias(f"{s}_c{k}") for s in "ab" for k in (1, 2)], (F.col("common") / F.col("union")).alias("similarity"))
    same = alike.select(*[F.col(c).alias(f"{s}_{c}") for s in "ab" for c in codes], F.lit(1.0).alias("similarity"))
    pairs = members_of_links(links, left, right, codes, "id").select("id_a", "id_b", "similarity")
    equal = members_of_links(same, left, right, codes, "id").select("id_a", "id_b", "similarity")
    if other is None:
        pairs = pairs.filter(F.col("id_a") != F.col("id_b")).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "similarity")
        equal = equal.filter(F.col("id_a") < F.col("id_b"))
    # An id with several sets may meet another one more than once.
    return pairs.unionByName(equal).groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))


def class_links(records: DataFrame, links: DataFrame) -> DataFrame:
    """One row per record: id, class_id (the least id with the same set) and n_links, its number of similar other ids.

    ``records`` of :func:`set_records` over one table, ``links`` of :func:`similar_classes`. Copies
    are counted, not listed: the copies of a class count by its size.
    """
    members = records.select("id", "c1", "c2").distinct()
    classes = members.groupBy("c1", "c2").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members"))
    far = _both_ways(links).join(classes.select(F.col("c1").alias("b1"), F.col("c2").alias("b2"), "members"), ["b1", "b2"])
    far = far.groupBy(F.col("a1").alias("c1"), F.col("a2").alias("c2")).agg(F.sum("members").alias("far"))
    known = classes.join(far, ["c1", "c2"], "left").select("c1", "c2", "class_id", (F.col("members") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    return attach(members, known, ["c1", "c2"], ["id"]).select("id", "class_id", "n_links")
