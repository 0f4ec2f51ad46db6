import random

from pyspark.sql import functions as F

from pathtide.operators.joins import asof_join, overlap_join
from pathtide.operators.matching import greedy_matches
from pathtide.operators.scan import ranked
from pathtide.operators.tracks import coalesce_runs, coverage, merge_tracks, threshold

RUNS = "chrom string, start_pos long, end_pos long, value long"
KEYS = ["chrom"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def steps_of(points, size):
    return [("c", a, b, v) for (a, v), (b, _) in zip(points, [*points[1:], (size, 0)]) if v]


def test_coverage_crosses_shards(spark):
    r = random.Random(2)
    ranges = [("c", a, a + r.randrange(0, 200_000)) for a in (r.randrange(0, 400_000) for _ in range(60))] + [("d", 5, 5), ("d", 1, 3)]
    got = rows(coverage(spark.createDataFrame(ranges, "chrom string, a long, b long"), KEYS, "a", "b"))
    cuts = sorted({x for c, a, b in ranges if c == "c" and a < b for x in (a, b)})
    want = [("c", x, y, n) for x, y in zip(cuts, cuts[1:]) if (n := sum(a <= x < b for c, a, b in ranges if c == "c"))]
    assert rows(coalesce_runs(spark.createDataFrame(got, RUNS), KEYS)) == sorted([*_merged(want), ("d", 1, 3, 1)])


def _merged(runs):
    out = []
    for c, a, b, v in runs:
        if out and out[-1][2] == a and out[-1][3] == v:
            out[-1] = (c, out[-1][1], b, v)
        else:
            out.append((c, a, b, v))
    return out


def test_maximum_of_two_tracks(spark):
    # change points [0,1,3,5,7,10] of one and [0,2,3,6,9,10] of the other
    a = steps_of([(0, 1), (1, 2), (3, 3), (5, 2), (7, 1)], 10)
    b = steps_of([(0, 2), (2, 1), (3, 2), (6, 3), (9, 2)], 10)
    got = rows(merge_tracks(spark.createDataFrame(a, RUNS), spark.createDataFrame(b, RUNS), KEYS, F.greatest))
    assert got == [("c", 0, 3, 2), ("c", 3, 5, 3), ("c", 5, 6, 2), ("c", 6, 9, 3), ("c", 9, 10, 2)]


def test_threshold(spark):
    a = spark.createDataFrame(steps_of([(0, 1), (2, 4), (5, 3), (7, 1), (70_000, 3), (140_000, 5)], 150_000), RUNS)
    assert rows(threshold(a, KEYS, 3)) == [("c", 2, 7), ("c", 70_000, 150_000)]
    assert rows(threshold(a.limit(0), KEYS, 3)) == []


def test_joins(spark):
    r = random.Random(4)
    a = [("c", i, x, x + r.randrange(0, 9000)) for i, x in enumerate(r.randrange(-9000, 40_000) for _ in range(80))]
    b = [("c", i, x, x + r.randrange(0, 300)) for i, x in enumerate(r.randrange(-9000, 40_000) for _ in range(80))]
    da, db = spark.createDataFrame(a, "chrom string, i long, a0 long, a1 long"), spark.createDataFrame(b, "chrom string, j long, b0 long, b1 long")
    got = sorted((x.i, x.j) for x in overlap_join(da, db, KEYS, ("a0", "a1"), ("b0", "b1"), width=512).collect())
    assert got == sorted((i, j) for _, i, p, q in a for _, j, s, t in b if p < q and s < t and p < t and s < q)
    points = db.groupBy("chrom", "b0").agg(F.min("j").alias("j"))
    last = {x.i: x.j for x in asof_join(da, points, KEYS, "a0", "b0", ["j"], width=1024).collect()}
    firsts = {}
    for _, j, s, _ in b:
        firsts[s] = min(j, firsts.get(s, j))
    assert last == {i: firsts[max(s for s in firsts if s <= p)] if any(s <= p for s in firsts) else None for _, i, p, _ in a}


def test_ranks_and_matching(spark):
    r = random.Random(5)
    a = [(i, "c", x, x + 40, float(r.randrange(5))) for i, x in enumerate(r.randrange(0, 900) for _ in range(60))]
    b = [(i, "c", x, x + 40, float(r.randrange(5))) for i, x in enumerate(r.randrange(0, 900) for _ in range(50))]
    schema = "id long, chrom string, a long, b long, score double"
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    free, want = set(range(50)), set()
    for i, _, p, q, s in sorted(a, key=lambda x: (-x[4], x[0])):
        best = [y for y in b if y[0] in free and p < y[3] and y[2] < q]
        if best:
            j = min(best, key=lambda y: (-y[4], y[0]))[0]
            free.discard(j)
            want.add((i, j))
    assert {tuple(x) for x in greedy_matches(da, db, ["chrom"]).collect()} == want
    assert greedy_matches(da.limit(0), db, ["chrom"]).count() == 0
    places = {x.id: (x.place, x.upto) for x in ranked(da, ["chrom"], "score", "id", 1.0, {"upto": F.col("id")}).collect()}
    order = sorted(a, key=lambda x: (-x[4], x[0]))
    assert places == {x[0]: (k + 1, sum(y[0] for y in order[: k + 1])) for k, x in enumerate(order)}
