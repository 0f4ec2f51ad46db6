import os

from pyspark.sql import functions as F

from pathtide.operators.joins import attach, lookup, overlap_join
from pathtide.operators.scan import ranked
from pathtide.session import clear_cuts, cut, shared_dir


def test_cuts_are_cleared(spark):
    got = cut(spark.range(5))
    plain = lambda path: "/" + path.removeprefix("file:").lstrip("/")
    folder = os.path.dirname(plain(got.inputFiles()[0]))
    assert got.count() == 5 and folder.startswith(plain(shared_dir(spark)))
    clear_cuts(spark)
    assert not os.path.exists(folder)
    assert cut(spark.range(3)).count() == 3


def test_hot_keys_and_bins_are_divided(spark):
    rows = spark.createDataFrame([("h", i) for i in range(50)] + [("c", 99), ("n", 1), (None, 2)], "k string, i long")
    table = spark.createDataFrame([("h", 1), ("c", 2), ("x", 3)], "k string, v int")
    for part in (7, 1000):
        got = sorted(tuple(r) for r in attach(rows, table, ["k"], ["i"], part).select("k", "i", "v").collect())
        assert got == sorted([("h", i, 1) for i in range(50)] + [("c", 99, 2)])
    for few in (0, 9):
        assert lookup(rows, table, ["k"], 3, ["i"], few).count() == 51
    a = spark.createDataFrame([("c", i, 5 * i, 5 * i + 12) for i in range(40)], "chrom string, i long, a0 long, a1 long")
    b = spark.createDataFrame([("c", j, 9 * j, 9 * j + 9) for j in range(20)] + [("d", 77, 0, 5)], "chrom string, j long, b0 long, b1 long")
    want = sorted((i, j) for i in range(40) for j in range(20) if 5 * i < 9 * j + 9 and 9 * j < 5 * i + 12)
    for hot in (None, 2, 1000):
        assert sorted((r.i, r.j) for r in overlap_join(a, b, ["chrom"], ("a0", "a1"), ("b0", "b1"), width=32, hot=hot).collect()) == want


def test_places_among_very_many_ties(spark):
    rows = [("g", 1.0 if i % 5 else 2.5 + i / 100, i) for i in range(60)] + [("h", -3.0, 7)]
    df = spark.createDataFrame(rows, "k string, q double, i long")
    order = sorted(rows, key=lambda r: (r[0], -r[1], r[2]))
    want = {(k, i): 1 + sum(1 for kk, _, ii in order[:order.index((k, q, i))] if kk == k) for k, q, i in rows}
    got = ranked(df, ["k"], "q", "i", 0.5, {"total": F.col("i")}, tie_step=8).collect()
    assert {(r.k, r.i): r.place for r in got} == want and max(r.total for r in got) == sum(range(60))
