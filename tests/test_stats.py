import math

import pytest
from pyspark.sql import functions as F

from pathtide.operators.stats import background, p_track, q_values
from pathtide.plans.signal_queries import resume_significant
from pathtide.sources.formats import write_track


def test_q_values(spark):
    p = spark.createDataFrame([("c", 0, 1, 2.0), ("d", 4, 5, 2.0), ("c", 1, 2, 1.0), ("c", 2, 5, 0.5)], "chrom string, start_pos long, end_pos long, p double")
    got = {r.p: (r.bp, r.q) for r in q_values(p, 6).collect()}
    want = {2.0: (2, 2 + math.log10(1 / 6)), 1.0: (1, 1 + math.log10(3 / 6)), 0.5: (3, 0.5 + math.log10(4 / 6))}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-6) for k in want)
    low = q_values(p, 60_000)
    assert {r.p: r.q for r in low.collect()}[2.0] == 0 and {r.p: r.q for r in low.collect()}[0.5] < 0
    assert all(r.q == 0 for r in q_values(p, 60_000, clip_all=True).collect())


def test_p_track(spark):
    runs = "chrom string, start_pos long, end_pos long, "
    sample = spark.createDataFrame([("c", 0, 3, 1), ("c", 3, 9, 2), ("d", 5, 6, 4)], runs + "value long")
    lam = spark.createDataFrame([("c", 0, 6, 1.0)], runs + "lam double")
    got = sorted((r.chrom, r.start_pos, r.end_pos, r.k, r.lam, r.p) for r in p_track(sample, lam, F.lit(1.0), F.lit(1.0), F.lit(0.5)).collect())
    assert [g[:5] for g in got] == [("c", 0, 3, 1.0, 1.0), ("c", 3, 6, 2.0, 1.0), ("c", 6, 9, 2.0, 0.5), ("d", 5, 6, 4.0, 0.5)]
    assert got[0][5] == pytest.approx(-math.log10(0.26424), abs=1e-4) and got[1][5] == pytest.approx(-math.log10(0.08030), abs=1e-4)


def test_background_of_two_scales(spark):
    starts = spark.createDataFrame([("c", 100), ("c", 104)], "chrom string, at long")
    got = sorted((r.start_pos, r.end_pos, round(r.lam, 9)) for r in background(starts, 10, [9, 40], F.lit(0.3)).collect())
    # halves 4 and 20: one start counts 10 / 8 near it and 10 / 40 in the wide scale
    assert got == [(80, 84, 0.3), (84, 96, 0.5), (96, 100, 1.25), (100, 104, 2.5), (104, 108, 1.25), (108, 120, 0.5), (120, 124, 0.3)]


def test_q_values_in_many_stretches(spark):
    rows = [("c", i, i + 1 + i % 3, (i * 37 % 101) / 7) for i in range(200)]
    p = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long, p double")
    want = {r.p: (r.bp, r.q) for r in q_values(p, 500, step=1000.0).collect()}
    assert {r.p: (r.bp, r.q) for r in q_values(p, 500, step=0.5).collect()} == want
    order = sorted(want, reverse=True)
    assert all(want[a][1] >= want[b][1] for a, b in zip(order, order[1:]))


def test_later_stage_from_written_tracks(spark, tmp_path):
    p = spark.createDataFrame([("c", 0, 5, 9.0), ("c", 5, 8, 8.5), ("d", 2, 4, 9.0), ("d", 7, 9, 0.1)], "chrom string, start_pos long, end_pos long, p double")
    write_track(p, str(tmp_path / "p"))
    assert sorted(tuple(r) for r in resume_significant(spark, str(tmp_path / "p"), 100).collect()) == [("c", 0, 8), ("d", 2, 4)]
    assert [tuple(r) for r in resume_significant(spark, str(tmp_path / "p"), 100, ["d"]).collect()] == [("d", 2, 4)]
