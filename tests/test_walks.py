import random

import numpy as np
import pytest

from pathtide.operators.walks import NotEnoughPairs, follow, fragment_length, haplotype_paths, smooth, tag_windows, variant_aware_paths, window_weights


def test_follow(spark):
    choice = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 10)], "at long, to long")
    starts = spark.createDataFrame([("a", 0), ("b", 50), ("c", 99)], "walk string, at long")
    got = {(r.walk, r.step): r.at for r in follow(choice, starts).collect()}
    assert got == {**{("a", i): i for i in range(21)}, ("b", 0): 50, **{("b", i + 1): 10 + i for i in range(11)}, ("c", 0): 99}


def test_haplotype(spark):
    links = [(1, 2), (1, 3), (2, 7), (2, 8), (3, 4), (3, 5), (4, 6), (5, 6), (6, 10), (7, 9), (8, 9), (9, 10), (10, 12)]
    edges = spark.createDataFrame([("c", a, b) for a, b in links], "chrom string, src long, dst long")
    counts = spark.createDataFrame([(1, 1), (3, 1), (4, 1), (6, 1), (10, 1), (2, 2), (7, 1), (9, 1)], "node_id long, n long")
    assert [r.node_id for r in haplotype_paths(edges, counts).orderBy("step").collect()] == [1, 2, 7, 9, 10, 12]


@pytest.mark.parametrize(
    ("points", "want"),
    [
        ([(0, 0), (15, 1), (30, 2), (45, 6), (50, 2), (60, 3), (70, 6)], [[11, 13, 14], [14, 15, 16], [14, 17]]),
        ([(0, 0), (15, 1), (45, 4), (50, 1), (60, 3), (70, 5)], [[11, 12, 14], [14, 16], [14, 16, 17]]),
    ],
)
def test_variant_aware(spark, points, want):
    nodes = spark.createDataFrame([(n, "c", 10, (n - 10) * 10, n == 13, n == 15) for n in range(10, 18)], "node_id long, chrom string, size int, node_index long, snp boolean, ins boolean")
    links = [(10, 11), (11, 12), (11, 13), (12, 14), (13, 14), (14, 15), (14, 16), (14, 17), (15, 16), (16, 17)]
    edges = spark.createDataFrame([("c", a, b) for a, b in links], "chrom string, src long, dst long")
    gaps = spark.createDataFrame([(14, 17)], "src long, dst long")
    track = spark.createDataFrame([("c", a, b, v) for (a, v), (b, _) in zip(points, [*points[1:], (80, 0)]) if v], "chrom string, start_pos long, end_pos long, value long")
    for members, path in zip(([11, 12, 13, 14], [14, 15, 16], [14, 15, 16, 17]), want):
        regions = spark.createDataFrame([(n, 1) for n in members], "node_id long, component long")
        assert [r.path for r in variant_aware_paths(nodes, edges, gaps, regions, track).collect()] == [path]


def test_tag_windows_and_smoothing(spark):
    r = random.Random(6)
    tags = [("c", r.randrange(9000)) for _ in range(80)] + [("d", 5)]
    want = []
    for key in "cd":
        window = []
        for x in [*sorted(t for k, t in tags if k == key), None]:
            if window and (x is None or x - window[0] >= 600):
                want.append((key, window[0], len(window), sum(window) // len(window)))
                window = []
            if x is not None:
                window.append(x)
    got = tag_windows(spark.createDataFrame(tags, "chrom string, at long"), ["chrom"], 600)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([1, 5, 2, 8, 3])], "lag long, n long")
    assert [round(x.smoothed, 6) for x in smooth(rows, "lag", "n", 1).orderBy("lag").collect()] == [round(v / 3, 6) for v in (11, 8, 15, 13, 19)]


def test_fragment_length_guards(spark):
    profile = spark.createDataFrame([(0, 9.0, True), (40, 5.0, True), (70, 7.0, True), (80, 8.0, False)], "lag long, smoothed double, is_maximum boolean")
    assert fragment_length(spark.range(600), profile) == 70
    with pytest.warns(UserWarning, match="unsure"):
        assert fragment_length(spark.range(100), profile) == 70
    with pytest.raises(NotEnoughPairs):
        fragment_length(spark.range(99), profile)
    with pytest.raises(NotEnoughPairs):
        fragment_length(spark.range(600), profile.filter("lag = 0"))
    with pytest.raises(ValueError, match="beyond"):
        fragment_length(spark.range(600), profile.selectExpr("lag + 1000 as lag", "smoothed", "is_maximum"))


def test_shaped_windows(spark):
    r = random.Random(5)
    y = [r.random() for _ in range(30)]
    rows = spark.createDataFrame(list(enumerate(y)), "lag long, n double")
    padded = np.array(y[3:0:-1] + y + y[-2:-5:-1])
    for kind in ("bartlett", "hanning", "hamming", "blackman"):
        weights = getattr(np, kind)(7)
        assert window_weights(kind, 3) == pytest.approx(weights.tolist(), abs=1e-12)
        want = np.convolve(weights / weights.sum(), padded, mode="valid")
        got = {x.lag: x.smoothed for x in smooth(rows, "lag", "n", 3, kind).collect()}
        assert [got[i] for i in range(30)] == pytest.approx(want.tolist())
