"""Small graphs with results worked out by hand."""

import math

import numpy as np
import pytest

from pathtide.functions.poisson import minus_log10_tail
from pathtide.operators.graph import components, extend_reads, linear_map
from pathtide.operators.segments import fill_holes, internal_fill, max_paths, peak_scores


def graph(spark, sizes, links):
    at, rows = 0, []
    for n in sorted(sizes):
        rows.append(("c", n, sizes[n], at))
        at += sizes[n]
    nodes = spark.createDataFrame(rows, "chrom string, node_id long, size int, node_index long")
    return nodes, spark.createDataFrame([("c", a, b) for a, b in links], "chrom string, src long, dst long")


def runs(spark, points):
    """points: (position, value) change points; the last one ends the track."""
    rows = [("c", a, b, float(v)) for (a, v), (b, _) in zip(points, points[1:]) if v]
    return spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long, value double")


def areas(df):
    return sorted((r.start_pos, r.end_pos) for r in df.collect())


CHAIN = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (4, 6), (5, 7), (6, 7), (7, 8), (7, 9), (9, 10)]
BUBBLES = [(101, 102), (101, 103), (102, 104), (103, 104)] + [(n, n + 1) for n in range(104, 110)]


def test_linear_map(spark):
    links = [(100, 101), (100, 102), (101, 105), (102, 103), (102, 104), (103, 105), (104, 105)]
    for sizes, starts, ends in (
        ({100 + i: 10 + i for i in range(6)}, [0, 10, 10, 22, 22, 36], [10, 36, 22, 36, 36, 51]),
        ({100 + i: i % 2 + 1 for i in range(6)}, [0, 1, 1, 2, 2, 4], [1, 4, 2, 4, 4, 6]),
    ):
        got = {r.node_id: (r.lin_start, r.lin_end) for r in linear_map(*graph(spark, sizes, links)).collect()}
        assert [got[n][0] for n in sorted(got)] == starts and [got[n][1] for n in sorted(got)] == ends


def test_extension_takes_both_arms(spark):
    nodes, links = graph(spark, {n: 5 for n in (1, 2, 3, 4)}, [(1, 2), (1, 3), (2, 4), (3, 4)])
    ends = spark.createDataFrame([(1, 1, 5), (2, 2, 1)], "read_id long, node_id long, offset int")
    got = {(r.read_id, r.node_id): r.reach for r in extend_reads(ends, nodes, links, 10).collect()}
    assert got == {(1, 1): 5, (1, 2): 5, (1, 3): 5, (1, 4): 5, (2, 2): 5, (2, 4): 5}


def test_components(spark):
    ids = spark.createDataFrame([(i,) for i in [*range(40), 100, 101, 102]], "id long")
    links = spark.createDataFrame([(i, i + 1) for i in range(39)] + [(102, 100), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in components(ids, links).collect()}
    assert got == {**{i: 0 for i in range(40)}, 100: 100, 102: 100, 101: 101}


def several(spark, cases):
    """One table of several graphs: case k has the chromosome ck and node ids from 1000 * k."""
    nodes, edges, tracks, touched = [], [], [], []
    for k, (sizes, links, points, seen) in enumerate(cases):
        at = 0
        for n in sorted(sizes):
            nodes.append((f"c{k}", 1000 * k + n, sizes[n], at))
            at += sizes[n]
        edges += [(f"c{k}", 1000 * k + a, 1000 * k + b) for a, b in links]
        tracks += [(f"c{k}", a, b, float(v)) for (a, v), (b, _) in zip(points, points[1:]) if v]
        touched += [(f"c{k}", 1000 * k + n) for n in seen or sizes]
    return (
        spark.createDataFrame(nodes, "chrom string, node_id long, size int, node_index long"), spark.createDataFrame(edges, "chrom string, src long, dst long"),
        spark.createDataFrame(tracks, "chrom string, start_pos long, end_pos long, value double"), spark.createDataFrame(touched, "chrom string, node_id long"),
    )


def test_holes(spark):
    bubble = [(101, 102), (102, 103), (102, 104), (103, 105), (104, 105), (105, 106)]
    six, six_runs = {n: 10 for n in range(101, 107)}, [(0, 1), (4, 0), (22, 1), (28, 0), (56, 1), (60, 0)]
    cases = [
        (({1: 12}, [], [(0, 0), (5, 1), (10, 0)], None), 4, [(5, 10)]),
        ((six, bubble, six_runs, [101, 103, 106]), 4, [(0, 4), (22, 28), (56, 60)]),
        (({n: 2 for n in range(1, 11)}, CHAIN, [(0, 1), (1, 0), (2, 1), (4, 0), (6, 1), (8, 0), (10, 1), (12, 0), (14, 1), (20, 0)], None), 3, [(0, 8), (10, 20)]),
        ((six, bubble, six_runs, None), 20, [(0, 30), (40, 60)]),
        (({n: 1 for n in range(1, 101)}, [(n, n + 1) for n in range(1, 100)], [(0, 1), (5, 0), (95, 1), (100, 0)], None), 20, [(0, 5), (95, 100)]),
    ]
    for longest in (3, 4, 20):
        own = [(c, want) for c, k, want in cases if k == longest]
        nodes, edges, track, touched = several(spark, [c for c, _ in own])
        got = fill_holes(track, nodes, edges, touched, longest).collect()
        for k, (_, want) in enumerate(own):
            assert sorted((r.start_pos, r.end_pos) for r in got if r.chrom == f"c{k}") == want


def test_internal_fill(spark):
    nodes, _ = graph(spark, {101: 100}, [(1, 2)])
    assert areas(internal_fill(runs(spark, [(0, 1), (10, 0), (19, 1), (30, 0), (41, 1), (50, 0)]), nodes, 10)) == [(0, 30), (41, 50)]


def test_best_paths(spark):
    ten, small = {n: 10 for n in range(101, 111)}, {n: 2 for n in range(101, 111)}
    chain = [(a + 100, b + 100) for a, b in CHAIN]
    cases = [
        (ten, BUBBLES, [(0, 0), (5, 1), (35, 0)], [(0, 0), (5, 1), (10, 2), (20, 3), (30, 4), (35, 0)], [(5, 5, [101, 103, 104])]),
        (ten, BUBBLES, [(0, 0), (5, 1), (35, 0)], [(0, 0), (15, 10), (30, 0)], [(5, 5, [101, 103, 104])]),
        (ten, BUBBLES, [(0, 0), (85, 1), (100, 0)], [(0, 0), (85, 10), (100, 0)], [(5, 10, [109, 110])]),
        (small, chain, [(0, 0), (1, 1), (7, 0), (8, 1), (10, 0), (12, 1), (14, 0)], [(0, 5), (4, 6), (20, 0)], [(0, 2, [105, 107]), (1, 1, [101, 103, 104])]),
    ]
    nodes, edges, area, _ = several(spark, [(s, e, a, None) for s, e, a, _, _ in cases])
    score = several(spark, [(s, e, t, None) for s, e, _, t, _ in cases])[2]
    got = max_paths(area, nodes, edges, score).collect()
    for k, case in enumerate(cases):
        own = [(r.start_off, r.end_off, [n - 1000 * k for n in r.region_paths]) for r in got if r.chrom == f"c{k}"]
        assert sorted(own) == case[-1]


def test_several_starts_and_ends(spark):
    nodes, edges = graph(spark, {n: 10 for n in range(1, 6)}, [(1, 3), (2, 3), (3, 4), (3, 5)])
    track = runs(spark, [(0, 2), (10, 2.2), (20, 0), (21, 2), (29, 0), (30, 2), (40, 0), (41, 3), (50, 0)])
    filled = fill_holes(track, nodes, edges, nodes, 2)
    got = max_paths(filled, nodes, edges, track).collect()
    assert sorted((r.start_off, r.end_off, r.region_paths) for r in got) == [(0, 10, [2, 3, 5])]


def test_peak_scores(spark):
    nodes, _ = graph(spark, {1: 10, 2: 10}, [(1, 2)])
    peaks = spark.createDataFrame([(7, "c", 5, 3, [1, 2]), (8, "c", 0, 2, [1])], "id long, chrom string, start_off int, end_off int, region_paths array<long>")
    got = {r.id: (r.bp, r.score) for r in peak_scores(peaks, nodes, runs(spark, [(4, 2.0), (6, 9.0), (7, 1.0), (20, 0)])).collect()}
    assert got == {7: (8, 9.0), 8: (2, 0.0)}


def test_poisson_tail():
    got = minus_log10_tail(np.array([1, 2, 0, 5000, 3, 900]), np.array([1.0, 1.0, 3.0, 1.0, 40.0, 1000.0]))
    assert got[0] == pytest.approx(-math.log10(0.26424), abs=1e-4) and got[1] == pytest.approx(-math.log10(0.08030), abs=1e-4)
    assert got[2] == 0 and got[3] == 1000 and 0 <= got[4] < 1e-9
    lower = 1 - sum(math.exp(-1000 + i * math.log(1000) - math.lgamma(i + 1)) for i in range(901))
    assert got[5] == pytest.approx(-math.log10(lower), abs=1e-9)
