import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from pathtide.llm.linkage import Comparison, block, estimate, fit
from pathtide.llm.sites import chromosome_key, graph_calls, link_sites, run_sample_candidates

NODES = "chrom string, node_id long, node_size int, node_index long, path_offset long"
PEAKS = "peak_id long, unique_id string, sample_id long, chromosome string, start_off int, end_off int, region_paths array<long>, average_q_value double, score string"
SAMPLES = "sample_id long, factor string, tissue string, replicate int, n_reads long, sequenced_at timestamp, run_id string"
LINEAR = "lp_id long, run_id long, chromosome string, start_pos long, end_pos long, score double, unique_id string, q string"
RUNS = "run_id long, run_label string, n_reads_approx long, called_at timestamp, sample_id string"
DAY = datetime(2024, 5, 1)


def test_em_finds_the_agreeing_side():
    r = np.random.default_rng(1)
    for share in (0.05, 0.9):
        match = r.random(20_000) < share
        levels = np.where(match[:, None], r.choice(3, (20_000, 4), p=[0.85, 0.1, 0.05]), r.choice(3, (20_000, 4), p=[0.1, 0.2, 0.7]))
        levels[r.random((20_000, 4)) < 0.1] = -1
        patterns, counts = np.unique(levels, axis=0, return_counts=True)
        got = estimate(patterns, counts.astype(float), list("abcd"), [3] * 4)
        assert abs(got.share - share) < 0.02
        assert all(abs(m[0] - 0.85) < 0.05 and abs(u[2] - 0.7) < 0.05 for m, u in zip(got.m, got.u))
    empty = estimate(np.zeros((0, 2), dtype=int), np.zeros(0), ["a", "b"], [2, 2])
    assert 0 < empty.share < 1


def test_block_and_levels(spark):
    a = spark.createDataFrame([(1, ["x", "y"], 5), (2, None, 6), (3, ["z", "z"], None)], "i long, k array<string>, v int")
    b = spark.createDataFrame([(7, "y", 5), (8, "z", 1), (9, None, 6)], "j long, kk string, w int")
    pairs = block(a, b, [([F.col("k")], [F.col("kk")]), ([F.col("v")], [F.col("w")])])
    assert sorted((r.i, r.j) for r in pairs.select("i", "j").distinct().collect()) == [(1, 7), (2, 9), (3, 8)]
    c = Comparison("v", [F.col("v") == F.col("w")], F.col("v").isNull())
    assert {(r.i, r.j): r.c_v for r in pairs.select("i", "j", c.level()).collect()} == {(1, 7): 0, (2, 9): 0, (3, 8): -1}
    assert fit(pairs.select(c.level()), [c]).posterior() is not None


def world(n_peaks=260):
    r = random.Random(8)
    nodes, at, path = [], 0, 0
    for k in range(4000):
        size, off = r.randrange(5, 60), k % 5 == 3
        nodes.append(("chr1", 1000 + k, size, at, None if off else path))
        at += size
        path += 0 if off else size
    place = {n[1]: n for n in nodes}
    samples = [(s, f, t, rep, n, DAY, "x") for s, f, t, rep, n in ((1, "ABU1", "leaf", 1, 10_000_000), (2, "ABU1", "root tip", 2, 50_000_000), (3, "CEDO2", "stem", 1, 30_000_000))]
    runs = [(11, "BAU1_lf_r1", 9_700_000, DAY + timedelta(days=9), "x"), (12, "root/ABU-1 #2", None, DAY + timedelta(days=20), "x"), (13, "cedo2 stm", 29_000_000, DAY + timedelta(days=3), "x"), (14, "ABU1.leaf.4", 70_000_000, DAY + timedelta(days=200), "x"), (15, None, None, None, None)]
    peaks, linear, truth = [], [], set()
    lp = 500
    for i in range(n_peaks):
        s = i % 3 + 1
        first = 1000 + r.randrange(3900)
        rp = [n for n in range(first, first + r.randrange(3, 9)) if (n - 1000) % 5 != 3]
        q = round(r.uniform(2, 90), 2)
        back = r.random() < 0.3
        a, b = r.randrange(1, 5), r.randrange(1, 5)
        peaks.append((i, None, s, None, a, b, [-n for n in reversed(rp)] if back else rp, q, "x"))
        f, l = place[rp[0]], place[rp[-1]]
        gs, ge = (f[4] + f[2] - b, l[4] + l[2] - a) if back else (f[4] + a, l[4] + b)
        if gs >= ge or i % 5 == 0:
            continue
        tenth = max(1, (ge - gs) // 10)
        linear.append((lp, 10 + s, r.choice(["chr1", "CHR1", "1"]), gs + r.randint(-tenth, tenth), max(ge + r.randint(-tenth, tenth), gs + tenth + 1), None if i % 17 == 0 else round(q * r.uniform(0.85, 1.15), 2), None, "x"))
        truth.add((i, lp))
        lp += 1
    for k in range(300):
        x = r.randrange(90_000)
        linear.append((5000 + k, r.choice([11, 12, 13, 14]), "chr1", x, x + r.randrange(30, 300), round(r.uniform(1, 90), 2), None, "x"))
    return nodes, samples, runs, peaks, linear, truth


def test_links_of_a_small_world(spark):
    nodes, samples, runs, peaks, linear, truth = world()
    peaks += [peaks[3], (9001, None, 1, None, 1, 2, [], 3.0, "x"), (9002, None, 1, None, 1, 2, None, 3.0, "x"), (9003, None, None, None, 1, 2, [1000], 3.0, "x"), (9004, None, 1, None, None, 2, [1000], float("nan"), "x")]
    linear += [linear[4], (9001, 11, None, 1, 2, 1.0, None, "x"), (9002, 11, "chr1", None, 2, 1.0, None, "x"), (9003, None, "chr1", 1, 2, 1.0, None, "x"), (9004, 11, "chr1", 9, 2, float("nan"), None, "x")]
    make = spark.createDataFrame
    tables = make(peaks, PEAKS), make(nodes, NODES), make(samples, SAMPLES), make(linear, LINEAR), make(runs, RUNS)
    out = link_sites(*tables).collect()
    got = {(r.peak_id, r.lp_id) for r in out}
    assert len(got) == len(out) and all(0.5 <= r.confidence <= 1 for r in out)
    assert len(got & truth) >= 0.97 * len(truth) and len(got & truth) >= 0.97 * len(got)
    assert len({r.lp_id for r in out}) == len(out)
    assert not {r.run_id for r in out} & {14, 15}
    for k in (0, 3, 4):
        some = list(tables)
        some[k] = some[k].limit(0)
        assert link_sites(*some).count() == 0


def test_parts(spark):
    names = spark.createDataFrame([("chr1",), ("CHR1",), ("1",), ("scf0012",), ("Scf12",), ("chrX",), (None,)], "c string")
    assert [r[0] for r in names.select(chromosome_key(F.col("c"))).collect()] == ["1", "1", "1", "scf12", "scf12", "x", None]
    nodes = spark.createDataFrame([("chr1", 1, 10, 0, 0), ("chr1", 2, 5, 10, None), ("chr1", 3, 10, 15, 10)], NODES)
    peaks = spark.createDataFrame([(1, None, 1, None, 2, 3, [2, 3], 1.0, ""), (2, None, 1, None, 2, 3, [-3, -2], 1.0, ""), (3, None, 1, None, 2, 3, [1, 2], 1.0, ""), (4, None, 1, None, 0, 3, [2], 1.0, "")], PEAKS)
    got = {r.peak_id: (r.gs, r.ge) for r in graph_calls(peaks, nodes).collect()}
    assert got == {1: (7, 13), 2: (7, 18), 3: (2, 13)}
    runs = spark.createDataFrame([(1, "SEED COAT PABA7 (2)", 100, DAY, ""), (2, "PAAB7", None, None, ""), (3, "", None, None, "")], RUNS)
    samples = spark.createDataFrame([(1, "PABA7", "seed coat", 2, 100, DAY, ""), (2, "PABA7", "leaf", 1, 900, DAY, ""), (3, None, None, None, None, None, "")], SAMPLES)
    got = {(r.run_id, r.sample_id): (r.c_factor, r.c_tissue, r.c_replicate, r.c_reads, r.c_days) for r in run_sample_candidates(runs, samples).collect()}
    # Conflicting labels are candidates too: the fit judges them.
    assert got == {(1, 1): (0, 0, 0, 0, 0), (1, 2): (0, 2, 1, 2, 0), (2, 1): (1, -1, -1, -1, -1), (2, 2): (1, -1, -1, -1, -1)}


def test_matches_stay_among_linked_owners():
    # Half the pairs are of owners that don't match; their agreement by chance is no evidence of matches.
    patterns, counts = np.array([[0, 0], [1, 1], [0, 1], [1, 0]]), np.array([600.0, 500.0, 60.0, 60.0])
    got = estimate(patterns, counts, ["a", "b"], [2, 2], able=counts * np.array([0.9, 0.1, 0.5, 0.5]))
    assert got.share > 0.7 and got.m[0][0] > 0.8 and got.u[0][1] > 0.8
