from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pathtide.llm.packing import fill_report, fitted, nnls, pack, patterns, plan_packing

SCHEMA = "id long, n long, size string, piece string, container int"


def check_plan(histogram, capacity):
    slots, made = plan_packing(histogram, capacity)
    load, seen = Counter(), Counter()
    for size, rank, items, first, each in slots:
        for r in range(items):
            seen[size, rank + r] += 1
            load[first + r // each] += size
    assert max(load.values(), default=0) <= capacity and set(load) <= set(range(made))
    assert seen == Counter({(s, r): 1 for s, n in histogram.items() for r in range(n)})
    return made


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=25), st.sampled_from([50, 64, 300]))
def test_every_item_has_one_place(histogram, capacity):
    check_plan(histogram, capacity)


def test_plan_is_near_the_bound():
    r = np.random.default_rng(1)
    h = Counter(int(x) for x in np.clip(r.lognormal(5.4, 0.9, 20_000), 1, 1024))
    made = check_plan(h, 1024)
    assert made <= 1.02 * sum(s * n for s, n in h.items()) / 1024


def test_nnls_and_patterns():
    entries = np.array([0, 1, 1]), np.array([0, 0, 1]), np.array([1, 1, 1])
    assert np.allclose(nnls(*entries, np.array([2.0, 5.0]), 2), [2, 3], atol=1e-6)
    assert (nnls(*entries, np.array([2.0, 1.0]), 2) >= 0).all() and nnls(*(np.zeros(0, int),) * 3, np.zeros(0), 0).shape == (0,)
    assert set(patterns([1, 2, 4], 4)) == {((4, 1),), ((2, 2),), ((2, 1), (1, 2)), ((1, 4),)}
    assert ((5, 1), (2, 1), (1, 1)) in patterns([1, 2, 5], 8)


def test_fit_asks_for_what_there_is_and_beats_best_fit():
    r = np.random.default_rng(3)
    h = Counter(int(x) for x in np.clip(r.normal(400, 120, 50_000), 1, 1024))
    bars = Counter()
    for s, n in h.items():
        bars[min(256, -(-s // 4))] += n
    asked = Counter()
    for shape, times in fitted(bars, 256):
        for b, k in shape:
            asked[b] += k * times
    assert all(asked[b] <= bars[b] + 1 for b in asked) and sum(asked.values()) > 0.5 * sum(bars.values())
    bound = -(-sum(s * n for s, n in h.items()) // 1024)
    made, plain = plan_packing(h, 1024)[1], plan_packing(h, 1024, fit=False)[1]
    assert bound <= made < plain


def test_pack(spark):
    rows = [(i, 10 + i % 7, "x", "y", 1) for i in range(300)] + [(1000, 100, None, None, 1), (1001, 101, None, None, 1), (1002, 350, None, None, 1), (1003, 200, None, None, 1), (1004, 0, None, None, 1), (1005, None, None, None, 1), (None, 5, None, None, 1), (0, 10, None, None, 1)]
    got = pack(spark.createDataFrame(rows, SCHEMA), "id", "n", 100).cache()
    out = got.collect()
    load, total = Counter(), Counter()
    for r in out:
        total[r.id] += r["size"]
        if r.container is not None:
            load[r.container] += r["size"]
    assert max(load.values()) <= 100
    assert total == Counter({i: sum(x[1] or 0 for x in rows if x[0] == i) for i in {x[0] for x in rows}})
    assert {r.id for r in out if r.piece == 1} == {1001, 1002, 1003}
    assert sorted((r.piece, r["size"]) for r in out if r.id == 1002) == [(0, 100), (1, 100), (2, 100), (3, 50)]
    assert [r.container for r in out if r.id in (1004, 1005)] == [None, None]
    report = fill_report(got, 100).first()
    assert report.containers == len(load) and report.fill > 0.95
    assert pack(spark.createDataFrame([], SCHEMA), "id", "n", 100).count() == 0
