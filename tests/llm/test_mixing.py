import math

import pytest

from pathtide.llm.mixing import bisected, entropy, exponent_for_entropy, mix, mix_report, plan_mix, plan_weights, powered, spread

DOCS = "id long, source string, n long, pass_no string, block int"
TARGETS = "source string, target_share double, max_repeats int, tokens string"


def test_exponent_meets_entropy():
    sizes = {"a": 1000.0, "b": 100.0, "c": 10.0}
    total = sum(sizes.values())
    shares = {s: n / total for s, n in sizes.items()}
    for wanted in (0.5, 0.8, 1.0):
        assert abs(entropy(powered(shares, exponent_for_entropy(sizes, wanted))) - wanted) < 1e-9
    assert exponent_for_entropy({}, 1.0) == 1.0 and powered({"a": 0.0}, 0.5) == {"a": 0.0}
    assert math.isclose(sum(powered(shares, 0.3).values()), 1)


def test_weights_keep_limits():
    sizes, targets, repeats = {"a": 1000, "b": 100, "c": 10, "d": 0}, {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}, {"a": 1, "b": 4, "c": 3, "d": 9}
    w, exponent = plan_weights(sizes, targets, repeats, 1110)
    assert 0 <= exponent <= 8
    assert all(w[s] * 1110 <= repeats[s] * sizes[s] + 1e-6 for s in sizes)
    assert math.isclose(sum(w.values()), 1, abs_tol=1e-9)
    assert w["c"] == pytest.approx(30 / 1110) and w["d"] == 0 and w["a"] >= 0.4 and w["b"] >= 0.3
    # limits that can't fill the budget: all sources at their limit
    w, _ = plan_weights({"a": 10, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 100)
    assert w == pytest.approx({"a": 0.1, "b": 0.1})


def test_exponent_of_the_plan_meets_the_targets_entropy():
    # d falls short of its target; what it leaves is spread so that the others are as diverse as their targets.
    sizes, targets, repeats = {"a": 6000, "b": 2500, "c": 1400, "d": 100}, {"a": 0.3, "b": 0.3, "c": 0.25, "d": 0.15}, {"a": 3, "b": 3, "c": 3, "d": 9}
    w, exponent = plan_weights(sizes, targets, repeats, 10_000)
    assert 0 < exponent < 8 and exponent != 1
    mine = lambda x: entropy({s: x[s] / sum(x[t] for t in "abc") for s in "abc"})
    assert mine(w) == pytest.approx(mine(targets), abs=1e-9) and sum(w.values()) == pytest.approx(1)
    assert w["d"] == pytest.approx(0.09) and all(w[s] >= targets[s] for s in "abc")
    # nothing is left over where all targets can be met
    assert plan_weights(sizes, targets, repeats | {"d": 99}, 10_000) == (pytest.approx(targets), 1.0)


def test_spread_and_bisection():
    room = {"a": 1.0, "b": 0.05, "c": 0.0}
    got = spread(0.3, {"a": 0.5, "b": 0.4, "c": 0.1}, room, 1.0)
    assert got == pytest.approx({"a": 0.25, "b": 0.05, "c": 0.0})
    assert bisected(lambda x: -x, -2.5) == pytest.approx(2.5) and bisected(lambda x: -x, 1.0) == 0.0 and bisected(lambda x: -x, -99.0) == 8.0


def test_mixture(spark):
    rows = [(i, "a", 5 + i % 3, "x", 1) for i in range(4000)] + [(10_000 + i, "b", 7, "x", 1) for i in range(300)] + [(20_000, "c", 30, "x", 1), (30_000, "z", 9, "x", 1), (30_001, None, 9, "x", 1), (30_002, "a", 0, "x", 1), (30_003, "a", None, "x", 1)]
    targets = [("a", 0.5, 1, "x"), ("b", 0.3, 10, "x"), ("c", 0.1, 2, "x"), ("d", 0.1, 3, "x"), (None, 0.1, 1, "x"), ("a", 0.1, 1, "x")]
    docs, wanted = spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, TARGETS)
    plan = plan_mix(docs, "id", "source", "n", wanted)
    got = mix(docs, "id", "source", "n", plan, blocks=16).cache()
    report = {r.source: r for r in mix_report(got, plan).collect()}
    assert {s: r.short for s, r in report.items()} == {"a": False, "b": False, "c": True, "d": True}
    for r in report.values():
        assert r.budget - 7 < r.taken <= r.budget or r.taken == r.budget
        assert r.repeats <= r.max_repeats
    assert sum(r.reached_share for r in report.values()) == pytest.approx(1)
    copies = got.groupBy("id", "pass_no").count()
    assert copies.filter("count > 1").count() == 0
    # any stretch of the order has the planned shares
    early = mix_report(got.filter("position < 0.5"), plan).collect()
    assert all(abs(r.reached_share - report[r.source].reached_share) < 0.03 for r in early)
    assert got.filter("position < 0 or position >= 1").count() == 0


def test_empty(spark):
    docs, wanted = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 2, None)], TARGETS)
    plan = plan_mix(docs, "id", "source", "n", wanted)
    assert [(r.tokens, r.budget, r.exponent) for r in plan.collect()] == [(0, 0, 1.0)]
    assert mix(docs, "id", "source", "n", plan).count() == 0
    assert mix_report(mix(docs, "id", "source", "n", plan), plan).first().reached_share == 0.0
    assert plan_mix(docs, "id", "source", "n", wanted.limit(0)).count() == 0
