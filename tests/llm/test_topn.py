import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pathtide.llm.topn import top_n

SCHEMA = "g string, h long, score double, id long, g0 string, i string, need int"


def brute(rows, n):
    best = {}
    for g, h, s, i, *_ in rows:
        if None not in (g, h, s, i) and not math.isnan(s):
            best[g, h, i] = max(s, best.get((g, h, i), -math.inf))
    groups = {}
    for (g, h, i), s in best.items():
        groups.setdefault((g, h), []).append((-(s + 0.0), i))
    return {(g, h, i) for (g, h), v in groups.items() for _, i in sorted(v)[:n]}


def run(spark, rows, n, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in top_n(df, ["g", "h"], "score", "id", n, **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_ties_signs_and_odd_values(spark):
    values = [0.0, -0.0, 1.5, -1.5, math.inf, -math.inf, math.nan, None, 5e-324, -5e-324, 1e308, 7.0, 7.0, 7.0]
    rows = [("a", 1, v, i * (-1) ** i, "x", None, 1) for i, v in enumerate(values * 3)]
    rows += [("b", 1, 7.0, i, "x", None, 1) for i in range(500)] + [("b", 1, 7.0, 3, "y", None, 1)]
    rows += [(None, 1, 1.0, 1, "x", None, 1), ("c", None, 1.0, 1, "x", None, 1), ("c", 1, 1.0, None, "x", None, 1), ("c", 1, 2.0, 2**62, "x", None, 1), ("c", 1, 2.0, -(2**62), "x", None, 1)]
    for n in (1, 3, 9):
        assert run(spark, rows, n, stretches=4) == brute(rows, n)
    assert run(spark, rows, 3, few=0) == brute(rows, 3)  # no state is broadcast
    assert run(spark, [], 3) == set() == run(spark, rows, 0)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.just(1), st.floats(allow_nan=False) | st.sampled_from([1.0, 2.0]), st.integers(-5, 40)), max_size=60), st.integers(1, 5))
def test_against_brute_force(spark, rows, n):
    rows = [(*r, None, None, None) for r in rows]
    assert run(spark, rows, n) == brute(rows, n)
