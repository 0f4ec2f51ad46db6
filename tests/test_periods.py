from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pathtide.operators.periods import merge_periods

SCHEMA = "id long, k string, g string, s long, e long, shard string, n string"


def brute(rows):
    """Periods and gaps by walking each key's sorted, distinct intervals."""
    out, by = [], {}
    for i, k, g, s, e, *_ in rows:
        if None not in (k, g, s, e) and s < e:
            by.setdefault((k, g), set()).add((s, e, i))
    for key, got in by.items():
        periods = []
        for s, e, _ in sorted(got, key=lambda x: x[:2]):
            if periods and s <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], e)
                periods[-1][2] += 1
            else:
                periods.append([s, e, 1])
        out += [(*key, "period", s, e, n) for s, e, n in periods]
        out += [(*key, "gap", a[1], b[0], None) for a, b in zip(periods, periods[1:])]
    return sorted(out, key=str)


def run(spark, rows, width, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    got = merge_periods(df, ["k", "g"], "s", "e", "id", width=width, **kw).collect()
    return sorted([tuple(r) for r in got], key=str)


def test_borders_nesting_and_long_intervals(spark):
    rows = [
        (1, "a", "x", 0, 10, None, "z"), (2, "a", "x", 10, 20, None, None), (3, "a", "x", 5, 95, None, None),
        (4, "a", "x", 100, 101, None, None), (5, "a", "x", -25, -1, None, None), (6, "a", "x", 42, 43, None, None),
        (1, "a", "x", 0, 10, None, None), (7, "b", "x", 7, 7, None, None), (8, "b", "x", 9, 7, None, None),
        (9, None, "x", 1, 2, None, None), (10, "b", None, 1, 2, None, None), (11, "b", "x", None, 2, None, None),
        (None, "b", "y", 1, 3, None, None), (None, "b", "y", 2, 4, None, None), (12, "b", "y", 4, 9, None, None),
    ]
    for width in (1, 10, 1000):
        assert run(spark, rows, width) == brute(rows)
    # Crowded shards are merged in blocks first.
    many = rows + [(100 + i, "a", "x", i * 7 % 50, i * 7 % 50 + 2, None, None) for i in range(40)] + [(100, "a", "x", 0, 2, None, None)]
    for width in (10, 1000):
        assert run(spark, many, width, hot=3) == brute(many)


def test_empty(spark):
    assert run(spark, [], 10) == []


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 9), st.sampled_from("ab"), st.just("x"), st.integers(-40, 80), st.integers(-40, 80)), min_size=1, max_size=30), st.sampled_from([3, 16]))
def test_against_brute_force(spark, rows, width):
    rows = [(i, k, g, s, e, None, None) for i, (_, k, g, s, e) in enumerate(rows)]
    assert run(spark, rows, width) == brute(rows)
