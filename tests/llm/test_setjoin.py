import itertools
import random

from pathtide.llm.setjoin import bands_for, class_links, set_records, similar_classes, similar_pairs

SCHEMA = "id string, s array<bigint>, size int, bucket string"


def brute(a, b=None, t=0.7):
    def sets(rows):
        return {(i, frozenset(x for x in s if x is not None)) for i, s, *_ in rows if i is not None and s and any(x is not None for x in s)}

    out = set()
    for (i, x), (j, y) in itertools.product(sets(a), sets(b if b is not None else a)):
        if len(x & y) + 1e-9 >= t * len(x | y) and (b is not None or i < j):
            out.add((i, j))
    return out


def rows_of(n, seed, wide=30):
    r = random.Random(seed)
    out = []
    for i in range(n):
        base = r.randrange(wide) * 40
        out.append((f"r{i}", [base + r.randrange(14) for _ in range(r.randrange(1, 16))], None, "x"))
    return out


def pairs(df, *args, **kw):
    return {(r.id_a, r.id_b) for r in similar_pairs(df, "id", "s", *args, **kw).collect()}


def test_within_against_brute_force(spark):
    rows = rows_of(400, 1, 6) + [("n1", None, 1, None), ("n2", [], 1, None), ("n3", [None], 1, None), (None, [1, 2, 3], 1, None), ("n4", [5, None, 5], 1, None), ("r0", rows_of(400, 1, 6)[0][1], 9, None)]
    rows.append(("long", list(range(50_000)), 1, None))
    rows.append(("long2", list(range(1000, 50_000)), 1, None))
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert len(want) > 50
    assert pairs(df, 0.7) == want
    assert pairs(df, 0.7, hot=3) == want  # every bucket goes the salted way
    assert pairs(df.limit(0), 0.7) == set()
    assert pairs(df, 1.0) == brute(rows, t=1.0)


def test_between_tables(spark):
    a, b = rows_of(150, 2, 3), rows_of(150, 3, 3)
    got = pairs(spark.createDataFrame(a, SCHEMA), 0.7, other=spark.createDataFrame(b, SCHEMA))
    assert got == brute(a, b)
    assert len(got) > 10


def test_class_links_count_copies(spark):
    rows = [("a", [1, 2, 3, 4], 0, ""), ("b", [4, 3, 2, 1, 1], 0, ""), ("c", [1, 2, 3, 4, 5], 0, ""), ("d", [9], 0, "")]
    records = set_records(spark.createDataFrame(rows, SCHEMA), "id", "s")
    got = {(r.id, r.class_id, r.n_links) for r in class_links(records, similar_classes(records, 0.7)).collect()}
    assert got == {("a", "a", 2), ("b", "a", 2), ("c", "c", 2), ("d", "d", 0)}


def test_chance_of_a_miss():
    b = bands_for(0.7, 3, 1e-7)
    assert (1 - 0.7**3) ** b <= 1e-7 < (1 - 0.7**3) ** (b - 1)
