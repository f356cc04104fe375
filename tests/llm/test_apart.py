"""Members of a key that no link connects, against all pairs."""

import random

from tidemark.llm.common import apart


def test_pairs_of_different_roots_each_once(spark):
    r = random.Random(3)
    rows = [(k, r.randrange(1 + k % 5), n, float(n)) for n in range(400) for k in {r.randrange(12)}]
    rows = [(k, root, n, w) for k, root, n, w in rows]
    got = apart(spark.createDataFrame(rows, "key long, root long, line long, w double"), ["line", "w"]).selectExpr("key", "least(x.line, y.line)", "greatest(x.line, y.line)").collect()
    want = {(k, min(a, b), max(a, b)) for k, p, a, _ in rows for j, q, b, _ in rows if k == j and p != q}
    assert len(got) == len(set(got)) and {tuple(x) for x in got} == want


def test_a_connected_group_costs_its_size(spark):
    # key 1: all connected; key 2: as many, and three strangers
    for n in (2_000, 100_000):
        rows = spark.range(2 * n).selectExpr("id % 2 + 1 as key", "0L as root", "id as line").union(spark.createDataFrame([(2, 7, -1), (2, 8, -2), (2, 8, -3)], "key long, root long, line long"))
        assert apart(rows, ["line"]).count() == 3 * n + 2


def test_nothing_to_compare(spark):
    assert apart(spark.createDataFrame([], "key long, root long, line long"), ["line"]).collect() == []
