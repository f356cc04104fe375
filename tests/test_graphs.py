"""Closures, cycles, lineage and impact against plain Python."""

import random

from tidemark.operators import graph as G

EDGE = "src long, dst long"


def reach(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    out = {}
    for v in {x for p in pairs for x in p}:
        far, todo = {v: 0}, [v]
        for x in todo:
            for y in after.get(x, ()):
                if y not in far:
                    far[y] = far[x] + 1
                    todo.append(y)
        out[v] = {k: d for k, d in far.items() if k != v}
    return out


def components(pairs):
    far, out = reach(pairs), {}
    for a in far:
        same = [b for b in far[a] if a in far[b]]
        if same or (a, a) in pairs:
            out[a] = min([*same, a])
    return out


def tangled(seed):
    """A random graph with a long tail, a tail that leads back, a ring and a node that depends on itself."""
    r = random.Random(seed)
    m = (8, 20, 30)[seed % 3]
    pairs = {(r.randrange(m), r.randrange(m)) for _ in range(int(m * (0.9, 1.2, 1.5)[seed % 3]))}
    return pairs | {(m + i, m + i + 1) for i in range(15)} | {(3, m), (m + 15, 3 if seed % 2 else 100), (200, 201), (201, 202), (202, 200), (300, 300)}


def test_a_chain_of_5000_is_whole_in_few_rounds(spark, monkeypatch):
    rounds, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: rounds.append(1) or cut(df))
    chain = spark.range(5000).selectExpr("id as src", "id + 1 as dst")
    got = G.closure(chain, spark.createDataFrame([(0,)], "seed long"), levels=4).collect()
    assert len(got) == 5000 and all(r["depth"] == r["node"] for r in got)
    assert len(rounds) < 45
    some = G.closure(chain, spark.createDataFrame([(10,), (4990,)], "seed long"), levels=4, max_depth=100)
    assert {(r["seed"], r["node"]) for r in some.collect()} == {(10, 10 + k) for k in range(1, 101)} | {(4990, 4990 + k) for k in range(1, 11)}


def test_closure_and_cycles_of_tangled_graphs(spark):
    for seed in range(3):
        pairs = tangled(seed)
        e, far = spark.createDataFrame(sorted(pairs), EDGE), reach(pairs)
        assert {(r["seed"], r["node"]): r["depth"] for r in G.closure_all(e).collect()} == {(a, b): d for a, x in far.items() for b, d in x.items()}
        seeds = [3, 200]
        got = G.closure(e, spark.createDataFrame([(s,) for s in seeds], "seed long"), levels=2).collect()
        assert {(r["seed"], r["node"]): r["depth"] for r in got} == {(a, b): d for a in seeds for b, d in far[a].items()}
        assert {r["node"]: r["component"] for r in G.cycles(e).collect()} == components(pairs)


def test_cycles_of_nothing(spark):
    assert G.cycles(spark.createDataFrame([], EDGE)).collect() == []
    assert G.cycles(spark.createDataFrame([(1, 2), (2, 3), (None, 1)], EDGE)).collect() == []


def test_lineage_composes_transforms_along_the_shortest_path(spark):
    rows = [("t", "x", "b", "x", "direct"), ("t", "x", "a", "x", "cast"), ("a", "x", "s", "k", "aggregate"), ("b", "x", "s", "k", "direct"), ("s", "k", "z", "k", "expression"), ("t", "x", "z", "k", None), ("a", "x", "s", "k", "direct")]
    lineage = spark.createDataFrame(rows, "table string, column string, source_table string, source_column string, transform string")
    got = {(r["table"], r["column"]): (r["depth"], r["terminal"], r["path"], r["transforms"], r["transform"]) for r in G.lineage_trace(lineage, "t", "x").collect()}
    assert got == {
        ("a", "x"): (1, False, ["a.x"], ["cast"], "cast"), ("b", "x"): (1, False, ["b.x"], ["direct"], "direct"), ("z", "k"): (1, True, ["z.k"], ["direct"], "direct"),
        ("s", "k"): (2, False, ["a.x", "s.k"], ["cast", "direct"], "cast"),
    }


def test_type_changes(spark):
    pairs = [("INT", "bigint", True), ("integer", "INT", True), ("BIGINT", "INT", False), ("STRING", "VARCHAR", False), ("char", "varchar", True), ("TEXT", "STRING", True), ("LONG", "double precision", True), ("DATE", "datetime", True), ("INT", "STRING", False), ("DECIMAL(10,2)", "DECIMAL(9,2)", False), ("foo", " FOO ", True)]
    df = spark.createDataFrame(pairs, "old string, new string, safe boolean")
    assert df.where(G.compatible(df["old"], df["new"]) != df["safe"]).collect() == []


def test_impact_of_each_kind_of_change(spark):
    edges = spark.createDataFrame([("s", "a"), ("a", "b"), ("s", "c"), ("c", "d"), ("d", "e")], "src string, dst string")
    refs = spark.createDataFrame([("a", "s", "Gone"), ("b", "s", "new"), ("c", "s", "n"), ("d", "s", "n2")], "node string, table string, column string")
    contracts = spark.createDataFrame([("d", "N", "bigint"), ("e", "gone", "string")], "node string, column string, data_type string")
    changes = spark.createDataFrame([("s", "gone", "REMOVE", None, None, None), ("s", "old", "RENAME", None, None, "NEW"), ("s", "n", "TYPE_CHANGE", "int", "BIGINT", None), ("s", "n2", "TYPE_CHANGE", "bigint", "int", None)], "table string, column string, kind string, old_type string, new_type string, new_name string")
    got = {r["node"]: (r["depth"], r["columns"], r["violations"], r["severity"]) for r in G.impact(edges, refs, contracts, changes).collect()}
    assert got == {
        "a": (1, ["gone"], [], "BREAKING"), "b": (2, ["new"], [], "BREAKING"), "c": (1, ["n"], [], "WARNING"),
        "d": (2, ["n2"], [], "BREAKING"), "e": (3, [], ["gone COLUMN_REMOVED"], "BREAKING"),
    }


def test_large_tables_are_never_broadcast(spark, monkeypatch):
    """Sizes of written and exploded tables are guessed too low, so joins say themselves which table is small; here none is."""
    plans, cut = [], G.cut
    seen = lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString())
    monkeypatch.setattr(G, "cut", lambda df: seen(df) or cut(df))
    monkeypatch.setattr(G, "SMALL", 0, raising=False)
    pairs = tangled(1) | {(1000 + i, 1001 + i) for i in range(30)}
    e = spark.createDataFrame(sorted(pairs), EDGE)
    got = G.closure(e, spark.createDataFrame([(3,), (1000,)], "seed long"), levels=2)
    seen(got)
    far = reach(pairs)
    assert {(r["seed"], r["node"]): r["depth"] for r in got.collect()} == {(a, b): d for a in (3, 1000) for b, d in far[a].items()}
    every = spark.range(1031).selectExpr("id as node")
    refs, contracts = every.selectExpr("node", "1000L as table", "explode(array('a', 'b', 'b')) as column"), every.selectExpr("node", "'A' as column", "'int' as data_type")
    changes = spark.createDataFrame([(1000, "b", "TYPE_CHANGE", "int", "bigint", None), (1000, "a", "ADD", None, None, None)], "table long, column string, kind string, old_type string, new_type string, new_name string")
    out = G.impact(e, refs, contracts, changes)
    seen(out)
    assert {(r["node"], r["depth"], tuple(r["columns"]), r["severity"]) for r in out.collect()} == {(1000 + k, k, ("a", "b"), "WARNING") for k in range(1, 31)}
    assert len(plans) > 20 and not [p for p in plans if "Broadcast" in p]
