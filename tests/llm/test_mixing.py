"""Source mixes: targets, schedules and what they take, against plain Python."""

import random
from fractions import Fraction

import pytest

from tidemark.llm import mixing

DOCS = "doc_id long, text string, source string, size int, k string"


def levels(sizes):
    """Targets by resharing until none is above three times its source's size; sizes by source, in order."""
    weight = {s: k % 3 + 1 for k, s in enumerate(sizes)}
    goal, open_, left = dict.fromkeys(sizes, Fraction(0)), set(sizes), Fraction(sum(sizes.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        if not over:
            return goal | {s: share * weight[s] for s in open_}
        goal |= {s: Fraction(3 * sizes[s]) for s in over}
        left -= sum(goal[s] for s in over)
        open_ -= over
    return goal


def corpus(seed, plan):
    r = random.Random(seed)
    return [(len(plan) * k + j, " ".join(["w"] * r.randrange(1, 60)), s, 0, "x") for j, (s, n) in enumerate(plan) for k in range(n)]


PLANS = [[("a", 40), ("b", 40), ("c", 40), ("d", 40)], [("a", 300), ("b", 2), ("c", 5), ("d", 60), (None, 3)], [("only", 20)], [("a", 1), ("b", 1), ("c", 500), ("é", 1), ("z", 30), ("Z", 4)]]


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("block", [None, 7, 1000])
def test_targets_are_met_and_no_document_is_taken_four_times(spark, plan, block):
    docs = corpus(len(plan), plan)
    df = spark.createDataFrame(docs, DOCS)
    rows = mixing.taken(df, block=block).collect()
    size = {d[0]: len(d[1].split()) for d in docs}
    source = {d[0]: d[2] for d in docs}
    sizes = {s: sum(size[i] for i in size if source[i] == s) for s in sorted({s for s, _ in plan if s is not None}) + [None] * any(s is None for s, _ in plan)}
    goal = levels(sizes)
    assert sorted(r.doc_id for r in rows) == sorted(size)
    for r in rows:
        assert (r["size"], r.source_size) == (size[r.doc_id], sizes[source[r.doc_id]]) and 0 <= r.taken <= 3 * r["size"]
        assert r.target == pytest.approx(float(goal[source[r.doc_id]]), rel=1e-12)
    for s in sizes:
        assert abs(sum(r.taken for r in rows if source[r.doc_id] == s) - goal[s]) < 1.001
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.taken(df.repartition(5), block=block).collect()))


def test_slots_hold_each_source_in_its_share_all_along(spark):
    df = spark.createDataFrame(corpus(1, [("a", 200), ("b", 300), ("c", 100)]), DOCS)
    mixed, goals, _ = mixing.mix(df, block=5)
    target = {r.k: r.target for r in goals.collect()}
    slots = {r.slot: r.k for r in mixed.select("slot", "k").distinct().collect()}
    order, whole = [slots[s] for s in sorted(slots)], sum(target.values())
    for n in range(50, len(order), 50):
        for k, goal in target.items():
            assert abs(order[:n].count(k) - n * goal / whole) < 6
    # a slot holds a block of one source
    words = mixed.groupBy("slot", "k").sum("words").collect()
    assert len(words) == len(slots) and sum(r["sum(words)"] == 5 for r in words) >= len(words) - 3


def test_pieces_are_whole_documents_in_order(spark):
    df = spark.createDataFrame(corpus(2, [("a", 50), ("b", 10)]), DOCS)
    mixed, goals, places = mixing.mix(df, block=13)
    quota = {r.k: (r.quota, r.source_size) for r in goals.collect()}
    lines = {k: sorted((r["at"], r["size"]) for r in places.where("at is not null").collect() if r.k == k) for k in quota}
    for k, line in lines.items():
        at = 0
        for start, size in line:
            assert start == at
            at += size
        assert at == quota[k][1]
    # every word of the line is taken as often as the quota passes it
    for k, (q, n) in quota.items():
        taken = [0] * n
        for r in mixed.where(mixed["k"] == k).collect():
            for w in range(r["at"] + r["first"], r["at"] + r["first"] + r["words"]):
                taken[w] += 1
        assert taken == [q // n + (w < q % n) for w in range(n)]


def test_edges(spark):
    long = "w " * 30_000
    docs = [(1, None, "a", 0, ""), (2, "", "a", 0, ""), (3, " \t\n", None, 0, ""), (None, "one two", "b", 0, ""), (None, "one two", "b", 0, ""), (4, long, "b", 0, ""), (4, long, "b", 0, "")] + [(5, "x y z", "c", 0, "")] * 9000
    rows = mixing.taken(spark.createDataFrame(docs, DOCS)).collect()
    assert len(rows) == len(docs) and [r.taken for r in rows if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert sum(r.taken for r in rows if r.doc_id == 5) in range(int(rows[-1].target) - 1, 27_000 * 3 + 1) and max(r.taken / max(r["size"], 1) for r in rows) <= 3
    assert mixing.taken(spark.createDataFrame([], DOCS)).collect() == []
    empty = mixing.taken(spark.createDataFrame([(1, None, None, 0, ""), (2, " ", "a", 0, "")], DOCS)).collect()
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in empty) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
