import itertools
import random

import numpy as np
import pytest

from tidemark.llm import common, stages
from tidemark.llm import simhash as S
from tidemark.llm.common import components


def brute(rows):
    """{row: component} by comparing all pairs."""
    fps = [S.fingerprint(t.encode() if t is not None else None) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 4:
            root[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        low[r] = min(low.get(r, i), i)
    return {rows[k][0]: (f"{fps[k]:016x}", low[find(k)]) for k in range(len(rows))}


def test_every_word_has_one_codeword_within_three():
    g = S.golay()
    x = np.random.default_rng(1).integers(0, 1 << 23, 5000)
    dist = np.array([[bin(int(a ^ c)).count("1") for c in g.codewords] for a in x[:40]])
    assert ((dist <= 3).sum(1) == 1).all()
    codes = g.decode(x[:40])
    for k in range(40):
        want = {int(c >> 11) for c, d in zip(g.codewords, dist[k], strict=True) if d <= 4}
        assert {int(c) >> 1 for c in codes[k] if c >= 0} == want


@pytest.mark.parametrize("flips", [0, 1, 2, 3, 4])
def test_keys_meet_at_four_bits(flips):
    rng = random.Random(flips)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for p in rng.sample(range(64), flips):
            b ^= 1 << p
        one = np.array([a], np.uint64).view(np.int64)
        two = np.array([b], np.uint64).view(np.int64)
        assert set(S.keys_of(one, False)[1]) & set(S.keys_of(two, True)[1])


def test_components(spark):
    e = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 30), (30, 7), (5, 5), (None, 4)] + [(100, k) for k in range(101, 140)]
    got = dict(components(spark.createDataFrame(e, "src long, dst long")).collect())
    assert got == {2: 1, 3: 1, 8: 7, 9: 7, 10: 7, 30: 7} | {k: 100 for k in range(101, 140)}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_against_all_pairs(spark):
    rng = random.Random(3)
    words = ["w%d" % k for k in range(40)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 20, 120]))] for _ in range(25)]
    rows = []
    for k in range(400):
        w = list(rng.choice(base))
        if rng.random() < 0.8:
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((k, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "A"), (1004, "a"), (1005, "x " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fingerprint", "2 as component_id", "3 as fp", "4 as id")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "a b")], "doc_id long, text string")
    assert sorted(r.component_id for r in S.near_duplicates(df).collect()) == [4, 4, 4]
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_wide_keys_are_pairs_of_nearest_codewords():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, (20, S.WORDS)).astype(np.uint64)
    keys = S.wide_keys(fps)
    g = S.golay()
    for f, ks in zip(fps, keys, strict=True):
        bits = sum(int(w) << (64 * k) for k, w in enumerate(f))
        code = [int(g.decode(np.array([(bits >> (23 * k)) & ((1 << 23) - 1)]))[0, 0]) >> 1 for k in range(S.WIDE)]
        assert ks.tolist() == [(n << 24) | (code[i] << 12) | code[j] for n, (i, j) in enumerate((i, j) for i in range(S.WIDE) for j in range(i))]
    assert not S.wide_fingerprint(None, 5).any() and S.wide_fingerprint(b"A b", 5).tolist() == S.wide_fingerprint(b"a  B", 5).tolist()


def test_unlike_texts_alone_in_a_key_do_not_meet(spark, monkeypatch):
    """Keys of 24 bits meet by chance; texts that stand alone there and aren't near go before anything is written."""
    met, real = [], S.cut

    def noted(df, where=None):
        out = real(df, where)
        if {"key", "w0"} <= set(out.columns):
            met.append(out.select("name").distinct().count())
        return out

    monkeypatch.setattr(S, "cut", noted)
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    rows = [(k, " ".join(word() for _ in range(30))) for k in range(3000)]
    rows.append((3000, rows[0][1] + " and"))
    of = {x.row: (x.component, x.own) for x in S.near_texts(spark.createDataFrame(rows, "row long, text string"), "row").collect()}
    assert len(set(of.values())) == 3000 and of[0] == of[3000]
    assert 2 <= met[0] <= 30


def test_no_join_of_keys_is_broadcast(spark, monkeypatch):
    """The keys of a small table are a hundred times its rows, and Spark sizes them by the table's bytes."""
    plans, write = [], type(spark.range(1).write).parquet

    def watched(self, path, *args, **more):
        plans.append(self._df._jdf.queryExecution().sparkPlan().toString())
        return write(self, path, *args, **more)

    monkeypatch.setattr(type(spark.range(1).write), "parquet", watched)
    monkeypatch.setattr(common, "BROADCAST", -1, raising=False)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(40)) for _ in range(60)) for _ in range(12)]
    df = spark.createDataFrame([(i, t + " end" * (i % 3)) for i, t in enumerate(texts * 3)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    out, kept = S.near_duplicates(df), stages.copies(spark, df, "")
    plans += [x._jdf.queryExecution().sparkPlan().toString() for x in (out, kept)]
    # a table of marks has a fixed size, and says so
    joins = [line for p in plans for line in p.splitlines() if "Broadcast" in line and "word of marks" not in line]
    assert len(plans) > 20 and not joins and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    assert out.select("component_id").distinct().count() == kept.count() == 12
