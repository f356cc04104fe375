"""Conversation tries against a brute-force version in Python."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import turntrie

TURNS = "conv_id long, turn long, role string, text string, depth string, key1 int"


def brute(seqs):
    """seqs: conversation to its turns (role, text)."""
    nodes = {}
    for c, said in seqs.items():
        for d in range(len(said) + 1):
            nodes.setdefault(tuple(said[:d]), []).append(c)
    out = []
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        kids = lambda n: sum(len(x) == len(n) + 1 and x[: len(n)] == n for x in nodes)
        ends = ",".join(map(str, sorted(c for c in members if len(seqs[c]) == len(node))))
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), kids(node), sum(not kids(n) for n in below), sum((len(nodes[n]) - 1) * words(n) for n in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def ordered(rows):
    seqs = {}
    for c, turn, role, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        seqs.setdefault(c, []).append((role or "", text or ""))
    return seqs


def regrown(seqs):
    out = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = seqs.get(c - c % 20, [])[:h] + own[h:]
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.drop("key1", "key2").collect()), key=repr)


def talk(seed, convs, most):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(r.randrange(1, most)):
            rows.append((c * r.choice([1, 1, 3]), r.choice([t, t, None]), r.choice(["user", "tool", None]), r.choice(["a", "a b", "a b c", "", None]), "x", 1))
    return rows


@pytest.mark.parametrize("shards", [None, 1, 9])
@pytest.mark.parametrize("piece", [1 << 16, 2])
def test_equal_to_brute_force(spark, monkeypatch, shards, piece):
    monkeypatch.setattr(turntrie, "PIECE", piece)
    rows = talk(4, 60, 7)
    seqs = turntrie.sequences(spark.createDataFrame(rows, TURNS))
    assert rows_of(turntrie.trie(seqs, shards)) == brute(ordered(rows))
    again = turntrie.regrown(seqs, 20, 3, F.crc32(F.col("conv").cast("string").cast("binary")) % 4)
    assert rows_of(turntrie.trie(again, shards)) == brute(regrown(ordered(rows)))


def test_long_conversations_and_long_shared_beginnings(spark):
    """Prefixes far longer than the columns that are sorted at once, in ranges that cut through them."""
    base = [(0, t, "user", f"turn {t}") for t in range(60)]
    rows = [(c, t, role, text if t < 60 - c or c % 3 else f"{text} {c}", "x", 1) for c in range(30) for _, t, role, text in base[: 60 - c % 7]]
    for shards in (1, 12):
        assert rows_of(turntrie.trie(turntrie.sequences(spark.createDataFrame(rows, TURNS)), shards)) == brute(ordered(rows))


def test_many_equal_conversations(spark):
    """One conversation under many ids lies in many ranges; its ids are hashed in order."""
    rows = spark.range(20_000).selectExpr("id as conv_id", "explode(array(0L, 1L)) as turn", "'user' as role", "if(id % 5000 = 7 and turn = 1, 'other', 'the same') as text")
    got = rows_of(turntrie.trie(turntrie.sequences(rows), 16))
    same = ",".join(str(c) for c in range(20_000) if c % 5000 != 7)
    other = "7,5007,10007,15007"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == sorted([(0, 0, None, 20_000, 1, 2, 2 * 19_999 + 2 * 19_995 + 3, sha("")), (0, 1, 0, 20_000, 2, 2, 2 * 19_999 + 2 * 19_995 + 3, sha("")), (0, 2, 0, 19_996, 0, 1, 2 * 19_995, sha(same)), (7, 2, 0, 4, 0, 1, 3, sha(other))], key=repr)


def test_edges(spark):
    rows = [(None, 1, "user", "lost", "", 0), (5, None, None, None, "", 0), (5, 3, "user", "hi", "", 0), (5, 3, "user", "hi", "", 0), (25, 0, "", "", "", 0), (40, 0, "user", "long " * 20_000, "", 0), (41, 0, "user", "long " * 20_000, "", 0)]
    df = spark.createDataFrame(rows, TURNS)
    assert rows_of(turntrie.trie(turntrie.sequences(df))) == brute(ordered(rows))
    # conversations that become turnless are members of the root alone
    share = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    got = rows_of(turntrie.trie(turntrie.regrown(turntrie.sequences(df), 20, 3, share), 3))
    assert got == brute(regrown(ordered(rows))) and [] in regrown(ordered(rows)).values()
    assert rows_of(turntrie.trie(turntrie.sequences(df.limit(0)))) == []
