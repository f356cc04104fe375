"""Spelling variants against a brute-force version in Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    v = vocabulary(docs)
    near = {w: [x for x in v if x != w and abs(len(x) - len(w)) < 2 and one_edit(x, w)] for w in v}
    form = {}
    for w, n in v.items():
        best = min(near[w], key=lambda x: (-v[x], x), default=None)
        form[w] = best if best is not None and v[best] >= 10 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), v[form[w]] if form[w] else None) for w, n in v.items())


def rows(spark, docs):
    return sorted(tuple(r) for r in spelling.variants(spark.createDataFrame(docs, "doc_id long, text string, word string, n int")).collect())


def corpus(seed, words, per):
    r = random.Random(seed)
    letters = "abcdeèÿÀ×"
    base = ["".join(r.choice(letters) for _ in range(r.randrange(7, 11))) for _ in range(words)]
    text = []
    for w in base:
        for _ in range(r.choice([1, 2, 30])):
            text.append(w)
        for _ in range(4):
            k = r.randrange(len(w))
            v = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :], w.upper(), w[::-1], "".join(sorted(w))])
            text += [v] * r.choice([1, 2, 3, 25])
    r.shuffle(text)
    return [(k, " ".join(text[k * per : (k + 1) * per]), "x", 1) for k in range(-(-len(text) // per))]


def plain(docs):
    return brute([d[:2] for d in docs])


@pytest.mark.parametrize(("cell", "group", "leaf"), [(8192, 1 << 16, 32), (40, 1 << 16, 4), (60, 25, 8)])
def test_equal_to_brute_force(spark, monkeypatch, cell, group, leaf):
    """With cells of their own, cells cut into many parts, and small leaves."""
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "GROUP", group)
    monkeypatch.setattr(spelling, "LEAF", leaf)
    docs = corpus(cell, 120, 50)
    got = rows(spark, docs)
    assert got == plain(docs) and sum(r[1] is not None for r in got) > 20 and sum(r[4] for r in got) > 100


def test_chains_lead_to_the_last_form(spark):
    words = [("letters", 2000), ("lettars", 200), ("lettarz", 20), ("lottarz", 2), ("leters", 9), ("lettres", 2), ("lettersx", 2)]
    docs = [(1000, " ".join(w for w, n in words for _ in range(n)), "", 0)]
    got = rows(spark, docs)
    assert got == plain(docs)
    assert {r[0]: r[2] for r in got}["lottarz"] == "letters"


def test_edges(spark):
    long = "ab" * 3000
    docs = [(1, None, "", 0), (2, "", "", 0), (None, "Straßen Straßen strassen", "", 0), (None, "Straßen", "", 0), (3, f"{long} {long} {long}a {long}a x{long} x{long} {long[:-1]}c {long[:-1]}c", "", 0)] + [(4, "tie-tie elevens elevens elevenz elevenz elevenx elevenx" + " elevent" * 30 + " elevene" * 30, "", 0)] * 3
    got = rows(spark, docs)
    assert got == plain(docs)
    assert {r[0]: r[1] for r in got}["elevens"] == "elevene" and sum(len(r[0]) > 5000 for r in got) == 4
    assert rows(spark, [(1, None, "", 0)]) == [] and rows(spark, []) == []


def test_words_of_equal_letters_and_a_hot_cell(spark, monkeypatch):
    """Anagrams have one vector: no split parts them, so their cell is cut by hash."""
    monkeypatch.setattr(spelling, "GROUP", 64)
    r = random.Random(9)
    words = {"".join(r.sample("abcdefgh", 8)) for _ in range(400)}
    words |= {w[:3] + "z" + w[4:] for w in list(words)[:100]}
    docs = [(k, f"{w} {w}", "", 0) for k, w in enumerate(sorted(words))]
    assert rows(spark, docs) == plain(docs)


def test_a_search_reaches_every_word_within_one_edit():
    r = random.Random(1)
    words = sorted({"".join(r.choice("abcdxyz") for _ in range(8)) for _ in range(3000)})
    sigs = spelling._sigs(words)
    for tight in (True, False):
        tree = spelling.grow(sigs, 8, tight)
        found = set()
        for leaf, q in spelling.search(tree, sigs, 1):
            found |= {(int(a), int(b)) for a in q for b in tree["members"][leaf]}
        near = {(i, j) for i in range(0, 3000, 7) if i < len(words) for j in range(len(words)) if i != j and one_edit(words[i], words[j])}
        assert near <= found and len(found) < len(words) ** 2 / 2
        home = spelling.place(tree, sigs)
        assert all(np.isin(np.flatnonzero(home == k), tree["members"][k]).all() for k in np.unique(home))
