"""Spelling variants: words one edit apart, grouped under a much more frequent form.

A word's letter counts are a vector of 32 numbers (code points modulo 32), written as one long of
unary digits: a bit for "one or more" and one for "two or more" of each letter. One edit changes
the vector by at most one up and one down, and so at most one bit each way. A k-d tree splits on
these bits; the box of a node is the bits that all its words have and those that any has. For
each pair of lengths (equal, or one apart) the words that may be near are found by range searches
that drop boxes out of reach; the letters' order is verified after that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CRC_SQL, crc_sql, cut

LEAST, OFTEN = 7, 2  # code points and occurrences of a word
SAMPLE = 1 << 16  # words, about, that the upper trees are fitted on
CELL, FEWEST = 8192, 16  # words of a cell at most, where the sample has FEWEST or more of its words
LEAF = 32
GROUP = 1 << 16  # words and searches that meet in a task at once; long words count more
OWN, VISIT, SHORTER = 1, 2, 3  # roles of searches; 0 is a word of the cell
LETTERS = 32
ROUTED = "tree int, cell int, role int, word string, n long, sig long"


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word): every maximal run of letters, A-Z in lower case; in one of 31 (by crc32 of id and run) a letter is left out. Null texts have none, a null id counts as empty."""
    run = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST},}}"), F.lit(0))).alias("run"))
    upper = "".join(map(chr, range(65, 91)))
    run = run.withColumn("run", F.when(F.rlike("run", F.lit("[A-Z]")), F.translate("run", upper, upper.lower())).otherwise(F.col("run")))
    run = run.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))).withColumn("p", (F.col("h") % F.length("run")).cast("int"))
    word = F.when(F.col("h") % 31 == 0, F.concat(F.substring("run", F.lit(1), F.col("p")), F.substring("run", F.col("p") + 2, F.length("run")))).otherwise(F.col("run"))
    return run.select(word.alias("word")).where(F.length("word") >= LEAST)


def _sigs(words: list[str]) -> np.ndarray:
    units = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    counts = np.zeros((len(words), LETTERS), np.int64)
    np.add.at(counts, (np.repeat(np.arange(len(words)), lens), units % LETTERS), 1)
    bits = np.concatenate([counts > 0, counts > 1], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig = _sigs(b.column("word").to_pylist()) if b.num_rows else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sig.view(np.int64))], [*b.schema.names, "sig"])


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, n, length, sig) of words that occur twice or more."""
    v = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).withColumn("length", F.length("word"))
    return v.mapInArrow(_signed, "word string, n long, length int, sig long")


def grow(sigs: np.ndarray, leaf: int, tight: bool) -> dict:
    """A k-d tree over longs of unary digits: lo and hi of each node's box, its children (left: the bit isn't set; -1 in a leaf), split bit, and the members of leaves.

    tight boxes are those of the members; others are what the splits alone say, for words that the tree hasn't seen.
    """
    lo, hi, kids, bit, members = [np.uint64(0)], [~np.uint64(0)], [(-1, -1)], [-1], [np.arange(len(sigs))]
    for k in (k for k in _counting(lo)):
        idx = members[k]
        if tight and len(idx):
            lo[k], hi[k] = np.bitwise_and.reduce(sigs[idx]), np.bitwise_or.reduce(sigs[idx])
        if len(idx) <= leaf:
            continue
        share = np.unpackbits(sigs[idx].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        b = int(np.argmin(np.abs(2 * share - len(idx))))
        if not 0 < share[b] < len(idx):
            continue
        one = np.uint64(1) << np.uint64(b)
        has = (sigs[idx] & one) != 0
        # two of a letter are also one, none is also not two
        twin = np.uint64(1) << np.uint64(b % LETTERS if b >= LETTERS else b + LETTERS)
        kids[k], bit[k], members[k] = (len(lo), len(lo) + 1), b, None
        lo += [lo[k], lo[k] | one | (twin if b >= LETTERS else np.uint64(0))]
        hi += [hi[k] & ~(one | (twin if b < LETTERS else np.uint64(0))), hi[k]]
        kids += [(-1, -1)] * 2
        bit += [-1] * 2
        members += [idx[~has], idx[has]]
    return {"lo": np.array(lo, np.uint64), "hi": np.array(hi, np.uint64), "kids": kids, "bit": bit, "members": members}


def _counting(growing: list) -> Iterator[int]:
    k = 0
    while k < len(growing):
        yield k
        k += 1


def search(tree: dict, sigs: np.ndarray, down: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, searches whose range its box reaches): words with at most one bit more, and `down` bits less."""
    lo, hi, kids = tree["lo"], tree["hi"], tree["kids"]
    stack = [(0, np.arange(len(sigs)))]
    while stack:
        k, q = stack.pop()
        s = sigs[q]
        q = q[(np.bitwise_count(lo[k] & ~s) <= 1) & (np.bitwise_count(s & ~hi[k]) <= down)]
        if not len(q):
            continue
        if kids[k][0] < 0:
            yield k, q
        else:
            stack += [(kids[k][0], q), (kids[k][1], q)]


def place(tree: dict, sigs: np.ndarray) -> np.ndarray:
    """The leaf of each word."""
    out = np.zeros(len(sigs), np.int32)
    stack = [(0, np.arange(len(sigs)))]
    while stack:
        k, q = stack.pop()
        if not len(q):
            continue
        if tree["kids"][k][0] < 0:
            out[q] = k
            continue
        has = (sigs[q] >> np.uint64(tree["bit"][k]) & np.uint64(1)) != 0
        stack += [(tree["kids"][k][0], q[~has]), (tree["kids"][k][1], q[has])]
    return out


ONE = {"lo": np.zeros(1, np.uint64), "hi": ~np.zeros(1, np.uint64), "kids": [(-1, -1)], "bit": [-1]}


def fit(vocab: DataFrame, words: int) -> dict[int, dict]:
    """The upper tree of each length, fitted on about SAMPLE words, by a hash of the word, however many there are: 12 bytes each come to the driver. Lengths that the sample lacks have one cell."""
    got = vocab.where(F.pmod(F.xxhash64("word"), F.lit(max(words, 1))) < SAMPLE).select("length", "sig").toArrow().to_pandas()
    leaf = max(FEWEST, CELL * len(got) // max(words, 1))
    trees = {int(n): grow(g["sig"].to_numpy().view(np.uint64), leaf, False) for n, g in got.groupby("length")}
    return {n: {k: v for k, v in t.items() if k != "members"} for n, t in trees.items()}


def _routes(trees: dict[int, dict], length: np.ndarray, sig: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(tree, cell, role, rows): each word in its cell, and the searches for it: words of its length in its cell and in later ones, longer ones anywhere in reach."""
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        s = sig[rows]
        same, longer = trees.get(int(n), ONE), trees.get(int(n) + 1, ONE)
        home = place(same, s)
        for c in np.unique(home):
            yield int(n), int(c), 0, rows[home == c]
            yield int(n), int(c), OWN, rows[home == c]
        for c, q in search(same, s, 1):
            if len(q := q[home[q] < c]):
                yield int(n), c, VISIT, rows[q]
        for c, q in search(longer, s, 0):
            yield int(n) + 1, c, SHORTER, rows[q]


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b.column("length").to_numpy(zero_copy_only=False), b.column("sig").to_numpy(zero_copy_only=False).view(np.uint64)


def routed(vocab: DataFrame, trees: dict[int, dict]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tree, cell, role, rows in _routes(trees, *_columns(b)) if b.num_rows else ():
                t = b.take(pa.array(rows))
                fixed = [pa.array(np.full(len(rows), x, np.int32)) for x in (tree, cell, role)]
                yield pa.RecordBatch.from_arrays([*fixed, t.column("word"), t.column("n"), t.column("sig")], ["tree", "cell", "role", "word", "n", "sig"])

    return vocab.mapInArrow(run, ROUTED)


def loads(vocab: DataFrame, trees: dict[int, dict]) -> DataFrame:
    """(tree, cell, points, searches) of cells that are too large for one task, in how many parts each is split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t = [(tree, cell, 0 if role else len(rows), len(rows) if role else 0) for tree, cell, role, rows in _routes(trees, *_columns(b))]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*t, strict=True)], ["tree", "cell", "points", "searches"])

    size = lambda c: F.ceil(F.sum(c) * F.greatest(F.lit(1.0), F.col("tree") / 32) / GROUP).cast("int")
    found = vocab.select("length", "sig").mapInArrow(run, "tree long, cell long, points long, searches long").groupBy("tree", "cell").agg(F.sum("points").alias("p"), F.sum("searches").alias("q"))
    found = found.groupBy("tree", "cell").agg(size("p").alias("points"), size("q").alias("searches"))
    return found.where("points > 1 or searches > 1").select(F.col("tree").cast("int").alias("tree"), F.col("cell").cast("int").alias("cell"), "points", "searches")


def _letters(words: pd.Series) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-16-le"), np.uint16).reshape(len(words), -1)


def _verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows are one edit apart: a and b of one length, or b one longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    n = a.shape[1]
    lead = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return lead + tail >= n


def _near(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one part of a cell: its words' own tree, range searches in it, and the letters' order."""
    rows = rows.reset_index(drop=True)
    points = rows[rows["role"] == 0].reset_index(drop=True)
    out = [rows.iloc[:0][["word", "n"]].rename(columns={"word": "a", "n": "na"}).assign(b="", nb=0)]
    if len(points):
        sigs = points["sig"].to_numpy().view(np.uint64)
        tree, letters = grow(sigs, LEAF, True), _letters(points["word"])
        for role, asks in rows[rows["role"] != 0].groupby("role"):
            asks = asks.reset_index(drop=True)
            s, own = asks["sig"].to_numpy().view(np.uint64), _letters(asks["word"])
            down = 0 if role == SHORTER else 1
            pend: list[tuple[np.ndarray, np.ndarray]] = []

            def flush() -> None:
                q, p = (np.concatenate(x) for x in zip(*pend, strict=True))
                pend.clear()
                for k in range(0, len(q), step := max(1, (1 << 24) // letters.shape[1])):
                    i, j = q[k : k + step], p[k : k + step]
                    ok = _verified(own[i], letters[j])
                    i, j = i[ok], j[ok]
                    if role == OWN:  # both ends of a pair search
                        less = (asks["word"].to_numpy()[i] < points["word"].to_numpy()[j]).astype(bool)
                        i, j = i[less], j[less]
                    out.append(pd.DataFrame({"a": asks["word"].to_numpy()[i], "na": asks["n"].to_numpy()[i], "b": points["word"].to_numpy()[j], "nb": points["n"].to_numpy()[j]}))

            held = 0
            for k, q in search(tree, s, down):
                m = tree["members"][k]
                more, less = sigs[m][None] & ~s[q][:, None], s[q][:, None] & ~sigs[m][None]
                x, y = np.nonzero((np.bitwise_count(more) <= 1) & (np.bitwise_count(less) <= down))
                pend.append((q[x], m[y]))
                held += len(x)
                if held > 1 << 20:
                    flush()
                    held = 0
            if pend:
                flush()
    return pd.concat(out)[["a", "na", "b", "nb"]]


def near_pairs(vocab: DataFrame, words: int) -> DataFrame:
    """(a, na, b, nb): every pair of words one edit apart, once. vocab as vocabulary() gives it, words its rows."""
    trees = fit(vocab, words)
    split = cut(loads(vocab, trees))
    r = routed(vocab, trees).join(split, ["tree", "cell"], "left").withColumns({"points": F.coalesce("points", F.lit(1)), "searches": F.coalesce("searches", F.lit(1))})
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    some = lambda n, salt: F.array(F.pmod(F.xxhash64(F.lit(salt), "word"), F.col(n)).cast("int"))
    point = F.col("role") == 0
    r = r.withColumn("block", F.explode(F.when(point, some("points", 1)).otherwise(every("points")))).withColumn("chunk", F.explode(F.when(point, every("searches")).otherwise(some("searches", 2))))
    return r.groupBy("tree", "cell", "block", "chunk").applyInPandas(lambda g: _near(g), "a string, na long, b string, nb long")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) where each word's form is followed to the last. Every step has ten times the occurrences, so five doublings pass any chain."""
    now = cut(links.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if not now.join(on, "root", "left_semi").limit(1).count():
            return now
        now = cut(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of 7 code points or more and 2 occurrences or more.

    Two words are near if one letter put in, left out or changed makes one the other; a word's
    form is its near word of the largest n (ties: the first in code-point order) if that is 10
    times its own n or more; root is the last form of the chain, or the word itself. Null and
    empty texts have no words, an empty table gives an empty result, repeated rows count again,
    texts and words are taken whole at any length; other columns aren't read.
    """
    vocab = cut(vocabulary(runs(docs, doc_id, text)))
    pairs = near_pairs(vocab, vocab.count())
    ends = F.explode(F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("nb")).alias("m"), F.col("b").alias("w")).alias("near")), F.struct(F.col("b").alias("word"), F.struct((-F.col("na")).alias("m"), F.col("a").alias("w")).alias("near"))))
    best = pairs.select(ends.alias("e")).select("e.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    much = -F.col("near.m") >= F.col("n") * 10
    found = cut(vocab.select("word", "n").join(best, "word", "left").select("word", F.when(much, F.col("near.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(much, -F.col("near.m")).alias("form_n")))
    last = roots(found.where("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


UTF8_SQL = "flatten(list_transform(string_split(s, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195, unicode(x)::bigint - 64] end))"
VARIANTS_SQL = rf"""
with recursive {CRC_SQL},
o as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{{LEAST},}}')) as run from documents),
l as (select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from o group by 1, 2),
h as (select run, n, {crc_sql(UTF8_SQL)} as h from (select *, id || ':' || run as s from l), crc),
v as (select word, sum(n)::bigint as n from (select n, case when h % 31 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word from h) where length(word) >= {LEAST} group by 1 having sum(n) >= {OFTEN}),
d as (select word, i, word[:i - 1] || word[i + 1:] as rest from v, (select unnest(range(1, (select max(length(word)) + 1 from v))) as i) where i <= length(word)),
p as (select distinct a.word as a, b.word as b from d a join d b on a.i = b.i and a.rest = b.rest and a.word <> b.word union select d.word, v.word from d join v on v.word = d.rest union select v.word, d.word from d join v on v.word = d.rest),
b as (select a as word, count(*) as n_near, arg_min(b, struct_pack(m := -v.n, w := b)) as near, max(v.n) as m from p join v on v.word = p.b group by 1),
f as (select v.word, case when m >= 10 * v.n then near end as form, v.n, coalesce(n_near, 0) as n_near, case when m >= 10 * v.n then m end as form_n from v left join b using (word)),
r as (select word, form as root, 1 as step from f where form is not null union all select r.word, f.form, step + 1 from r join f on f.word = r.root where f.form is not null)
select f.word, form, coalesce(root, f.word) as root, n, n_near, form_n from f left join (select word, arg_max(root, step) as root from r group by 1) using (word)
"""
