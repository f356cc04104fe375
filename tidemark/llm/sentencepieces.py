"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch's distinct words become one flat array of symbols. In each round every word finds its
best-ranked adjacent pair (a segmented minimum), merges the pair's occurrences from left to
right, and words without any pair leave. Where a merged symbol could take part in a pair ranked
before it, or where two pieces share a score, only the leftmost occurrence is merged in the
round, which is the order of the library's queue; elsewhere all occurrences at once give the same.

Pieces never hold a space mark after another character (checked when the model is loaded), so
no merge crosses the start of a word, and words can be encoded apart.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

MARK = "▁"
NONE = np.int64(1) << 40
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
# texts that a model of another normaliser, prefix, kind or fallback encodes in another way
PROBES = ["", " ", "a", " a", "a  b ", "  a\tb\n", "Ｆｕｌｌ ﬁ Ⅷ ½ ①", "A\u0301 á \u00a0x\u3000y", "straße İi", "日本語 \U0001f600", "\x00\x7f\ufeff", "▁x", "the international representatives' 12345"]
codecs.register_error("piecewise", lambda e: ("�", e.start + 1))


class Pieces:
    """Vocabulary, pair table and the encoder and decoder over it."""

    def __init__(self, path: str, cache_words: int = 200_000) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        plain = {p: i for i, p in enumerate(names) if not special[i]}
        if any(MARK in p.lstrip(MARK) for p in plain):
            raise ValueError("a piece holds a space mark after another character")
        scores = np.array([sp.get_score(i) for i in range(n)])
        order = np.unique(-scores)
        rank = np.searchsorted(order, -scores)
        shared = np.bincount(rank[list(plain.values())], minlength=len(order)) > 1
        self.char = np.arange(0x110000, dtype=np.int64) + n  # characters without a piece stand above the ids
        for p, i in plain.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        symbol = lambda p: plain.get(p, int(self.char[ord(p)]) if len(p) == 1 else None)
        pairs, early = {}, np.zeros(n, bool)
        self.base = n + 0x110000
        for p, i in plain.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = i
                for part in (p[:k], p[k:]):
                    if (j := plain.get(part)) is not None and rank[i] <= rank[j]:
                        early[j] = True
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.rank = rank[self.merged].astype(np.int64)
        self.one_by_one = np.zeros(len(order) + 1, bool)
        self.one_by_one[rank[early]] = True
        self.one_by_one[:-1] |= shared
        self.bytes_of = np.array([plain.get("", sp.piece_to_id(f"<0x{b:02X}>")) for b in range(256)], np.int64)
        unk = b" \xe2\x81\x87 "
        raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else unk if sp.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.raw = raw
        self.silent = np.array([sp.is_control(i) for i in range(n)])
        self.spaced = np.array([p[0] == MARK for p in names])
        self.guard = int(self.char[ord(".")])  # any piece without a mark
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.raw_flat = np.frombuffer(b"".join(raw), np.uint8)
        self.cache_words = cache_words
        self.forget()
        # a model with another normaliser, prefix, kind or way with unknown characters is refused, not encoded wrongly
        want = sp.encode(PROBES, add_bos=True, add_eos=True, num_threads=1)
        for t, own, theirs in zip(PROBES, self.encode(PROBES), want, strict=True):
            if own.tolist() != theirs or self.decode(own) != sp.decode(theirs):
                raise ValueError(f"{path} isn't a model that this encoder knows: it encodes {t!r} in another way")

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.flat, self.at, self.len = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        wid = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_wid = [], []
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], wid[1:] != wid[:-1])))
            key = sym[:-1] * self.base + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = (self.keys[at] == key) & (wid[1:] == wid[:-1])
            rank = np.full(len(sym), NONE)
            rank[:-1][found] = self.rank[at[found]]
            best = np.minimum.reduceat(rank, first)
            spread = np.diff(np.append(first, len(sym)))
            mine = np.repeat(best, spread)
            over = mine == NONE
            if over.any():
                done_sym.append(sym[over])
                done_wid.append(wid[over])
            hit = np.flatnonzero((rank == mine) & ~over)
            if len(hit):
                # of hits that follow one another directly, every other one, from the first
                fresh = np.concatenate(([True], (np.diff(hit) > 1)))
                begin = np.maximum.accumulate(np.where(fresh, hit, 0))
                hit = hit[(hit - begin) % 2 == 0]
                alone = self.one_by_one[rank[hit]]
                lead = np.concatenate(([True], wid[hit][1:] != wid[hit][:-1]))
                hit = hit[~alone | lead]
                sym[hit] = self.merged[at[hit]]
            keep = ~over
            keep[hit + 1] = False
            sym, wid = sym[keep], wid[keep]
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        wid = np.concatenate(done_wid) if done_wid else np.zeros(0, np.int64)
        order = np.argsort(wid, kind="stable")
        sym, wid = sym[order], wid[order]
        if (odd := sym >= self.size).any():
            spread = np.ones(len(sym), np.int64)
            raw = [chr(int(c) - self.size).encode("utf-8", "replace") for c in sym[odd]]
            spread[odd] = [len(x) for x in raw]
            where = np.repeat(odd, spread)
            sym, wid = np.repeat(sym, spread), np.repeat(wid, spread)
            sym[where] = self.bytes_of[np.frombuffer(b"".join(raw), np.uint8)]
        return sym, np.bincount(wid, minlength=len(words))

    def learn(self, lists: list[list[str]]) -> None:
        fresh = list({w for ws in lists for w in ws if w not in self.words})
        if not fresh:
            return
        if self.words and len(self.words) + len(fresh) > self.cache_words:
            self.forget()
            fresh = list({w for ws in lists for w in ws})
        ids, n = self.merge(fresh)
        base = len(self.words)
        self.words.update(zip(fresh, range(base, base + len(fresh)), strict=True))
        self.at = np.concatenate((self.at, np.cumsum(n) - n + len(self.flat)))
        self.flat, self.len = np.concatenate((self.flat, ids)), np.concatenate((self.len, n))

    def split(self, text: str) -> list[str]:
        """Words; the first and each after a single space without their mark."""
        if not text:
            return []
        if MARK not in text:
            words = text.split(" ")
            if "" not in words:
                return words
        # a word here is kept apart from one without its mark by a leading space
        return [w[1:] if w[0] == MARK and w[1:2] not in ("", MARK) else f" {w}" for w in WORD.findall(MARK + text.replace(" ", MARK))]

    def full(self, words: list[str]) -> list[str]:
        return [w[1:] if w[0] == " " else MARK + w for w in words]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, begin and end included."""
        lists = [self.split(t) for t in texts]
        self.learn([self.full(ws) for ws in lists])
        idx = np.fromiter((self.words[w] for ws in lists for w in self.full(ws)), np.int64)
        n = self.len[idx]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.at[idx] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate(([0], ends))[np.cumsum([0, *map(len, lists)])]
        return [np.concatenate(([self.bos], ids[a:b], [self.eos])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        if self.silent[ids].any():
            # a control id ends a run of bytes: the runs between are decoded apart
            parts = [x[~self.silent[x]] for x in np.split(ids, np.flatnonzero(self.silent[ids]))]
            parts = [x for x in parts if len(x)]
            return "".join(self.decode(x) if k == 0 else self.decode(np.concatenate(([self.guard], x)))[1:] for k, x in enumerate(parts))
        n = self.raw_len[ids]
        ends = np.cumsum(n)
        out = self.raw_flat[np.repeat(self.raw_at[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        if len(ids) and self.spaced[ids[0]]:
            out = out[1:]
        return out.decode("utf-8", "piecewise")


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def batches_of(texts: Iterable[str], chars: int = 1 << 18) -> Iterator[list[str]]:
    """Lists of texts, one after another: arrays of a merge round take some hundred bytes a character."""
    out, n = [], 0
    for t in texts:
        if out and n + len(t) > chars:
            yield out
            out, n = [], 0
        out.append(t)
        n += len(t)
    if out:
        yield out


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", whole: bool = True) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256 and, if whole, ids and decoded) for every row.

    A null text is encoded as the empty one (begin and end alone). Ids may be null or repeat;
    an empty table gives an empty result; only the two named columns are read.
    model is a path that every executor can open; it is read there, once per worker. Words that
    a task has encoded are kept until it ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            at = 0
            for part in batches_of((t.as_py() or b"").decode("utf-8", "replace") for t in b.column(1)):
                ids = p.encode(part)
                text = [p.decode(x) for x in ids]
                cols = [
                    b.column(0).slice(at, len(part)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in text]),
                ]
                if whole:
                    cols += [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(text, pa.string())]
                at += len(part)
                yield pa.RecordBatch.from_arrays(cols, names[: len(cols)])
        # the worker stays for later stages, the task's words don't
        p.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * whole
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)
