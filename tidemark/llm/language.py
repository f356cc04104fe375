"""Language identification by the nearest of several centroids per language.

Texts become normalised TF-IDF vectors of hashed character n-grams (1 to 3 letters, words
bounded). Document frequencies are counted over all training rows. The centroids (spherical
k-means within each language) are fitted on a sample of at most `sample_rows` training rows,
taken by a hash of the id. A prediction is the language of the nearest centroid by cosine; a
text further from it than nearly all training texts are is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Lower-case code point of each letter, 0 for all else."""
    if not _letters:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _letters.append(out)
    return _letters[0]


def grams(text: str, dims: int) -> np.ndarray:
    """Counts of a whole text's n-grams in `dims` (a power of two) hashed bins."""
    count = np.zeros(dims, np.int64)
    table = letters()
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    shift = np.uint64(64 - (dims.bit_length() - 1))
    for at in range(0, len(raw), 1 << 18):
        # two letters before the piece, so that n-grams across pieces count once
        x = table[raw[max(0, at - 2) : at + (1 << 18)]].astype(np.uint64)
        skip = min(2, at)
        if at == 0:
            x, skip = np.concatenate((np.zeros(1, np.uint64), x)), 1
        if at + (1 << 18) >= len(raw):
            x = np.append(x, np.uint64(0))
        a, b, c = x[:-2], x[1:-1], x[2:]
        one = x[skip:][x[skip:] > 0]
        two = (x[:-1] * np.uint64(0x1F3D5B79) + x[1:] + np.uint64(1 << 50))[(x[:-1] > 0) | (x[1:] > 0)]
        three = (a * np.uint64(0x9E3779B1) + b * np.uint64(0x85EBCA77) * np.uint64(0x101) + c + np.uint64(1 << 51))[(b > 0) & ((a > 0) | (c > 0))]
        h = np.concatenate((one, two, three)) * np.uint64(0x9E3779B97F4A7C15)
        count += np.bincount((h >> shift).astype(np.int64), minlength=dims)
    return count


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]  # of each centroid
    least: float  # cosine under which a text is rejected

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and rejections of rows of counts."""
        cos = vectors(counts, self.idf) @ self.centroids.T
        names = sorted(set(self.langs))
        best = np.stack([cos[:, [k for k, x in enumerate(self.langs) if x == n]].max(1) for n in names], 1)
        p = np.exp(12 * (best - best.max(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        return [names[k] for k in best.argmax(1)], p.max(1) * np.clip(best.max(1), 0, 1) ** 0.25, best.max(1) < self.least


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from far apart rows, so equal input gives equal centroids."""
    k = min(k, len(v))
    at = [int((v @ v.mean(0)).argmax())]
    while len(at) < k:
        at.append(int((v @ v[at].T).max(1).argmin()))
    c = v[at]
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        c = np.stack([v[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(rows: DataFrame, id_col: str, text_col: str, lang_col: str, dims: int = 4096, per_lang: int = 3, sample_rows: int = 2000) -> Model | None:
    """A model from labelled rows (null languages and texts left out); None if there are none."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and t is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(dims, np.int64)
        n: dict[str, int] = {}
        for b in batches:
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                df += grams(t, dims) > 0
                n[lang] = n.get(lang, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([*map(str, range(dims)), *(f"lang {x}" for x in n)]), pa.array([*df.tolist(), *n.values()], pa.int64())], ["k", "n"])

    got = {r.k: r.n for r in rows.select("t", "lang").mapInArrow(count, "k string, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    totals = {k[5:]: n for k, n in got.items() if k.startswith("lang ")}
    if not totals:
        return None
    idf = np.log((1 + sum(totals.values())) / (1 + np.array([got.get(str(k), 0) for k in range(dims)]))) + 1.0
    # about sample_rows / languages of each, by a hash of id and text; rows that repeat thousands of times don't fill another language's place
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(sample_rows / len(totals) / n)) for k, n in totals.items()])
    picked = rows.where((F.pmod(F.xxhash64("id", "t"), F.lit(1 << 20)) / float(1 << 20)) < share)

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [np.minimum(grams(t, dims), 65535).astype("<u2").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(v, pa.binary())], ["lang", "v"])

    most = Window.partitionBy("lang").orderBy(F.xxhash64("v"), "v")
    sample = picked.mapInArrow(vectorise, "lang string, v binary").withColumn("at", F.row_number().over(most)).where(F.col("at") <= max(2 * sample_rows // len(totals), 1)).select("lang", "v").orderBy("lang", "v").collect()
    langs = [r.lang for r in sample]
    v = vectors(np.stack([np.frombuffer(bytes(r.v), "<u2") for r in sample]).astype(float), idf) if sample else np.zeros((0, dims))
    cents, names = [], []
    for lang in sorted(set(langs)):
        c = cluster(v[[k for k, x in enumerate(langs) if x == lang]], per_lang)
        cents.append(c)
        names += [lang] * len(c)
    if not cents:
        return None
    c = np.concatenate(cents)
    return Model(idf, c, names, float(np.quantile((v @ c.T).max(1), 0.005)))


def identify(docs: DataFrame, model: Model | None, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, lang_pred, score, rejected) for every row.

    A null text or one without any letter is `und` with score 0 and rejected; so is every text
    if there is no model (no labelled row). Ids may be null or repeat; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(2).to_pylist()
                counts = np.stack([grams(t or "", len(model.idf) if model else 64) for t in texts])
                if model:
                    lang, score, far = model.predict(counts)
                else:
                    lang, score, far = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                blank = counts.sum(1) == 0
                lang = ["und" if x else y for x, y in zip(blank, lang, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang), pa.array(np.where(blank, 0.0, np.clip(score, 0, 1))), pa.array(far | blank)], ["id", "held_out", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def identify_by_folds(docs: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 2000) -> DataFrame:
    """Learns from the rows whose crc32 fold is not 0 and predicts every row; fold 0 is held out."""
    out = fold(F.col(id_col), folds) == 0
    return identify(docs, fit(docs.where(~out), id_col, text_col, lang_col, sample_rows=sample_rows), out, id_col, text_col)
