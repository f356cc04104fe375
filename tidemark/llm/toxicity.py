"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches.

Texts are folded first: letters that look alike and digits that stand for letters become one
plain letter each, all else becomes a space. Lexicon entries are words and beginnings of words
whose share among toxic training rows is far above that among the others; their weight is the
log of that ratio. Exception phrases are learned from the same rows: pairs of words with a listed
one that stand in clean rows nearly always. What matches, less what exception phrases excuse, is weighed
against a power of the text's length; the power and the weight that counts as toxic are those that
tell the training rows apart best.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, lean
from .common import fold as crc_fold

# Characters that look like a Latin letter, with that letter; digits that stand for one.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ɡ": "g", "ԛ": "q", "ԝ": "w", "п": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ß": "s", "ø": "o", "đ": "d", "ł": "l", "æ": "a", "œ": "o",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}

# features that a task counts before it hands them on
MANY = 200_000
# powers of the length that a lexicon may weigh matches against
POWERS = (0.5, 0.25, 0.75)

_table: list[np.ndarray] = []


def table() -> np.ndarray:
    """ASCII byte of each code point: a folded letter, a space, or 1 for combining marks, which vanish."""
    if not _table:
        out = np.full(0x110000, 32, np.uint8)
        for c in range(0x110000):
            ch = chr(c)
            if unicodedata.combining(ch) or c in (0x200B, 0x200C, 0x200D, 0xAD):
                out[c] = 1
                continue
            low = ch.lower()
            plain = unicodedata.normalize("NFKD", low)[:1] if c > 127 else low[:1]
            plain = LOOKALIKES.get(plain, LOOKALIKES.get(low, plain))
            if "a" <= plain <= "z":
                out[c] = ord(plain)
            elif ch.isalpha():
                out[c] = 95  # a letter without a Latin likeness
        for d, x in DIGITS.items():
            out[ord(d)] = ord(x)
        _table.append(out)
    return _table[0]


def folded(text: str | None) -> str:
    """Words in plain letters, with one space before, between and after them."""
    raw = table()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    out = raw[raw != 1].tobytes().decode("ascii")
    return f" {' '.join(out.split())} "


def features(words: set[str], least: int = 4, most: int = 9) -> set[str]:
    """Whole words (with a space at their end) and their beginnings."""
    out = {f"{w} " for w in words if len(w) > 1}
    for w in words:
        out.update(w[:k] for k in range(least, min(most, len(w)) + 1))
    return out


def _count(rows: DataFrame, listed: frozenset[str] | None) -> DataFrame:
    """(feature, n): rows that hold the feature; '' counts the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["feature", "n"])
        c: Counter = Counter()
        for b in batches:
            c[""] += b.num_rows
            for t in b.column(0):
                found = features(set(folded(t.as_py()).split()))
                c.update(found if listed is None else found & listed)
                if len(c) > MANY:
                    yield rows(c)
                    c = Counter()
        yield rows(c)

    return rows.select("t").mapInArrow(lean(run), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _contexts(rows: DataFrame, listed: frozenset[str]) -> dict[str, int]:
    """In how many different words' company (the word before) each feature stands: copies of one text add nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set()
            for t in b.column(0).to_pylist():
                before = ""
                for w in folded(t).split():
                    found.update((f, before) for f in features({w}) & listed)
                    before = w
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([w for _, w in found], pa.string())], ["feature", "before"])

    if not listed:
        return {}
    got = rows.select("t").mapInArrow(lean(run), "feature string, before string").distinct().groupBy("feature").agg(F.count("*").alias("n"))
    return {r.feature: r.n for r in got.collect()}


class Lexicon(NamedTuple):
    """weights: of words (with a space at their end) and beginnings; exceptions: pairs of words that excuse what they hold; a text of n words whose matches weigh w counts as toxic from w / n ** power = cut on."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    power: float = POWERS[0]
    cut: float = 0.5


def best_cut(w: np.ndarray, n: np.ndarray, toxic: np.ndarray, missed: int) -> tuple[float, float]:
    """(power, cut) of the best F1 over rows of matched weight w > 0, n words and labels, besides `missed` toxic rows without a match; the cut lies in the middle of the gap."""
    best = (-1.0, POWERS[0], 0.5)
    for power in POWERS:
        x = w / np.maximum(n, 1) ** power
        order = np.argsort(-x, kind="stable")
        x, y = x[order], toxic[order]
        ends = np.flatnonzero(np.append(x[1:] != x[:-1], True))
        hit = np.cumsum(y)[ends]
        f1 = 2 * hit / (ends + 1 + y.sum() + missed)
        # of equal ones the most rows
        k = len(f1) - 1 - int(np.argmax(f1[::-1]))
        low = x[ends[k] + 1] if k + 1 < len(ends) else x[ends[k]] / 4
        if f1[k] > best[0] + 1e-9:
            best = (float(f1[k]), power, float(np.sqrt(x[ends[k]] * low)))
    return best[1:]


def _fitted(rows: DataFrame, lexicon: Lexicon) -> Lexicon:
    """lexicon with power and cut from rows (t, y): three numbers of each row with a match come to the driver, of a sample at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(lexicon)
        for b in batches:
            got = [m.weigh(t.as_py()) for t in b.column(0)]
            on = np.array([w > 0 for w, _ in got], bool)
            w, n = (np.array([g[k] for g in got], float) for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(w[on]), pa.array(n[on]), b.column(1).filter(pa.array(on)).cast(pa.int64())], ["w", "n", "y"])

    got = rows.select("t", F.col("y").cast("long").alias("y")).mapInArrow(lean(run), "w double, n double, y long").toArrow().to_pandas().sort_values(["w", "n", "y"])
    if not len(got) or not (got["y"] == 1).any():
        return lexicon
    toxic = rows.where("y = 1").count()
    power, cut_ = best_cut(got["w"].to_numpy(), got["n"].to_numpy(), (got["y"] == 1).to_numpy(), toxic - int((got["y"] == 1).sum()))
    return lexicon._replace(power=power, cut=cut_)


def _phrases(rows: DataFrame, listed: frozenset[str]) -> DataFrame:
    """(phrase, toxic, clean): rows of each kind that hold a pair of neighbouring words of which one is listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: Counter = Counter()
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = folded(t).split()
                on = [k for k, w in enumerate(ws) if features({w}) & listed]
                count.update({(f"{ws[i]} {ws[i + 1]}", y == 1) for k in on for i in (k - 1, k) if 0 <= i < len(ws) - 1})
            keys = list(count)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in keys], pa.string()), pa.array([y for _, y in keys], pa.bool_()), pa.array([count[k] for k in keys], pa.int64())], ["phrase", "bad", "n"])

    got = rows.select("t", "y").mapInArrow(lean(run), "phrase string, bad boolean, n long")
    return got.groupBy("phrase").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(~F.col("bad"), F.col("n")).otherwise(0)).alias("clean"))


def learn(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 50_000, ratio: float = 30.0, evidence: float = 14.0) -> Lexicon:
    """A lexicon fitted on about `sample_rows` labelled rows at most, by a hash of the id.

    The labels of the sample are as many as that parameter says and go to every task, so texts
    aren't shuffled; its texts are written once. Rows with a null id or label teach nothing; an id
    with several labels counts as toxic if one says so. An entry is at least `ratio` times as
    frequent in toxic rows as in the others, and its evidence (log likelihood) is at least
    `evidence`, over rows and over the different words that it follows. A phrase is an exception
    if it stands in three clean rows or more and in a tenth as many toxic ones at most. Last the power
    of the length and the weight that counts are fitted on the sample's rows.
    """
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    y = y.where(train)
    share = sample_rows / max(y.count(), 1)
    y = y.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(share, 1.0) * (1 << 20)))
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null").join(F.broadcast(y), "id").select("t", "y"))
    toxic, clean = rows.where("y = 1"), rows.where("y <> 1")
    t, n = (r.n for r in rows.agg(F.count_if(F.col("y") == 1).alias("t"), F.count_if(F.col("y") != 1).alias("n")).select(F.explode(F.array("t", "n")).alias("n")).collect())
    if not t:
        return Lexicon({}, ())
    # a feature of fewer toxic rows can't have the evidence even if no clean row holds it
    fewest = max(3, math.ceil(evidence / max(-math.log(t / (t + n)), 1e-9))) if n else 3
    bad = {r.feature: r.n for r in _count(toxic, None).where(F.col("n") >= fewest).where("feature <> ''").collect()}
    if not bad:
        return Lexicon({}, ())
    good = {r.feature: r.n for r in _count(clean, frozenset(bad)).collect()}
    share = t / max(t + n, 1)
    out = {}
    for f, k in bad.items():
        c = good.get(f, 0)
        w = math.log((k + 0.5) / (t + 1)) - math.log((c + 0.5) / (n + 1))
        gain = k * math.log(k / ((k + c) * share)) + (c * math.log(c / ((k + c) * (1 - share))) if c and share < 1 else 0)
        if w >= math.log(ratio) and gain >= evidence:
            out[f] = min(w, 7.0)
    out = {f: w for f, w in out.items() if contexts[f] * math.log(1 / share) >= evidence} if (contexts := _contexts(toxic, frozenset(out))) else {}
    # of beginnings of one another that mark nearly the same toxic rows, the longest stays
    longer: dict[str, str] = {}
    for f in sorted(out, key=len):
        for k in range(4, len(f)):
            if f[:k] in out and bad[f] >= 0.95 * bad[f[:k]]:
                longer[f[:k]] = f
    out = {f: w for f, w in out.items() if f not in longer}
    # and an entry adds nothing where a shorter beginning of it is as sure
    keep = {f: w for f, w in out.items() if not any(out.get(f[:k], -1) >= w - 0.5 for k in range(4, len(f)))}
    found = _phrases(rows, frozenset(keep)).where("clean >= 3 and toxic * 10 <= clean").select("phrase").collect() if keep else []
    return _fitted(rows, Lexicon(dict(sorted(keep.items(), key=lambda x: (-x[1], x[0]))), tuple(sorted(r.phrase for r in found))))


class Matcher:
    def __init__(self, lexicon: Lexicon, threshold: float = 0.3) -> None:
        import ahocorasick

        self.power, self.half = lexicon.power, lexicon.cut * (1 - threshold) / threshold
        self.auto = ahocorasick.Automaton()
        for f, w in lexicon.weights.items():
            self.auto.add_word(f" {f}", (len(f) + 1, w))
        for p in lexicon.exceptions:
            q = f" {p} "
            self.auto.add_word(q, (len(q), None))
        self.any = len(self.auto) > 0
        if self.any:
            self.auto.make_automaton()

    def weigh(self, text: str | None) -> tuple[float, int]:
        """The summed weight of matches that start at different words and aren't excused, and the number of words."""
        f = folded(text)
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, w) in self.auto.iter(f) if self.any else ():
            start = end - size + 1
            if w is None:
                excused.append((start, end))
            else:
                best[start] = max(best.get(start, 0.0), w)
        for a, b in excused if best else ():
            for s in [s for s in best if a <= s < b]:
                del best[s]
        return sum(best.values()), f.count(" ") - 1

    def score(self, text: str | None) -> float:
        """0 to 1: x / (x + half), x the weight over the power of the length; the threshold where x is the lexicon's cut."""
        w, n = self.weigh(text)
        x = w / max(n, 1) ** self.power
        return x / (x + self.half)


def scored(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.3, score_col: str = "score", pred_col: str = "predicted") -> DataFrame:
    """docs with score (0 to 1; 0 for null and blank texts) and predicted (1 if score >= threshold).

    All columns and rows pass through, repeated rows with equal scores; texts are scored whole,
    whatever their length; an empty table gives an empty result; columns of docs named like the
    two new ones are an error.
    """
    if {score_col, pred_col} & set(docs.columns):
        raise ValueError(f"docs already has {score_col} or {pred_col}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(lexicon, threshold)
        for b in batches:
            s = np.array([m.score(t) for t in b.column(at).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*b.schema.names, score_col, pred_col])

    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField(pred_col, T.IntegerType())])
    return docs.mapInArrow(lean(run), schema)


def score_by_folds(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id_col, held_out, score, predicted): learns from rows whose crc32 fold of 4 is not 2, scores every row.

    Null and empty texts score 0; ids may be null or repeat; without toxic training rows every score is 0.
    """
    lexicon = learn(docs, labels, crc_fold(F.col("id"), 4) != 2, id_col, text_col)
    rows = docs.select(F.col(id_col), (crc_fold(F.col(id_col), 4) == 2).alias("held_out"), F.col(text_col).alias("text_to_score"))
    return scored(rows, lexicon, "text_to_score", threshold).drop("text_to_score")
