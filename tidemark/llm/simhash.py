"""SimHash near-duplicates found through Golay codewords.

A 64-bit fingerprint falls into segments of 22, 21 and 21 bits, each read as a word of the
[23,12,7] code. Fingerprints at 4 or fewer differing bits either agree on a whole segment, or
have exactly one differing bit in each of at least two segments (1+1+1 or 1+1+2). So two kinds
of keys lose no pair:

* exact: segment number and segment (its nearest codeword and syndrome), with one of five blocks
  of the other bits, of which one at least is equal too: 29 bits or more;
* pair: for two segments, one side gives the nearest codeword of each (distance 3 at most), the
  other side all codewords at distance 4 at most of each. With one bit of difference the nearest
  codeword of the one lies within 4 of the other. The parity of each distance goes into the key.

Candidates are verified by their differing bits. Inside one key every fingerprint is compared
with one representative first; what that already connects needs no further comparison, so a
large group of near copies costs its size, not its square. The rest is compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLOTS, apart, bitmap, components, cut, lean, marks

SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
GENERATOR = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial."""
    out = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        out ^= np.where((out >> bit) & 1, GENERATOR << (bit - 11), 0)
    return out


class Golay:
    """leader[s]: the error of weight 3 or less with syndrome s. near[s]: the up to 5 codewords w with w and leader[s] at distance 4."""

    def __init__(self) -> None:
        words = np.arange(4096, dtype=np.int64) << 11
        self.codewords = words | _syndrome(words)
        self.weight = np.array([bin(x).count("1") for x in range(1 << 12)], dtype=np.int64)
        one = 1 << np.arange(23, dtype=np.int64)
        light = [np.zeros(1, np.int64), one, (one[:, None] | one)[np.triu_indices(23, 1)]]
        i, j, k = (x.ravel() for x in np.meshgrid(*[np.arange(23)] * 3, indexing="ij"))
        light.append((one[i] | one[j] | one[k])[(i < j) & (j < k)])
        errors = np.concatenate(light)
        self.leader = np.zeros(2048, np.int64)
        self.leader[_syndrome(errors)] = errors
        sevens = self.codewords[self.bits(self.codewords) == 7]
        self.near = np.zeros((2048, 5), np.int64)
        for s in range(2048):
            if self.bits(self.leader[s : s + 1])[0] == 3:
                self.near[s] = sevens[(sevens & self.leader[s]) == self.leader[s]]

    def bits(self, x: np.ndarray) -> np.ndarray:
        return self.weight[x & 4095] + self.weight[(x >> 12) & 4095]

    def decode(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word the codewords within distance 4, nearest first, as index * 2 + parity of the distance; -1 where there are fewer than 6."""
        s = _syndrome(words)
        nearest = words ^ self.leader[s]
        out = np.full((len(words), 6), -1, np.int64)
        out[:, 0] = (nearest >> 11) * 2 + (self.bits(self.leader[s]) & 1)
        far = self.near[s]
        # distance 4 is even
        out[:, 1:] = np.where(far > 0, ((nearest[:, None] ^ far) >> 11) * 2, -1)
        return out


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """SimHash of the XXH64 (seed 42) of word shingles; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    buf = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[: len(words) - k]))
    stops = ends[k - 1 :] - 1
    h64 = xxhash.xxh64_intdigest
    h = np.fromiter((h64(buf[a:b], 42) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), np.uint64, len(stops))
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        count += np.unpackbits(h[at : at + (1 << 15)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long. Null and blank texts have 0; every row gives a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(lean(run), f"id {kind}, fp long")


def keys_of(fp: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, keys). probe: keys of the side that gives all codewords within 4; else of the side that gives the nearest."""
    g, u = golay(), fp.view(np.uint64)
    segs = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows = np.arange(len(fp))
    # kind in bits 60.., so that exact and pair keys differ
    who, keys = [], []
    for i, (at, n) in enumerate(SEGMENTS):
        rest = ((u >> np.uint64(at + n)) << np.uint64(at)) | (u & np.uint64((1 << at) - 1))
        # four differing bits leave one of five blocks of the rest alone
        for k in range(5):
            low, high = k * (64 - n) // 5, (k + 1) * (64 - n) // 5
            block = ((rest >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)).astype(np.int64)
            who.append(rows)
            keys.append((np.int64(i) << 60) | (np.int64(k) << 40) | (block << 24) | segs[i])
    codes = [g.decode(s) for s in segs]
    for n, (i, j) in enumerate(PAIRS):
        a, b = (c if probe else c[:, :1] for c in (codes[i], codes[j]))
        # one differing bit flips the parity of the distance to a codeword
        flip = np.int64(probe)
        both = (((a ^ flip)[:, :, None] << 14) | (b ^ flip)[:, None, :]) | (np.int64(3 + n) << 60)
        ok = (a >= 0)[:, :, None] & (b >= 0)[:, None, :]
        r, x, y = np.nonzero(ok)
        who.append(r)
        keys.append(both[r, x, y])
    return np.concatenate(who), np.concatenate(keys)


def _keyed(fps: DataFrame, probe: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                r, k = keys_of(part, probe)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(part[r]), pa.array(n[at : at + 4096][r])], ["key", "fp", "n"])

    return fps.select("fp", "n").mapInArrow(lean(run), "key long, fp long, n long")


def _differing(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints (fp, n: its rows) whose components are those of all pairs at `bits` (4 at most) differing bits."""
    if not 0 <= bits <= 4:
        raise ValueError("the keys find 4 differing bits at most")
    base = _keyed(fps, False)
    rep = base.groupBy("key").agg(F.max(F.struct("n", "fp")).getField("fp").alias("rep"), F.count("*").alias("n_base"))
    met = cut(_keyed(fps, True).join(rep, "key").where("fp <> rep or n_base > 1").select("key", "fp", "rep", "n_base"))
    star = met.where((F.col("fp") != F.col("rep")) & (_differing("fp", "rep") <= bits)).select(F.col("rep").alias("src"), F.col("fp").alias("dst")).distinct()
    star = cut(star)
    of = components(star)
    # keys whose members one representative doesn't connect
    label = lambda df, c, name: df.join(of.select(F.col("node").alias(c), F.col("root").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))
    open_ = met.where("n_base > 1")
    probe = cut(label(label(open_, "fp", "root"), "rep", "rep_root").select("key", "fp", "root", "rep_root"))
    held = base.join(open_.select("key").distinct(), "key", "left_semi").select("key", F.col("fp").alias("other"))
    held = cut(label(held, "other", "other_root").select("key", "other", "other_root"))
    off = probe.where("root <> rep_root")
    keys = lambda df: df.select("key").distinct()
    roots = probe.select("key", "rep_root").distinct()
    held = held.join(roots, "key")
    test = (F.col("root") != F.col("other_root")) & (_differing("fp", "other") <= bits)
    a = probe.alias("p").join(held.where("other_root <> rep_root").drop("rep_root").alias("h"), "key").where(test)
    b = off.alias("p").join(held.where("other_root = rep_root").drop("rep_root").alias("h"), "key").where(test)
    more = a.select(F.col("other").alias("src"), F.col("fp").alias("dst")).union(b.select(F.col("other").alias("src"), F.col("fp").alias("dst")))
    return star.union(more)


WORDS, WIDE = 6, 16
# texts of Jaccard similarity 0.8 differ in 15 % of the bits, unlike ones in half: three standard deviations more of 384 and of 64 bits
FAR, NEAR = 80, 22


def wide_fingerprint(text: bytes | None, shingle: int) -> np.ndarray:
    """Six longs: SimHash of 384 bits of the distinct word shingles; zeros for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(WORDS, np.uint64)
    h = np.fromiter(shingles(words, shingle), np.uint64)
    count = np.zeros((WORDS, 64), np.int64)
    for at in range(0, len(h), 1 << 13):
        part = h[at : at + (1 << 13)]
        for k in range(WORDS):
            part = part * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
            part ^= part >> np.uint64(31)
            count[k] += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(2 * count > len(h), axis=1).view(">u8").ravel().astype(np.uint64)


def shingles(words: list[bytes], shingle: int) -> set[int]:
    """XXH64 of the distinct shingles of a text's words; fewer words are one shingle."""
    k = min(shingle, len(words))
    return {xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)}


def wide_keys(fps: np.ndarray) -> np.ndarray:
    """(n, 120) keys of n wide fingerprints: for every two of 16 segments of 23 bits their nearest codewords."""
    g = golay()
    u = np.concatenate((fps, np.zeros((len(fps), 1), np.uint64)), axis=1)
    code = []
    for k in range(WIDE):
        word, at = divmod(23 * k, 64)
        seg = u[:, word] >> np.uint64(at)
        if at > 41:
            seg = seg | (u[:, word + 1] << np.uint64(64 - at))
        code.append(g.decode((seg & np.uint64((1 << 23) - 1)).astype(np.int64))[:, 0] >> 1)
    pairs = [(i, j) for i in range(WIDE) for j in range(i)]
    return np.stack([(np.int64(n) << 24) | (code[i] << 12) | code[j] for n, (i, j) in enumerate(pairs)], 1)


def _name(text: bytes | None) -> bytes:
    """128 bits of a text's words."""
    return xxhash.xxh3_128_digest(b" ".join((text or b"").lower().split()))


def _wide(docs: DataFrame, shingle: int) -> DataFrame:
    """(row, name, check, fp, w0..w5, keys) of docs (row, t): hashes of the words' text, fingerprint, wide fingerprint and its keys; keys only where a task meets a text first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                names, prints, new = [], [], []
                for t in part.column(1):
                    t = t.as_py()
                    name = _name(t)
                    new.append(name not in seen)
                    if new[-1]:
                        if len(seen) > 100_000:
                            seen.clear()
                        seen[name] = np.concatenate(([np.uint64(fingerprint(t))], wide_fingerprint(t, shingle)))
                    names.append(name)
                    prints.append(seen[name])
                p, fresh = np.array(prints, np.uint64).reshape(-1, WORDS + 1), np.array(new, bool)
                keys, size = wide_keys(p[fresh, 1:]).ravel(), np.concatenate(([0], np.cumsum(fresh * (WIDE * (WIDE - 1) // 2))))
                two = np.frombuffer(b"".join(names), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(two[:, 0]), pa.array(two[:, 1]), *(pa.array(p[:, k].view(np.int64)) for k in range(WORDS + 1)), pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(keys))], columns)

    columns = ["row", "name", "check", "fp", *(f"w{k}" for k in range(WORDS)), "keys"]
    schema = f"row {docs.schema['row'].dataType.simpleString()}, name long, check long, fp long, {', '.join(f'w{k} long' for k in range(WORDS))}, keys array<long>"
    return docs.mapInArrow(lean(run), schema)


def _texts(docs: DataFrame, marked: bytes) -> DataFrame:
    """(name, t) of the texts of docs (row, t) whose name is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.frombuffer(marked, np.uint64)
        for b in batches:
            # one text at a time
            name = np.frombuffer(b"".join(_name(t.as_py()) for t in b.column(0)), ">i8").astype(np.int64).reshape(-1, 2)[:, 0]
            slot = name % SLOTS
            hit = np.flatnonzero((on[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1))
            for at in range(0, len(hit), 256):
                some = hit[at : at + 256]
                yield pa.RecordBatch.from_arrays([pa.array(name[some]), b.column(0).take(pa.array(some))], ["name", "t"])

    return docs.select("t").mapInArrow(lean(run), "name long, t binary")


def _jaccard(pairs: DataFrame, shingle: int, least: float) -> DataFrame:
    """Pairs (a, b, ta, tb) whose texts have a Jaccard similarity of word shingles of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, set[int]] = (0, set())
        for b in batches:
            a, on = b.column(0).to_pylist(), []
            for k in range(b.num_rows):
                # a representative stands in many pairs, mostly one after another
                x = last[1] if last[1] and last[0] == a[k] else shingles(b.column(2)[k].as_py().lower().split(), shingle)
                last = (a[k], x)
                y = shingles(b.column(3)[k].as_py().lower().split(), shingle)
                on.append(len(x & y) >= least * len(x | y))
            yield b.select(["a", "b"]).filter(pa.array(on, pa.bool_()))

    return pairs.select("a", "b", "ta", "tb").mapInArrow(lean(run), "a long, b long")


def near_texts(docs: DataFrame, row_col: str, text_col: str = "text", shingle: int = 5, least: float = 0.8, bits: int = 4) -> DataFrame:
    """(row_col, component, own) for every row of docs; rows that agree in the last two are near duplicates.

    Links are texts of Jaccard similarity `least` or more over sets of word shingles, and
    fingerprints (see near_duplicates) at `bits` or fewer differing bits. Texts of equal words are
    one text; rows without words are one component. Candidates for the first kind share the
    nearest Golay codewords of two of 16 segments of a wide SimHash and differ in few of its bits;
    each is verified on its text. README.md states the recall of the keys. Repeated rows, ties and
    texts of any length are taken as they are; an empty table gives an empty result.
    """
    docs = docs.select(F.col(row_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    rows = cut(_wide(docs, shingle))
    fps = [f"w{k}" for k in range(WORDS)]
    of = rows.where(F.size("keys") > 0)
    keyed = of.where(" or ".join(f"{w} <> 0" for w in fps)).select("name", "w0", F.explode("keys").alias("key"))
    # two texts alone in a key, most of which meet by chance, must be near: the test that is asked of all their pairs
    shared = keyed.groupBy("key").agg(F.min("name").alias("least"), F.max("name").alias("last"), F.count("*").alias("m"), F.bit_xor("w0").alias("apart"))
    shared = shared.where((F.col("least") != F.col("last")) & ((F.col("m") > 2) | (F.bit_count("apart") <= NEAR))).select("key")
    met = cut(keyed.join(shared, "key"))
    prints = of.groupBy("name").agg(*[F.min(w).alias(w) for w in fps])

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda c: prints.select(F.col("name").alias(c), *[F.col(w).alias(f"{w}_{c}") for w in fps])
        far = sum((_differing(f"{w}_a", f"{w}_b") for w in fps[1:]), _differing("w0_a", "w0_b"))
        p = cut(pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(far <= FAR).select("a", "b"))
        some = cut(_texts(docs, bitmap(marks(p.select(F.explode(F.array("a", "b")).alias("name")), "name"))).groupBy("name").agg(F.first("t").alias("t")))
        text = lambda c: some.select(F.col("name").alias(c), F.col("t").alias(f"t{c}"))
        return cut(_jaccard(p.join(text("b"), "b").join(text("a"), "a"), shingle, least))

    def rooted(edges: DataFrame) -> DataFrame:
        return met.join(components(edges, "a", "b").withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))

    # fingerprints at few bits
    few = of.groupBy("fp").agg(F.count("*").alias("n"), F.min("name").alias("least"))
    group = of.select("name", "fp").join(components(links(few, bits)).withColumnRenamed("node", "fp"), "fp", "left").select("name", F.coalesce("root", "fp").alias("group"))
    edges = cut(group.join(group.groupBy("group").agg(F.min("name").alias("least")), "group").select(F.col("least").alias("a"), F.col("name").alias("b")).where("a <> b").distinct())
    # each text with one representative of a key, then with two more; only texts that none of them connects meet one another.
    # unlike texts differ in 32 of 64 bits, alike ones in 10
    top = F.struct("name", "w0", "root")
    for orders in ((F.col("name"),), (-F.col("name"), F.xxhash64("name"))):
        named = rooted(edges)
        reps = named.groupBy("key").agg(F.array(*[F.min_by(top, o) for o in orders]).alias("tops"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", "tops")
        near = named.join(reps, "key").withColumn("top", F.explode("tops")).where((F.col("root") != F.col("top.root")) & (_differing("w0", "top.w0") <= NEAR))
        edges = cut(edges.union(verified(near.select(F.col("top.name").alias("a"), F.col("name").alias("b")))))
    rest = apart(rooted(edges), ["name", "w0"]).where(_differing("x.w0", "y.w0") <= NEAR)
    edges = edges.union(verified(rest.select(F.least("x.name", "y.name").alias("a"), F.greatest("x.name", "y.name").alias("b"))))
    linked = components(edges, "a", "b").withColumnRenamed("node", "name")
    linked = linked.union(linked.select("root", "root").distinct())
    # texts that nothing else is linked to are told apart by all 128 bits
    out = rows.select("row", "name", "check").join(linked.hint("merge"), "name", "left")
    return out.select(F.col("row").alias(row_col), F.coalesce("root", "name").alias("component"), F.when(F.col("root").isNull(), F.col("check")).otherwise(0).alias("own"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4, shingle: int = 4) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of docs.

    fingerprint is 16 lowercase hex digits; component_id is the smallest id reachable over links
    of `bits` or fewer differing bits, the row's own included. Null and blank texts have
    fingerprint zero and link like any other. A null id gets its component's smallest id (null
    if no member has one); repeated rows are all returned; an empty table gives an empty result.
    Only the two named columns are read, so others may have any name.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    classes = cut(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    of = components(links(classes, bits))
    rooted = cut(classes.select("fp", "least").join(of.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    low = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    to = rooted.join(low.hint("merge"), "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(to.hint("merge"), "fp").select(F.col("id").alias(id_col), hexed, "component_id")
