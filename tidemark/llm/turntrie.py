"""A trie of conversations by their turns, with counts for every shared prefix.

Conversations become rows of turn ids, sorted into ranges. In a range, numpy sorts padded
matrices of ids, eight columns at a time; changes against the row above, OR-accumulated over the
columns, mark where nodes start, and reduceat sums every depth. Nodes that may lie in two ranges
are added up by their key, and their subtrees in a second pass over the ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CRC_SQL, crc_sql, cut

WORD = r"[^\x20\x09-\x0D]+"
WIDTH = 8  # columns that are sorted at once, and by which conversations are dealt out
SHARD = 1 << 19  # turns of a range
PIECE = 1 << 16  # ids of one piece of a list
PAD = np.iinfo(np.int64).min
NONE = hashlib.sha256(b"").hexdigest()
SUMS = ["n_children", "n_leaves", "saved_tokens"]
KEY = ["key1", "key2"]
PART = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("up", T.IntegerType()), T.StructField("shared", T.BooleanType()), *[T.StructField(k, T.LongType()) for k in ("key1", "key2", "parent1", "parent2")],
    T.StructField("conv_id", T.LongType()), T.StructField("depth", T.LongType()), T.StructField("parent_conv_id", T.LongType()), T.StructField("n_convs", T.LongType()), T.StructField("words", T.LongType()), T.StructField("inner", T.BooleanType()),
    *[T.StructField(k, T.LongType()) for k in SUMS], T.StructField("ends_sha256", T.StringType()), T.StructField("ends", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("ids", T.StringType())]))),
])


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, said): the turns of each conversation as structs of two hashes (128 bits) and the words of the text, ordered by turn (null first), then role and text.

    A null role or text counts as empty; rows without a conversation id are left out.
    """
    t = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("conv is not null")
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    said = F.struct(F.row_number().over(order).alias("pos"), F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("second"), "text", "role").alias("h2"), F.regexp_count("text", F.lit(WORD)).alias("words"))
    return t.select("conv", said.alias("t")).groupBy("conv").agg(F.transform(F.array_sort(F.collect_list("t")), lambda x: x.dropFields("pos")).alias("said"))


def regrown(seqs: DataFrame, family: int, most: int, share: Column) -> DataFrame:
    """Every conversation with the first turns of the first of its family in place of its own: share (up to most) turns; a family is `family` ids."""
    head = seqs.where(F.col("conv") % family == 0).select(F.col("conv").alias("head"), F.slice("said", 1, most).alias("first"))
    j = seqs.withColumn("head", F.col("conv") - F.col("conv") % family).join(head, "head", "left").withColumn("h", share.cast("int"))
    none = F.slice("said", F.lit(1), F.lit(0))
    return j.select("conv", F.concat(F.slice(F.coalesce("first", none), F.lit(1), F.col("h")), F.slice("said", F.col("h") + 1, F.greatest(F.size("said") - F.col("h"), F.lit(0)))).alias("said"))


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A hash of two longs each, for keys of prefixes."""
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64) + np.uint64(salt)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def up_sums(depth: np.ndarray, up: np.ndarray, *own: np.ndarray) -> list[np.ndarray]:
    """Each array summed over subtrees; up is the index of the parent, -1 for roots."""
    out = [x.copy() for x in own]
    order = np.argsort(depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts)[::-1]:
        level = level[up[level] >= 0]
        for x in out:
            np.add.at(x, up[level], x[level])
    return out


def nodes_of(conv: np.ndarray, starts: np.ndarray, h1: np.ndarray, h2: np.ndarray, words: np.ndarray) -> dict:
    """The nodes of one range of conversations: arrays by node, parents before children, and the ends (node, conversations) in ascending order.

    starts: where each conversation's turns begin in h1, h2 and words, one more than conversations.
    """
    lens = np.diff(starts)
    n = len(conv)
    top = np.zeros(1, np.int64)
    cols: dict[str, list[np.ndarray]] = {"up": [top - 1], "depth": [top], "n": [top + n], "conv": [np.array([conv.min()])], "words": [top], "key1": [top], "key2": [top], "first": [top]}
    # rows of the first and last stretch of this range, which others may share
    head = np.full((n, WIDTH), PAD)
    for j in range(WIDTH):
        has = lens > j
        head[has, j] = h1[starts[:-1][has] + j]
    low, high = (np.lexsort(head.T[::-1])[k] for k in (0, -1))
    edge = (head == head[low]).all(1) | (head == head[high]).all(1)
    shared: list[np.ndarray] = [np.array([True])]
    ends: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(int((lens == 0).sum()), np.int64), np.sort(conv[lens == 0]))]
    rows, group, count, d0 = np.arange(n), np.zeros(n, np.int64), 1, 0
    while True:
        on = lens[rows] > d0
        rows, group = rows[on], group[on]
        if not len(rows):
            break
        has = d0 + np.arange(WIDTH) < lens[rows][:, None]
        at = np.minimum(starts[:-1][rows][:, None] + d0 + np.arange(WIDTH), len(h1) - 1)
        ids = np.empty((len(rows), 2 * WIDTH), np.int64)
        ids[:, 0::2], ids[:, 1::2] = np.where(has, h1[at], PAD), np.where(has, h2[at], PAD)
        order = np.lexsort((conv[rows], *ids.T[::-1], group))
        rows, group, has, at, ids = rows[order], group[order], has[order], at[order], ids[order]
        change = np.ones((len(rows), WIDTH), bool)
        change[1:] = (ids[1:, 0::2] != ids[:-1, 0::2]) | (ids[1:, 1::2] != ids[:-1, 1::2]) | (has[1:] != has[:-1])
        change[1:, 0] |= group[1:] != group[:-1]
        change = np.logical_or.accumulate(change, axis=1)
        for j in range(WIDTH):
            live = np.flatnonzero(has[:, j])
            if not len(live):
                break
            new = np.flatnonzero(change[live, j])
            own = count + np.cumsum(change[live, j]) - 1
            first = live[new]
            up = group[first]
            base = count - len(cols["key1"][-1])  # parents stand among the nodes of the depth before
            a, b = ids[first, 2 * j], ids[first, 2 * j + 1]
            k1, k2 = cols["key1"][-1][up - base], cols["key2"][-1][up - base]
            cols["up"].append(up)
            cols["depth"].append(np.full(len(new), d0 + j + 1))
            cols["n"].append(np.diff(np.append(new, len(live))))
            cols["conv"].append(np.minimum.reduceat(conv[rows[live]], new))
            cols["words"].append(words[at[first, j]].astype(np.int64))
            cols["key1"].append(_mix(_mix(k1, a, 1), b, 2))
            cols["key2"].append(_mix(_mix(k2, b, 3), a, 4))
            cols["first"].append(rows[first])
            shared.append(np.logical_or.reduceat(edge[rows[live]], new))
            done = lens[rows[live]] == d0 + j + 1
            ends.append((own[done], conv[rows[live]][done]))
            group[live] = own
            count += len(new)
        d0 += WIDTH
    out = {k: np.concatenate(v) for k, v in cols.items()}
    return out | {"shared": np.concatenate(shared), "ends": ends}


def _frame(shard: int, g: dict) -> pd.DataFrame:
    """Rows of PART: whole figures for nodes of this range alone; for shared ones what this range and its own nodes add."""
    size, up, shared = len(g["up"]), g["up"], g["shared"]
    below = up >= 0
    inner = np.zeros(size, bool)
    inner[up[below]] = True
    own = ~shared  # figures of shared nodes themselves come with the second pass
    leaves, saved = up_sums(g["depth"], up, (own & ~inner).astype(np.int64), np.where(own, (g["n"] - 1) * g["words"], 0))
    children = np.zeros(size, np.int64)
    np.add.at(children, up[below & own], 1)
    sha = np.full(size, NONE, object)
    lists: list = [None] * size
    for node, convs in g["ends"]:
        if not len(node):
            continue
        order = np.lexsort((convs, node))
        node, convs = node[order], convs[order]
        cuts = np.flatnonzero(np.diff(node)) + 1
        for k, part in zip(node[np.append(0, cuts)], np.split(convs, cuts), strict=True):
            if shared[k]:
                lists[k] = [{"first": int(part[i]), "ids": ",".join(map(str, part[i : i + PIECE].tolist()))} for i in range(0, len(part), PIECE)]
            else:
                sha[k] = hashlib.sha256(",".join(map(str, part.tolist())).encode()).hexdigest()
    parent = np.where(below, up, 0)
    by_key = shared | shared[parent]  # these take the parent's figure by its key
    null = lambda x, keep: pd.array(np.where(keep, x, 0), "Int64").copy() if keep.all() else pd.array([v if k else None for v, k in zip(x.tolist(), keep.tolist(), strict=True)], "Int64")
    return pd.DataFrame({
        "shard": np.full(size, shard, np.int32), "at": np.arange(size, dtype=np.int32), "up": up.astype(np.int32), "shared": shared, "key1": g["key1"], "key2": g["key2"], "parent1": null(g["key1"][parent], below & by_key), "parent2": null(g["key2"][parent], below & by_key), "conv_id": g["conv"], "depth": g["depth"],
        "parent_conv_id": null(g["conv"][parent], below & ~by_key), "n_convs": g["n"], "words": g["words"], "inner": inner, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": sha, "ends": lists,
    })


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got).combine_chunks()
    said = t.column("h1").combine_chunks()
    starts = said.offsets.to_numpy().astype(np.int64)
    flat = lambda c: t.column(c).combine_chunks().values.to_numpy(zero_copy_only=False)
    g = nodes_of(t.column("conv").to_numpy(), starts, flat("h1"), flat("h2"), flat("words"))
    yield from pa.Table.from_pandas(_frame(TaskContext.get().partitionId(), g), schema=_arrow(), preserve_index=False).to_batches(max_chunksize=10_000)


def _arrow() -> pa.Schema:
    kinds = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.StringType(): pa.string()}
    return pa.schema([(f.name, kinds.get(f.dataType, pa.list_(pa.struct([("first", pa.int64()), ("ids", pa.string())])))) for f in PART])


def _again(rows: pd.DataFrame) -> pd.DataFrame:
    """What one range adds to the subtrees of its shared nodes: a node's own figures count in the first of its ranges."""
    rows = rows.sort_values("at", kind="stable")
    at, up = rows["at"].to_numpy(), rows["up"].to_numpy()
    above = np.where(up >= 0, np.searchsorted(at, np.maximum(up, 0)), -1)
    mine, inner = (rows["owner"] == rows["shard"]).to_numpy(), rows["inner"].to_numpy()
    leaves, saved = up_sums(rows["depth"].to_numpy(), above, rows["n_leaves"].to_numpy() * 0 + (mine & ~inner), np.where(mine, (rows["n_convs"] - 1) * rows["words"], 0))
    children = rows["n_children"].to_numpy().copy()
    np.add.at(children, above[mine & (above >= 0)], 1)
    # n_leaves and saved_tokens hold the range's own nodes already, summed over all of a node's subtree
    return pd.DataFrame({"key1": rows["key1"], "key2": rows["key2"], "n_children": children, "n_leaves": leaves + rows["n_leaves"].to_numpy(), "saved_tokens": saved + rows["saved_tokens"].to_numpy()})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key1, key2, ends_sha256) of pieces sorted by key and first id; one hash is kept at a time, never a list."""
    now, h = None, None
    out: list[tuple] = []
    for b in batches:
        for k1, k2, ids in zip(*(b.column(c).to_pylist() for c in ("key1", "key2", "ids")), strict=True):
            if (k1, k2) != now:
                if now is not None:
                    out.append((*now, h.hexdigest()))
                now, h = (k1, k2), hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        if out:
            yield _rows(out)
            out = []
    if now is not None:
        yield _rows([(*now, h.hexdigest())])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    k1, k2, sha = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sha, pa.string())], [*KEY, "ends_sha256"])


def trie(seqs: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes of conversations (conv, said): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and key1 and key2, 128 bits that name the prefix.

    A node is a distinct sequence of first turns; the root has none and every conversation is a
    member of it. Conversations of equal turns are members of the same nodes, any number of
    them: they are dealt out by their id. A conversation's ids (24 bytes a turn) are one row;
    nothing is as wide as the longest one but its own row. No conversation, no node.
    """
    flat = lambda c: F.transform("said", lambda x: x[c])
    rows = cut(seqs.select("conv", flat("h1").alias("h1"), flat("h2").alias("h2"), flat("words").alias("words")))
    if shards is None:
        turns = rows.agg(F.sum(F.size("h1"))).first()[0] or 0
        shards = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), turns // SHARD + 1)
    dealt = rows.repartitionByRange(shards, F.slice("h1", 1, WIDTH), "conv")
    part = cut(dealt.mapInArrow(_shard, PART))
    ours = part.where("shared")
    totals = ours.groupBy(*KEY, "depth").agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("shard").alias("owner"), F.max("inner").alias("inner"), F.first("parent1").alias("parent1"), F.first("parent2").alias("parent2"))
    totals = cut(totals)
    again = ours.drop("n_convs", "inner", "depth", "conv_id").join(totals.select(*KEY, "depth", "n_convs", "owner", "inner"), KEY)
    again = again.select("shard", "at", "up", *KEY, "depth", "n_convs", "words", "owner", "inner", *SUMS)
    sums = again.groupBy("shard").applyInPandas(_again, "key1 long, key2 long, n_children long, n_leaves long, saved_tokens long").groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in SUMS])
    pieces = ours.select(*KEY, F.explode("ends").alias("e")).select(*KEY, "e.first", "e.ids")
    sha = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, "key1 long, key2 long, ends_sha256 string")
    names = totals.select(F.col("key1").alias("parent1"), F.col("key2").alias("parent2"), F.col("conv_id").alias("parent_conv_id"))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", *SUMS, "ends_sha256", *KEY]
    both = totals.join(sums, KEY).join(sha, KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE))).join(names, ["parent1", "parent2"], "left").select(*cols)
    alone = part.where("not shared")
    below = alone.where("parent1 is not null").drop("parent_conv_id").join(names, ["parent1", "parent2"]).select(*cols)
    return both.union(below).union(alone.where("parent1 is null").select(*cols))


TRIE_SQL = rf"""
with {CRC_SQL},
t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) as said from conversations where conv_id is not null),
g as (select c, list(said order by pos) as own from t group by c),
s as (select c, own, {crc_sql("list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)")} % 4 as h from g, crc),
f as (select s.c, list_concat(coalesce(b.own, [])[1:s.h], s.own[s.h + 1:]) as seq from s left join s b on b.c = s.c - s.c % 20),
p as (select c, seq[1:d] as node, d, len(seq) = d as ended from f, (select unnest(range(0, (select max(len(seq)) + 1 from f))) as d) where d <= len(seq)),
n as (select node, d, count(*) as n, min(c) as c, string_agg(c::varchar, ',' order by c) filter (ended) as ends, (count(*) - 1) * case when d = 0 then 0 else len(regexp_extract_all(node[d].t, '[^\x20\x09-\x0D]+')) end as saved from p group by node, d),
k as (select node[1:d - 1] as node, d - 1 as d, count(*) as kids from n where d > 0 group by 1, 2),
l as (select n.*, coalesce(kids, 0) as kids from n left join k using (node, d)),
u as (select a.node[1:x] as node, x as d, sum((a.kids = 0)::int) as leaves, sum(a.saved) as saved from l a, (select unnest(range(0, (select max(d) + 1 from n))) as x) where x <= a.d group by 1, 2)
select l.c as conv_id, l.d::bigint as depth, o.c as parent_conv_id, l.n as n_convs, l.kids as n_children, u.leaves::bigint as n_leaves, u.saved::bigint as saved_tokens, sha256(coalesce(l.ends, '')) as ends_sha256
from l join u on u.node = l.node and u.d = l.d left join n o on o.d = l.d - 1 and o.node = l.node[1:l.d - 1]
"""
