"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points are mapped through the cumulative targets, so that any stretch of slots holds
each source in about its share. A source's documents, shuffled, lie end to end on a line of words
that repeats up to three times; the line is cut into blocks of equal words, and the source's
slots, ranked, take the blocks in order. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
EPOCHS = 3
# points are multiples of the golden ratio modulo 1 on a lattice of 2^31: an odd step passes all of it
LATTICE, STEP = 1 << 31, 1327217885
CELLS, CHUNK, PART, COPIES = 1 << 16, 1 << 16, 8192, 4096


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, size): the words of each document, 0 for a null text."""
    return docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """(k, source, source_size, target, quota) of each source.

    Sources in order, null last, weigh 1, 2, 3, 1, ...; targets share all words by weight but stop
    at three times the source's words, and what is over goes to the others by weight. Sources are
    sorted by the level at which they stop, so that those which do are the first ones; the level
    of the first that doesn't, the largest of the rest, holds for all of them. The windows have
    one row a source.
    """
    g = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    g = g.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", (F.col("k") - 1) % 3 + 1)
    most = F.col("source_size") * EPOCHS
    by = Window.orderBy((most / F.col("weight")).asc(), "k")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = (total - F.coalesce(F.sum(most).over(before), F.lit(0))) / F.sum("weight").over(after)
    g = cut(g.withColumn("level", level))
    rest = g.where(most >= F.col("level") * F.col("weight")).agg(F.max("level").alias("settled"))
    goal = F.least(most.cast("double"), F.col("settled") * F.col("weight"))
    out = g.crossJoin(F.broadcast(rest)).withColumn("target", goal)
    return out.select("k", "source", "source_size", "target", F.floor("target").alias("quota"))


def schedule(goals: DataFrame, block: int) -> DataFrame:
    """(k, rank, slot): for each source its blocks, 0 to ceil(quota / block) - 1, each once, and the slots that they have in the mix.

    Points in a source's part of the cumulative quotas are its slots; their ranks are counted in
    chunks of slots, so that no source's slots meet in one task. The points miss a quota by a few
    slots at most: slots that a source has too many go to sources that have too few, what is
    still missing goes behind the last slot.
    """
    spark = goals.sparkSession
    need = F.ceil(F.col("quota") / block)
    upto = F.sum("quota").over(Window.orderBy("k"))
    parts = goals.where("quota > 0").select("k", need.alias("need"), upto.alias("upto"), "quota")
    whole = parts.agg(F.sum("quota")).first()[0] or 0
    slots = -(-whole // block)
    bound = lambda c: F.floor(c / whole * LATTICE)
    parts = cut(parts.withColumns({"low": bound(F.col("upto") - F.col("quota")), "high": bound(F.col("upto"))})) if whole else parts.withColumns({"low": F.lit(0).cast("long"), "high": F.lit(0).cast("long")})
    width = LATTICE // CELLS
    ends = parts.where("high > low").withColumn("cell", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))))
    points = spark.range(0, slots, 1, max(spark.sparkContext.defaultParallelism, slots >> 22)).select(F.col("id").alias("slot"), (F.col("id") % LATTICE * STEP % LATTICE).alias("x")).withColumn("cell", F.expr(f"x div {width}"))
    mine = points.join(ends, "cell").where("x >= low and x < high").select("k", "need", "slot", F.expr(f"slot div {CHUNK}").alias("chunk"))
    mine = mine.withColumn("rank", F.row_number().over(Window.partitionBy("k", "chunk").orderBy("slot")) - 1)
    counts = mine.groupBy("k", "chunk").agg(F.count("*").alias("n"))
    offsets = counts.select("k", "chunk", (F.sum("n").over(Window.partitionBy("k").orderBy("chunk")) - F.col("n")).alias("before"))
    ranked = cut(mine.join(offsets, ["k", "chunk"]).select("k", "need", "slot", (F.col("rank") + F.col("before")).alias("rank")))
    over = ranked.where("rank >= need").select("slot", F.row_number().over(Window.orderBy("slot")).alias("i"))
    have = ranked.groupBy("k").agg(F.count("*").alias("have"))
    short = parts.join(have, "k", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < need")
    short = short.select("k", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("rank")).withColumn("i", F.row_number().over(Window.orderBy("rank", "k")))
    filled = short.join(over, "i", "left").select("k", "rank", F.coalesce("slot", F.lit(slots) + F.col("i")).alias("slot"))
    return ranked.where("rank < need").select("k", "rank", "slot").union(filled)


def lined(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(k, id, size, at): where each document begins on its source's line, in the order of a hash of id and size.

    Equal (source, id, size) are one stretch until the end. Offsets are summed over parts of the
    hash first, so that a source's documents never meet in one task.
    """
    g = goals.select("k", F.col("source").alias("its source"))
    rows = sizes.where("size > 0").join(g, F.col("source").eqNullSafe(F.col("its source"))).groupBy("k", "id", "size").agg(F.count("*").alias("copies"))
    key = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string")).cast("binary"))
    parts = 1 + sizes.count() // PART
    rows = rows.withColumn("key", key).withColumn("part", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * parts / (1 << 32)))
    rows = rows.withColumn("length", F.col("size") * F.col("copies"))
    sums = rows.groupBy("k", "part").agg(F.sum("length").alias("n"))
    offsets = sums.select("k", "part", (F.sum("n").over(Window.partitionBy("k").orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("length").over(Window.partitionBy("k", "part").orderBy("key", F.col("id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    at = rows.withColumn("within", within).join(offsets, ["k", "part"]).select("k", "id", "size", "copies", (F.col("within") + F.col("before")).alias("at"))
    # many copies come out of several tasks
    first = at.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long")))).hint("rebalance")
    copy = F.explode(F.sequence("from", F.least(F.col("from") + COPIES, F.col("copies")) - 1))
    return first.withColumn("copy", copy).select("k", "id", "size", (F.col("at") + F.col("copy") * F.col("size")).alias("at"))


def block_size(words: int, slots: int = 1 << 16, most: int = 4096) -> int:
    """Words of a block: `most`, or fewer where the words would not fill `slots` slots."""
    return max(1, min(most, words // slots))


def pieces(line: DataFrame, goals: DataFrame, block: int) -> DataFrame:
    """(k, rank, id, size, at, first, words): `words` words of a document from its word `first` on, in block `rank` of its source's repeated line."""
    span = line.join(goals.select("k", "source_size", "quota"), "k").where("at < quota")
    span = span.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1)))).withColumn("a", F.col("at") + F.col("turn") * F.col("source_size")).where("a < quota")
    span = span.withColumn("b", F.least(F.col("a") + F.col("size"), "quota"))
    each = span.withColumn("rank", F.explode(F.sequence(F.expr(f"a div {block}"), F.expr(f"(b - 1) div {block}"))))
    start = F.greatest("a", F.col("rank") * block)
    return each.select("k", "rank", "id", "size", "at", (start - F.col("a")).alias("first"), (F.least("b", (F.col("rank") + 1) * block) - start).alias("words"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix, the sources and the documents' places.

    mix: (slot, k, id, size, at, first, words), to be read in order of slot, k, at and first;
    sources: targets(); places: lined() for documents with words, whether the mix takes them or
    not. Every source's taken words are its target rounded down, and no document is taken more
    than three times. Null texts have no words; null is a source of its own, the last; a
    document longer than a block is cut at blocks, whole texts count; repeated rows are taken each; ties
    of the hash are broken by id and size; an empty table gives an empty mix; other columns
    aren't read, so their names don't matter.
    """
    sizes = cut(sized(docs, doc_id, text, source))
    goals = cut(targets(sizes))
    whole = goals.agg(F.sum("source_size")).first()[0] or 0
    block = block or block_size(whole)
    line = cut(lined(sizes, goals))
    out = pieces(line, goals, block).join(schedule(goals, block), ["k", "rank"])
    return out.select("slot", "k", "id", "size", "at", "first", "words"), goals, line.union(sizes.where("size = 0").join(goals, sizes["source"].eqNullSafe(goals["source"])).select("k", "id", "size", F.lit(None).cast("long").alias("at")))


def taken(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken): one row for each row of docs, with the words that mix() takes of it."""
    mixed, goals, places = mix(docs, doc_id, text, source, block)
    used = mixed.groupBy("k", "id", "size", "at").agg(F.sum("words").alias("taken"))
    g = goals.select("k", "source_size", "target", "quota")
    # documents behind the quota, and those without words, aren't in the mix
    rest = places.join(g.select("k", "quota"), "k").where("at is null or at >= quota").select("k", "id", "size", F.lit(0).cast("long").alias("taken"))
    both = used.select("k", "id", "size", "taken").union(rest).join(g, "k")
    return both.select(F.col("id").alias(doc_id), "size", "source_size", "target", "taken")


TAKEN_SQL = rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
g as (select source, z, k, (k - 1) % 3 + 1 as w from (select source, sum(size)::bigint as z, row_number() over (order by source nulls last) as k from d group by source)),
o as (select *, (sum(z) over () - coalesce(sum({EPOCHS} * z) over (order by {EPOCHS}.0::double * z / w, k rows between unbounded preceding and 1 preceding), 0))::double / sum(w) over (order by {EPOCHS}.0::double * z / w, k rows between current row and unbounded following) as level from g),
t as (select source, z, least({EPOCHS}.0::double * z, w * (select max(level) from o where {EPOCHS} * z >= level * w)) as target from o),
q as (select *, floor(target)::bigint as quota from t),
p as (select d.doc_id, d.size, q.z, q.target, q.quota, sum(d.size) over (partition by d.source order by md5(coalesce(d.doc_id::varchar, '') || ':' || d.size), d.doc_id nulls first, d.size rows between unbounded preceding and current row) - d.size as place from d join q on d.source is not distinct from q.source)
select doc_id, size, z as source_size, target, case when size = 0 then 0 else size * (quota // z) + greatest(0, least(size, quota % z - place)) end::bigint as taken from p
"""
