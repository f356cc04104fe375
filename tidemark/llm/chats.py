"""Chat formatting after collapsing logged snapshots of growing conversations.

Each turn gets a hash of the conversation up to it. A conversation whose whole hash is the hash
of a proper prefix of another is a snapshot of that one; an anti-join leaves the maximal ones,
of equal ones the one of smallest id. What is left is rendered. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _named(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))


def _hashes() -> tuple[Column, Column]:
    """Two hashes of a turn and its position."""
    said = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return F.xxhash64("pos", *said), F.xxhash64(F.lit("second"), "pos", *said)


def prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, n, h1, h2, role, text): the position of each turn, the conversation's length, and two 64-bit hashes of the turns up to it.

    A turn's hash covers its position, so an exclusive or over the turns so far depends on
    their order; both hashes and the length must agree for two prefixes to count as equal.
    Turns without a conversation id are left out.
    """
    t = _named(turns, conv, turn, role, text).where("conv is not null")
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    t = t.withColumn("pos", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv")))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    one, two = _hashes()
    return t.withColumn("h1", F.bit_xor(one).over(upto)).withColumn("h2", F.bit_xor(two).over(upto))


def loners(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The distinct turns without a conversation id, as prefixes() has them; they may be any share of the rows, so no window gathers them."""
    one, two = _hashes()
    t = _named(turns, conv, turn, role, text).where("conv is null").select("conv", "role", "text").distinct()
    return t.withColumns({"pos": F.lit(1), "n": F.lit(1).cast("long")}).withColumns({"h1": one, "h2": two})


def maximal(p: DataFrame, lone: DataFrame) -> DataFrame:
    """(conv, h1, h2): one id of each conversation that no longer one begins with; the id is null if no equal one has an id."""
    ends = ["conv", "h1", "h2", "pos"]
    whole = p.where("pos = n").select(ends).union(lone.select(ends)).groupBy("h1", "h2", "pos").agg(F.min("conv").alias("conv"))
    inner = p.where("pos < n").select("h1", "h2", "pos").distinct()
    return whole.join(inner, ["h1", "h2", "pos"], "left_anti").select("conv", "h1", "h2")


def render(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, chat) of the maximal conversations.

    Turns are ordered by turn, then role, then text, nulls first; a repeated turn counts as a
    turn. A null role is rendered as `user`, a null text as the empty one; nothing tells which turns
    without a conversation id belong together, so each is a conversation of one turn and null id.
    Marks inside a text are broken by a space. An empty table gives an empty result; other
    columns are not read.
    """
    # written once: the windows sort all texts, what follows needs hashes alone
    p = cut(prefixes(turns, conv, turn, role, text).select("conv", "pos", "n", "h1", "h2"))
    lone = loners(turns, conv, turn, role, text)
    kept = cut(maximal(p, lone))
    safe = lambda r, t: F.concat(F.lit(OPEN), F.coalesce(r, F.lit("user")), F.lit("\n"), F.replace(F.coalesce(t, F.lit("")), F.lit("<|im_"), F.lit("<| im_")), F.lit(CLOSE + "\n"))
    # structs compare field by field, nulls first
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    chats = _named(turns, conv, turn, role, text).join(kept.select("conv"), "conv", "left_semi").groupBy("conv").agg(F.count("*").alias("n_turns"), said.alias("said"))
    out = chats.select("conv", "n_turns", F.array_join(F.transform("said", lambda x: safe(x["role"], x["text"])), "").alias("chat"))
    alone = lone.join(kept.where("conv is null").select("h1", "h2"), ["h1", "h2"], "left_semi").select("conv", F.col("n").alias("n_turns"), safe(F.col("role"), F.col("text")).alias("chat"))
    return out.union(alone).withColumnRenamed("conv", conv)


RENDER_SQL = f"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as pos, role, text from conversations where conv_id is not null
  union all select distinct null, 1, role, text from conversations where conv_id is null),
c as (select conv_id, count(*) as n_turns, list(coalesce(role, '-') || chr(31) || coalesce(text, '') order by pos) as said,
  string_agg('{OPEN}' || coalesce(role, 'user') || chr(10) || replace(coalesce(text, ''), '<|im_', '<| im_') || '{CLOSE}' || chr(10), '' order by pos) as chat from t group by conv_id, case when conv_id is null then struct_pack(r := role, t := text) end)
select conv_id, n_turns, chat from c
where not exists (select 1 from c o where o.said[1] = c.said[1] and o.n_turns > c.n_turns and o.said[1:c.n_turns] = c.said)
and not exists (select 1 from c o where o.said = c.said and (o.conv_id < c.conv_id or c.conv_id is null and o.conv_id is not null))
"""
