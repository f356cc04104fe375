"""Benchmark decontamination by canonical templates.

Numbers, units and names become typed placeholders, one for one, so canonical and raw words keep
their places. A text has two canonical forms: with names as they stand, in lower case, and with
every capitalised word but function words as a name, at the beginning of a sentence too. Windows of
canonical words of the benchmark are hashed and joined with those of the documents. Windows of
one alignment (place in the document less place in the item) belong together; they count only
if the words behind the placeholders are consistent: one value in the item always stands for one
value in the document. A re-parameterised question matches with other values. DataFrame functions
only.

Before the join, document windows pass a table of one byte per hash slot that marks the
benchmark's windows. Its size is fixed, so a larger benchmark only lets more windows through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let, row_keys

NAME, NUMBER, UNIT = "", "", ""
# Units.
UNITS = "kg|mg|g|km|cm|mm|m|ml|l|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|ft|inches|pounds?|lbs?|dollars?|usd|euros?|eur|percent|mph|kmh|watts?|volts?|litres?|liters?|meters?|metres?|kilometers?|kilometres?|grams?|degrees?"
# Words that are no names where they are capitalised.
FUNCTION = (
    "a an and as at but by do does each every find for from give had has have he her his how i if in is it let many much no not of on or our she so some suppose that the their then there these they this to was we were what when where which who why will with you your "
    "au aux ce cette dans de des du elle en est et il ils je la le les leur mais nous on ou par pas pour que qui se si son sont sur un une vous "
    "als am auf aus das dem den der die du ein eine er es für ich im ist mit nach nicht sie sind und von was wie wir zu "
    "al como con cuando del el ella ellos es esta este la las lo los mas no nos para pero por que se si su sus un una y"
).split()
SEPARATOR = f"[^\\p{{L}}\\p{{N}}{NAME}{NUMBER}{UNIT}]+"
SLOTS = 1 << 19
# slots of windows up to which Spark may send them to the driver and all executors
SMALL = 50_000


def typed(text: Column) -> Column:
    """Words with numbers and units typed, in the case of the text."""
    numbered = F.regexp_replace(text, "[0-9]+", NUMBER)
    return words(let(numbered, lambda x: F.when(F.contains(x, F.lit(NUMBER)), F.regexp_replace(x, f"(?<={NUMBER} ?)(?i:{UNITS})(?!\\p{{L}})", UNIT)).otherwise(x)))


def _name(word: Column, low: Column) -> Column:
    """Whether a word, in lower case low, is capitalised and isn't a function word. Most words are in lower case and end at the first comparison."""
    return (word != low) & (F.substring(word, 1, 1) != F.substring(low, 1, 1)) & ~low.isin(*sorted(set(FUNCTION)))


def named(word: Column) -> Column:
    """A name's placeholder for a capitalised word that isn't a function word; else the word in lower case."""
    return F.when(_name(word, F.lower(word)), NAME).otherwise(F.lower(word))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATOR, -1), lambda x: x != "")


def _bit(marked: Column, h: Column) -> Column:
    """Whether the byte of h's slot is set. A byte a slot: lambdas are interpreted, and bits would need their slot twice."""
    return F.substring(marked, F.pmod(h, F.lit(SLOTS)).cast("int") + 1, F.lit(1)) != F.lit(b"\0")


def _plain(word: Column) -> Column:
    return ~F.rlike(word, F.lit(f"[{NAME}{NUMBER}{UNIT}]"))


WINDOW = "struct<pos:int,n:int,form:int,h:bigint,plain:int,slots:array<struct<at:int,value:string>>>"


def _joined(h: Column, n: int) -> Column:
    """Hashes of n consecutive elements of h at each place: halves are hashed once and meet, so that no place looks up n elements."""
    if n == 1:
        return h
    k = n // 2 if n % 2 == 0 else n - 1
    rest = F.greatest(F.size(h) - n + 1, F.lit(0))
    return let(_joined(h, k), lambda w: F.zip_with(F.slice(w, F.lit(1), rest), F.slice(h if n % 2 else w, F.lit(k + 1), rest), lambda a, b: F.xxhash64(a, b)))


def _windows(text: Column, widths: list[int], marked: bytes | None) -> Column:
    """Array of (pos, n, form, h, plain, slots): hashes of the windows of n canonical words in both forms (1: names typed), their plain words, and (place, raw word) of their placeholders.

    With marks, windows that aren't marked are left out, and a text without a name has form 0 alone.
    """

    def found(h: Column, bits: Column | None, n: int) -> Column:
        every = lambda w: F.when(F.size(w) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(w) - 1))
        kept = lambda w: every(w) if bits is None else F.filter(every(w), lambda i: _bit(bits, F.get(w, i)))
        return let(_joined(h, n), lambda w: F.transform(kept(w), lambda i: F.struct(i.alias("pos"), F.lit(n).alias("n"), F.get(w, i).alias("h"))))

    def slots(canonical: Column, hs: Column, form: int) -> Column:
        word = lambda p: (F.lower, named)[form](F.get(canonical, p))
        one = lambda raw, x: F.filter(F.transform(F.sequence(x["pos"], x["pos"] + x["n"] - 1), lambda p: F.when(~_plain(word(p)), F.struct((p - x["pos"]).alias("at"), F.lower(F.get(raw, p)).alias("value")))), lambda s: s.isNotNull())
        return F.when(F.size(hs) == 0, F.array().cast(f"array<{WINDOW}>")).otherwise(
            let(words(text), lambda raw: F.transform(hs, lambda x: let(one(raw, x), lambda v: F.struct(x["pos"].alias("pos"), x["n"].alias("n"), F.lit(form).alias("form"), x["h"].alias("h"), (x["n"] - F.size(v)).cast("int").alias("plain"), v.alias("slots"))))).cast(f"array<{WINDOW}>")
        )

    def both(raw: Column, bits: Column | None) -> Column:
        of = lambda h, form: let(F.flatten(F.array(*[found(h, bits, n) for n in widths])) if len(widths) > 1 else found(h, bits, widths[0]), lambda hs: slots(raw, hs, form))

        def forms(low: Column, plain: Column) -> Column:
            typed_names = F.transform(raw, lambda x, i: F.when(_name(x, F.get(low, i)), F.xxhash64(F.lit(NAME))).otherwise(F.get(plain, i)))
            again = lambda h: of(h, 1) if bits is None else F.when(h == plain, F.array().cast(f"array<{WINDOW}>")).otherwise(of(h, 1))
            return F.concat(of(plain, 0), let(typed_names, again))

        return let(F.transform(raw, F.lower), lambda low: let(F.transform(low, lambda x: F.xxhash64(x)), lambda h: forms(low, h)))

    return let(typed(text), lambda raw: both(raw, None) if marked is None else let(F.lit(marked), lambda bits: both(raw, bits)))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 5, share: float = 0.5, windows: int = 9) -> DataFrame:
    """(id, k1, k2, item, windows, item_windows, share, verbatim): rows of docs that hold an item or a re-parameterised form of it.

    A pair counts if, over its consistent alignments, at least `share` of the item's windows in one
    form or `windows` of them match. An item's windows have 3 plain words or more, 2 with names
    typed; an item without such windows has all its windows; one of fewer than `width` words is one window of all its words
    and counts only where they stand word for word. Items without a word, null texts and empty
    tables give nothing; texts are read whole. k1 and k2 are hashes of (id, text), by which rows
    with null or repeated ids are told apart; repeated rows count once. Only the named columns are read.
    """
    item = items.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    item = item.withColumn("size", F.size(typed(F.col("t")))).where("size > 0")
    # at most width - 1 lengths
    short = sorted(r.size for r in item.where(F.col("size") < width).select("size").distinct().collect())
    own = item.select("item", "size", F.explode(_windows(F.col("t"), [width, *short], None)).alias("w")).select("item", "size", "w.*").where(F.col("n") == F.least("size", F.lit(width)))
    # names leave fewer plain words
    own = own.withColumn("rich", (F.col("n") == width) & (F.col("plain") >= 3 - F.col("form")))
    rich = own.groupBy("item", "form").agg(F.max("rich").alias("any"))
    own = own.join(rich, ["item", "form"]).where("rich or not any")
    own = own.select("item", "form", F.col("n").alias("item_n"), F.col("pos").alias("item_pos"), "h", F.col("slots").alias("item_slots")).distinct()
    sizes = own.groupBy("item", "form").agg(F.countDistinct("item_pos").alias("item_windows"))
    marks = bytearray(SLOTS)
    # at most SLOTS rows, whatever the benchmark's size
    for r in own.select(F.pmod("h", F.lit(SLOTS)).alias("k")).distinct().collect():
        marks[r.k] = 1
    if sum(marks) > SMALL:
        # Spark sizes the windows by the bytes of their items' texts
        own = own.hint("merge")
    text = F.coalesce(F.col(text_col), F.lit(""))
    seen = docs.select(F.col(id_col).alias("id"), *row_keys(F.col(id_col), F.col(text_col)), F.explode(_windows(text, [width, *short], bytes(marks))).alias("w"))
    seen = seen.select("id", "k1", "k2", F.col("w.pos").alias("pos"), F.col("w.h").alias("h"), F.col("w.slots").alias("slots")).distinct()
    met = seen.join(own, "h").withColumn("pairs", F.arrays_zip(F.transform("item_slots", lambda x: x["value"]).alias("a"), F.transform("slots", lambda x: x["value"]).alias("b")))
    # at most as many window positions as the item has: one document position for each
    aligned = met.groupBy("id", "k1", "k2", "item", "form", "item_n", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    same = F.forall("pairs", lambda x: x["a"] == x["b"])
    aligned = aligned.where((F.size(F.array_distinct(F.transform("pairs", lambda x: x["a"]))) == F.size("pairs")) & ((F.col("item_n") == width) | same))
    per = aligned.select("id", "k1", "k2", "item", "form", same.alias("same"), F.explode("at").alias("p")).groupBy("id", "k1", "k2", "item", "form").agg(F.countDistinct("p").alias("windows"), F.min("same").alias("verbatim"))
    out = per.join(sizes, ["item", "form"]).withColumn("share", F.col("windows") / F.col("item_windows")).where((F.col("share") >= share) | (F.col("windows") >= windows))
    best = F.max_by(F.struct("windows", "item_windows", "share"), F.struct("share", -F.col("form"))).alias("best")
    return out.groupBy("id", "k1", "k2", "item").agg(best, F.max("verbatim").alias("verbatim")).select("id", "k1", "k2", "item", "best.*", "verbatim")


def clean(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that leaks() found, repeated ones included; all columns and all other rows stay."""
    mark = ["first key of decontamination", "second key of decontamination"]
    k1, k2 = row_keys(F.col(id_col), F.col(text_col))
    keyed = docs.withColumn(mark[0], k1).withColumn(mark[1], k2)
    return keyed.join(found.select(F.col("k1").alias(mark[0]), F.col("k2").alias(mark[1])).distinct(), mark, "left_anti").drop(*mark)
