"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query of mandatory trigrams is derived: an OR of
ANDs. The index holds (trigram, row) for the trigrams that some rule asks for. A rule's
candidates are the rows in which all trigrams of one AND are posted; only these are verified
with the regular expression. A rule without a mandatory trigram is scanned over all rows.
DataFrame functions only.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_mark, cut, marks
from .native import let, row_key, running


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # of which at least `least` characters are asked for
    least: int = 0


# The base rules.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
# Public token formats.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google_api", r"AIza[0-9A-Za-z_-]{35}"),
)


def trigram_query(pattern: str, most: int = 64) -> list[frozenset[str]]:
    """ANDs of lower-case trigrams, one of which holds in every text the pattern matches; [frozenset()] if nothing is mandatory."""

    def cross(a: list[tuple[str, ...]], b: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
        # the last literal run of a continues in the first of b
        return [(*x[:-1], x[-1] + y[0], *y[1:]) for x in a for y in b]

    def walk(items) -> list[tuple[str, ...]]:
        """Alternatives; each is a row of literal runs, and between two runs anything may stand."""
        out: list[tuple[str, ...]] = [("",)]
        for op, arg in items:
            if op is C.LITERAL:
                nxt = [(chr(arg).lower(),)]
            elif op is C.IN and len(arg) <= 8 and all(o is C.LITERAL for o, _ in arg):
                nxt = sorted({(chr(c).lower(),) for _, c in arg})
            elif op is C.SUBPATTERN:
                nxt = walk(arg[3])
            elif op is C.BRANCH:
                nxt = [x for part in arg[1] for x in walk(part)]
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                nxt = [(*x, *y) for x in walk(arg[2]) for y in [("",)]] if arg[1] > 1 else walk(arg[2])
                nxt = cross(nxt, [("",)])
            elif op is C.AT:
                continue
            else:
                nxt = [("", "")]
            both = cross(out, nxt)
            out = both if len(both) <= most else [(*x, "") for x in out]
        return out

    ands = {frozenset(run[k : k + 3] for run in runs for k in range(len(run) - 2)) for runs in walk(parser.parse(pattern))}
    # an AND that holds whenever a smaller one does adds nothing
    return sorted((a for a in ands if not any(b < a for b in ands)), key=sorted)


def postings(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """(trigram, row): the inverted index over the trigrams that the rules ask for."""
    wanted = sorted({t for r in rules for a in trigram_query(r.pattern) for t in a})
    text = F.coalesce(F.col(text_col), F.lit(""))
    listed = F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>")
    found = F.flatten(F.transform(F.array(F.lower(text)), lambda low: F.filter(listed, lambda t: F.contains(low, t))))
    return docs.select(row_key(F.col(id_col), text).alias("row"), F.explode(found).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row, kinds): for each row the rules of which one AND is fully posted."""
    spark = index.sparkSession
    asked = [(r.kind, n, t, len(a)) for r in rules for n, a in enumerate(trigram_query(r.pattern)) for t in a]
    # as large as the rules' text, whatever the corpus
    query = F.broadcast(spark.createDataFrame(asked, "kind string, part int, trigram string, need int"))
    met = index.join(query, "trigram").groupBy("row", "kind", "part", "need").agg(F.countDistinct("trigram").alias("n")).where("n = need")
    return met.groupBy("row").agg(F.collect_set("kind").alias("kinds"))




def found_spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, kind_order, end, kind): leftmost non-overlapping matches, those of the rule's length alone; ends exclusive, in code points."""
    kind = "array<struct<start:int,rank:int,end:int,kind:string>>"

    def spans(m: Column) -> Column:
        gaps = F.split(text, rule.pattern, -1)
        return let(
            F.struct(F.transform(m, lambda x: F.length(x)).alias("size"), F.transform(gaps, lambda x: F.length(x)).alias("gap"), (F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else m).alias("part")),
            lambda s: let(
                running(F.transform(s["size"], lambda x, i: x + F.get(s["gap"], i))),
                lambda before: F.filter(
                    F.transform(
                        s["size"],
                        lambda x, i: F.when(
                            F.length(F.get(s["part"], i)) >= rule.least,
                            F.struct((F.get(before, i) + F.get(s["gap"], i)).alias("start"), F.lit(order).alias("rank"), (F.get(before, i) + F.get(s["gap"], i) + x).alias("end"), F.lit(rule.kind).alias("kind")),
                        ),
                    ),
                    lambda x: x.isNotNull(),
                ),
            ),
        )

    none = F.array().cast(kind)
    return let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(spans(m).cast(kind)))


def _short(rule: Rule) -> Rule:
    """A pattern that is one class repeated finds the same long runs with its length inside, and fewer short ones."""
    m = re.fullmatch(r"(\[[^\]]*\])\+", rule.pattern)
    return Rule(rule.kind, f"{m[1]}{{{rule.least},}}", 0, rule.least) if m and rule.least else rule


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """(id_col, found) for every row; found: array of (start, rank, end, kind) by start, then rule order.

    A null text is scanned as the empty one. Ids may be null or repeat, repeated rows are all
    returned, an empty table gives an empty result, and other columns are not read.
    """
    rules = (*base, *more)
    indexed = tuple(r for r in rules if frozenset() not in trigram_query(r.pattern))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("row", row_key(F.col("id"), F.col("text")))
    of = candidates(postings(docs, indexed, id_col, text_col), indexed)
    # texts of rows without a candidate aren't shuffled; a row that shares a slot of the marks is only looked at once more
    of = cut(of)
    marked = marks(of, "row")
    joined = by_mark(rows, "row", marked, False).withColumn("kinds", F.lit(None).cast(of.schema["kinds"].dataType)).union(by_mark(rows, "row", marked, True).join(of, "row", "left").select("id", "text", "row", "kinds"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    parts = []
    for k, r in enumerate(rules):
        spans = found_spans(F.col("text"), _short(r), k)
        parts.append(F.when(F.array_contains(F.coalesce("kinds", F.array().cast("array<string>")), r.kind), spans).otherwise(none) if r in indexed else spans)
    return joined.select(F.col("id").alias(id_col), F.array_sort(F.concat(*parts)).alias("found"))


def digest(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of their spans, and all spans as text."""
    line = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    own = F.filter("found", lambda x: x["rank"] < len(base))
    count = lambda k: F.size(F.filter("found", lambda x: x["rank"] == k)).cast("long")
    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(base)]
    return found.select(*[c for c in found.columns if c != "found"], *counts, F.sha2(line(own), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))


def digest_sql(rules: tuple[Rule, ...] = (*BASE, *MORE), n_base: int = len(BASE)) -> str:
    """DuckDB text of digest(scan(documents)), straight from the patterns."""
    quote = lambda p: p.replace("'", "''")
    parts = [
        f"""select doc_id, n, {k} as rank, '{r.kind}' as kind, i,
          list_sum(list_transform(g[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::bigint as s, length(m[i]) as len, length(p[i]) as part
        from (select doc_id, n, m, g, p, unnest(range(1, len(m) + 1)) as i from (select doc_id, n, regexp_extract_all(text, '{quote(r.pattern)}') as m, regexp_split_to_array(text, '{quote(r.pattern)}') as g, regexp_extract_all(text, '{quote(r.pattern)}', {r.group}) as p from d where regexp_matches(text, '{quote(r.pattern)}')))"""
        for k, r in enumerate(rules)
    ]
    keep = " or ".join(f"(rank = {k} and part >= {r.least})" for k, r in enumerate(rules))
    join = "coalesce(string_agg(kind || ':' || s || ':' || (s + len), ',' order by s, rank){where}, '')"
    counts = ", ".join(f"count(*) filter (rank = {k}) as n_{r.kind}" for k, r in enumerate(rules[:n_base]))
    return f"""with d as (select doc_id, row_number() over () as n, coalesce(text, '') as text from documents),
      hits as ({" union all ".join(parts)}), kept as (select * from hits where {keep})
      select d.doc_id, {counts}, sha256({join.format(where=f" filter (rank < {n_base})")}) as base_sha256, {join.format(where="")} as spans
      from d left join (select n, rank, kind, s, len from kept) k on d.n = k.n group by d.n, d.doc_id"""
