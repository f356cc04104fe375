"""Scrubbing, pseudonyms, retention, erasure and the audit chain."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of the telemetry profile with what stands for them, in the order in which they are applied.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD = r"\b(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6(?:011|5\d{2}))[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{1,4}\b"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6 = r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"
TOKEN = r"(?i)\bdapi[a-f0-9]{32}\b"
SECRET = r"(?i)\b(?:password|secret|token|api_key|apikey)\s*[=:]\s*(?!\[REDACTED)\S+"
TELEMETRY = [
    (EMAIL, "[REDACTED_EMAIL]"), (PHONE, "[REDACTED_PHONE]"), (SSN, "[REDACTED_SSN]"), (CARD, "[REDACTED_CC]"),
    (IPV4, "[REDACTED_IP]"), (IPV6, "[REDACTED_IP]"), (TOKEN, "[REDACTED_TOKEN]"), (SECRET, "[REDACTED_SECRET]"),
]
# Literals of SQL text, replaced before the telemetry profile.
SQL_EMAIL = r"'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}'"
SQL_NAME = r"(?i)(?:first_name|last_name|full_name|username)\s*=\s*'[^']+'"
SQL_LITERALS = [(SQL_EMAIL, "'[REDACTED_EMAIL]'"), (SQL_NAME, "[REDACTED_NAME_FILTER]")]
# Patterns of the prompt profile, in order; of SQL in prompts, literals and long numbers go first.
PROMPT_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PROMPT_CARD = r"\b(?:\d[ -]*?){13,19}\b"
PROMPT_SECRET = r"(?i)\b(?:password|secret|token|api_key|apikey|api[-_]?secret)\s*[=:]\s*\S+"
PROMPT = [(PROMPT_EMAIL, "<EMAIL>"), (SSN, "<SSN>"), (PROMPT_CARD, "<CC>"), (PHONE, "<PHONE>"), (TOKEN, "<TOKEN>"), (PROMPT_SECRET, "<SECRET>")]
PROMPT_LITERAL, PROMPT_NUMBER = r"'(?:[^']|'')*'", r"\b\d{7,}\b"
PROMPT_SQL = [(PROMPT_LITERAL, "<LITERAL>"), (PROMPT_NUMBER, "<ID>")]
PROFILES = {"telemetry": TELEMETRY, "sql": SQL_LITERALS + TELEMETRY, "prompt": PROMPT, "prompt_sql": PROMPT_SQL + PROMPT}
# what a text must hold for a pattern to match: cheap to look for, so that most texts pass most patterns by
GUARDS = {
    EMAIL: "@", PROMPT_EMAIL: "@", SQL_EMAIL: "@", PHONE: r"\d{3}", SSN: r"\d-\d", CARD: r"\d{4}", PROMPT_CARD: r"\d[ -]*\d", IPV4: r"\d\.\d", IPV6: r"[0-9a-fA-F]:[0-9a-fA-F]",
    SQL_NAME: "'", PROMPT_LITERAL: "'", PROMPT_NUMBER: r"\d{7}",
}


def _may(c: Column, pattern: str) -> Column:
    guard = GUARDS.get(pattern)
    return F.lit(True) if guard is None else F.contains(c, F.lit(guard)) if len(guard) == 1 else F.rlike(c, F.lit(guard))


def scrubbed(c: Column, profile: str = "telemetry") -> Column:
    """c with a profile's patterns replaced in order. Digits and spaces are ASCII ones; null stays null."""
    step = lambda x, pattern, to: F.when(_may(x, pattern), F.regexp_replace(x, pattern, to)).otherwise(x)
    for pattern, to in PROFILES[profile]:
        # through a lambda's variable each step is computed once
        c = F.element_at(F.transform(F.array(c), lambda x: step(x, pattern, to)), 1)  # noqa: B023
    return c


def scrub(df: DataFrame, cols: list[str], profile: str = "telemetry") -> DataFrame:
    return df.withColumns({c: scrubbed(F.col(c), profile) for c in cols})


def contains_pii(c: Column) -> Column:
    """Whether a pattern of the prompt profile or a quoted literal occurs; null counts as no."""
    out = F.lit(False)
    for pattern in (*[p for p, _ in PROMPT], PROMPT_LITERAL):
        out = out | (_may(c, pattern) & F.rlike(c, F.lit(pattern)))
    return F.coalesce(out, F.lit(False))


def _nested(c: Column, kind: T.DataType, profile: str) -> Column:
    if isinstance(kind, T.StringType):
        return scrubbed(c, profile)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _nested(x, kind.elementType, profile))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _nested(v, kind.valueType, profile))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_nested(c[f.name], f.dataType, profile).alias(f.name) for f in kind.fields]))
    return c


def scrub_nested(df: DataFrame, profile: str = "telemetry") -> DataFrame:
    """Scrubs every text in df, inside arrays, map values and structs too."""
    return df.select(*[_nested(F.col(f"`{f.name}`"), f.dataType, profile).alias(f.name) for f in df.schema.fields])


def pseudonym(c: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), c.cast("string")), 256), 1, 16)


def anonymize(df: DataFrame, cols: list[str], salt: str) -> DataFrame:
    return df.withColumns({c: pseudonym(F.col(c), salt) for c in cols})


def apply_consent(df: DataFrame, consent: str, ids: list[str], texts: list[str], salt: str) -> DataFrame:
    """Rows of consent `none` go, ids of `anonymized` are hashed, texts are always scrubbed."""
    out = df.where(F.coalesce(F.col(consent), F.lit("none")) != "none")
    return out.withColumns({c: F.when(F.col(consent) == "anonymized", pseudonym(F.col(c), salt)).otherwise(F.col(c).cast("string")) for c in ids} | {c: scrubbed(F.col(c)) for c in texts})


def purge(df: DataFrame, ts: str, days: int, now: str) -> DataFrame:
    """Rows that are not older than `days`."""
    return df.where(F.col(ts) >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))


def purge_counts(tables: dict[str, tuple[DataFrame, str, str]], now: str) -> DataFrame:
    """(table, kept, purged) of tables by name: each with its time column and the interval ("30 days") that its rows stay. Rows without a time stay."""
    parts = []
    for name, (df, ts, stays) in tables.items():
        old = F.coalesce(F.col(ts) < F.lit(now).cast("timestamp") - F.expr(f"interval {stays}"), F.lit(False))
        parts.append(df.agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("purged")).select(F.lit(name).alias("table"), "kept", "purged"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def sorted_json(c: Column) -> Column:
    """JSON text with its keys sorted and no spaces; null for null and for text that isn't JSON."""
    return F.to_json(F.try_parse_json(c))


def erase(df: DataFrame, actor: str, who, metadata: str) -> DataFrame:
    """Takes a person out of the log; the row stays."""
    mine = F.col(actor).cast("string") == str(who)
    return df.withColumn("is_anonymized", mine).withColumn(metadata, F.when(~mine, F.col(metadata))).withColumn(actor, F.when(mine, "[REDACTED]").otherwise(F.col(actor).cast("string")))


def audit_hash(cols: list[str], previous: Column | None = None) -> Column:
    """SHA-256 of the fields joined by pipes, nulls as empty, after the previous hash if one is given."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return F.sha2(F.concat_ws("|", *([F.coalesce(previous, F.lit(""))] if previous is not None else []), *parts), 256)


def audit_verify(log: DataFrame, tenant: str, order: list[str], cols: list[str]) -> DataFrame:
    """(tenant, valid, checked): checked counts the rows before the first break whose hash was verified. Each row must link to the one before; rows that were anonymised skip the recomputation, and aren't counted."""
    w = Window.partitionBy(tenant).orderBy(*order)
    link = F.coalesce(F.col("previous_hash"), F.lit("")) == F.coalesce(F.lag("entry_hash").over(w), F.lit(""))
    own = F.col("is_anonymized") | (F.col("entry_hash") == audit_hash(cols, F.col("previous_hash")))
    upto = F.count_if(~F.col("is_anonymized")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = log.withColumn("ok", link & own).withColumn("at", F.row_number().over(w)).withColumn("before", upto - F.when(F.col("is_anonymized"), 0).otherwise(1))
    g = rows.groupBy(tenant).agg(F.min(F.when(~F.col("ok"), F.struct("at", "before"))).alias("broken"), F.count_if(~F.col("is_anonymized")).alias("n"))
    return g.select(tenant, F.col("broken").isNull().alias("valid"), F.coalesce("broken.before", "n").alias("checked"))


def audit_chain(df: DataFrame, tenant: str, order: list[str], cols: list[str]) -> DataFrame:
    """Adds previous_hash and entry_hash. A chain has one next hash after another, so a tenant's rows pass one task, but as a sorted stream of which one hash is kept."""
    schema = T.StructType([*df.schema.fields, T.StructField("previous_hash", T.StringType()), T.StructField("entry_hash", T.StringType())])
    joined = "fields of the chain"
    rows = df.withColumn(joined, F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
    rows = rows.repartition(tenant).sortWithinPartitions(tenant, *order)
    at, names = rows.columns.index(tenant), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, last = object(), ""
        for b in batches:
            before, after = [], []
            for t, text in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if t != who:
                    who, last = t, ""
                before.append(last)
                last = hashlib.sha256(f"{last}|{text}".encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(before, pa.string()), pa.array(after, pa.string())], [*names, "previous_hash", "entry_hash"])

    return rows.mapInArrow(run, schema)
