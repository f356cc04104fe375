"""Data tests, schema contracts, drift, reconciliation."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Type names that mean the same.
ALIASES = {"INTEGER": "INT", "BIGINTEGER": "BIGINT", "LONG": "BIGINT", "SHORT": "SMALLINT", "TINYINT": "SMALLINT", "REAL": "FLOAT", "DOUBLE PRECISION": "DOUBLE", "VARCHAR": "STRING", "TEXT": "STRING", "CHAR": "STRING", "NVARCHAR": "STRING", "DATETIME": "TIMESTAMP", "BOOL": "BOOLEAN", "NUMERIC": "DECIMAL", "NUMBER": "DECIMAL"}
KINDS = ("NOT_NULL", "UNIQUE", "ROW_COUNT_MIN", "ROW_COUNT_MAX", "ACCEPTED_VALUES", "CUSTOM_SQL")


@dataclass(frozen=True)
class Check:
    """A test of a table; value: the bound, the accepted values, or SQL with {model} that selects bad rows."""

    kind: str
    column: str | None = None
    value: object = None
    severity: str = "BLOCK"

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown test {self.kind}")


def test_id(model: str, t: Check) -> str:
    return hashlib.sha256("\0".join([model, t.kind, t.column or "", str(t.value)]).encode()).hexdigest()


test_id.__test__ = False


def run_suite(df: DataFrame, checks: list[Check], model: str) -> DataFrame:
    """(test_id, kind, column, failures, passed) of each check, sorted by kind, column and value.

    All checks but UNIQUE and CUSTOM_SQL are conditional sums of one pass. A null is a value of
    UNIQUE (two nulls fail) and is skipped by ACCEPTED_VALUES.
    """
    spark = df.sparkSession
    order = sorted(checks, key=lambda t: (t.kind, t.column or "", str(t.value)))
    one: list[Column] = []
    others: list[tuple[int, DataFrame]] = []
    for k, t in enumerate(order):
        c = F.col(t.column) if t.column else None
        if t.kind == "NOT_NULL":
            one.append(F.count_if(c.isNull()).alias(str(k)))
        elif t.kind == "ACCEPTED_VALUES":
            one.append(F.count_if(c.isNotNull() & ~c.isin(*t.value)).alias(str(k)))
        elif t.kind == "ROW_COUNT_MIN":
            one.append((F.count("*") < t.value).cast("long").alias(str(k)))
        elif t.kind == "ROW_COUNT_MAX":
            one.append((F.count("*") > t.value).cast("long").alias(str(k)))
        elif t.kind == "UNIQUE":
            others.append((k, df.groupBy(c).count().where("count > 1").agg(F.count("*").alias("failures"))))
        else:
            view = f"suite_{test_id(model, t)[:12]}"
            df.createOrReplaceTempView(view)
            others.append((k, spark.sql(str(t.value).replace("{model}", view)).agg(F.count("*").alias("failures"))))
    parts = [d.select(F.lit(k).alias("k"), "failures") for k, d in others]
    if one:
        wide = df.agg(*one)
        parts.append(wide.select(F.explode(F.array(*[F.struct(F.lit(int(n)).alias("k"), F.col(f"`{n}`").alias("failures")) for n in wide.columns])).alias("x")).select("x.k", "x.failures"))
    named = spark.createDataFrame([(k, test_id(model, t), t.kind, t.column or "") for k, t in enumerate(order)], "k int, test_id string, kind string, column string")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return named.join(found, "k").orderBy("k").select("test_id", "kind", "column", "failures", (F.col("failures") == 0).alias("passed"))


def suite_summary(results: DataFrame, definitions: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Total, passed, failed and blocking failures; a result without a definition blocks."""
    j = results.join(definitions, keys, "left")
    return j.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("passed").alias("passed_tests"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(~F.col("passed") & (F.coalesce("severity", F.lit("BLOCK")) == "BLOCK")).alias("blocked"))


def normal_type(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for p in ALIASES.items() for x in p])
    up = F.upper(F.trim(c))
    return F.coalesce(names[up], up)


def schema_table(df: DataFrame, name: str) -> DataFrame:
    """(table_name, column_name, data_type, nullable, ordinal) of a DataFrame's schema."""
    rows = [(name, f.name, f.dataType.simpleString().upper(), int(f.nullable), k) for k, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable int, ordinal int")


def measured_schema(df: DataFrame, name: str) -> DataFrame:
    """As schema_table(), with nullable told from the rows: whether a column holds a null, counted in one pass."""
    nulls = df.agg(*[F.count_if(F.col(f"`{f.name}`").isNull()).alias(str(k)) for k, f in enumerate(df.schema.fields)])
    rows = [F.struct(F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString().upper()).alias("data_type"), (F.col(f"`{k}`") > 0).cast("int").alias("nullable"), F.lit(k).alias("ordinal")) for k, f in enumerate(df.schema.fields)]
    return nulls.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def describe(spark: SparkSession, table: str) -> DataFrame:
    rows = [(table, c.name, c.dataType.upper(), int(c.nullable), k) for k, c in enumerate(spark.catalog.listColumns(table))]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable int, ordinal int")


def _compared(expected: DataFrame, actual: DataFrame) -> DataFrame:
    name = lambda df, side: df.select(F.col("table_name"), F.lower("column_name").alias("column_name"), normal_type(F.col("data_type")).alias(f"{side}_type"), F.col("nullable").alias(f"{side}_null"))
    return name(expected, "expected").join(name(actual, "actual"), ["table_name", "column_name"], "full")


def contract_violations(expected: DataFrame, actual: DataFrame, mode: str = "STRICT") -> DataFrame:
    """(table, column, violation, severity): removals, type changes and contract NOT NULL on a nullable column break; additions inform. DISABLED checks nothing."""
    e, a = F.col("expected_type"), F.col("actual_type")
    types = F.when(a.isNull(), F.array(F.lit("COLUMN_REMOVED"))).when(e.isNull(), F.array(F.lit("COLUMN_ADDED"))).otherwise(
        F.array_compact(F.array(F.when(e != a, "TYPE_CHANGED"), F.when((F.col("expected_null") == 0) & (F.col("actual_null") == 1), "NULLABLE_TIGHTENED"))))
    out = _compared(expected, actual).select("table_name", "column_name", F.explode(types).alias("violation"))
    out = out.withColumn("severity", F.when(F.col("violation") == "COLUMN_ADDED", "INFO").when(F.lit(mode == "WARN"), "WARNING").otherwise("BREAKING"))
    return out.where(F.lit(mode != "DISABLED"))


def contract_batch(violations: DataFrame) -> DataFrame:
    return violations.groupBy("table_name").agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("BREAKING", "WARNING", "INFO")])


def schema_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Removed, added and retyped columns after alias normalisation; expected columns without a type are checked for presence only."""
    e, a = F.col("expected_type"), F.col("actual_type")
    kind = F.when(F.col("actual_null").isNull(), "REMOVED").when(F.col("expected_null").isNull(), "ADDED").when(e != a, "TYPE_CHANGED")
    return _compared(expected, actual).select("table_name", "column_name", kind.alias("drift"), e.alias("expected_type"), a.alias("actual_type")).where("drift is not null")


def drift_class(tables: DataFrame, drift: DataFrame) -> DataFrame:
    """The gravest drift of each table, NONE without any."""
    rank = F.when(F.col("drift") == "REMOVED", 0).when(F.col("drift") == "TYPE_CHANGED", 1).otherwise(2)
    worst = drift.groupBy("table_name").agg(F.min_by("drift", rank).alias("drift_class"))
    return tables.join(worst, "table_name", "left").select("table_name", F.coalesce("drift_class", F.lit("NONE")).alias("drift_class"))


def reconcile(recorded: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, discrepancy or null): recorded against observed status; rows that weren't observed are skipped."""
    r, o = F.col("status"), F.col("observed")
    kind = (
        F.when(r == o, None).when((r == "SUCCESS") & (o == "FAIL"), "phantom_success").when((r == "FAIL") & (o == "SUCCESS"), "missed_success")
        .when((r == "RUNNING") & (o == "SUCCESS"), "stale_running").when((r == "RUNNING") & (o == "FAIL"), "stale_running_failed").when(r == "PENDING", "stale_pending").otherwise("status_mismatch")
    )
    return recorded.join(observed, key).select(key, kind.alias("discrepancy"))
