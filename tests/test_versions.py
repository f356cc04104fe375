"""Stored tables: what a merge rewrites, what readers see of one that fails, environments."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import versions
from tidemark.operators.versions import Conflict, Merged, StoredTable

KEYS = "k long, v string"


def stored(spark, rows, keys=("k",)):
    t = StoredTable(spark, tempfile.mkdtemp(prefix="spark-") + "/t", keys, F.concat(F.lit("p"), F.floor(F.col("k") / 10).cast("string")))
    t.create(rows)
    return t


def table(spark, t, **at):
    return {tuple(r) for r in t.read(**at).collect()}


def test_a_merge_rewrites_only_the_parts_that_hold_its_keys(spark):
    t = stored(spark, spark.range(100).selectExpr("id as k", "'a' as v"))
    did = t.merge(spark.createDataFrame([(5, "b"), (7, "b"), (42, "b"), (105, "n")], KEYS))
    assert did == Merged(version=2, rewritten=2, added=0, kept=8)
    assert table(spark, t) == {(k, "b" if k in (5, 7, 42) else "a") for k in range(100)} | {(105, "n")}
    assert table(spark, t, version=1) == {(k, "a") for k in range(100)}
    old, new = ({r.folder for r in t.manifest(v).collect()} for v in (1, 2))
    assert len(old & new) == 8 and len(new - old) == 3


def test_new_rows_go_beside_what_a_part_has(spark):
    t = stored(spark, spark.range(0, 100, 2).selectExpr("id as k", "'a' as v"))
    did = t.merge(spark.createDataFrame([(51, "n"), (53, "n")], KEYS))
    assert (did.rewritten, did.added, did.kept) == (0, 1, 10)
    assert t.read().count() == 52
    # the part now has two folders; a key in one of them rewrites that one
    assert t.merge(spark.createDataFrame([(51, "m")], KEYS)).rewritten == 1
    assert {v for k, v in table(spark, t) if k in (51, 53)} == {"m", "n"}


def test_named_columns_null_keys_and_repeated_rows(spark):
    t = stored(spark, spark.createDataFrame([(1, "a", 1), (None, "a", 2), (25, "a", 3)], "k long, v string, w int"))
    did = t.merge(spark.createDataFrame([(None, "b", 9), (25, "x", 8), (25, "y", 7), (26, "c", 6)], "k long, v string, w int"), update_cols=["v"], order_by=[F.col("w")])
    assert table(spark, t) == {(1, "a", 1), (None, "b", 2), (25, "y", 3), (26, "c", 6)} and did.rewritten == 2


def test_an_empty_source_changes_nothing(spark):
    t = stored(spark, spark.range(20).selectExpr("id as k", "'a' as v"))
    did = t.merge(spark.createDataFrame([], KEYS))
    assert (did.rewritten, did.added, did.kept) == (0, 0, 2) and t.read().count() == 20


def test_a_row_may_move_to_another_part(spark):
    t = StoredTable(spark, tempfile.mkdtemp(prefix="spark-") + "/t", ("k",), F.col("v"))
    t.create(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y/z")], KEYS))
    assert t.merge(spark.createDataFrame([(1, "y/z")], KEYS)) == Merged(version=2, rewritten=1, added=1, kept=1)
    assert table(spark, t) == {(1, "y/z"), (2, "x"), (3, "y/z")}


def test_a_failed_merge_leaves_the_table_as_it_was(spark, monkeypatch):
    t = stored(spark, spark.range(30).selectExpr("id as k", "'a' as v"))
    bad = spark.range(40).select(F.col("id").alias("k"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.lit("b")).alias("v"))
    with pytest.raises(Exception, match="broken"):
        t.merge(bad)
    monkeypatch.setattr(versions, "_claim", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        t.merge(spark.createDataFrame([(5, "b")], KEYS))
    assert t.version() == 1 and table(spark, t) == {(k, "a") for k in range(30)}


def test_of_two_writers_one_is_told(spark, monkeypatch):
    t = stored(spark, spark.range(30).selectExpr("id as k", "'a' as v"))
    written = StoredTable._written

    def slow(self, df):
        out = written(self, df)
        monkeypatch.setattr(StoredTable, "_written", written)
        assert t.merge(spark.createDataFrame([(5, "first")], KEYS)).version == 2
        return out

    monkeypatch.setattr(StoredTable, "_written", slow)
    with pytest.raises(Conflict):
        t.merge(spark.createDataFrame([(5, "second")], KEYS))
    assert (5, "first") in table(spark, t) and t.version() == 2


def test_environments_follow_pointers(spark):
    t = stored(spark, spark.range(10).selectExpr("id as k", "'a' as v"))
    with pytest.raises(ValueError, match="no environment"):
        t.read(env="dev")
    with pytest.raises(ValueError, match="no version"):
        t.point("dev", 7)
    t.point("dev", 1)
    t.point("prod", 1)
    for v in (2, 3):
        assert t.merge(spark.createDataFrame([(1, f"v{v}")], KEYS)).version == v
        t.point("dev", v)
        assert t.promote("dev", "prod") == v
    assert (1, "v3") in table(spark, t, env="prod")
    assert (t.roll_back("prod"), t.roll_back("prod")) == (2, 1)
    assert (1, "a") in table(spark, t, env="prod") and (1, "v3") in table(spark, t, env="dev")
    with pytest.raises(ValueError, match="nothing to go back to"):
        t.roll_back("prod")
    assert t.moves("prod")[-1] == (1, "rolled back") and t.moves("prod")[1] == (2, "promoted from dev")


def test_the_digest_tells_contents_apart_whatever_their_order(spark):
    digest = lambda rows: {(r.part, r.digest) for r in stored(spark, rows).manifest().collect()}
    rows = spark.range(30).selectExpr("id as k", "'a' as v")
    assert digest(rows) == digest(rows.orderBy(F.col("k").desc())) != digest(rows.withColumn("v", F.expr("if(k = 3, 'b', v)")))
