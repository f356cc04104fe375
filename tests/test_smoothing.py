"""Whole-history smoothing against a plain fold, and verified rows of audit chains."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import privacy, stats


def fold(x, alpha=0.3):
    s, sums, e, e2 = x[0], x[0], 0.0, 0.0
    for v in x[1:]:
        err = abs(v - s)
        s = alpha * v + (1 - alpha) * s
        sums, e, e2 = sums + s, e + err, e2 + err * err
    return s, sums, e, e2


@pytest.mark.parametrize(("size", "fan"), [(4096, 256), (64, 4), (1, 256), (7, 3)])
def test_smoothing_equals_a_fold(spark, size, fan):
    r = random.Random(size)
    lengths = {"long": 10_000 if size > 1 else 500, "short": 3, "one": 1, None: 50}
    x = {k: [r.uniform(0, 100) for _ in range(n)] for k, n in lengths.items()}
    rows = [(k, i, v) for k, vs in x.items() for i, v in enumerate(vs)] + [("long", -1, None), ("none", 0, None)]
    r.shuffle(rows)
    hist = spark.createDataFrame(rows, "model string, at int, cost double")
    got = {row["model"]: row for row in stats.smoothed(hist, "model", "cost", ["at"], size=size, fan=fan).collect()}
    assert set(got) == set(x)
    for k, vs in x.items():
        assert got[k]["n"] == len(vs) and got[k]["first"] == vs[0]
        assert [got[k][c] for c in ("s", "sum_s", "e", "e2")] == pytest.approx(fold(vs), rel=1e-9)


def test_no_array_is_longer_than_a_block(spark, monkeypatch):
    sizes, cut = [], stats.cut

    def watched(df):
        out = cut(df)
        if "x" in out.columns:
            sizes.append(out.agg(F.max(F.size("x"))).first()[0])
        return out

    monkeypatch.setattr(stats, "cut", watched)
    hist = spark.range(10_000).selectExpr("1 as model", "id as at", "cast(id % 7 as double) as cost")
    assert stats.smoothed(hist, "model", "cost", ["at"], size=100).first()["n"] == 10_000
    assert sizes == [100]


def test_forecast_of_no_history(spark):
    assert stats.ewma_forecast(spark.createDataFrame([], "model string, at int, cost double"), "model", "cost", ["at"]).collect() == []


def test_only_verified_rows_are_counted(spark):
    rows = spark.range(40).selectExpr("id % 4 as tenant", "id as at", "cast(id as string) as what")
    log = privacy.audit_chain(rows, "tenant", ["at"], ["what"]).withColumn("is_anonymized", F.expr("tenant = 1 and at in (5, 9) or tenant = 2 and at in (2, 30)"))
    # tenant 1: two anonymised; 2: two anonymised and a break at its seventh row; 3: the link of its fourth row is broken
    log = log.withColumn("what", F.when(F.expr("is_anonymized or tenant = 2 and at = 26"), "altered").otherwise(F.col("what")))
    log = log.withColumn("previous_hash", F.when(F.expr("tenant = 3 and at = 15"), "x").otherwise(F.col("previous_hash")))
    got = {tuple(r) for r in privacy.audit_verify(log, "tenant", ["at"], ["what"]).collect()}
    assert got == {(0, True, 10), (1, True, 8), (2, False, 5), (3, False, 3)}
