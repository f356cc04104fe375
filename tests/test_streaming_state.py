"""Outbox logs, streaming quantile sketches, exact quantiles of skewed values."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import stats
from tidemark.operators.materialize import names
from tidemark.streaming import flows

OUTBOX = "event_id long, created_at timestamp, status string, attempts int, handled boolean"


def arrive(spark, folder, first, last):
    """One file of events first to last - 1; every fifth is never handled."""
    rows = spark.range(first, last).selectExpr("id as event_id", "timestamp_seconds(id) as created_at", "'pending' as status", "0 as attempts", "id % 5 <> 0 as handled")
    rows.coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(OUTBOX).option("maxFilesPerTrigger", 1).parquet(folder)


def expected(batches, most, steps):
    """The outbox in plain Python."""
    box = {}
    for first, last in batches:
        box |= {k: ["pending", 0] for k in range(first, last)}
        for _ in range(steps):
            waiting = sorted(k for k, v in box.items() if v[0] == "pending")
            for k in waiting[: min(most, max(100, 2 * len(waiting)))]:
                if k % 5:
                    box[k][0] = "delivered"
                else:
                    box[k][1] += 1
                    box[k][0] = "failed" if box[k][1] >= 3 else "pending"
    return {k: tuple(v) for k, v in box.items()}


def test_a_batch_writes_what_it_brought_and_tried(spark, tmp_path):
    source, where, batches = str(tmp_path / "in"), str(tmp_path / "box"), [(100 * k, 100 * k + 100) for k in range(8)]
    for first, last in batches:
        arrive(spark, source, first, last)
    got = {r.event_id: (r.status, r.attempts) for r in flows.deliver(stream(spark, source), steps=1, most=120, where=where).collect()}
    # files of one folder may arrive in another order: settled rows and their number are the same
    assert len(got) == 800 and sum(s == "delivered" for s, _ in got.values()) <= 640
    sizes = [spark.read.schema(OUTBOX).parquet(f"{where}/log/{n}").count() for n in names(spark, f"{where}/log")]
    assert len(sizes) == 8 and max(sizes) <= 100 + 120
    # pending rows alone are written again, and only when the log has outgrown them
    again = [spark.read.schema(OUTBOX).parquet(f"{where}/pending/{n}") for n in names(spark, f"{where}/pending")]
    assert again and all(a.where("status <> 'pending'").isEmpty() for a in again) and sum(a.count() for a in again) <= sum(sizes)


def test_an_outbox_goes_on_where_it_was(spark, tmp_path):
    source, where, batches = str(tmp_path / "in"), str(tmp_path / "box"), []
    for k in range(5):
        batches.append((60 * k, 60 * k + 60))
        arrive(spark, source, *batches[-1])
        got = {r.event_id: (r.status, r.attempts) for r in flows.deliver(stream(spark, source), steps=2, most=110, where=where).collect()}
        assert got == expected(batches, 110, 2)


def test_a_batch_that_runs_again_counts_once(spark, tmp_path, monkeypatch):
    source, where = str(tmp_path / "in"), str(tmp_path / "box")
    arrive(spark, source, 0, 150)
    step, lost = flows.outbox_step, []

    def once(batch, *a):
        if not lost:
            lost.append(1)
            raise RuntimeError("lost")
        return step(batch, *a)

    monkeypatch.setattr(flows, "outbox_step", once)
    with pytest.raises(Exception, match="lost"):
        flows.deliver(stream(spark, source), steps=2, most=110, where=where)
    got = {r.event_id: (r.status, r.attempts) for r in flows.deliver(stream(spark, source), steps=2, most=110, where=where).collect()}
    assert got == expected([(0, 150)], 110, 2)


def test_sketches_of_a_stream_are_within_their_error_and_merge(spark, tmp_path):
    r, n = random.Random(2), 40_000
    values = [r.lognormvariate(0, 2) for _ in range(n)]
    rows = spark.createDataFrame(list(enumerate(values)), "k long, v double").selectExpr("k % 2 as model", "timestamp_seconds(k % 7200) as at", "v")
    rows.write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([(0, 90_000, 1.0)], "model long, s long, v double").selectExpr("model", "timestamp_seconds(s) as at", "v")
    late.write.mode("append").parquet(str(tmp_path / "in"))
    hours = flows.drain(flows.quantile_sketches(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["model"], "at", "v"))
    shares = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    for found, hour in ((flows.sketch_quantiles(hours, shares), True), (flows.sketch_quantiles(flows.merged_sketches(hours, ["model"], "day"), shares), False)):
        got = found.collect()
        assert sum(x.n for x in got) == n and len(got) == (4 if hour else 2)
        for x in got:
            own = sorted(v for k, v in enumerate(values) if k % 2 == x.model and (not hour or k % 7200 // 3600 == x.bucket.hour))
            for name, share in shares.items():
                assert abs(sum(v <= x[name] for v in own) / len(own) - share) <= flows.RANK_ERROR + 1 / len(own)


@pytest.mark.parametrize("small", [1_000_000, 50])
def test_exact_ranks_of_skewed_values(spark, small):
    r = random.Random(5)
    x = {"outlier": [r.random() for _ in range(3000)] + [1e15], "same": [2.0] * 2000, "powers": [float(2 ** r.randrange(60)) for _ in range(2000)], "few": [3.0, 1.0, 2.0], None: [5.0, 4.0] * 100}
    rows = [(k, v) for k, vs in x.items() for v in vs] + [("few", None), ("none", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    got = {g["k"]: (g["p50"], g["p95"]) for g in stats.floor_ranks(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}, small=small).collect()}
    assert got == {k: tuple(sorted(vs)[min(int(len(vs) * p), len(vs) - 1)] for p in (0.5, 0.95)) for k, vs in x.items()}


def test_an_outlier_doesnt_gather_a_keys_values(spark, monkeypatch):
    """The widest range has a few times its share of the values."""
    seen = []
    window = stats.Window.partitionBy

    def watched(*cols):
        seen.append(cols)
        return window(*cols)

    monkeypatch.setattr(stats.Window, "partitionBy", watched)
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.when(F.col("id") == 7, F.lit(1e18)).otherwise(F.rand(3)).alias("v"))
    assert stats.floor_ranks(df, ["k"], "v", {"p50": 0.5}, small=10, parts=50).count() == 1
    assert ("k", "part") in seen
    cuts = df.agg(F.percentile_approx("v", [k / 50 for k in range(1, 50)], F.lit(1000)).alias("c"))
    most = df.join(cuts).groupBy(F.size(F.filter("c", lambda x: x < F.col("v")))).count().agg(F.max("count")).first()[0]
    assert most < 3 * 20_000 / 50
