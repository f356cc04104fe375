"""Anomalies, forecasts, risk scores, roll-ups, drift and evaluation.

Fixed values: the weights, thresholds and defaults in the scores of this module.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import rounded
from .materialize import cut
from .select import latest, top_n


def cost_anomaly(hist: DataFrame, key: str, value: str, order: list[Column]) -> DataFrame:
    """Latest value of each key against its history (the latest included): z score, quartile fences, midrank percentile, type and severity; keys of 3 or more points.

    The gravest come first, then the largest scores.
    """
    last = latest(hist, [key], order).select(key, F.col(value).alias("latest"))
    x = F.col(value)
    g = hist.groupBy(key).agg(F.count("*").alias("n"), F.avg(x).alias("mu"), F.stddev_pop(x).alias("sd")).where("n >= 3").join(last, key)
    g = g.join(quantiles(hist, [key], value, {"q1": 0.25, "q3": 0.75}), key)
    rank = hist.join(last, key).groupBy(key).agg(F.count_if(x < F.col("latest")).alias("below"), F.count_if(x == F.col("latest")).alias("equal"))
    z = F.when(F.col("sd") > 0, (F.col("latest") - F.col("mu")) / F.col("sd")).otherwise(0.0)
    q1, q3 = F.col("q1"), F.col("q3")
    out = g.join(rank, key).withColumn("z", z).withColumn("outside", (F.col("latest") < q1 - 1.5 * (q3 - q1)) | (F.col("latest") > q3 + 1.5 * (q3 - q1)))
    odd = (F.abs("z") >= 2) | F.col("outside")
    grave = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "major", 1).when(F.col("severity") == "minor", 2).otherwise(3)
    severity = F.when(F.abs("z") >= 4, "critical").when(F.abs("z") >= 3, "major").otherwise("minor")
    return out.select(
        key, "n", F.round("latest", 4).alias("latest"), F.round("z", 4).alias("z"), F.round((F.col("below") + 0.5 * F.col("equal")) / F.col("n") * 100, 2).alias("percentile"), odd.alias("is_anomaly"),
        F.when(odd, F.when(F.col("z") > 0, "spike").otherwise("drop")).alias("kind"), F.when(odd, severity).alias("severity")).orderBy(grave, F.abs("z").desc(), key)


def ewma_forecast(hist: DataFrame, key: str, value: str, order: list[str], alpha: float = 0.3, runs_per_day: float = 1.0, size: int = 4096) -> DataFrame:
    """Exponentially weighted forecast of each key over its whole history; null values don't count.

    One point gives a margin of half the 7-day forecast. The trend is the relative slope of the
    smoothed values against 5 %. smoothed() says how a history is split over tasks.
    """
    f = smoothed(hist, key, value, order, alpha, size)
    m = F.col("n") - 1
    sd = F.when(m > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("e2") / m - (F.col("e") / m) * (F.col("e") / m))))
    week = F.col("s") * runs_per_day * 7
    margin = F.when(m > 0, 1.96 * sd * F.sqrt(F.lit(7.0)) * runs_per_day).otherwise(week * 0.5)
    slope = F.when((m > 0) & (F.col("sum_s") != 0), (F.col("s") - F.col("first")) / m / (F.col("sum_s") / F.col("n"))).otherwise(0.0)
    trend = F.when(slope > 0.05, "increasing").when(slope < -0.05, "decreasing").otherwise("stable")
    return f.select(key, F.round("s", 4).alias("forecast"), F.round(week, 4).alias("next_7d"), F.round(F.col("s") * runs_per_day * 30, 4).alias("next_30d"), F.round(F.greatest(F.lit(0.0), week - margin), 4).alias("lower"), F.round(week + margin, 4).alias("upper"), trend.alias("trend"))


def smoothed(hist: DataFrame, key: str, value: str, order: list[str], alpha: float = 0.3, size: int = 4096, fan: int = 256) -> DataFrame:
    """(key, n, first, s, sum_s, e, e2) of s[0] = x[0], s[i] = alpha x[i] + (1 - alpha) s[i - 1]: the last s, the sum of all, and the sums of |x[i] - s[i - 1]| and its square.

    Rows are sorted into ranges of key and order, and each key's stretch of a range is cut into
    blocks of `size` points. A block takes the s before it to the s behind it by a line, a s + b,
    whatever stands before it; composing these lines in groups of `fan`, and groups of groups, gives the s
    that each block begins with. So no key's history is one array or passes one task.
    """
    o = [f"o{k}" for k in range(len(order))]
    rows = hist.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), *[F.col(c).alias(n) for c, n in zip(order, o, strict=True)], F.col(value).cast("double").alias("v"))
    rows = rows.repartitionByRange("key", *o, "v").withColumn("range", F.spark_partition_id())
    chunk = F.floor((F.row_number().over(Window.partitionBy("key", "range").orderBy(*o, "v")) - 1) / size)
    points = F.array_sort(F.collect_list(F.struct(*o, "v")))
    blocks = cut(rows.withColumn("chunk", chunk).groupBy("key", "range", "chunk").agg(F.transform(points, lambda p: p["v"]).alias("x")))
    name = ["range", "chunk"]
    line = F.aggregate("x", F.lit(0.0), lambda s, v: alpha * v + (1 - alpha) * s)
    maps = blocks.select("key", *name, (F.row_number().over(Window.partitionBy("key").orderBy(*name)) - 1).cast("long").alias("i"), F.pow(F.lit(1 - alpha), F.size("x")).alias("a"), line.alias("b"), F.element_at("x", 1).alias("first"))
    maps = cut(maps)
    first = maps.where("i = 0").select("key", F.col("first").alias("x0"))
    most = maps.agg(F.max("i")).first()[0] or 0
    starts = _same(_same(maps.select("key", *name, "i"), _before(maps.select("key", "i", "a", "b"), most, fan), ["key", "i"]), first, ["key"])
    starts = starts.select("key", *name, "i", "x0", (F.col("a") * F.col("x0") + F.col("b")).alias("s0"))

    def step(a: Column, v: Column) -> Column:
        s, err = alpha * v + (1 - alpha) * a["s"], F.abs(v - a["s"])
        return F.struct(s.alias("s"), (a["sum_s"] + s).alias("sum_s"), (a["e"] + err).alias("e"), (a["e2"] + err * err).alias("e2"))

    # the first point is folded from itself: that changes nothing
    zero = F.struct(F.col("s0").alias("s"), F.lit(0.0).alias("sum_s"), F.lit(0.0).alias("e"), F.lit(0.0).alias("e2"))
    folded = _same(blocks, starts, ["key", *name]).select("key", "i", "x0", F.size("x").alias("n"), F.aggregate("x", zero, step).alias("f"))
    out = folded.groupBy("key").agg(F.sum("n").alias("n"), F.first("x0").alias("first"), F.max_by("f.s", "i").alias("s"), *[F.sum(f"f.{c}").alias(c) for c in ("sum_s", "e", "e2")])
    return out.withColumnRenamed("key", key)


def _before(maps: DataFrame, most: int, fan: int) -> DataFrame:
    """(key, i, a, b): the lines of all of a key's blocks before i, composed; maps (key, i, a, b), i from 0 to most."""
    after = lambda x, y: F.struct((y["a"] * x["a"]).alias("a"), (y["a"] * x["b"] + y["b"]).alias("b"))
    none = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    whole = lambda m: F.aggregate(m, none, after)
    groups = maps.groupBy("key", F.floor(F.col("i") / fan).alias("g")).agg(F.array_sort(F.collect_list(F.struct("i", "a", "b"))).alias("m"))
    inner = groups.select("key", "g", F.explode(F.transform("m", lambda x, j: F.struct(x["i"].alias("i"), whole(F.slice("m", F.lit(1), j)).alias("own")))).alias("r")).select("key", "g", "r.*")
    if most < fan:
        return inner.select("key", "i", "own.a", "own.b")
    totals = cut(groups.select("key", F.col("g").alias("i"), whole(F.col("m")).alias("t")).select("key", "i", "t.*"))
    outer = _before(totals, most // fan, fan).select("key", F.col("i").alias("g"), F.struct("a", "b").alias("from"))
    return _same(inner, outer, ["key", "g"]).select("key", "i", after(F.col("from"), F.col("own")).alias("t")).select("key", "i", "t.*")


def forecast_total(f: DataFrame) -> DataFrame:
    """Sums; the trend is that of a strict majority."""
    up, down, n = F.count_if(F.col("trend") == "increasing"), F.count_if(F.col("trend") == "decreasing"), F.count("*")
    return f.agg(n.alias("keys"), F.round(F.sum("next_7d"), 2).alias("next_7d"), F.round(F.sum("next_30d"), 2).alias("next_30d"), F.when(up * 2 > n, "increasing").when(down * 2 > n, "decreasing").otherwise("stable").alias("trend"))


def cost_trend(runs: DataFrame, now: str) -> DataFrame:
    """Mean cost of the last 7 days against the mean of each model's newest 50."""
    at = F.lit(now).cast("timestamp")
    recent = top_n(runs.where("cost_usd is not null"), ["model"], [F.col("started_at").desc(), F.col("run_id").desc()], 50)
    week = F.col("started_at") >= at - F.expr("interval 7 days")
    g = recent.groupBy("model").agg(F.coalesce(F.avg(F.when(week, F.col("cost_usd"))), F.lit(0.0)).alias("r"), F.avg("cost_usd").alias("h"))
    change = F.when(F.col("h") > 0.001, (F.col("r") - F.col("h")) / F.col("h")).when(F.col("r") > 0.001, 1.0).otherwise(0.0)
    return g.withColumn("c", change).select("model", F.round("c", 6).alias("change"), F.when(F.col("c") > 0.05, "up").when(F.col("c") < -0.05, "down").otherwise("flat").alias("direction"), F.round(F.col("r") * 30, 4).alias("monthly"), (F.col("c") > 0.3).alias("alert"))


def failure_risk(s: DataFrame) -> DataFrame:
    """Score and probability of failure from a run summary joined with consecutive failures and shuffle trend."""
    rate, recent = F.col("failed") / F.col("total"), F.when(F.col("recent") > 0, F.col("recent_failed") / F.col("recent")).otherwise(0.0)
    part = lambda c, v: F.when(c, v).otherwise(0.0)
    one = F.lit(1.0)
    score = (
        2.5 * F.least(rate / 0.3, one) + part((recent > 1.5 * rate) & (F.col("recent_failed") > 0), 2.0 * F.least((recent - rate) / 0.2, one)) + part(F.col("consecutive_failures") > 0, 1.5 * F.least(F.col("consecutive_failures") / 3, one))
        + part((F.col("trend") > 0.2) & (F.col("avg_runtime") > 0), F.least(F.col("trend"), one)) + part((F.col("shuffle_trend") > 0.3) & (F.col("avg_shuffle") > 0), 0.8 * F.least(F.col("shuffle_trend") / 1.5, one))
        + part(F.col("hours_since_success") > 168, 0.7 * F.least(F.col("hours_since_success") / 720, one)) + part((~F.coalesce("last_error", F.lit("")).isin("", "timeout")) & (F.col("consecutive_failures") > 0), F.lit(0.5))
    )
    z = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), 1.2 * (F.col("score") - 3.5)))
    p = s.withColumn("score", score).withColumn("probability", 1 / (1 + F.exp(-z)))
    return p.select("model", F.round("score", 6).alias("score"), F.round("probability", 6).alias("probability"), F.when(F.col("probability") >= 0.6, "high").when(F.col("probability") >= 0.3, "medium").otherwise("low").alias("risk"))


def latency_stats(df: DataFrame, key: str, value: str, order: list[Column], n: int = 100) -> DataFrame:
    """Linear percentiles of the newest n values of each key."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    g = top_n(df, [key], order, n).groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), p.alias("p"), F.min(value).alias("least"), F.max(value).alias("most"))
    return g.select(key, "n", "mean", *[F.round(F.col("p")[k], 6).alias(name) for k, name in enumerate(("p50", "p95", "p99"))], "least", "most")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys, null equal to null."""
    other = b.select(*[F.col(k).alias(f"right {k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"right {k}"))
    return a.join(other, on, "left").drop(*[f"right {k}" for k in keys])


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and for each name of shares the quantile, linear between the two values next to it; exact, and no group is one array."""
    ranks = {f"{side} of {name}": (lambda n, x=x, f=f: f((n - 1) * F.lit(x))) for name, x in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    n = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("count of values"))
    at = lambda x: (F.col("count of values") - 1) * F.lit(x)
    low, high = (lambda name: F.col(f"`low of {name}`")), (lambda name: F.col(f"`high of {name}`"))
    return _same(n, floor_ranks(df, keys, value, ranks), keys).select(*keys, *[(low(k) + (high(k) - low(k)) * (at(x) - F.floor(at(x)))).alias(k) for k, x in shares.items()])


def floor_ranks(df: DataFrame, keys: list[str], value: str, shares: dict[str, float | Callable[[Column], Column]], small: int = 50_000, parts: int = 256) -> DataFrame:
    """keys and for each name of shares the value at rank int(n * share), at most the last, of the key's sorted values; nulls don't count. A share may be a function from n to the rank.

    Keys of up to `small` values, by a count taken first, are sorted in one task each. Of others
    equal values are counted, and running counts go over `parts` ranges of the values, cut at approximate
    quantiles, so that ranges hold about as many values each whatever their distribution. Both
    ways are exact.
    """
    rank = lambda share: F.least(share(F.col("n")) if callable(share) else F.floor(F.col("n") * share), F.col("n") - 1)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    large = cut(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > small).select(*keys, F.lit(True).alias("is large")))
    own = Window.partitionBy(*keys)

    def sorted_(d: DataFrame) -> DataFrame:
        d = d.withColumn("at", F.row_number().over(own.orderBy("v")) - 1).withColumn("n", F.count("*").over(own))
        return d.groupBy(*keys).agg(*[F.max(F.when(F.col("at") == rank(x), F.col("v"))).alias(name) for name, x in shares.items()])

    if large.isEmpty():
        return sorted_(rows)
    v = _same(rows, large, keys)
    few, many = v.where("`is large` is null").drop("is large"), v.where("`is large`").drop("is large")
    v = cut(many.groupBy(*keys, "v").agg(F.count("*").alias("c")))
    ends = v.groupBy(*keys).agg(F.percentile_approx("v", [k / parts for k in range(1, parts)], F.lit(20 * parts)).alias("cuts"), F.sum("c").alias("n"))
    ranged = _same(v, ends, keys).withColumn("part", F.size(F.filter("cuts", lambda x: x < F.col("v")))).drop("cuts")
    sizes = ranged.groupBy(*keys, "part").agg(F.sum("c").alias("size"))
    before = sizes.select(*keys, "part", (F.sum("size").over(Window.partitionBy(*keys).orderBy("part")) - F.col("size")).alias("before"))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "part").orderBy("v"))
    run = _same(ranged, before, [*keys, "part"]).withColumn("upto", upto)
    out = run.groupBy(*keys).agg(*[F.max(F.when((F.col("upto") > rank(x)) & (F.col("upto") - F.col("c") <= rank(x)), F.col("v"))).alias(name) for name, x in shares.items()])
    return sorted_(few).union(out) if keys else out  # without keys, an aggregate of no rows is a row


def rollup(telemetry: DataFrame, unit: str) -> DataFrame:
    """Counts, sums and floor-index percentiles of each model and hour or day."""
    t = telemetry.withColumn("bucket", F.date_trunc(unit, "captured_at"))
    g = t.groupBy("model", "bucket").agg(
        F.count("*").alias("n"), F.round(F.avg("runtime_seconds"), 6).alias("avg_runtime"), F.sum("shuffle_bytes").alias("shuffle_bytes"), F.sum("input_rows").alias("input_rows"), F.sum("output_rows").alias("output_rows"), F.round(F.avg("partition_count"), 6).alias("avg_partitions"))
    return _same(g, floor_ranks(t, ["model", "bucket"], "runtime_seconds", {"p50": 0.5, "p95": 0.95}), ["model", "bucket"]).select("model", "bucket", "n", "avg_runtime", "shuffle_bytes", "input_rows", "output_rows", "avg_partitions", "p50", "p95")


def kpi_report(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Each KPI's value (floor-index P95 where lower is better, else the mean), status and number of values; a KPI without metrics is insufficient."""
    g = _same(metrics.groupBy("kpi").agg(F.avg("value").alias("mean"), F.count("value").alias("sample_size")), floor_ranks(metrics, ["kpi"], "value", {"p95": 0.95}), ["kpi"])
    low = F.col("lower_is_better") == 1
    j = thresholds.join(g, "kpi", "left").withColumn("value", F.when(low, F.col("p95")).otherwise(F.col("mean")))
    ok = lambda c: F.when(low, F.col("value") <= F.col(c)).otherwise(F.col("value") >= F.col(c))
    return j.select("kpi", F.round("value", 6).alias("value"), F.when(F.col("value").isNull(), "insufficient").when(ok("target"), "passing").when(ok("warn"), "warning").otherwise("failing").alias("status"), F.coalesce("sample_size", F.lit(0)).alias("sample_size"))


def kpi_health(report: DataFrame) -> DataFrame:
    """One row: KPIs of each status, and healthy without failing ones, degraded with one or two, else unhealthy."""
    n = lambda s: F.count_if(F.col("status") == s)
    health = F.when(n("failing") == 0, "healthy").when(n("failing") <= 2, "degraded").otherwise("unhealthy")
    return report.agg(F.count("*").alias("total"), *[n(s).alias(s) for s in ("passing", "warning", "failing", "insufficient")], health.alias("health"))


def psi(df: DataFrame, key: str, value: str, order: list[str], window: int = 500, bins: int = 10) -> DataFrame:
    """Population stability of each key's last `window` values against its first, over quantile bins of the first; keys of 100 or more values.

    Values outside the edges fall in no bin but count in n; empty bins count as 1e-6.
    """
    enough = df.groupBy(key).agg(F.count("*").alias("total")).where("total >= 100").select(key)
    d = df.select(key, F.col(value).alias("v"), *[F.col(c).alias(f"order {c}") for c in order])
    end = lambda by: top_n(d, [key], by, window).join(enough, key, "left_semi").select(key, "v")
    first, last = end([F.col(f"order {c}") for c in order]), end([F.col(f"order {c}").desc() for c in order])
    cuts = first.groupBy(key).agg(F.percentile("v", F.array(*[F.lit(k / bins) for k in range(bins + 1)])).alias("e"), F.count("*").alias("na")).withColumn("e", F.transform("e", lambda x, i: F.when(i == 0, x - 1e-8).when(i == bins, x + 1e-8).otherwise(x)))
    sides = first.select(key, "v", F.lit("a").alias("side")).union(last.select(key, "v", F.lit("b").alias("side"))).join(cuts, key)
    at = F.size(F.filter("e", lambda x: x <= F.col("v")))
    inside = sides.withColumn("bin", F.when(F.col("v") == F.element_at("e", -1), bins).otherwise(at))
    per = inside.groupBy(key, "bin").agg(F.count_if(F.col("side") == "a").alias("ca"), F.count_if(F.col("side") == "b").alias("cb"))
    every = cuts.select(key, F.col("na").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    j = every.join(per, [key, "bin"], "left")
    pa, pb = (F.greatest(F.coalesce(c, F.lit(0)) / F.col("n"), F.lit(1e-6)) for c in ("ca", "cb"))
    out = j.groupBy(key).agg(F.sum((pb - pa) * F.log(pb / pa)).alias("psi"))
    return out.select(key, F.round("psi", 6).alias("psi"), F.when(F.col("psi") < 0.1, "stable").when(F.col("psi") < 0.2, "warning").otherwise("drift").alias("status"))


def confusion(df: DataFrame, labels: list) -> DataFrame:
    """Counts of every pair of labels, zeros included; labels are few."""
    spark = df.sparkSession
    every = spark.createDataFrame([(a, p) for a in labels for p in labels], "actual int, predicted int")
    return every.join(df.groupBy("actual", "predicted").agg(F.count("*").alias("n")), ["actual", "predicted"], "left").na.fill(0, ["n"])


def prf1(df: DataFrame, labels: list) -> DataFrame:
    """Precision, recall and F1 of each label and their macro mean; 0 where undefined. One pass."""
    count = lambda c: F.count_if(c)
    a, p = F.col("actual"), F.col("predicted")
    cells = df.agg(*[count(c).alias(f"{n}_{x}") for x in labels for n, c in (("tp", (a == x) & (p == x)), ("fp", (a != x) & (p == x)), ("fn", (a == x) & (p != x)))])
    rows = cells.select(F.explode(F.array(*[F.struct(F.lit(str(x)).alias("label"), *[F.col(f"{n}_{x}").alias(n) for n in ("tp", "fp", "fn")]) for x in labels])).alias("r")).select("r.*")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    r = rows.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    r = r.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label", "precision", "recall", "f1")
    out = r.union(r.agg(F.lit("macro"), F.avg("precision"), F.avg("recall"), F.avg("f1")))
    return out.select("label", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])


def calibration(df: DataFrame) -> DataFrame:
    """Accuracy in four buckets of confidence; 0 for empty ones."""
    c = F.col("confidence")
    b = F.when(c < 0.3, 0).when(c < 0.6, 1).when(c < 0.8, 2).otherwise(3)
    g = df.groupBy(b.alias("bucket")).agg(F.avg((F.col("actual") == F.col("predicted")).cast("int")).alias("accuracy"), F.count("*").alias("n"))
    every = df.sparkSession.range(4).select(F.col("id").cast("int").alias("bucket"))
    return every.join(g, "bucket", "left").select("bucket", F.round(F.coalesce("accuracy", F.lit(0.0)), 4).alias("accuracy"), F.coalesce("n", F.lit(0)).alias("n"))


def customer_health(usage: DataFrame, key: str, now: str, feature_days: int = 30, previous: DataFrame | None = None) -> DataFrame:
    """0 to 100 from the recency of three kinds of events and the number of kinds used; status, and trend against earlier scores (key, score)."""
    at = F.lit(now).cast("timestamp")

    def recency(kind: str) -> Column:
        days = (F.unix_micros(at) - F.unix_micros(F.max(F.when(F.col("event_type") == kind, F.col("created_at"))))) / 86_400_000_000
        return rounded(F.when(days.isNull() | (days >= 30), 0.0).when(days <= 1, 25.0).otherwise(25.0 * (30 - days) / 29), 2)

    used = F.countDistinct(F.when(F.col("created_at") >= at - F.expr(f"interval {feature_days} days"), F.col("event_type")))
    g = usage.groupBy(key).agg(*[recency(k).alias(f"r{n}") for n, k in enumerate(("api_request", "plan_run", "ai_call"))], rounded(F.least(F.lit(25.0), used / 6 * 25), 2).alias("r3"))
    g = g.select(key, rounded(F.col("r0") + F.col("r1") + F.col("r2") + F.col("r3"), 1).alias("score"))
    g = g.withColumn("status", F.when(F.col("score") >= 60, "active").when(F.col("score") >= 30, "at_risk").otherwise("churning"))
    if previous is None:
        return g
    j = g.join(previous.select(key, F.col("score").alias("before")), key, "left")
    return j.withColumn("trend", F.when(F.col("score") - F.col("before") > 5, "improving").when(F.col("score") - F.col("before") < -5, "declining").otherwise("stable")).drop("before")


def cost_predict(avg_runtime: Column, partitions: Column, size: Column, workers: Column, rate: float, confidence: Column) -> dict[str, Column]:
    """Heuristic cost with its band."""
    base = F.coalesce(avg_runtime, 300 + 30 * partitions)
    sec = F.greatest(F.lit(30.0), base * (1 + F.log1p(size) / 50) * F.when(workers > 1, 1 / (1 + F.log2(workers))).otherwise(1.0))
    cost = sec / 60 * rate
    band = F.when(confidence < 0.5, 0.4).when(confidence < 0.8, 0.2).otherwise(0.05)
    return {"cost": F.round(cost, 6), "low": F.round(cost * (1 - band), 6), "high": F.round(cost * (1 + band), 6)}


def fit_cost_model(df: DataFrame, features: list[str], label: str):
    """A linear regression pipeline; predictions below 0 are clamped by predict_cost()."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), LinearRegression(featuresCol="features", labelCol=label, predictionCol="raw")]).fit(df)


def predict_cost(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("predicted", F.greatest(F.lit(0.0), F.col("raw"))).drop("features", "raw")


def sql_text_features(text: Column) -> dict[str, Column]:
    """Counts read off SQL text."""
    up = F.upper(F.coalesce(text, F.lit("")))
    tables = F.array_distinct(F.regexp_extract_all(up, F.lit(r"\b(?:FROM|JOIN)\s+([A-Z_][A-Z0-9_.]*)"), F.lit(1)))
    return {"joins": F.regexp_count(up, F.lit(r"\bJOIN\b")), "ctes": F.regexp_count(up, F.lit(r"\bWITH\b")), "has_window": F.rlike(up, F.lit(r"\bOVER\s*\(")), "tables": F.size(tables), "volume": F.round(F.log1p(F.length(up)), 6)}
