"""Structured Streaming flows and the batch steps they run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.materialize import names, scratch


def read(spark: SparkSession, sf_dir: str, name: str, ts: str | None = None) -> DataFrame:
    """A table of the given folder as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    out = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(_folder(spark, sf_dir, name))
    return out.withColumn(ts, F.col(ts).cast("timestamp")) if ts else out


def _folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """File streams read folders: that of the table, or a glob that fits its one file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    one = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    return f"{sf_dir}/{name}.parque[t]" if one else f"{sf_dir}/{name}.parquet"


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote to a table."""
    spark = stream.sparkSession
    out, state = scratch(spark), scratch(spark)
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def usage_ingest(stream: DataFrame, sink: str, checkpoint: str, key: str = "event_id", ts: str = "ts", delay: str = "1 hour") -> StreamingQuery:
    """Appends events to the sink, each key once within the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key]).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)


def hourly_usage(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events of each type and hour. Append mode: an hour comes out once the watermark has passed it."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("w.start").alias("hour"), "event_type", "n", "v")


def upsert_batches(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Update-mode totals, kept as the newest row of each key; a batch that runs again writes the same folder, so nothing counts twice."""
    spark = stream.sparkSession
    out, state = scratch(spark), scratch(spark)

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, *[f"r.{c}" for c in rest])


def outbox_step(batch: DataFrame, max_attempts: int = 3) -> DataFrame:
    """One delivery attempt of pending rows (handled says how it went): delivered, pending with one more attempt, or failed after max_attempts."""
    tried = F.col("attempts") + 1
    status = F.when(F.col("status") != "pending", F.col("status")).when(F.col("handled"), "delivered").when(tried >= max_attempts, "failed").otherwise("pending")
    return batch.withColumns({"status": status, "attempts": F.when((F.col("status") == "pending") & ~F.col("handled"), tried).otherwise(F.col("attempts"))})


def batch_size(pending: int, least: int = 100, most: int = 500) -> int:
    """Rows of a delivery step: twice what is pending, within bounds."""
    return min(most, max(least, 2 * pending))


def deliver(stream: DataFrame, steps: int = 1, most: int = 500, where: str | None = None) -> DataFrame:
    """An outbox fed by a stream (event_id, created_at, status, attempts, handled): after each micro-batch `steps` delivery steps of the oldest pending rows.

    The outbox is a log: a micro-batch writes the rows that it brought and those that it tried, and
    no others; an event's newest row counts. Pending rows are written again, alone, once the log
    since has more rows than they; then older files are not read for them any more. A
    micro-batch that runs again writes its part of the log again from what was there before it,
    so a delivery happens at least once and its outcome counts once. A folder `where` holds the log
    and the stream's progress and may be used again. Returns the outbox once all input is taken in.
    """
    spark, schema = stream.sparkSession, stream.schema
    out = where or scratch(spark)
    rest = [f.name for f in schema.fields if f.name != "event_id"]

    def read(kind: str, ns: list[int]) -> DataFrame:
        paths = [f"{out}/{kind}/{n:012d}" for n in ns]
        rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
        at = F.element_at(F.split("_metadata.file_path", "/"), -2).cast("long") if paths else F.lit(0).cast("long")
        return rows.select("*", at.alias("batch of log"))

    def newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("event_id").agg(F.max_by(F.struct(*rest), "batch of log").alias("r")).select("event_id", *[f"r.{c}" for c in rest]).select(*schema.names)

    def batches(kind: str) -> list[int]:
        return [int(x) for x in names(spark, f"{out}/{kind}")]

    def pending(n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Rows that are pending before batch n; the rows written as such last, and the log since."""
        base = max((m for m in batches("pending") if m < n), default=-1)
        old, log = read("pending", [base] if base >= 0 else []), read("log", [m for m in batches("log") if base < m < n])
        return newest(old.union(log)).where("status = 'pending'"), old, log

    def write(batch: DataFrame, n: int) -> None:
        new = batch.select(*schema.names)
        waiting = pending(n)[0].unionByName(new)
        tried = spark.createDataFrame([], schema)
        for k in range(steps):
            open_ = waiting.join(tried.select("event_id"), "event_id", "left_anti").select(*schema.names).union(tried.where("status = 'pending'"))
            now = open_.orderBy("created_at", "event_id").limit(batch_size(open_.count(), most=most))
            path = f"{out}/tried/{n:012d}-{k}"
            outbox_step(now).select(*schema.names).unionByName(tried.join(now.select("event_id"), "event_id", "left_anti")).write.mode("overwrite").parquet(path)
            tried = spark.read.schema(schema).parquet(path)
        tried.unionByName(new.join(tried.select("event_id"), "event_id", "left_anti").select(*schema.names)).write.mode("overwrite").parquet(f"{out}/log/{n:012d}")
        after, old, log = pending(n + 1)
        if log.count() > max(old.count(), most):
            after.write.mode("overwrite").parquet(f"{out}/pending/{n:012d}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()
    return newest(read("log", batches("log")))


# normalised rank error of a sketch of this size: 2.296 / k ** 0.9021
SKETCH, RANK_ERROR = 1024, 0.0045


def quantile_sketches(stream: DataFrame, keys: list[str], ts: str, value: str, unit: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(keys, bucket, n, sketch) of a stream (or a table): a mergeable quantile sketch of each key and stretch of time, kept as streaming state of bounded size."""
    g = stream.withWatermark(ts, delay).groupBy(F.window(ts, unit).alias("w"), *keys)
    return g.agg(F.count(value).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH)).alias("sketch")).select(*keys, F.col("w.start").alias("bucket"), "n", "sketch")


def merged_sketches(sketches: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """(keys, bucket, n, sketch) of longer stretches (day, week, month), from the sketches of shorter ones."""
    return sketches.groupBy(*keys, F.date_trunc(unit, "bucket").alias("bucket")).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """The sketches' quantiles by name; the rank of each is off by RANK_ERROR at most, with 99 % confidence, and not at all up to SKETCH values."""
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *[F.kll_sketch_get_quantile_double("sketch", F.lit(x)).alias(name) for name, x in shares.items()])


def fan_out(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """(event_id, subscriber) of a stream or table of events: subscribers (subscriber, event_types) are as few as registrations, so they go to every task, one row a type."""
    by_type = subscribers.select("subscriber", F.explode("event_types").alias("event_type")).distinct()
    return events.join(F.broadcast(by_type), "event_type").select("event_id", "subscriber")
