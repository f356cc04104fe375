"""What several operators of this subpackage need: tables, cut lineage, components, crc folds."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# slots of a bit table: 2^23 bits are 131,072 rows of a broadcast
SLOTS = 1 << 23
# what a join may send to the driver and all executors unasked, while a table is written: Spark goes by the bytes of the table that was read, and its rows' keys, once exploded or made in Python, may be a hundred times that
BROADCAST = 256 << 10
# while a table is written: its shuffle files go when it is there, and Python tasks get pieces of few MB at a time
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where it is unset only a local master may go on, in a temporary folder: driver and executors
    are one process there. Elsewhere that would lose files, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def holding(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session that are as before afterwards."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def writing(spark: SparkSession) -> AbstractContextManager[None]:
    """WRITING, and joins that send no more than BROADCAST bytes of their own accord."""
    most = min(BROADCAST, spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    return holding(spark, WRITING | {"spark.sql.autoBroadcastJoinThreshold": str(most)})


def cut(df: DataFrame, where: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and it is computed once.

    where, if given, receives the path, so that the table can be dropped once nothing reads it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    with writing(spark):
        df.write.parquet(path)
    if where is not None:
        where.append(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, that gives freed memory back at its end: Python workers stay for later stages, and what they hold counts there."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        # only glibc has and needs it
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


def drop(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


def marks(of: DataFrame, name: str, slots: int = SLOTS) -> DataFrame:
    """(word, bits): one bit for each slot that a long of column `name` falls in; slots / 64 rows at most, whatever the input."""
    slot = of.select(F.pmod(name, F.lit(slots)).alias("slot"))
    return slot.groupBy(F.expr("cast(slot div 64 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(slot, 64) as int)))").alias("bits"))


def bitmap(marked: DataFrame, slots: int = SLOTS) -> bytes:
    """marks() as the bytes of one array of longs: a fixed size, whatever the input."""
    t = marked.select("word", "bits").toArrow()
    on = np.zeros(slots // 64, np.int64)
    on[t.column("word").to_numpy()] = t.column("bits").to_numpy()
    return on.tobytes()


def by_mark(df: DataFrame, name: str, marked: DataFrame, on: bool, slots: int = SLOTS) -> DataFrame:
    """Rows of df whose long `name` is marked (on) or isn't. marked has a fixed size and is broadcast; null counts as not marked."""
    slot = f"pmod(`{name}`, {slots}L)"
    bit = F.expr(f"cast({slot} div 64 as int) = `word of marks` and (shiftrightunsigned(`bits of marks`, cast(pmod({slot}, 64) as int)) & 1) = 1")
    small = F.broadcast(marked.select(F.col("word").alias("word of marks"), F.col("bits").alias("bits of marks")))
    return df.join(small, bit, "left_semi" if on else "left_anti")


def fold(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as fold 0 of the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod


def apart(named: DataFrame, cols: list[str], where: list[str] | None = None, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pairs (key, x: struct, y: struct) of the members of each key that have different roots, each once; named (key, root, cols).

    Keys whose members all have one root are dropped before the join. In the others the root of
    most members is set apart: its members meet those of other roots, never one another, so a
    large group that is connected costs its size for every stranger in its key. Members of many
    small roots still meet in full. where, as in cut(), receives the path of a table that the pairs read.
    more, if given, adds columns to the members (key, root, cols) of the keys that are left; x and y have them too.
    """
    spread = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    sides = cut(named.join(spread, "key").select("key", "root", *cols), where)
    sides = more(sides) if more else sides
    sides = sides.select("key", "root", F.struct(*[c for c in sides.columns if c != "key"]).alias("y"))
    main = sides.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    sides = sides.join(main, "key")
    off = sides.where("root <> main").select("key", F.col("y").alias("x"))
    return off.join(sides, "key").where("root = main or x.root < root").select("key", "x", "y")


def components(edges: DataFrame, src: str = "src", dst: str = "dst", where: list[str] | None = None) -> DataFrame:
    """Connected components of undirected edges by alternating large-star and small-star rounds.

    Returns (node, root) for every node that has an edge to another node; root is the smallest
    node of its component. Null ends and self edges are left out. Every round is a grouped
    minimum (combined before the shuffle) and one join that Spark may split where a hub is hot;
    a round's table is written to the shared folder, so a lost executor costs one round.
    where, as in cut(), receives the path of the last.
    """
    spark = edges.sparkSession
    old: list[str] = []
    now: list[str] = []
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), now)
    while True:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m0")).select(F.col("a").alias("k"), F.least("a", "m0").alias("m"))
        # large star: larger neighbours of a point at the least of a's neighbourhood
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a node that is its own minimum keeps its edges through the same rule
        large = large.where("a <> b").distinct()
        # small star: smaller neighbours and a itself point at the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(low, F.col("a") == F.col("k"))
        out = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("k").alias("a"), F.col("m").alias("b")))
        old, now = now, []
        nxt = cut(out.where("a <> b").distinct(), now)
        # settled when every node has one edge, to a node that has none of its own
        with writing(spark):
            bad = nxt.groupBy("a").count().where("count > 1").limit(1).count() or nxt.join(nxt.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        e = nxt
        drop(spark, old)
        if not bad:
            break
    if where is not None:
        where += now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def crc_sql(bytes_of: str) -> str:
    """crc32 of a list of bytes in DuckDB; needs the table crc."""
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bytes_of}), lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295::bigint)"


CRC_SQL = "crc as (select list(c order by i) as t from (select i, list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) as c from range(256) r(i)))"
