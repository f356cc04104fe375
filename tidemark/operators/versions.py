"""Tables kept as versions: a merge rewrites the partitions it touches, environments point at versions.

A version is a small Parquet table of parts (part, folder, rows, low, high, nulls, digest) and
exists once its marker file does; folders of data are never changed. Markers are created only
where none is, so of two writers one gets the version and the other an error, and readers see
a merge whole or not at all.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .materialize import merge_by_key, names
from .select import latest

PART = "part_of_stored_table"


class Conflict(RuntimeError):
    """Another writer was first."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _claim(spark: SparkSession, path: str, text: str) -> None:
    """Creates a file with the text, or raises Conflict where there is one."""
    fs, p = _fs(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            raise Conflict(path) from e
        raise
    out.write(bytearray(text.encode()))
    out.close()


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


@dataclass(frozen=True)
class Merged:
    """What a merge did: the version it made, parts rewritten, parts that only got new rows in a folder beside, and parts left alone."""

    version: int
    rewritten: int
    added: int
    kept: int


@dataclass(frozen=True)
class StoredTable:
    """A table under path with one row a key; part names the partition of a row (a string column expression), such as a month or a range of keys."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    part: Column

    def _at(self, *names: object) -> str:
        return "/".join([self.path.rstrip("/"), *map(str, names)])

    def create(self, df: DataFrame) -> int:
        """The first version."""
        return self._commit(0, self._written(df))

    def version(self) -> int:
        """The newest version, 0 if there is none."""
        return max((int(n) for n in names(self.spark, self._at("versions"))), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(part, folder, rows, low, high, nulls, digest): low and high are those of the first key, digest is a hash of all rows, whatever their order."""
        v = self.version() if version is None else version
        if not v:
            raise ValueError(f"no version of {self.path}")
        return self.spark.read.parquet(self._at("manifests", _text(self.spark, self._at("versions", f"{v:012d}"))))

    def _rows(self, manifest: DataFrame, schema: T.StructType | None = None) -> DataFrame:
        """Rows of a manifest's folders; their names come to the driver, one a part."""
        folders = [self._at("data", r.folder) for r in manifest.select("folder").collect()]
        if folders:
            return self.spark.read.parquet(*folders)
        return self.spark.createDataFrame([], schema if schema is not None else self._schema())

    def _schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(_text(self.spark, self._at("schema"))))

    def read(self, version: int | None = None, env: str | None = None) -> DataFrame:
        """The newest version, the one given, or the one that an environment points at."""
        return self._rows(self.manifest(self.pointed(env) if env is not None else version))

    def merge(self, source: DataFrame, update_cols: list[str] | None = None, order_by: list[Column] | None = None) -> Merged:
        """merge_by_key() into the newest version, as a new one.

        Parts whose range of first keys no source row can be in aren't read; of the others only
        keys are, to see which hold a source key; only those are rewritten. New rows of other parts go into
        a folder beside what is there.
        """
        now = self.version()
        old = self.manifest(now).cache()
        try:
            schema = self._rows(old).schema
            rest = [c for c in schema.names if c not in self.keys]
            src = self._kept(latest(source.select(*schema.names), list(self.keys), order_by or [F.col(c).desc() for c in rest] or [F.col(c) for c in self.keys]))
            first = self.keys[0]
            ends = src.agg(F.min(first).alias("a"), F.max(first).alias("b"), F.count_if(F.col(first).isNull()).alias("n")).first()
            reach = F.lit(False) if ends.a is None else (F.col("low") <= F.lit(ends.b)) & (F.col("high") >= F.lit(ends.a))
            maybe = old.where(F.coalesce(reach, F.lit(False)) | (F.lit(ends.n > 0) & (F.col("nulls") > 0)))
            same = F.lit(True)
            for k in self.keys:
                same = same & F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
            folder = F.concat_ws("/", F.slice(F.split("_metadata.file_path", "/"), -3, 2))
            held = self._rows(maybe, schema).select(*self.keys, folder.alias("folder")) if not maybe.isEmpty() else None
            touched = [r.folder for r in held.alias("t").join(src.select(*self.keys).alias("s"), same, "left_semi").select("folder").distinct().collect()] if held is not None else []
            hit = old.where(F.col("folder").isin(touched)) if touched else old.limit(0)
            new = self._written(merge_by_key(self._rows(hit, schema), src, list(self.keys), update_cols))
            keep = old.where(~F.col("folder").isin(touched)) if touched else old
            parts, kept = new.select("part").distinct(), keep.count()
            added = parts.join(keep.select("part"), "part", "left_semi").count()
            return Merged(self._commit(now, keep.unionByName(new)), len(touched), added, kept)
        finally:
            old.unpersist()

    def _kept(self, df: DataFrame) -> DataFrame:
        path = self._at("sources", uuid.uuid4().hex)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _written(self, df: DataFrame) -> DataFrame:
        """Writes rows by part and describes the folders; nothing points at them yet."""
        name = uuid.uuid4().hex
        # names of folders are plain; parts that differ in other characters only are one
        part = F.regexp_replace(F.coalesce(self.part, F.lit("none")), "[^A-Za-z0-9_.-]", "_")
        df.withColumn(PART, part).hint("rebalance", PART).write.partitionBy(PART).parquet(self._at("data", name))
        if not names(self.spark, self._at("schema")):
            try:
                _claim(self.spark, self._at("schema"), df.schema.json())
            except Conflict:
                pass
        back = self.spark.read.schema(T.StructType([*df.schema.fields, T.StructField(PART, T.StringType())])).parquet(self._at("data", name))
        first = F.col(self.keys[0])
        return back.groupBy(F.col(PART).alias("part"), F.concat(F.lit(name + "/"), F.element_at(F.split("_metadata.file_path", "/"), -2)).alias("folder")).agg(
            F.count("*").alias("rows"), F.min(first).alias("low"), F.max(first).alias("high"), F.count_if(first.isNull()).alias("nulls"), F.lower(F.hex(F.bit_xor(F.xxhash64(*df.columns)))).alias("digest"))

    def _commit(self, after: int, manifest: DataFrame) -> int:
        name = uuid.uuid4().hex
        manifest.coalesce(1).write.parquet(self._at("manifests", name))
        _claim(self.spark, self._at("versions", f"{after + 1:012d}"), name)
        return after + 1

    # environments: one pointer file for each move, the newest counts

    def point(self, env: str, version: int, why: str = "set") -> None:
        if f"{version:012d}" not in names(self.spark, self._at("versions")):
            raise ValueError(f"no version {version}")
        moves = names(self.spark, self._at("environments", env))
        _claim(self.spark, self._at("environments", env, f"{len(moves) + 1:012d}"), f"{version} {why}")

    def moves(self, env: str) -> list[tuple[int, str]]:
        """(version, why) of an environment's moves, oldest first."""
        out = [_text(self.spark, self._at("environments", env, n)).split(" ", 1) for n in names(self.spark, self._at("environments", env))]
        return [(int(v), why) for v, why in out]

    def pointed(self, env: str) -> int:
        moves = self.moves(env)
        if not moves:
            raise ValueError(f"no environment {env}")
        return moves[-1][0]

    def promote(self, source: str, target: str) -> int:
        """Points target at what source points at; no data is copied. Both must exist."""
        version = self.pointed(source)
        self.pointed(target)
        self.point(target, version, f"promoted from {source}")
        return version

    def roll_back(self, env: str) -> int:
        """Points env at what it pointed at before its last promotion or setting."""
        stack: list[int] = []
        for version, why in self.moves(env):
            if why == "rolled back":
                stack.pop()
            else:
                stack.append(version)
        if len(stack) < 2:
            raise ValueError(f"{env} has nothing to go back to")
        self.point(env, stack[-2], "rolled back")
        return stack[-2]
