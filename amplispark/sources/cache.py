"""A content-addressed cache of texts in a shared folder (SRC-14).

A batch of entries is written to a folder that no reader looks at and then
renamed, which is one step of the file system, so nobody ever sees half a write,
and a writer that dies leaves nothing behind but that folder. Every entry has the
SHA-256 of its text beside it: an entry that does not match it, and whatever a
damaged file holds, is a miss.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "kind string, key string, text string, created timestamp, digest string"


def content_key(*parts: Column) -> Column:
    """The key of a request: the SHA-256 of its parts as JSON, fields in the order of their names; nulls count."""
    row = F.struct(*[p.alias(f"p{i:03d}") for i, p in enumerate(parts)])
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def _digest(kind: Column, key: Column, text: Column, created: Column) -> Column:
    return F.sha2(F.to_json(F.struct(kind.alias("a"), key.alias("b"), text.alias("c"), created.cast("double").alias("d")), {"ignoreNullFields": "false"}), 256)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stage(entries: DataFrame, root: str, now: Column) -> str:
    """Writes (kind, key, text) entries where no reader looks; returns the folder. Null texts are not stored."""
    path = f"{root}/_staged-{uuid.uuid4().hex}"
    rows = entries.where(F.col("text").isNotNull()).select("kind", "key", "text", now.cast("timestamp").alias("created"))
    rows.withColumn("digest", _digest(F.col("kind"), F.col("key"), F.col("text"), F.col("created"))).write.parquet(path)
    return path


def commit(spark: SparkSession, staged: str) -> str:
    """Makes a staged folder one that readers see, by a rename."""
    root, _, name = staged.rpartition("/")
    path = f"{root}/batch-{name.removeprefix('_staged-')}"
    jvm, at, fs = _fs(spark, staged)
    if not fs.rename(at, jvm.org.apache.hadoop.fs.Path(path)):
        raise OSError(f"cannot rename {staged}")
    return path


def put(entries: DataFrame, root: str, now: Column | None = None) -> str:
    """Adds entries; of one key the newest is what is read."""
    return commit(entries.sparkSession, stage(entries, root, F.current_timestamp() if now is None else now))


def entries(spark: SparkSession, root: str) -> DataFrame:
    """Every entry that can be read and is whole."""
    jvm, at, fs = _fs(spark, root)
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/batch-*")) if fs.exists(at) else None
    paths = [] if found is None else [f.getPath().toString() for f in found]
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(*paths)
    return rows.where(F.col("digest") == _digest(F.col("kind"), F.col("key"), F.col("text"), F.col("created")))


def get(asked: DataFrame, root: str, days: float | None, now: Column | None = None) -> DataFrame:
    """(kind, key, text) of the asked (kind, key): the newest whole entry that is not older than ``days`` (null: no age is too old); null where there is none."""
    held = entries(asked.sparkSession, root)
    if days is not None:
        age = (F.current_timestamp() if now is None else now).cast("double") - F.col("created").cast("double")
        held = held.where(age <= days * 86400)
    newest = held.groupBy("kind", "key").agg(F.max_by("text", F.struct("created", "digest")).alias("text"))
    return asked.select("kind", "key").join(newest, ["kind", "key"], "left")
