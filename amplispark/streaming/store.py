"""The keyed genome store and its incremental collection (SRC-14, SRC-15, SNK-07, ST-01 .. ST-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from amplispark.operators.assess import newest_first

#: ST-03: how often a genome may fail before it counts as unavailable.
FAILURES = 2


def store_key(*parts: Column) -> Column:
    """LC-14, SRC-14: one key for what a stored row depends on."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def current(store: DataFrame) -> DataFrame:
    """SRC-15, ST-01: the last row of each (key, accession), by sequence number."""
    order = Window.partitionBy("key", "accession").orderBy(F.desc("seq_no"))
    return store.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def with_failures(store: DataFrame) -> DataFrame:
    """ST-03: per (key, accession) done, failed or unavailable; a success clears the failures before it."""
    last_ok = store.groupBy("key", "accession").agg(F.max(F.when(F.col("ok"), F.col("seq_no"))).alias("ok_at"))
    j = store.join(last_ok, ["key", "accession"])
    failed = F.count(F.when(~F.col("ok") & (F.col("ok_at").isNull() | (F.col("seq_no") > F.col("ok_at"))), 1))
    per = j.groupBy("key", "accession", "ok_at").agg(failed.alias("failures"))
    state = F.when(F.col("failures") >= FAILURES, F.lit("unavailable")).when(F.col("failures") > 0, F.lit("failed")).otherwise(F.lit("done"))
    return per.select("key", "accession", state.alias("state"), "failures")


def with_dates(store: DataFrame, dates: DataFrame) -> DataFrame:
    """ST-04: collection dates that were read after the genome was stored."""
    late = dates.groupBy("accession").agg(F.max_by("collected", "seq_no").alias("_late"))
    return store.join(late, "accession", "left").withColumn("collected", F.coalesce("_late", "collected")).drop("_late")


def listen(source: DataFrame, listing: str, checkpoint: str) -> StreamingQuery:
    """ST-01: appends what a stream lists to the table at ``listing``; whatever the budget of a run, nothing listed is lost.

    A batch has a folder of its own, so one that is run again replaces its rows.
    """

    def append(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["key", "accession"]).write.mode("overwrite").parquet(f"{listing}/batch={number}")

    return source.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def missing(spark: SparkSession, listing: str, path: str) -> DataFrame | None:
    """ST-01: the listed genomes that the store at ``path`` lacks, each once; None where nothing was listed yet."""
    listed, done = _stored(spark, listing), _stored(spark, path)
    if listed is None:
        return None
    rows = listed.drop("batch").dropDuplicates(["key", "accession"])
    return rows if done is None else rows.join(done.select("key", "accession"), ["key", "accession"], "left_anti")


def collect(source: DataFrame, path: str, checkpoint: str, budget: int | None = None) -> None:
    """ST-01, ST-02, SNK-07: one run: takes in what the stream lists, then appends to the store at ``path`` what it lacks, at most ``budget`` genomes, newest first.

    The listing is kept beside the checkpoint, so the next run goes on with what
    this one left, also if nothing new is listed. A run that was cut short left
    either all of its genomes in the store or none.
    """
    listing = f"{checkpoint.rstrip('/')}-listing"
    listen(source, listing, checkpoint).awaitTermination()
    spark = source.sparkSession
    fresh = missing(spark, listing, path)
    if fresh is not None:
        fresh = fresh if budget is None else newest_first(fresh, "release_date", budget)
        fresh.write.mode("append").parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The store so far, or None before its first batch."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(at) else None
