"""Resumable ingest of arriving files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trafficloom.plans.lookup import lookup
from trafficloom.plans.pinning import pin

BATCH = "ingest_batch"
LOG = "_commits"


def ingest_incremental(
    spark: SparkSession,
    source: str,
    schema: StructType,
    target: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    source_format: str = "parquet",
) -> None:
    """Take in all files that arrived since the last call, then stop.

    What was read is kept in the streaming checkpoint. Every batch owns the partition of its number and
    replaces it as a whole, so that a batch repeated after a failure leaves no rows twice.
    """

    def commit(rows: DataFrame, number: int) -> None:
        folder = f"{target.rstrip('/')}/{BATCH}={number}"
        transform(rows).write.mode("overwrite").parquet(folder)

    stream = spark.readStream.schema(schema).format(source_format).load(source)
    run = (
        stream.writeStream.foreachBatch(commit)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """All rows taken in so far, with the number of their batch."""
    return spark.read.option("basePath", target).parquet(target)


def _log(spark: SparkSession, target: str) -> DataFrame:
    """(number, key, last_frame, rows) of all batches that are committed; a batch without rows has one row without key."""
    schema = "number long, key string, last_frame long, rows long"
    try:
        return spark.read.schema(schema).parquet(f"{target.rstrip('/')}/{LOG}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def ingest_frames(
    spark: SparkSession,
    source: str,
    schema: StructType,
    target: str,
    checkpoint: str,
    key: str = "sequence",
    frame: str = "frame",
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    source_format: str = "parquet",
) -> None:
    """Take in what arrived of each `key` beyond its last committed `frame`, then stop.

    Frames up to the last one committed are skipped, whether they come again or late; all rows of a new frame are taken, and
    rows without frame are not. A batch counts once its entry stands in the commit log, which is written last, as one file.
    The log is the state: it holds the last frame of every key and batch, so a batch that failed half-way leaves neither
    rows nor state behind, and is written anew. Readers follow the log (`committed`).
    """
    place = target.rstrip("/")

    def commit(rows: DataFrame, number: int) -> None:
        log = pin(_log(spark, target))
        if not log.where(F.col("number") == number).isEmpty():
            return
        last = log.where("key IS NOT NULL").groupBy("key").agg(F.max("last_frame").alias("_last"))
        keyed = rows.where(F.col(frame).isNotNull()).withColumn("_key", F.coalesce(F.col(key).cast("string"), F.lit("")))
        sizes = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
        known = pin(sizes.join(last.withColumnRenamed("key", "_key"), "_key"))
        told = lookup(keyed, known, "_key", "_n", frame, how="left")
        fresh = told.where(F.col("_last").isNull() | (F.col(frame) > F.col("_last"))).drop("_last", "_n")
        folder = f"{place}/{BATCH}={number}"
        transform(fresh.drop("_key")).write.mode("overwrite").parquet(folder)
        entries = fresh.groupBy(F.col("_key").alias("key")).agg(
            F.max(F.col(frame).cast("long")).alias("last_frame"), F.count(F.lit(1)).alias("rows")
        )
        nothing = spark.range(1).select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("last_frame"), F.lit(0).cast("long").alias("rows"))
        entry = entries.unionByName(nothing).select(F.lit(number).cast("long").alias("number"), "key", "last_frame", "rows")
        entry.coalesce(1).write.mode("overwrite").parquet(f"{place}/{LOG}/batch={number}")

    stream = spark.readStream.schema(schema).format(source_format).load(source)
    stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def committed(spark: SparkSession, target: str) -> DataFrame:
    """Rows of the committed batches, with the number of their batch; what a failed batch left is not seen.

    Batches are committed in order, so the last number bounds the folders that are read.
    """
    last = _log(spark, target).agg(F.max("number")).first()[0]
    return ingested(spark, target).where(F.col(BATCH) <= F.lit(-1 if last is None else last))


def pending(listed: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """Listed inputs whose result does not exist yet."""
    return listed.join(done.select(F.col(key)).distinct(), key, "left_anti")
