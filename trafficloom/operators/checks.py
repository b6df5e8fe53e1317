"""Expressions that turn a broken promise of the input into an error of the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def required(value: Column, sound: Column, message: str) -> Column:
    """The value where `sound` holds; the job fails with the message elsewhere."""
    return F.when(F.coalesce(sound, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def resolve_samples(obs: DataFrame, samples: DataFrame) -> DataFrame:
    """Observations with sample index and time taken from the timeline; each must find a sample of its scene."""
    known = samples.select(
        F.col("token").alias("sample_token"),
        F.col("scene_token").alias("_scene"),
        F.col("sample_index").alias("_index"),
        F.col("timestamp_ns").alias("_time"),
    )
    scene = required(
        F.col("scene_token"),
        F.col("_scene") == F.col("scene_token"),
        "an observation does not resolve to a sample of its scene",
    )
    return (
        obs.join(known, "sample_token", "left")
        .withColumns({"scene_token": scene, "sample_index": F.col("_index"), "timestamp_ns": F.col("_time")})
        .drop("_scene", "_index", "_time")
    )


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
