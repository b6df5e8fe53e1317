"""The given tables seen as domain tables (observations, frames, poses, predictions, reviews).

Day = sample, three-hour bucket = frame, user = object; five sequences per 50 users, so that sequences grow with the users and samples do not. Sums are taken over whole
cents, so that no result depends on the order of a floating-point sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trafficloom.functions.numbers import add
from trafficloom.functions.tokens import stable_token
from trafficloom.params import SpatialParams, TemporalParams
from trafficloom.plans.ordered import positions
from trafficloom.plans.pinning import pin

SPATIAL = SpatialParams(candidate_distance=15.0, relation_distance=10.0, near_distance=1.0)
TEMPORAL = TemporalParams(candidate_distance=15.0)
GATE = 15.0
SCENE_FRAMES, MIN_TAIL, STRIDE = 20, 10, 5
FIRST_DAY = "2024-01-01"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their day, hour bucket, microseconds since the first day and k."""
    ts = F.col("ts")
    day = F.datediff(F.to_date(ts), F.lit(FIRST_DAY).cast("date")).cast("long")
    seconds = day * 86400 + F.hour(ts).cast("long") * 3600 + F.minute(ts).cast("long") * 60
    micros = seconds * 1000000 + (F.extract(F.lit("SECOND"), ts) * 1000000).cast("long")
    return read(spark, sf, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        day.alias("day"),
        F.expr("user_id % 5 + 5 * (user_id div 50)").alias("sequence"),
        (day * 8 + F.floor(F.hour(ts) / 3)).cast("long").alias("frame"),
        (micros * 1000).alias("time_ns"),
    )


def _div(column: str, by: int) -> Column:
    return F.expr(f"{column} div {by}")


def sample_token(sequence: Column | str = "sequence", day: Column | str = "raw_frame_index") -> Column:
    return stable_token("sample", sequence, day)


def user_days(spark: SparkSession, sf: str) -> DataFrame:
    """Sums per user and day, which observations, samples and features follow from."""
    return events(spark, sf).groupBy("user_id", "sequence", F.col("day").alias("raw_frame_index")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"), F.sum("k").alias("ks")
    )


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """One row per user and day."""
    return _observed(user_days(spark, sf))


def shared_observations(spark: SparkSession, sf: str) -> DataFrame:
    """`observations` for queries that read them many times: the sums per user and day, which all else follows from, are pinned, so
    that the events are shuffled once."""
    return _observed(pin(user_days(spark, sf)))


def numbered_observations(days: DataFrame) -> DataFrame:
    """Observations of `user_days` with their feature row, 0..n-1 by sequence, scene, sample and instance, and modalities.

    The sums are numbered, not the observations: no token or name is sorted or written for it.
    """
    order = [F.col("sequence"), _scene(), F.col("raw_frame_index") % 10, F.col("user_id")]
    numbered = pin(positions(days, order, "feature_row"))
    return _observed(numbered, "feature_row").withColumn("modality_mask", _modalities())


def _scene() -> Column:
    return F.concat_ws("-", F.lit("scene"), "sequence", _div("raw_frame_index", 10))


def _modalities() -> Column:
    user = F.col("user_id")
    return F.array(user % 9 != 0, F.col("n") >= 2, user % 9 != 0)


def _observed(grouped: DataFrame, *more: str) -> DataFrame:
    """Observations of the sums per user and day; `more` columns are kept."""
    user = F.col("user_id")
    base = grouped.select(
        *more,
        "user_id",
        "sequence",
        "raw_frame_index",
        "n",
        _scene().alias("scene_token"),
        (F.col("raw_frame_index") % 10).alias("sample_index"),
        sample_token().alias("sample_token"),
        F.concat(F.lit("i"), user).alias("instance_token"),
        (F.col("cents") / (F.col("n") * 500.0)).alias("center_x"),
        (F.col("ks") / (F.col("n") * 5.0)).alias("center_y"),
        F.lit(0.0).alias("center_z"),
        (2.0 + user % 3).alias("length"),
        (1.0 + user % 2).alias("width"),
        (1.0 + F.col("n") / 4.0).alias("height"),
        (F.col("raw_frame_index") * 1000000000).alias("timestamp_ns"),
        F.when(user % 7 == 0, F.lit("unknown")).otherwise(F.concat(F.lit("c"), user % 4)).alias("label"),
        (user % 6).alias("semantic_id"),
        _div("user_id", 6).alias("instance_id"),
        (user % 3 == 0).alias("dynamic"),
        (user % 7 != 0).alias("supervised_eligible"),
        (user % 4 != 0).alias("mask_available"),
        (F.col("n") * 10).alias("mask_pixels"),
        F.concat_ws("/", "sequence", F.lit("CAM0"), "raw_frame_index").alias("filename"),
    )
    sides = {}
    for axis, size in (("x", "length"), ("y", "width"), ("z", "height")):
        sides[f"min_{axis}"] = F.col(f"center_{axis}") - F.col(size) / 2.0
        sides[f"max_{axis}"] = F.col(f"center_{axis}") + F.col(size) / 2.0
    boxed = base.withColumns(sides).withColumns(
        {
            "token": stable_token("annotation", "sample_token", "user_id"),
            "volume": F.col("length") * F.col("width") * F.col("height"),
            "depth": F.col("center_x"),
        }
    )
    visible = F.col("user_id") % 9 != 0
    return boxed.withColumns(
        {
            "x1": F.when(visible, 10.0 * F.col("center_x")),
            "y1": F.when(visible, 10.0 * F.col("center_y")),
            "x2": F.when(visible, 10.0 * F.col("center_x") + 20.0 + F.col("user_id") % 15),
            "y2": F.when(visible, 10.0 * F.col("center_y") + 20.0 + F.col("user_id") % 11),
        }
    )


def samples(spark: SparkSession, sf: str, days: DataFrame | None = None) -> DataFrame:
    """One row per sequence and day that has an observation, linked inside its scene; `days` are the `user_days`, if at hand."""
    if days is None:
        days = events(spark, sf).select("sequence", F.col("day").alias("raw_frame_index"))
    days = days.select("sequence", "raw_frame_index").distinct()
    here = days.select(
        "sequence",
        "raw_frame_index",
        _scene().alias("scene_token"),
        (F.col("raw_frame_index") % 10).alias("sample_index"),
        sample_token().alias("token"),
        (F.col("raw_frame_index") * 1000000000).alias("timestamp_ns"),
    )
    # A scene has at most ten samples, so the window is small whatever the number of sequences.
    over = Window.partitionBy("scene_token").orderBy("sample_index")
    return here.withColumns(
        {
            "prev": F.coalesce(F.lag("token").over(over), F.lit("")),
            "next": F.coalesce(F.lead("token").over(over), F.lit("")),
        }
    )


def features(spark: SparkSession, sf: str, obs: DataFrame | None = None) -> DataFrame:
    """Feature rows: observations numbered 0..n-1 by sequence, scene, sample and instance."""
    if obs is None:
        return featured(numbered_observations(user_days(spark, sf)))
    order = [F.col(c) for c in ("sequence", "scene_token", "sample_index", "user_id")]
    return positions(featured(obs.withColumn("modality_mask", _modalities())), order, "feature_row")


def featured(obs: DataFrame) -> DataFrame:
    """Columns of feature rows, with their number where the observations have it."""
    return obs.select(
        *[c for c in ("feature_row",) if c in obs.columns],
        F.col("token").alias("annotation_token"),
        "sequence",
        "scene_token",
        "sample_token",
        "sample_index",
        "raw_frame_index",
        "timestamp_ns",
        F.col("instance_token").alias("identity"),
        "user_id",
        "center_x",
        "center_y",
        "center_z",
        "length",
        "width",
        "height",
        "supervised_eligible",
        "modality_mask",
        (F.col("user_id") % 26).alias("category"),
    )


def predictions(spark: SparkSession, sf: str, shift: float = 0.0) -> DataFrame:
    """Three-label predictions, one row per order."""
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return read(spark, sf, "orders").select(
        key.alias("relation_id"),
        F.col("o_custkey").alias("group_id"),
        (key % 9).alias("sequence"),
        F.array(
            price / 100000.0 - 2.0 + shift, 1.0 - (key % 7) / 3.0 + shift, price / 100000.0 - 1.5 + shift
        ).alias("logits"),
        F.array(
            (F.col("o_orderstatus") == "F").cast("int"),
            (F.col("o_orderstatus") == "O").cast("int"),
            (price > 200000).cast("int"),
        ).alias("targets"),
        (key % 6 != 0).alias("available"),
    )


def frame_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Sensor files in long form: one row per (sequence, frame, channel) with path, size and own time."""
    channel = F.explode(
        F.array_compact(
            F.array(
                F.when(F.col("event_id") % 2 == 0, F.lit("CAM0")).otherwise(F.lit("LIDAR_TOP")),
                F.when(F.col("event_type") == "click", F.lit("CAM1"))
                .when(F.col("event_type") == "view", F.lit("SEMANTIC_CAM0"))
                .when(F.col("event_type") == "error", F.lit("INSTANCE_CAM0")),
            )
        )
    )
    return (
        events(spark, sf)
        .select("sequence", "frame", "time_ns", channel.alias("channel"))
        .groupBy("sequence", "frame", "channel")
        .agg(F.min("time_ns").alias("timestamp_ns"), F.count(F.lit(1)).alias("size"))
        .withColumn("path", F.concat_ws("/", "sequence", "channel", F.lpad(F.col("frame").cast("string"), 10, "0")))
    )


def poses(spark: SparkSession, sf: str) -> DataFrame:
    """First purchase of each (sequence, frame) as a pose: x, y and a yaw from k."""
    first = F.min_by(F.struct("value", "k"), F.col("event_id")).alias("p")
    return (
        events(spark, sf)
        .where(F.col("event_type") == "purchase")
        .groupBy("sequence", "frame")
        .agg(first)
        .select(
            "sequence",
            "frame",
            F.col("p.value").alias("x"),
            F.col("p.k").cast("double").alias("y"),
            F.lit(0.0).alias("z"),
            (F.col("p.k") * F.lit(3.141592653589793) / 101.0).alias("yaw"),
        )
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a LiDAR point of its sequence and day."""
    return events(spark, sf).select(
        sample_token("sequence", "day").alias("sample_token"),
        F.col("event_id").alias("point_id"),
        (F.col("cents") / 500.0).alias("x"),
        (F.col("k") / 5.0).alias("y"),
        (F.col("event_id") % 3).cast("double").alias("z"),
    )


def splits(spark: SparkSession, sf: str) -> DataFrame:
    """Sequence to split: 0 to 2 train, 3 validation, 4 test, for the sequences that occur."""
    name = F.when(F.col("sequence") <= 2, F.lit("train")).when(F.col("sequence") == 3, F.lit("validation"))
    return events(spark, sf).select("sequence").distinct().withColumn("split", name.otherwise(F.lit("test")))


def total(columns: list[str]) -> Column:
    return add([F.col(c) for c in columns])
