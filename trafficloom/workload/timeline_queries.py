"""Queries on frames, scenes, samples and poses."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficloom.functions import rigid
from trafficloom.operators import timeline
from trafficloom.plans.pinning import pin
from trafficloom.workload import tables
from trafficloom.workload.common import r6, registry, rounded

QUERIES, query = registry()
CUT = dict(scene_frames=tables.SCENE_FRAMES, min_tail_frames=tables.MIN_TAIL)

_C, _S = math.cos(math.pi / 4), math.sin(math.pi / 4)
# A LiDAR turned by 45 degrees against the camera and shifted by (0.5, -0.25, 1.5).
VELO_FROM_CAMERA = (_C, -_S, 0.0, 0.5, _S, _C, 0.0, -0.25, 0.0, 0.0, 1.0, 1.5, 0.0, 0.0, 0.0, 1.0)


def _turned(yaw, x, y, z):
    return rigid.matrix(
        [[F.cos(yaw), -F.sin(yaw), 0.0, x], [F.sin(yaw), F.cos(yaw), 0.0, y], [0.0, 0.0, 1.0, z], [0.0, 0.0, 0.0, 1.0]]
    )


def poses(spark: SparkSession, sf: str) -> DataFrame:
    return tables.poses(spark, sf).select(
        "sequence", "frame", _turned(F.col("yaw"), F.col("x"), F.col("y"), F.col("z")).alias("matrix")
    )


def channels(spark: SparkSession, sf: str) -> DataFrame:
    return tables.frame_channels(spark, sf)


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.sync_frames(channels(spark, sf))


def narrow(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).select("sequence", "frame", "timestamp_ns")


def clip_frames(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.clip_frames(narrow(spark, sf), **CUT)


def expected(spark: SparkSession, sf: str) -> DataFrame:
    """Sequence names as the orders know them: one more than the events have."""
    return tables.read(spark, sf, "orders").select((F.col("o_orderkey") % 6).alias("sequence")).distinct()


@query
def tl_complete_sequences(spark, sf):
    files = channels(spark, sf)
    rgb, lidar = files.where("channel = 'CAM0'"), files.where("channel = 'LIDAR_TOP'")
    return timeline.complete_sequences(rgb, lidar, poses(spark, sf))


@query
def tl_sync_frames(spark, sf):
    return frames(spark, sf).select("sequence", "frame", "timestamp_ns")


def _subsets(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "train").when(F.col("event_type") == "signup", "val")
    return tables.events(spark, sf).select("sequence", "frame", kind.alias("subset")).where("subset IS NOT NULL")


@query
def tl_manifest(spark, sf):
    return timeline.manifest(channels(spark, sf), poses(spark, sf), _subsets(spark, sf))


@query
def tl_manifest_summary(spark, sf):
    return timeline.manifest_summary(channels(spark, sf))


@query
def tl_contiguous_runs(spark, sf):
    return timeline.contiguous_runs(narrow(spark, sf), ["sequence"], "frame")


@query
def tl_scene_clips(spark, sf):
    return rounded(timeline.scene_clips(narrow(spark, sf), sample_stride=tables.STRIDE, **CUT), "duration_sec")


@query
def tl_rejected_segments(spark, sf):
    return timeline.rejected_segments(narrow(spark, sf), expected(spark, sf), max_scenes_per_log=3, **CUT)


@query
def tl_keyframes(spark, sf):
    return timeline.keyframes(clip_frames(spark, sf), tables.STRIDE)


@query
def tl_frame_to_sample(spark, sf):
    return timeline.frame_to_sample(clip_frames(spark, sf), tables.STRIDE)


@query
def tl_sample_data(spark, sf):
    raw = timeline.frame_to_sample(clip_frames(spark, sf), tables.STRIDE)
    return timeline.sample_data(raw, channels(spark, sf))


@query
def tl_nominal_fps(spark, sf):
    return rounded(timeline.nominal_fps(narrow(spark, sf)), "nominal_fps")


@query
def tl_pose_asof(spark, sf):
    return timeline.pose_asof(narrow(spark, sf), poses(spark, sf)).drop("left_matrix", "right_matrix")


def _interpolated(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.interpolate_pose(timeline.pose_asof(narrow(spark, sf), poses(spark, sf)))


@query
def tl_pose_interpolate(spark, sf):
    m = F.col("matrix")
    return _interpolated(spark, sf).select(
        "sequence",
        "frame",
        "pose_source",
        *[r6(rigid.at(m, i, 3), n) for i, n in enumerate(("x", "y", "z"))],
        r6(rigid.at(m, 0, 0), "cos_yaw"),
        r6(rigid.at(m, 1, 0), "sin_yaw"),
    )


@query
def tl_ego_pose(spark, sf):
    posed = timeline.ego_pose(_interpolated(spark, sf), VELO_FROM_CAMERA)
    q = F.col("rotation_xyzw")
    return posed.select(
        "token",
        "sequence",
        "frame",
        r6("x"),
        r6("y"),
        r6("z"),
        *[r6(F.get(q, F.lit(i)), n) for i, n in enumerate(("qx", "qy", "qz", "qw"))],
        "pose_source",
        "span_frames",
    )


@query
def tl_pose_counts(spark, sf):
    return timeline.pose_counts(timeline.pose_asof(narrow(spark, sf), poses(spark, sf)))


@query
def tl_sensor_table(spark, sf):
    """Every user drives a rig whose calibration follows from the user's own sums."""
    per = tables.events(spark, sf).groupBy(F.col("user_id").alias("rig")).agg(
        F.sum("cents").alias("c"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("n")
    )
    yaw, zero = F.col("k") / (F.col("n") * 40.0), F.lit(0.0)
    shift = F.col("c") / (F.col("n") * 10000.0)
    numbers = F.array(shift, yaw, zero)
    rigs = per.select(
        "rig",
        _turned(yaw, shift, zero, F.lit(1.0)).alias("velo_from_cam0"),
        _turned(zero, zero, shift, zero).alias("pose_from_cam0"),
        _turned(zero, F.lit(0.6), shift, zero).alias("pose_from_cam1"),
        _turned(yaw / 10.0, zero, zero, zero).alias("rect0"),
        _turned(-yaw / 10.0, zero, zero, zero).alias("rect1"),
        *[numbers.alias(f"{c}{i}") for c in "kpd" for i in (0, 1)],
        *[F.array(F.lit(1408), F.lit(376)).alias(f"size{i}") for i in (0, 1)],
    )
    t, back = F.col("ego_from_sensor"), F.col("sensor_from_ego")
    return timeline.sensor_table(rigs).select(
        "token",
        "rig",
        "channel",
        "modality",
        "width",
        "height",
        *[r6(rigid.at(t, i, 3), f"t{i}") for i in range(3)],
        r6(rigid.at(t, 0, 0), "cos_yaw"),
        r6(rigid.at(t, 1, 0), "sin_yaw"),
        r6(rigid.at(back, 0, 3), "back_x"),
        r6(F.get(F.col("intrinsic"), F.lit(0)), "focal"),
    )


@query
def tl_log_summary(spark, sf):
    scenes = timeline.scene_clips(narrow(spark, sf), sample_stride=tables.STRIDE, **CUT)
    return timeline.log_summary(narrow(spark, sf), scenes)


@query
def tl_manifest_hash(spark, sf):
    accepted = clip_frames(spark, sf).select("sequence", "frame")
    return timeline.manifest_hash(channels(spark, sf).join(accepted, ["sequence", "frame"]))


@query
def tl_validate(spark, sf):
    """Rules over timeline tables that lost the second clip of every sequence and one sample of every clip."""
    scenes = pin(timeline.scene_clips(narrow(spark, sf), sample_stride=tables.STRIDE, **CUT))
    clips = pin(clip_frames(spark, sf))
    samples = timeline.keyframes(clips, tables.STRIDE)
    raw = timeline.frame_to_sample(clips, tables.STRIDE)
    given = {
        "scenes": scenes.where("clip_index <> 1"),
        "samples": samples.where("sample_index <> 1"),
        "raw_frames": raw,
        "sample_data": pin(timeline.sample_data(raw, channels(spark, sf))),
    }
    keys = [
        ("samples", "scene_token", "scenes"),
        ("raw_frames", "scene_token", "scenes"),
        ("raw_frames", "sample_token", "samples"),
        ("sample_data", "sample_token", "samples"),
        ("sample_data", "raw_frame_token", "raw_frames"),
        ("sample_data", "prev", "sample_data"),
        ("sample_data", "next", "sample_data"),
    ]
    return timeline.validate(given, keys, tables.SCENE_FRAMES, tables.STRIDE)


@query
def tl_parts_report(spark, sf):
    reports = (
        tables.observations(spark, sf)
        .groupBy("sequence")
        .agg(
            F.count(F.lit(1)).alias("observations"),
            F.countDistinct("sample_token").alias("samples"),
            F.countDistinct("instance_token").alias("instances"),
        )
        .withColumn("passed", F.col("sequence") != 3)
    )
    return timeline.parts_report(reports, expected(spark, sf), ["observations", "samples", "instances"])


@query
def tl_budget_prefix(spark, sf):
    """As many whole sequences as it takes to cover one byte per event."""
    files = channels(spark, sf)
    priority = files.select("sequence", F.expr("(sequence * 3) % 5").alias("priority")).distinct()
    minimum = tables.read(spark, sf, "events").count()
    chosen = timeline.budget_prefix(files, priority, minimum)
    boxes = tables.events(spark, sf).where("event_type = 'signup'").select(
        "sequence", "frame", (F.col("user_id") % 3 == 0).alias("dynamic")
    )
    return timeline.selection_statistics(chosen, frames(spark, sf), boxes)


@query
def tl_split_assign(spark, sf):
    known = tables.splits(spark, sf).where("split <> 'validation'")
    return timeline.split_assign(narrow(spark, sf), known)
