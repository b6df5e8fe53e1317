"""Queries on tracklet windows and temporal relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficloom.operators import tracklets
from trafficloom.workload import tables
from trafficloom.workload.common import joined, r6, registry, rounded

QUERIES, query = registry()
ENDS = ("a_token", "b_token")


def windows(spark: SparkSession, sf: str, obs: DataFrame | None = None) -> DataFrame:
    return tracklets.windows(tables.observations(spark, sf) if obs is None else obs, tables.samples(spark, sf))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return tracklets.candidate_pairs(windows(spark, sf), tables.TEMPORAL)


def relations(spark: SparkSession, sf: str, rules: str = "directed", obs: DataFrame | None = None) -> DataFrame:
    return tracklets.relations(windows(spark, sf, obs), tables.TEMPORAL, rules)


@query
def tp_tracklet_windows(spark, sf):
    return windows(spark, sf).select(
        "token",
        "scene_token",
        "sequence",
        "instance_token",
        "label",
        "dynamic",
        "start_sample_index",
        "middle_sample_index",
        "end_sample_index",
        joined("annotation_tokens"),
        joined("raw_frame_indices"),
        joined("timestamps_ns"),
        r6("duration_seconds"),
        r6("velocity_x"),
        r6("velocity_y"),
        r6("velocity_z"),
        r6("speed"),
    )


@query
def tp_candidate_pairs(spark, sf):
    return _pairs(spark, sf).select("scene_token", "start_sample_index", *ENDS, r6("middle_distance"))


@query
def tp_distance_trend(spark, sf):
    trend = tracklets.distance_trend(_pairs(spark, sf), tables.TEMPORAL)
    return trend.select(
        *ENDS,
        *[r6(F.get("relative_distances", F.lit(i)), f"distance_{i}") for i in range(5)],
        r6("distance_change"),
        r6("decreasing_fraction"),
        r6("increasing_fraction"),
    )


@query
def tp_radial_speed(spark, sf):
    return tracklets.radial_speed(_pairs(spark, sf)).select(
        *ENDS, r6("subject_radial_speed"), r6("object_radial_speed")
    )


@query
def tp_direction_cosine(spark, sf):
    return tracklets.direction_cosine(_pairs(spark, sf), tables.TEMPORAL).select(*ENDS, r6("direction_cosine"))


@query
def tp_path_distance(spark, sf):
    return tracklets.path_distance(_pairs(spark, sf), tables.TEMPORAL).select(*ENDS, r6("path_distance"))


@query
def tp_visibility(spark, sf):
    return tracklets.visibility(_pairs(spark, sf)).select(
        *ENDS, "subject_visible_steps", "object_visible_steps", "joint_visible_steps"
    )


@query
def tp_review_eligibility(spark, sf):
    return tracklets.review_eligibility(tracklets.visibility(_pairs(spark, sf)), tables.TEMPORAL).select(
        *ENDS, "review_eligible", "review_reason"
    )


def _labels(spark: SparkSession, sf: str, rules: str) -> DataFrame:
    measured = tracklets.measure_pairs(_pairs(spark, sf), tables.TEMPORAL)
    return tracklets.label_pairs(measured, tables.TEMPORAL, rules).select(*ENDS, *tracklets.ALL_TEMPORAL)


@query
def tp_predicates(spark, sf):
    return _labels(spark, sf, "directed")


@query
def tp_predicates_legacy(spark, sf):
    return _labels(spark, sf, "pairwise")


@query
def tp_relations(spark, sf):
    numbers = (
        "subject_speed object_speed subject_velocity_x subject_velocity_y object_velocity_x object_velocity_y "
        "subject_radial_speed object_radial_speed distance_change decreasing_fraction increasing_fraction "
        "direction_cosine path_distance middle_distance"
    ).split()
    plain = (
        "token scene_token sequence start_sample_index middle_sample_index middle_raw_frame_index subject_tracklet "
        "object_tracklet subject_label object_label subject_motion_toward_object subject_motion_away_from_object "
        "pair_distance_decreasing pair_distance_increasing approaching_agreement moving_away_agreement "
        "joint_visible_steps review_reason no_relation supervised_eligible"
    ).split()
    rels = rounded(relations(spark, sf), *numbers)
    return rels.select(*plain, *numbers, joined("raw_frame_indices"), joined("positive_predicates"))


@query
def tp_symmetry_check(spark, sf):
    """Violations per kind, over relations whose subject label is forgotten for one class."""
    rels = relations(spark, sf)
    damaged = rels.withColumn(
        "same_motion_direction", F.col("same_motion_direction") & (F.col("subject_label") != "c2")
    ).where((F.col("subject_label") != "c1") | (F.col("object_label") != "unknown"))
    return tracklets.symmetry_violations(damaged).groupBy("error").agg(F.count(F.lit(1)).alias("violations"))


@query
def tp_statistics(spark, sf):
    tracks = windows(spark, sf)
    return tracklets.statistics(tracks, tracklets.relations(tracks, tables.TEMPORAL))
