"""Queries on object observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficloom.functions import rigid
from trafficloom.operators import observations as ob
from trafficloom.params import CHANNELS
from trafficloom.plans.pinning import pin
from trafficloom.workload import tables, timeline_queries
from trafficloom.workload.common import r6, registry, rounded

QUERIES, query = registry()


def observed(spark: SparkSession, sf: str) -> DataFrame:
    return tables.observations(spark, sf).withColumn("combined_id", ob.combined_id())


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a mask pixel carrying the id of its user."""
    user = F.col("user_id")
    return tables.events(spark, sf).select(
        tables.sample_token("sequence", "day").alias("sample_token"),
        (user % 6 * 1000 + F.expr("user_id div 6")).alias("value"),
        F.expr("cents div 50").alias("px"),
        (F.col("k") * 2).alias("py"),
    )


def usable(spark: SparkSession, sf: str) -> DataFrame:
    obs = observed(spark, sf).drop("mask_pixels")
    points = ob.points_in_box(tables.points(spark, sf), obs)
    masks = ob.mask_histogram(pixels(spark, sf), obs)
    return ob.usability(obs.join(points, "token").join(masks, "token"), 25, 2, 2)


@query
def ob_uniform_subset(spark, sf):
    days = tables.samples(spark, sf).select("sequence", "raw_frame_index")
    return ob.uniform_subset(days, ["sequence"], "raw_frame_index", 12)


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Static users stand from their first to their last day, dynamic ones appear day by day."""
    user = F.col("user_id")
    days = tables.observations(spark, sf).select("sequence", "user_id", "raw_frame_index", "dynamic")
    spans = days.groupBy("sequence", "user_id").agg(
        F.min("raw_frame_index").alias("start_frame"), F.max("raw_frame_index").alias("end_frame")
    )
    joined = days.join(spans, ["sequence", "user_id"]).where(
        F.col("dynamic") | (F.col("raw_frame_index") == F.col("start_frame"))
    )
    return joined.select(
        "sequence",
        (user * 100 + F.col("raw_frame_index")).alias("document_order"),
        (user % 2).alias("semantic_id"),
        F.expr("user_id div 20").alias("instance_id"),
        "dynamic",
        F.col("raw_frame_index").alias("timestamp"),
        "start_frame",
        "end_frame",
    )


@query
def ob_active_boxes(spark, sf):
    frames = tables.samples(spark, sf).select("sequence", F.col("raw_frame_index").alias("frame"))
    return ob.active_boxes(frames, _boxes(spark, sf))


def _transformed(spark: SparkSession, sf: str) -> DataFrame:
    obs = tables.observations(spark, sf).select(
        "token", "user_id", "raw_frame_index", *[F.col(c).alias(f"given_{c}") for c in ("length", "width", "height", "center_x", "center_y")]
    )
    yaw = (F.col("user_id") % 8) * 0.39269908169872414
    size = F.when(F.col("user_id") % 9 == 0, 0.0).otherwise(1.0)
    c, s = F.cos(yaw), F.sin(yaw)
    g = {n: F.col(f"given_{n}") for n in ("length", "width", "height", "center_x", "center_y")}
    transform = rigid.matrix(
        [
            [size * c * g["length"], -s * g["width"], 0.0, g["center_x"]],
            [size * s * g["length"], c * g["width"], 0.0, g["center_y"]],
            [0.0, 0.0, g["height"], 0.0],
            [0.0, 0.0, 0.0, 1.0],
        ]
    )
    turn = F.col("raw_frame_index") * 0.1
    day = F.col("raw_frame_index").cast("double")
    pose = rigid.matrix(
        [[F.cos(turn), -F.sin(turn), 0.0, day], [F.sin(turn), F.cos(turn), 0.0, day * 2.0], [0.0, 0.0, 1.0, 0.5], [0.0, 0.0, 0.0, 1.0]]
    )
    half = [(x, y, z) for x in (-0.5, 0.5) for y in (-0.5, 0.5) for z in (-0.5, 0.5)]
    vertices = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for x, y, z in half])
    return ob.transform_corners(
        obs.select("token", transform.alias("transform"), vertices.alias("vertices"), pose.alias("world_from_ego"))
    )


@query
def ob_transform_corners(spark, sf):
    bounds = [f"{m}_{a}" for a in "xyz" for m in ("min", "max", "center")]
    return _transformed(spark, sf).select(
        "token", *[r6(b) for b in bounds], r6("length"), r6("width"), r6("volume"), F.size("hull").alias("hull_corners")
    )


@query
def ob_corner_failures(spark, sf):
    return ob.corner_failures(_transformed(spark, sf))


@query
def ob_project_box(spark, sf):
    """Boxes seen by a camera that stands among them and looks along x."""
    corner = [
        F.struct(F.col(f"{x}_x").alias("x"), F.col(f"{y}_y").alias("y"), F.col(f"{z}_z").alias("z"))
        for x in ("min", "max")
        for y in ("min", "max")
        for z in ("min", "max")
    ]
    camera = rigid.matrix([[0.0, 0.0, 1.0, 30.0], [-1.0, 0.0, 0.0, 10.0], [0.0, -1.0, 0.0, 1.0], [0.0, 0.0, 0.0, 1.0]])
    level = rigid.matrix([[1.0 if i == j else 0.0 for j in range(4)] for i in range(4)])
    lens = F.array(*[F.lit(v) for v in (500.0, 0.0, 320.0, 0.0, 0.0, 500.0, 120.0, 0.0, 0.0, 0.0, 1.0, 0.0)])
    boxes = tables.observations(spark, sf).select(
        "token",
        F.array(*corner).alias("corners_world"),
        camera.alias("world_from_camera"),
        level.alias("rectification"),
        lens.alias("projection"),
    )
    seen = ob.project_box(boxes, 640, 240)
    return seen.select("token", *[r6(c) for c in ("x1", "y1", "x2", "y2", "image_area", "depth")])


@query
def ob_points_in_box(spark, sf):
    return ob.points_in_box(tables.points(spark, sf), tables.observations(spark, sf))


@query
def ob_object_points(spark, sf):
    hits = ob.object_points(tables.points(spark, sf), tables.observations(spark, sf))
    return rounded(hits, "x", "y", "z")


@query
def ob_mask_histogram(spark, sf):
    return ob.mask_histogram(pixels(spark, sf), observed(spark, sf))


@query
def ob_usability(spark, sf):
    return usable(spark, sf).select("token", "lidar_points", "mask_pixels", "rgb_usable", "lidar_usable")


@query
def ob_usability_counts(spark, sf):
    return ob.usability_counts(usable(spark, sf))


def _annotations(spark: SparkSession, sf: str) -> DataFrame:
    posed = tables.events(spark, sf).where("event_type = 'purchase'").select(
        tables.sample_token("sequence", "day").alias("sample_token")
    )
    return ob.annotations(usable(spark, sf), posed)


@query
def ob_annotations(spark, sf):
    return _annotations(spark, sf).select(
        "token",
        "sample_token",
        "instance_token",
        "label",
        r6("center_x"),
        r6("center_y"),
        r6("length"),
        r6("volume"),
        F.get("modality_mask", F.lit(0)).alias("rgb"),
        F.get("modality_mask", F.lit(1)).alias("lidar"),
        "lidar_points",
        "mask_pixels",
        "supervised_eligible",
    )


@query
def ob_keyframe_files(spark, sf):
    return ob.keyframe_files(timeline_queries.QUERIES["tl_sample_data"](spark, sf), CHANNELS)


@query
def ob_categories(spark, sf):
    return ob.categories(_annotations(spark, sf))


@query
def ob_instances(spark, sf):
    return ob.instances(_annotations(spark, sf))


def _cropped(spark: SparkSession, sf: str) -> DataFrame:
    return ob.crop_window(observed(spark, sf), 600, 150)


@query
def ob_crop_window(spark, sf):
    return _cropped(spark, sf).select("token", "crop_x1", "crop_y1", "crop_x2", "crop_y2")


@query
def ob_crop_source(spark, sf):
    return ob.crop_source(_cropped(spark, sf), pixels(spark, sf)).select("token", "crop_source")


def _sampled(spark: SparkSession, sf: str) -> DataFrame:
    hits = ob.object_points(tables.points(spark, sf), tables.observations(spark, sf))
    return ob.fixed_sample(hits, count=4, minimum=2)


@query
def ob_fixed_sample(spark, sf):
    return rounded(_sampled(spark, sf), "x", "y", "z")


@query
def ob_normals(spark, sf):
    """Normals of planes through three points: products of their components, which have no sign, where the plane is determined."""
    sampled = pin(_sampled(spark, sf))
    found = ob.normals(sampled, neighbours=3).join(sampled.select("token", "position", "x", "y", "z"), ["token", "position"])
    known = F.col("breadth") > 1e-9
    products = [
        r6(F.when(known, F.col(f"n{a}") * F.col(f"n{b}")), f"n{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")
    ]
    outward = sum((F.col(f"n{a}") * F.col(a) for a in "xyz"), F.lit(0.0)) >= -1e-9
    return found.select("token", "position", *products, outward.alias("outward"))
