"""Queries on spatial relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficloom.operators import spatial
from trafficloom.params import SPATIAL_PREDICATES
from trafficloom.plans.pinning import scratch_path
from trafficloom.workload import tables
from trafficloom.workload.common import joined, r6, registry, rounded

QUERIES, query = registry()
ENDS = ("a_token", "b_token")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.candidate_pairs(tables.observations(spark, sf), tables.SPATIAL.candidate_distance)


def relations(spark: SparkSession, sf: str, obs: DataFrame | None = None) -> DataFrame:
    return spatial.relations(tables.observations(spark, sf) if obs is None else obs, tables.SPATIAL)


@query
def sp_candidate_pairs(spark, sf):
    return _pairs(spark, sf).select("sample_token", *ENDS, r6("center_distance"))


@query
def sp_bev_overlap(spark, sf):
    return rounded(
        spatial.bev_overlap(_pairs(spark, sf)).select(*ENDS, "bev_intersection", "bev_iou", "box_distance"),
        "bev_intersection",
        "bev_iou",
        "box_distance",
    )


@query
def sp_vertical_overlap(spark, sf):
    return rounded(
        spatial.vertical_overlap(_pairs(spark, sf)).select(*ENDS, "vertical_overlap", "a_height", "b_height"),
        "vertical_overlap",
        "a_height",
        "b_height",
    )


@query
def sp_margins(spark, sf):
    return rounded(
        spatial.margins(_pairs(spark, sf), tables.SPATIAL).select(*ENDS, "lateral_margin", "longitudinal_margin"),
        "lateral_margin",
        "longitudinal_margin",
    )


@query
def sp_image_overlap(spark, sf):
    return rounded(spatial.image_overlap(_pairs(spark, sf)).select(*ENDS, "image_overlap"), "image_overlap")


@query
def sp_predicates(spark, sf):
    measured = spatial.measure_pairs(_pairs(spark, sf), tables.SPATIAL)
    return spatial.label_pairs(measured, tables.SPATIAL).select(*ENDS, *SPATIAL_PREDICATES)


MEASURES = (
    "delta_x delta_y delta_z center_distance box_distance bev_intersection bev_iou vertical_overlap image_overlap "
    "lateral_margin longitudinal_margin volume_ratio height_ratio"
).split()


@query
def sp_relations(spark, sf):
    rels = relations(spark, sf)
    return rels.select(
        "token",
        "sample_token",
        "sequence",
        "raw_frame_index",
        "subject_token",
        "object_token",
        "subject_label",
        "object_label",
        *[r6(m) for m in MEASURES],
        "subject_mask_pixels",
        "object_mask_pixels",
        "occlusion_mask_supported",
        joined("predicate_vector"),
        joined("positive_predicates"),
        "no_relation",
        "supervised_eligible",
    )


@query
def sp_canonical_check(spark, sf):
    """Violations per rule, over the relations after forgetting the labels of unsupervised subjects."""
    rels = relations(spark, sf)
    damaged = rels.withColumns(
        {
            "near": F.col("near") & (F.col("subject_label") != "unknown"),
            "left_of": F.col("left_of") | (F.col("subject_label") == F.col("object_label")),
        }
    ).where((F.col("subject_label") != "c3") | (F.col("object_label") != "unknown"))
    return (
        spatial.canonical_violations(damaged)
        .groupBy("error", "predicate")
        .agg(F.count(F.lit(1)).alias("violations"))
    )


@query
def sp_statistics(spark, sf):
    return rounded(spatial.statistics(relations(spark, sf)), "positive_rate_percent")


@query
def sp_parts_summary(spark, sf):
    counters = spatial.part_counters(relations(spark, sf))
    # Expected parts come from the orders: one name is never seen among the relations.
    expected = tables.read(spark, sf, "orders").select((F.col("o_orderkey") % 6).alias("sequence")).distinct()
    versions = relations(spark, sf).select(
        F.when(F.col("sequence") == 2, F.lit("v0")).otherwise(F.lit("v1")).alias("schema_version")
    )
    return spatial.parts_summary(counters, expected, versions=versions.distinct(), wanted_version="v1")


@query
def sp_validate_part(spark, sf):
    """Relations and reports per sequence, damaged so that every rule but those on empty input is broken."""
    frame, sequence = F.col("raw_frame_index"), F.col("sequence")
    whole = relations(spark, sf)
    rels = whole.drop("subject_box").withColumns(
        {
            "filename": F.when(frame % 7 != 0, F.col("filename")),
            "occlusion_mask_supported": F.when(frame % 11 != 3, F.col("occlusion_mask_supported")),
            "positive_predicates": F.when(
                frame % 5 == 1, F.concat("positive_predicates", F.array(F.lit("flying")))
            ).otherwise(F.col("positive_predicates")),
            "predicate_vector": F.when(frame % 5 == 2, F.slice("predicate_vector", 1, 4)).otherwise(F.col("predicate_vector")),
        }
    )
    order = F.array(*[F.lit(p) for p in SPATIAL_PREDICATES])
    reports = whole.groupBy("sequence").agg((F.count(F.lit(1)) - 40).alias("relation_candidates")).select(
        F.when(sequence % 2 == 0, "v2").when(sequence % 3 == 0, "v1").alias("schema_version"),
        (sequence % 3 != 0).alias("passed"),
        "relation_candidates",
        F.when(sequence % 4 == 0, F.reverse(order)).otherwise(order).alias("counted_predicates"),
        F.when(sequence % 5 == 0, F.reverse(order)).otherwise(order).alias("predicate_order"),
        F.when(sequence % 7 != 0, F.lit(True)).alias("canonical_inverse"),
    )
    written = spatial.write_part(rels, scratch_path(spark, "part"))
    return written.unionByName(spatial.validate_reports(reports, "v2"))


@query
def sp_support_flags(spark, sf):
    return spatial.support_flags(spatial.statistics(relations(spark, sf)), rare_below=6000)
