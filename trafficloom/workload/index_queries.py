"""Queries on feature rows joined to relations and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficloom.operators import relation_index as ri
from trafficloom.params import SPATIAL_PREDICATES, TEMPORAL_PREDICATES
from trafficloom.plans.pinning import pin, scratch_path
from trafficloom.sources import writers
from trafficloom.workload import association_queries, spatial_queries, tables, tracklet_queries
from trafficloom.workload.common import joined, registry, rounded

QUERIES, query = registry()
CLASSES = range(26)


def features(spark: SparkSession, sf: str) -> DataFrame:
    return tables.features(spark, sf)


def known_features(spark: SparkSession, sf: str) -> DataFrame:
    """Feature rows of objects with a known label only: relations of the others have no features."""
    return features(spark, sf).where("supervised_eligible")


def tracklet_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ri.tracklet_rows(tracklet_queries.windows(spark, sf), known_features(spark, sf))


def temporal_index(spark: SparkSession, sf: str) -> DataFrame:
    return ri.temporal_index(tracklet_queries.relations(spark, sf), tracklet_rows(spark, sf))


@query
def ri_complete_rows(spark, sf):
    return ri.complete_rows(features(spark, sf)).select("feature_row", "annotation_token", "category")


@query
def ri_feature_timeline(spark, sf):
    return ri.feature_timeline(features(spark, sf), tables.samples(spark, sf)).select(
        "feature_row", "sample_token", "sample_index", "timestamp_ns"
    )


@query
def ri_modality_counts(spark, sf):
    return ri.modality_counts(features(spark, sf))


@query
def src_jsonl_metadata(spark, sf):
    """Row checks over metadata from which one class of objects is gone."""
    return ri.metadata_checks(features(spark, sf).where("category <> 3"))


def stored(df: DataFrame, name: str, key: str) -> DataFrame:
    """The rows as a table in buckets of `key`, as many as a shuffle would have partitions."""
    spark = df.sparkSession
    return writers.write_bucketed(df, scratch_path(spark, "index"), name, key, int(spark.conf.get("spark.sql.shuffle.partitions")))


@query
def ri_spatial(spark, sf):
    """Relations stored by subject and feature rows stored by token: only the relations are shuffled once, for their objects."""
    rels = spatial_queries.relations(spark, sf).select(
        "token", "subject_token", "object_token", *SPATIAL_PREDICATES, "raw_frame_index", "sample_token"
    )
    rows = known_features(spark, sf).select("annotation_token", "feature_row", "modality_mask")
    kept = ri.spatial_index(stored(rels, "relations", "subject_token"), stored(rows, "features", "annotation_token"))
    return kept.select("token", "source_row", "target_row", *SPATIAL_PREDICATES, "raw_frame_index", "sample_token")


@query
def ri_spatial_counts(spark, sf):
    return ri.spatial_counts(spatial_queries.relations(spark, sf), known_features(spark, sf))


@query
def ri_spatial_geometry(spark, sf):
    rels = ri.spatial_geometry(spatial_queries.relations(spark, sf))
    parts = [
        (F.round(F.get("geometry", F.lit(i)).cast("double"), 4) + 0.0).alias(n) for i, n in enumerate(ri.SPATIAL_GEOMETRY)
    ]
    return rels.select("token", *parts)


@query
def ri_tracklet_rows(spark, sf):
    return tracklet_rows(spark, sf).select("tracklet", joined("rows"), joined("complete"))


@query
def ri_joint_mask(spark, sf):
    ends = ri.temporal_ends(tracklet_queries.relations(spark, sf), tracklet_rows(spark, sf))
    return ends.select("token", joined("joint_mask"), "state")


@query
def ri_temporal(spark, sf):
    """Relations stored by subject and window rows stored by window, joined like the spatial ones."""
    rels = tracklet_queries.relations(spark, sf).select(
        "token", "subject_tracklet", "object_tracklet", "scene_token", "start_sample_index", *TEMPORAL_PREDICATES
    )
    kept = ri.temporal_index(
        stored(rels, "relations", "subject_tracklet"), stored(tracklet_rows(spark, sf), "tracklets", "tracklet")
    )
    return kept.select(
        "token", "group_id", joined("source_rows"), joined("target_rows"), joined("source_mask"), *TEMPORAL_PREDICATES
    )


@query
def ri_temporal_counts(spark, sf):
    return ri.temporal_counts(tracklet_queries.relations(spark, sf), tracklet_rows(spark, sf))


@query
def ri_temporal_geometry(spark, sf):
    rels = ri.temporal_geometry(tracklet_queries.relations(spark, sf))
    parts = [
        (F.round(F.get("geometry", F.lit(i)).cast("double"), 4) + 0.0).alias(f"g{i:02d}") for i in range(24)
    ]
    return rels.select("token", *parts)


@query
def ri_exploratory_count(spark, sf):
    ends = ri.temporal_ends(tracklet_queries.relations(spark, sf), tracklet_rows(spark, sf))
    return ends.groupBy("sequence").agg(ri.exploratory_count().alias("exploratory_ignored"))


def association_ends(spark: SparkSession, sf: str) -> DataFrame:
    return ri.association_ends(association_queries.candidates(spark, sf), features(spark, sf))


@query
def ri_association_groups(spark, sf):
    return association_ends(spark, sf)


@query
def ri_association_counts(spark, sf):
    return ri.association_counts(association_queries.candidates(spark, sf), features(spark, sf))


@query
def ri_association_geometry(spark, sf):
    candidates, rows = association_queries.candidates(spark, sf), pin(features(spark, sf))
    pairs = ri.association_pairs(candidates, ri.association_ends(candidates, rows), rows)
    measured = ri.association_geometry(pairs)
    parts = [
        (F.round(F.get("geometry", F.lit(i)).cast("double"), 4) + 0.0).alias(f"g{i:02d}") for i in range(16)
    ]
    return measured.select("source_row", "target_row", "source_index", "target_index", *parts)


@query
def ri_class_weights(spark, sf):
    return rounded(ri.class_weights(features(spark, sf), complete_only=True), "weight")


@query
def ri_pos_weights(spark, sf):
    spatial = ri.pos_weights(spatial_queries.relations(spark, sf), SPATIAL_PREDICATES)
    temporal = ri.pos_weights(tracklet_queries.relations(spark, sf), TEMPORAL_PREDICATES)
    return rounded(spatial.unionByName(temporal), "weight")


def _audited(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Feature rows, both indices of relations and the rows of kept association groups."""
    obs = tables.shared_observations(spark, sf)
    rows = pin(tables.features(spark, sf, obs))
    of_windows = pin(ri.tracklet_rows(tracklet_queries.windows(spark, sf, obs), rows))
    spatial = ri.spatial_index(spatial_queries.relations(spark, sf, obs), rows)
    temporal = ri.temporal_index(tracklet_queries.relations(spark, sf, obs=obs), of_windows)
    return rows, spatial, temporal, ri.association_ends(association_queries.candidates(spark, sf, obs), rows)


def _of_sequences(spark: SparkSession, sf: str, groups: DataFrame) -> DataFrame:
    return groups.join(tables.samples(spark, sf).select(F.col("token").alias("source_sample"), "sequence"), "source_sample")


def _audit(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows, spatial, temporal, ends = _audited(spark, sf)
    groups = _of_sequences(spark, sf, ends.select("source_sample").distinct())
    splits = tables.splits(spark, sf)
    return ri.audit_counts(rows, spatial, temporal, groups, splits), splits


@query
def ri_multimodal_audit(spark, sf):
    rows, spatial, temporal, ends = _audited(spark, sf)
    complete = rows.select("annotation_token", ri.is_complete().alias("strict"))
    groups = ends.join(complete, "annotation_token", "left").groupBy("source_sample").agg(F.min("strict").alias("strict"))
    audit = ri.multimodal_audit(
        rows,
        spatial.withColumn("strict", F.col("source_complete") & F.col("target_complete")),
        temporal.withColumn("strict", (F.size(F.filter("joint_mask", lambda m: m)) >= 3) & F.get("joint_mask", F.lit(2))),
        _of_sequences(spark, sf, groups),
        tables.splits(spark, sf),
        CLASSES,
    )
    return rounded(audit, "value")


def _asked(spark: SparkSession, sf: str, splits: DataFrame) -> DataFrame:
    """The splits and one more than the data has."""
    return splits.unionByName(
        tables.read(spark, sf, "orders").select(
            (F.col("o_orderkey") % 6).alias("sequence"), F.lit("unassigned").alias("split")
        ).distinct()
    )


@query
def ri_audit_errors(spark, sf):
    """Empty tasks and unsupported predicates when one more split than the data has is asked for."""
    audit, splits = _audit(spark, sf)
    return ri.audit_errors(audit, _asked(spark, sf, splits))


@query
def ri_audit_summary(spark, sf):
    """Share of complete objects, errors and verdict of those splits."""
    audit, splits = _audit(spark, sf)
    kept, asked = pin(audit), _asked(spark, sf, splits)
    return rounded(ri.audit_summary(kept, ri.audit_errors(kept, asked), asked), "complete_percent")


@query
def ri_vocabulary_audit(spark, sf):
    """Labels of the observations against the labels the parts' types would configure."""
    categories = tables.observations(spark, sf).select("label", "semantic_id").distinct()
    configured = tables.read(spark, sf, "part").select(
        F.concat(F.lit("c"), F.col("p_size") % 3).alias("label")
    )
    more = tables.read(spark, sf, "part").select(F.lower("p_type").alias("label"))
    return ri.vocabulary_audit(categories, configured.union(more))


@query
def ri_split_overlap(spark, sf):
    """Customers' orders as shards: a customer whose orders fall in both halves of the years leaks."""
    shards = tables.read(spark, sf, "orders").select(
        F.col("o_custkey").alias("sequence"),
        F.when(F.year("o_orderdate") < 1996, "train").otherwise("validation").alias("split"),
    )
    return ri.split_overlap(shards)
