"""Queries on human review and on views of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficloom.operators import review, views
from trafficloom.operators.tracklets import ALL_TEMPORAL
from trafficloom.plans.pinning import pin
from trafficloom.workload import spatial_queries, tables, tracklet_queries
from trafficloom.workload.common import joined, r6, registry

QUERIES, query = registry()


def _spatial_sample(spark: SparkSession, sf: str) -> DataFrame:
    return review.sample_spatial(spatial_queries.relations(spark, sf), 20, 10)


def _temporal_sample(spark: SparkSession, sf: str) -> DataFrame:
    return review.sample_temporal(tracklet_queries.relations(spark, sf), 15, 5, ALL_TEMPORAL)


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a review record, decided where it has a label."""
    labels = tables.read(spark, sf, "labels")
    doc = F.col("doc_id")
    return (
        tables.read(spark, sf, "documents")
        .select("doc_id", "lang", "source", "n_chars")
        .join(labels, "doc_id", "left")
        .select(
            doc.alias("relation_id"),
            F.when(doc % 2 == 0, "spatial").otherwise("temporal").alias("kind"),
            F.col("lang").alias("reviewed_as"),
            (F.col("quality") == 1).alias("human_valid"),
            F.when(F.col("toxic") == 1, F.array(F.lit("toxic"), F.col("lang")))
            .otherwise(F.array().cast("array<string>"))
            .alias("corrected_predicates"),
            F.concat(F.lit("member_"), doc % 3).alias("reviewer"),
            (F.col("n_chars") % 9).alias("sequence"),
            "source",
        )
    )


@query
def rv_sample_spatial(spark, sf):
    return _spatial_sample(spark, sf).select("sampled_for", "rank", "token")


@query
def rv_sample_temporal(spark, sf):
    return _temporal_sample(spark, sf).select("sampled_for", "rank", "token")


@query
def rv_unsupported(spark, sf):
    """Predicates of both tasks that a sample of temporal relations has no row for."""
    return review.unsupported(_temporal_sample(spark, sf), [*ALL_TEMPORAL, "left_of", "near"])


def _records(spark: SparkSession, sf: str) -> DataFrame:
    spatial = review.records(_spatial_sample(spark, sf), "spatial", ["raw_frame_index"])
    temporal = review.records(_temporal_sample(spark, sf), "temporal", ["raw_frame_indices", "distance_change"])
    return spatial.unionByName(temporal, allowMissingColumns=True)


@query
def rv_records(spark, sf):
    return _records(spark, sf).select(
        "relation_id",
        "kind",
        "sampled_for",
        "subject_label",
        "object_label",
        joined("automatic_predicates"),
        "image_filename",
        "human_decision",
        joined("corrected_predicates"),
        "raw_frame_index",
        r6("distance_change"),
    )


@query
def rv_manifest(spark, sf):
    return review.manifest(_records(spark, sf))


@query
def rv_assign_reviewers(spark, sf):
    template = tables.read(spark, sf, "labels").select(F.col("doc_id").alias("relation_id"))
    return review.assign_reviewers(template, ["member_1", "member_2", "member_3"])


@query
def rv_status(spark, sf):
    return review.status(reviews(spark, sf), ["kind"])


@query
def rv_invalid_corrections(spark, sf):
    return review.invalid_corrections(reviews(spark, sf), ["toxic", "en", "fr"]).select(
        "relation_id", "kind", joined("corrected_predicates")
    )


@query
def rv_packages(spark, sf):
    return review.packages(reviews(spark, sf), 27)


@query
def rv_agreement(spark, sf):
    """Three reviewers of every document: two copy its labels, one looks at its number; some decided otherwise before."""
    labels = tables.read(spark, sf, "labels")
    template = (
        tables.read(spark, sf, "documents")
        .select("doc_id")
        .join(labels, "doc_id", "left")
        .withColumn("kind", F.when(F.col("doc_id") % 2 == 0, "spatial").otherwise("temporal"))
    )
    copies = review.assign_reviewers(template, ["member_1", "member_2", "member_3"])
    decision = (
        F.when(F.col("reviewer") == "member_1", F.col("quality") == 1)
        .when(F.col("reviewer") == "member_2", F.col("toxic") == 0)
        .otherwise(F.col("doc_id") % 2 == 1)
    )
    final = copies.select(
        F.col("doc_id").alias("relation_id"), "kind", "reviewer", decision.alias("decision"), F.lit(2).alias("order")
    )
    earlier = final.where("relation_id % 3 = 0").withColumns({"decision": ~F.col("decision"), "order": F.lit(1)})
    withdrawn = final.where("relation_id % 5 = 0").withColumns({"decision": F.lit(None).cast("boolean"), "order": F.lit(0)})
    given = final.unionByName(earlier).unionByName(withdrawn)
    result = review.agreement(given, 3)
    return result.withColumn("unanimous_percent", F.round("unanimous_percent", 6) + 0.0)


@query
def rv_corrections(spark, sf):
    """Pairs of documents as records of one relation."""
    rows = reviews(spark, sf)
    decided = F.when(F.col("human_valid"), "correct").when(~F.col("human_valid"), "incorrect")
    odd = F.array_contains("corrected_predicates", "toxic")
    return review.corrections(
        rows.select(
            F.when(F.col("relation_id") != 7, F.expr("relation_id div 2")).alias("relation_id"),
            "kind",
            F.col("source").alias("folder"),
            F.when(odd, F.lit("wrong")).otherwise(decided).alias("human_decision"),
            F.when(F.col("reviewed_as") != "de", F.col("corrected_predicates")).alias("corrected_predicates"),
        ),
        {"spatial": ["toxic", "en"], "temporal": ["toxic", "fr"]},
    )


@query
def rv_top_examples(spark, sf):
    spatial = review.top_examples(spatial_queries.relations(spark, sf), tables.observations(spark, sf), 8)
    temporal = review.temporal_example(tracklet_queries.relations(spark, sf))
    columns = ["sampled_for", "rank", "token"]
    return spatial.select(*columns, r6("clarity")).unionByName(temporal.select(*columns, r6("clarity")))


# Views


def support(spark: SparkSession, sf: str) -> DataFrame:
    return views.frame_support(spatial_queries.relations(spark, sf))


@query
def vw_frame_support(spark, sf):
    return support(spark, sf)


@query
def vw_best_window(spark, sf):
    frames = pin(support(spark, sf))
    best = views.best_window(frames, 6, 1).withColumn("choice", F.lit("best"))
    return best.unionByName(views.best_window(frames, 4, 1, start_frame=9).withColumn("choice", F.lit("from_start")))


def _relations(spark: SparkSession, sf: str, obs: DataFrame | None = None) -> DataFrame:
    temporal = views.temporal_at_middle(tracklet_queries.relations(spark, sf, obs=obs), ALL_TEMPORAL)
    return views.frame_relations(views.spatial_at_frame(spatial_queries.relations(spark, sf, obs)), temporal)


def _objects(spark: SparkSession, sf: str) -> DataFrame:
    obs = tables.shared_observations(spark, sf)
    return views.frame_objects(obs, _relations(spark, sf, obs))


def _left(column: str):
    return r6(F.get(column, F.lit(0)), f"{column}_left")


@query
def vw_frame_relations(spark, sf):
    return _relations(spark, sf).select(
        "sequence",
        "frame",
        "kind",
        "relation_id",
        "subject_instance",
        "object_instance",
        joined("predicates"),
        _left("subject_box"),
        _left("object_box"),
        r6("radial_speed"),
    )


@query
def vw_frame_objects(spark, sf):
    return _objects(spark, sf).select("sequence", "frame", "key", "label", _left("box"))


@query
def vw_display_ids(spark, sf):
    return views.display_ids(_objects(spark, sf)).select("sequence", "frame", "key", "display_id")


@query
def vw_frame_document(spark, sf):
    """The documents of all frames, read back from their JSON entry by entry."""
    obs = tables.shared_observations(spark, sf)
    relations = pin(_relations(spark, sf, obs))
    objects = views.frame_objects(obs, relations)
    entries = views.frame_entries(views.frame_document(objects, relations, part_rows=500))
    is_object, o, r = F.col("kind") == "object", F.col("object"), F.col("relation")
    return entries.select(
        "sequence",
        "frame",
        "part",
        "kind",
        F.col("position").cast("long").alias("position"),
        F.coalesce(o["key"], r["relation_id"]).alias("key"),
        F.when(is_object, F.concat_ws(" ", o["display_id"], o["label"]))
        .otherwise(F.concat_ws(" ", r["subject_instance"], r["object_instance"], F.array_join(r["predicates"], ",")))
        .alias("shown"),
        r6(F.when(is_object, F.get(o["box"], F.lit(0))).otherwise(r["radial_speed"]), "measure"),
    )
