"""Queries on metrics and track quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficloom.operators import evaluation as ev
from trafficloom.operators import matching, quality
from trafficloom.params import TEMPORAL_PREDICATES
from trafficloom.plans.pinning import pin
from trafficloom.workload import matching_queries, tables, tracklet_queries
from trafficloom.workload.common import registry, rounded

QUERIES, query = registry()
P = TEMPORAL_PREDICATES


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return tables.predictions(spark, sf)


def teacher(spark: SparkSession, sf: str) -> DataFrame:
    return tables.predictions(spark, sf, shift=0.3)


def order_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality facts of the orders taken as relations."""
    key = F.col("o_orderkey")
    facts = tables.read(spark, sf, "orders").select(
        key.alias("relation_id"),
        (key % 9).alias("sequence"),
        (key % 6 != 0).alias("available"),
        (key % 11 == 0).alias("identity_error"),
        (key % 6).alias("correct_joint_steps"),
        F.when(key % 6 != 0, "available").otherwise("middle_step_missing").alias("unavailable_reason"),
    )
    return quality.quality_bin(facts)


def _r8(column, name: str):
    """Eight digits: the logits carry seven, so none lies halfway."""
    return (F.round(column, 8) + 0.0).alias(name)


RATES = ("precision", "recall", "f1")
FIGURES = ("macro_f1", "mean_average_precision", "micro_precision", "micro_recall", "micro_f1", "exact_match_accuracy")


@query
def ev_average_precision(spark, sf):
    return rounded(ev.average_precision(ev.to_long(predictions(spark, sf), P)), "average_precision")


@query
def ev_confusion(spark, sf):
    return rounded(ev.confusion(predictions(spark, sf), P), *RATES)


@query
def ev_multilabel(spark, sf):
    return rounded(ev.multilabel(predictions(spark, sf), P), *FIGURES)


@query
def ev_object(spark, sf):
    vectors = tables.read(spark, sf, "embeddings").select(F.slice("embedding", 1, 10).alias("scores"), "label")
    return rounded(ev.object_metrics(vectors, 10), *RATES, "accuracy")


@query
def ev_mask_unavailable(spark, sf):
    masked = ev.mask_unavailable(predictions(spark, sf))
    return masked.select("relation_id", *[_r8(F.get("logits", F.lit(i)), f"logit_{i}") for i in range(3)])


@query
def ev_recall_at_k(spark, sf):
    return rounded(ev.recall_at_k(predictions(spark, sf), P), "recall")


@query
def ev_coverage(spark, sf):
    return rounded(ev.coverage(predictions(spark, sf)), "candidate_coverage")


@query
def ev_combined(spark, sf):
    named = ("left_of", "in_front_of", "near")
    spatial = ev.predicate_metrics(teacher(spark, sf), named)
    temporal = ev.predicate_metrics(ev.mask_unavailable(predictions(spark, sf)), P)
    return rounded(ev.combined(spatial, temporal), "macro_f1", "mean_average_precision")


@query
def ev_selection_score(spark, sf):
    """Mean of two average precisions per sequence and, where the sequence is even, the exact match."""
    scored = ev.multilabel(predictions(spark, sf), P, ["sequence"]).select(
        "sequence",
        F.col("mean_average_precision").alias("spatial"),
        F.col("macro_f1").alias("temporal"),
        F.when(F.col("sequence") % 2 == 0, F.col("exact_match_accuracy")).alias("association"),
    )
    names = ["spatial", "temporal", "association"]
    return rounded(ev.selection_score(scored, names).select("sequence", "selection_score"), "selection_score")


@query
def ev_relation_metadata(spark, sf):
    rows = predictions(spark, sf).select("relation_id", "group_id", "sequence", "available")
    parts = [rows.where("sequence < 5"), rows.where("sequence >= 5").drop("available")]
    return ev.relation_metadata(parts)


@query
def ev_provenance_check(spark, sf):
    """Every customer's orders must carry the checkpoint of the customer's segment."""
    parts = tables.read(spark, sf, "orders").select(
        F.col("o_custkey").alias("sequence"), F.md5(F.substring("o_orderpriority", 1, 1)).alias("checkpoint")
    )
    wanted = tables.read(spark, sf, "customer").select(
        F.col("c_custkey").alias("sequence"), F.md5((F.col("c_custkey") % 5 + 1).cast("string")).alias("checkpoint")
    )
    return ev.provenance_check(parts, wanted)


@query
def ev_available_only(spark, sf):
    return rounded(ev.available_only(predictions(spark, sf), P), *FIGURES)


# Track quality


@query
def an_align(spark, sf):
    joined = quality.align(teacher(spark, sf), predictions(spark, sf))
    parts = [_r8(F.get(f"{s}_logits", F.lit(i)), f"{s}_{i}") for s in ("teacher", "predicted") for i in range(3)]
    return joined.select("relation_id", "sequence", *parts)


@query
def an_align_violations(spark, sf):
    """Rules over a teacher without pending orders and predictions with moved sequences and urgent orders twice."""
    status = tables.read(spark, sf, "orders").select(F.col("o_orderkey").alias("relation_id"), "o_orderstatus", "o_orderpriority")
    left = teacher(spark, sf).join(status.where("o_orderstatus <> 'P'").select("relation_id"), "relation_id")
    right = predictions(spark, sf).join(status, "relation_id")
    moved = right.withColumn("sequence", F.when(F.col("o_orderpriority") == "5-LOW", F.col("sequence") + 1).otherwise(F.col("sequence")))
    twice = moved.unionByName(moved.where("o_orderpriority = '1-URGENT'")).drop("o_orderstatus", "o_orderpriority")
    return quality.align_violations(left, twice)


def _records(spark: SparkSession, sf: str) -> DataFrame:
    scored = matching_queries.Scored(spark, sf)
    links = pin(scored.links())
    tracks = pin(matching.components(scored.rows, links))
    resolved = pin(matching_queries.resolved(scored, tracks))
    return quality.records(resolved, scored.rows, links)


@query
def an_records(spark, sf):
    numbers = (
        "relative_joint_recall",
        "source_purity",
        "target_purity",
        "mean_link_confidence",
        "minimum_link_confidence",
    )
    return rounded(_records(spark, sf), *numbers)


@query
def an_quality_bin(spark, sf):
    return _records(spark, sf).groupBy("sequence", "quality_bin").agg(F.count(F.lit(1)).alias("relations"))


@query
def an_token_check(spark, sf):
    """Rules over relations whose target tokens were shifted by one step."""
    scored = matching_queries.Scored(spark, sf)
    known = scored.features.select(F.col("feature_row").alias("row"), "annotation_token")
    rels = matching_queries.predicted(spark, sf)

    tokens = tracklet_queries.relations(spark, sf).select(
        F.col("token").alias("relation_id"),
        F.col("subject_annotation_tokens").alias("source_tokens"),
        F.concat(F.slice("object_annotation_tokens", 2, 4), F.slice("object_annotation_tokens", 1, 1)).alias("target_tokens"),
    )
    stored = rels.select("relation_id", (F.col("joint_steps") >= 3).alias("stored_available"))
    return quality.token_check(rels.join(tokens, "relation_id"), known, stored)


@query
def an_stratified_metrics(spark, sf):
    result = quality.stratified(teacher(spark, sf), predictions(spark, sf), order_quality(spark, sf), P)
    numbers = [c for c, t in result.dtypes if t == "double"]
    return rounded(result, *numbers)


@query
def an_reason_counts(spark, sf):
    return quality.reason_counts(order_quality(spark, sf))


@query
def an_summary_table(spark, sf):
    result = quality.summary_table(
        quality.stratified(teacher(spark, sf), predictions(spark, sf), order_quality(spark, sf), P)
    )
    numbers = [c for c, t in result.dtypes if t == "double"]
    return rounded(result, *numbers)
