"""Samples for human review, review records and agreement."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficloom.functions.boxes import has_area
from trafficloom.functions.numbers import count_where
from trafficloom.params import REVIEW_DECISIONS, SPATIAL_PREDICATES

NO_RELATION = "no_relation"
PARTS = 64


def _by_predicate(rels: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """A row once per label it carries, `no_relation` included."""
    labels = F.array_compact(F.array(*[F.when(F.col(p), F.lit(p)) for p in predicates]))
    return rels.withColumn("sampled_for", F.explode(labels))


def _first(rows: DataFrame, sizes: dict[str, int], order: Sequence[Column]) -> DataFrame:
    """First rows per label: first those of each hashed part of a label, then of the parts together."""
    most, over = max(sizes.values()), Window.partitionBy("sampled_for").orderBy(*order)
    inside = Window.partitionBy("sampled_for", "_part").orderBy(*order)
    parted = rows.withColumn("_part", F.pmod(F.xxhash64("token"), F.lit(PARTS)))
    leading = parted.withColumn("_at", F.row_number().over(inside)).where(F.col("_at") <= most).drop("_at", "_part")
    ranked = leading.withColumn("rank", F.row_number().over(over))
    wanted = F.create_map(*[F.lit(v) for pair in sizes.items() for v in pair])
    return ranked.where(F.col("rank") <= wanted[F.col("sampled_for")])


def _draw(seed: int) -> list[Column]:
    text = F.concat_ws("|", "token", F.lit(str(seed)), "sampled_for")
    return [F.md5(text), F.col("token")]


def sample_spatial(rels: DataFrame, count: int, no_relation_count: int, seed: int = 42) -> DataFrame:
    """`count` random relations per predicate and `no_relation_count` without any, both boxes visible."""
    eligible = rels.where(
        F.col("supervised_eligible") & F.col("subject_visible") & F.col("object_visible")
    )
    sizes = {**{p: count for p in SPATIAL_PREDICATES}, NO_RELATION: no_relation_count}
    return _first(_by_predicate(eligible, list(sizes)), sizes, _draw(seed))


def sample_temporal(
    rels: DataFrame,
    count: int,
    no_relation_count: int,
    predicates: Sequence[str],
    seed: int = 42,
    minimum_joint_visible_steps: int = 3,
) -> DataFrame:
    """The same for temporal relations that are eligible for review."""
    eligible = rels.where(
        F.col("supervised_eligible")
        & F.col("review_eligible")
        & (F.col("joint_visible_steps") >= minimum_joint_visible_steps)
    )
    sizes = {**{p: count for p in predicates}, NO_RELATION: no_relation_count}
    return _first(_by_predicate(eligible, list(sizes)), sizes, _draw(seed))


def unsupported(sample: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """Predicates the sample has no row for."""
    found = sample.agg(*[count_where(F.col("sampled_for") == p).alias(p) for p in predicates])
    return found.unpivot([], list(predicates), "predicate", "n").where("n = 0").select("predicate")


def records(sample: DataFrame, kind: str, measures: Sequence[str] = ()) -> DataFrame:
    """Review records without a decision yet."""
    return sample.select(
        F.col("token").alias("relation_id"),
        "sequence",
        F.lit(kind).alias("kind"),
        "sampled_for",
        "subject_label",
        "object_label",
        F.col("positive_predicates").alias("automatic_predicates"),
        F.concat(F.col("sampled_for"), F.lit("_"), F.lpad(F.col("rank").cast("string"), 3, "0"), F.lit(".jpg")).alias(
            "image_filename"
        ),
        F.lit(None).cast("string").alias("human_decision"),
        F.array().cast("array<string>").alias("corrected_predicates"),
        F.lit("").alias("human_notes"),
        *measures,
    )


def manifest(records_: DataFrame) -> DataFrame:
    """Records per kind and predicate, per kind, and in all."""
    every = F.lit("ALL")
    return records_.rollup("kind", "sampled_for").agg(F.count(F.lit(1)).alias("examples")).select(
        F.coalesce("kind", every).alias("kind"), F.coalesce("sampled_for", every).alias("sampled_for"), "examples"
    )


def assign_reviewers(template: DataFrame, reviewers: Sequence[str]) -> DataFrame:
    """The template once per reviewer."""
    each = F.explode(F.array(*[F.lit(r) for r in reviewers]))
    return template.withColumns({"reviewer": each, "review_set": F.lit("common_overlap")})


def status(reviews: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pending, true and false decisions per predicate and overall (`ALL`)."""
    valid = F.col("human_valid")
    counted = (
        reviews.rollup(*by, "reviewed_as")
        .agg(
            F.grouping("reviewed_as").alias("_all"),
            F.grouping_id().alias("_id"),
            F.count(F.lit(1)).alias("records"),
            count_where(valid.isNull()).alias("pending"),
            count_where(valid).alias("valid"),
            count_where(~valid).alias("invalid"),
        )
        .where(F.col("_id").isin(0, 1))
    )
    named = F.when(F.col("_all") == 1, F.lit("ALL")).otherwise(F.col("reviewed_as"))
    return counted.withColumn("reviewed_as", named).drop("_all", "_id")


def invalid_corrections(reviews: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """Reviews whose corrections are missing or leave the vocabulary."""
    allowed = F.array(*[F.lit(v) for v in vocabulary])
    outside = F.size(F.array_except("corrected_predicates", allowed)) > 0
    return reviews.where(F.col("corrected_predicates").isNull() | outside)


def packages(reviews: DataFrame, expected: int = 9) -> DataFrame:
    """Packages (reviewer, sequence) with both kinds, per reviewer and in all, against the expected number."""
    kinds = reviews.groupBy("reviewer", "sequence").agg(
        (F.max(F.col("kind") == "spatial") & F.max(F.col("kind") == "temporal")).alias("_both")
    )
    return kinds.rollup("reviewer").agg(count_where(F.col("_both")).alias("packages")).select(
        F.coalesce(F.col("reviewer").cast("string"), F.lit("ALL")).alias("reviewer"),
        "packages",
        F.when(F.col("reviewer").isNull(), F.col("packages") == expected).alias("complete"),
    )


def agreement_items(reviews: DataFrame, reviewers: int = 3, order: str = "order") -> DataFrame:
    """Per item: whether all reviewers decided, and whether they agree.

    Of a reviewer's records of an item the last by `order` counts, if it takes a decision back as well. Of records with the
    same place the one with the larger decision counts.
    """
    place = F.struct(order, F.col("decision").isNotNull(), F.col("decision").cast("string"))
    last = reviews.groupBy("kind", "relation_id", "reviewer").agg(F.max_by(F.struct("decision"), place).alias("_last"))
    latest = last.select("kind", "relation_id", "reviewer", "_last.decision")
    decided = latest.groupBy("kind", "relation_id").agg(
        F.countDistinct("reviewer").alias("_reviewers"),
        count_where(F.col("decision").isNull()).alias("_pending"),
        F.countDistinct("decision").alias("_decisions"),
    )
    complete = (F.col("_reviewers") == reviewers) & (F.col("_pending") == 0)
    return decided.select(
        "kind", "relation_id", complete.alias("complete"), (complete & (F.col("_decisions") == 1)).alias("unanimous")
    )


def agreement(reviews: DataFrame, reviewers: int = 3, order: str = "order") -> DataFrame:
    items = agreement_items(reviews, reviewers, order)
    counted = items.agg(
        F.count(F.lit(1)).alias("items_found"),
        count_where(F.col("complete")).alias("items_reviewed_by_all"),
        count_where(F.col("unanimous")).alias("unanimous_items"),
        count_where(F.col("complete") & ~F.col("unanimous")).alias("disagreements"),
    )
    share = 100.0 * F.col("unanimous_items") / F.greatest("items_reviewed_by_all", F.lit(1))
    return counted.withColumn("unanimous_percent", F.when(F.col("items_reviewed_by_all") > 0, share))


def corrections(
    rows: DataFrame, vocabularies: dict[str, Sequence[str]], decisions: Sequence[str] = REVIEW_DECISIONS
) -> DataFrame:
    """(section, name, value): decisions overall and per folder, errors, and ids with conflicting records.

    `rows` has relation_id, kind, folder, human_decision and corrected_predicates.
    """
    decision, corrected = F.col("human_decision"), F.col("corrected_predicates")
    named = F.coalesce(decision, F.lit("pending"))
    allowed = F.array().cast("array<string>")
    for kind, words in vocabularies.items():
        allowed = F.when(F.col("kind") == kind, F.array(*[F.lit(w) for w in words])).otherwise(allowed)
    empty = F.coalesce(F.col("relation_id").cast("string"), F.lit("")) == ""
    faults = {
        "missing_relation_id": empty,
        "invalid_human_decision": decision.isNotNull() & ~decision.isin(list(decisions)),
        "invalid_corrected_predicates": corrected.isNull() | (F.size(F.array_except(corrected, allowed)) > 0),
        "incorrect_without_correction_list": F.coalesce(decision == "incorrect", F.lit(False)) & corrected.isNull(),
    }
    overall = rows.groupBy(named.alias("name")).agg(F.count(F.lit(1)).alias("value"))
    folders = rows.groupBy(F.concat_ws(":", "folder", named).alias("name")).agg(F.count(F.lit(1)).alias("value"))
    errors = rows.agg(*[count_where(f).alias(n) for n, f in faults.items()]).unpivot([], list(faults), "name", "value")
    stated = F.to_json(F.struct(decision.alias("d"), corrected.alias("c")))
    # Conflicts show in the smallest and largest text; no list of versions is kept.
    conflicts = (
        rows.where(~empty)
        .groupBy("relation_id")
        .agg((F.min(stated) != F.max(stated)).alias("_conflict"))
        .agg(count_where(F.col("_conflict")).alias("value"))
        .select(F.lit("inconsistent_duplicates").alias("name"), "value")
    )
    sections = [("decision", overall), ("folder", folders), ("error", errors), ("error", conflicts)]
    return reduce(
        DataFrame.unionByName, [df.select(F.lit(s).alias("section"), "name", "value") for s, df in sections]
    )


def top_examples(rels: DataFrame, obs: DataFrame, per_predicate: int) -> DataFrame:
    """Clearest spatial relations per predicate, both ends visible in the image."""
    visible = obs.where(has_area(F.array("x1", "y1", "x2", "y2"))).select("token")
    seen = rels.where("supervised_eligible")
    for end in ("subject_token", "object_token"):
        seen = seen.join(visible.withColumnRenamed("token", end), end, "left_semi")
    clarity = (
        F.when(F.col("sampled_for") == "left_of", F.abs("delta_y"))
        .when(F.col("sampled_for") == "in_front_of", F.abs("delta_x"))
        .when(F.col("sampled_for") == "near", -F.col("box_distance"))
        .when(F.col("sampled_for") == "overlapping", F.col("bev_iou"))
        .otherwise(F.col("image_overlap"))
    )
    rows = _by_predicate(seen, SPATIAL_PREDICATES).withColumn("clarity", clarity)
    sizes = {p: per_predicate for p in SPATIAL_PREDICATES}
    return _first(rows, sizes, [F.col("clarity").desc(), F.col("token")])


def temporal_example(rels: DataFrame) -> DataFrame:
    """One temporal relation per predicate, by the order that suits it."""
    change, cosine = F.col("distance_change"), F.col("direction_cosine")
    clarity = (
        F.when(F.col("sampled_for") == "approaching", -change)
        .when(F.col("sampled_for") == "moving_away", change)
        .when(F.col("sampled_for") == "same_motion_direction", cosine)
        .otherwise(-F.col("path_distance"))
    )
    names = ("approaching", "moving_away", "same_motion_direction", "crossing_path")
    rows = _by_predicate(rels.where("supervised_eligible"), names).withColumn("clarity", clarity)
    return _first(rows, {n: 1 for n in names}, [F.col("clarity").desc(), F.col("token")])
