"""How good predicted tracks are, and what their errors cost."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficloom.functions.numbers import add, count_where, flag, ratio
from trafficloom.operators import evaluation
from trafficloom.params import QUALITY_BINS
from trafficloom.plans.pinning import pin

ALL, OVERALL, AVAILABLE = "ALL", "overall", "available_only"


def align(teacher: DataFrame, predicted: DataFrame) -> DataFrame:
    """Both prediction sets side by side, one row per relation both have with equal sequence and targets."""
    right = predicted.select(
        "relation_id",
        F.col("sequence").alias("_sequence"),
        F.col("targets").alias("_targets"),
        F.col("logits").alias("predicted_logits"),
        F.col("available").alias("predicted_available"),
    )
    same = (F.col("sequence") == F.col("_sequence")) & (F.col("targets") == F.col("_targets"))
    return (
        teacher.withColumnRenamed("logits", "teacher_logits")
        .join(right, "relation_id")
        .where(same)
        .drop("_sequence", "_targets")
    )


def align_violations(teacher: DataFrame, predicted: DataFrame) -> DataFrame:
    """(rule, violations): ids unique and on both sides, sequences and targets equal."""

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy("relation_id").agg(
            F.count(F.lit(1)).alias(f"{p}_n"),
            F.min("sequence").alias(f"{p}_sequence"),
            F.min(F.array_join("targets", ",")).alias(f"{p}_targets"),
        )

    both = side(teacher, "t").join(side(predicted, "p"), "relation_id", "full_outer")
    t, p = F.col("t_n"), F.col("p_n")
    paired = t.isNotNull() & p.isNotNull()
    rules = {
        "teacher_only": count_where(p.isNull()),
        "predicted_only": count_where(t.isNull()),
        "duplicate_ids": count_where((t > 1) | (p > 1)),
        "sequence_differs": count_where(paired & (F.col("t_sequence") != F.col("p_sequence"))),
        "targets_differ": count_where(paired & (F.col("t_targets") != F.col("p_targets"))),
    }
    return both.agg(*[r.alias(n) for n, r in rules.items()]).unpivot([], list(rules), "rule", "violations")


def _count(condition: Sequence[Column]) -> Column:
    return add([flag(c) for c in condition])


def _end_quality(relations: DataFrame, features: DataFrame, links: DataFrame, size: int) -> DataFrame:
    """Identities and link confidences of every end of a relation (middle row and first frame).

    Ends are shared by many relations, so this is done per distinct end. Missing rows take part in no join.
    """
    keys = ["_mid", "_start"]

    def end(name: str) -> DataFrame:
        return relations.select(
            F.col(f"{name}_middle_row").alias("_mid"),
            F.get("frames", F.lit(0)).alias("_start"),
            F.col(f"{name}_rows").alias("gt"),
            F.col(f"predicted_{name}_rows").alias("pr"),
        )

    ends = end("source").union(end("target")).distinct()
    # Expected and found rows in one list: steps 0..4 are the relation's own rows, 5..9 the predicted ones.
    listed = ends.select(*keys, F.posexplode(F.concat("gt", "pr")).alias("_step", "row")).where(F.col("row") >= 0)
    named = listed.join(features.select("row", "identity"), "row")
    identities = named.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_step") == i, F.col("identity"))).alias(f"_e{i}") for i in range(size)],
        *[F.max(F.when(F.col("_step") == size + i, F.col("identity"))).alias(f"_a{i}") for i in range(size)],
    )
    hops = F.explode(
        F.array(
            *[F.struct(F.get("pr", F.lit(i)).alias("source"), F.get("pr", F.lit(i + 1)).alias("target")) for i in range(size - 1)]
        )
    )
    walked = ends.select(*keys, hops.alias("_h")).select(*keys, "_h.*").where("source >= 0 AND target >= 0")
    trusted = (
        walked.join(links.select("source", "target", "confidence"), ["source", "target"])
        .groupBy(*keys)
        .agg(F.sum("confidence").alias("_csum"), F.count(F.lit(1)).alias("_cn"), F.min("confidence").alias("_cmin"))
    )
    expected, actual = [F.col(f"_e{i}") for i in range(size)], [F.col(f"_a{i}") for i in range(size)]
    correct = [F.coalesce(e == a, F.lit(False)) for e, a in zip(expected, actual)]
    wrong = [e.isNotNull() & a.isNotNull() & (e != a) for e, a in zip(expected, actual)]
    seen = F.array_compact(F.array(*actual))
    most = F.array_max(F.transform(F.col("_seen"), lambda v: F.size(F.filter(F.col("_seen"), lambda w: w == v))))
    judged = (
        ends.join(identities, keys, "left")
        .join(trusted, keys, "left")
        .withColumn("_seen", seen)
        .select(
            *keys,
            F.array(*correct).alias("correct"),
            reduce(lambda a, b: a | b, wrong).alias("wrong"),
            (F.size(F.array_distinct("_seen")) > 1).alias("switch"),
            F.when(F.size("_seen") > 0, most / F.greatest(F.size("_seen"), F.lit(1))).alias("purity"),
            *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("_csum", "_cn")],
            "_cmin",
        )
    )
    return judged


def records(relations: DataFrame, features: DataFrame, links: DataFrame, size: int = 5) -> DataFrame:
    """One row per relation with step counts, identity errors and link confidence.

    `relations` comes from `matching.availability`; `features` has (row, identity), `links` the accepted
    links with their confidence.
    """
    ends = _end_quality(relations, features, links, size)

    def prefixed(name: str) -> DataFrame:
        return ends.select(
            F.col("_mid").alias(f"{name}_middle_row"),
            "_start",
            *[F.col(c).alias(f"_{name}_{c.strip('_')}") for c in ("correct", "wrong", "switch", "purity", "_csum", "_cn", "_cmin")],
        )

    joined = (
        relations.withColumn("_start", F.get("frames", F.lit(0)))
        .join(prefixed("source"), ["source_middle_row", "_start"])
        .join(prefixed("target"), ["target_middle_row", "_start"])
    )
    at = [F.lit(i) for i in range(size)]

    def present(column: str) -> list[Column]:
        return [F.get(column, i) >= 0 for i in at]

    def right(end: str) -> list[Column]:
        return [F.get(f"_{end}_correct", i) for i in at]

    teacher_joint = _count([a & b for a, b in zip(present("source_rows"), present("target_rows"))])
    correct_joint = _count([a & b for a, b in zip(right("source"), right("target"))])
    error = F.col("_source_switch") | F.col("_target_switch") | F.col("_source_wrong") | F.col("_target_wrong")
    hops = F.col("_source_cn") + F.col("_target_cn")
    kept = ["relation_id", "sequence", "group_id", "available", "unavailable_reason"]
    rows = joined.select(
        *kept,
        F.get("frames", at[0]).alias("start_frame"),
        F.get("frames", at[size // 2]).alias("middle_frame"),
        F.get("frames", at[size - 1]).alias("end_frame"),
        teacher_joint.alias("teacher_joint_steps"),
        _count(present("predicted_source_rows")).alias("predicted_source_steps"),
        _count(present("predicted_target_rows")).alias("predicted_target_steps"),
        F.col("joint_steps").alias("predicted_joint_steps"),
        _count(right("source")).alias("correct_source_steps"),
        _count(right("target")).alias("correct_target_steps"),
        correct_joint.alias("correct_joint_steps"),
        ratio(correct_joint, teacher_joint).alias("relative_joint_recall"),
        F.col("_source_purity").alias("source_purity"),
        F.col("_target_purity").alias("target_purity"),
        F.col("_source_switch").alias("source_switch"),
        F.col("_target_switch").alias("target_switch"),
        error.alias("identity_error"),
        F.when(hops > 0, (F.col("_source_csum") + F.col("_target_csum")) / F.greatest(hops, F.lit(1))).alias("mean_link_confidence"),
        F.least("_source_cmin", "_target_cmin").alias("minimum_link_confidence"),
    )
    return quality_bin(rows)


def quality_bin(df: DataFrame, steps: str = "correct_joint_steps") -> DataFrame:
    """`quality_bin` from availability, identity error and correct steps."""
    correct = F.col(steps)
    chosen = (
        F.when(~F.col("available"), F.lit("missing"))
        .when(F.col("identity_error"), F.lit("poor_identity"))
        .when(correct == 5, F.lit("perfect_5"))
        .when(correct == 4, F.lit("good_4"))
        .when(correct == 3, F.lit("partial_3"))
        .otherwise(F.lit("poor_identity"))
    )
    return df.withColumn("quality_bin", chosen)


def token_check(relations: DataFrame, features: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(rule, violations): stored tokens belong to the rows they stand with, stored availability to the recomputed one.

    `relations` has `source_rows`/`target_rows` with `source_tokens`/`target_tokens`; `stored` has
    (relation_id, stored_available).
    """
    metadata = features.select("row", F.col("annotation_token").alias("_known"))

    def side(name: str) -> DataFrame:
        steps = relations.select(F.explode(F.arrays_zip(f"{name}_rows", f"{name}_tokens")).alias("s"))
        pairs = steps.select(F.col(f"s.{name}_rows").alias("row"), F.col(f"s.{name}_tokens").alias("token")).distinct()
        wrong = pairs.where(F.col("row") >= 0).join(metadata, "row").where(F.col("_known") != F.col("token"))
        return wrong.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(f"{name}_token_mismatch").alias("rule"), "violations")

    rules = side("source").unionByName(side("target"))
    if stored is None:
        return rules
    both = relations.select("relation_id", "available").join(stored, "relation_id")
    differing = both.agg(count_where(F.col("available") != F.col("stored_available")).alias("violations"))
    return rules.unionByName(differing.select(F.lit("availability_differs").alias("rule"), "violations"))


def slices() -> list[Column]:
    """The slices of a row, one column per kind: (sequence or ALL) x (bin or overall), and available rows."""

    def slice_(sequence: Column, stratum: Column) -> Column:
        return F.struct(sequence.alias("slice_sequence"), stratum.alias("stratum"))

    everything, own = F.lit(ALL), F.col("sequence").cast("string")
    return [
        slice_(everything, F.lit(OVERALL)),
        F.when(F.col("available"), slice_(everything, F.lit(AVAILABLE))),
        slice_(everything, F.col("quality_bin")),
        slice_(own, F.lit(OVERALL)),
        slice_(own, F.col("quality_bin")),
    ]


def strata(rows: DataFrame) -> DataFrame:
    """Every row once per slice it belongs to, for aggregates that are combined before they are shuffled."""
    return rows.withColumn("_slice", F.explode(F.array_compact(F.array(*slices())))).select("*", "_slice.*").drop("_slice")


def stratified(
    teacher: DataFrame, predicted: DataFrame, quality: DataFrame, predicates: Sequence[str]
) -> DataFrame:
    """Metrics of both prediction sets and their difference for every slice.

    `quality` has (relation_id, sequence, available, identity_error, correct_joint_steps, quality_bin).
    """
    facts = quality.select("relation_id", "sequence", "available", "identity_error", "correct_joint_steps", "quality_bin")
    keys = ["slice_sequence", "stratum"]

    def of(df: DataFrame, name: str) -> DataFrame:
        return df.select("relation_id", "logits", "targets", F.lit(name).alias("set"))

    both = of(teacher, "teacher").unionByName(of(predicted, "predicted"))
    rows = pin(both.join(facts, "relation_id"))
    sliced = strata(rows)
    long = evaluation.to_long(rows, predicates, ["set", "sequence", "available", "quality_bin"])
    precise = evaluation.sliced_average_precision(long, ["set", "predicate"], slices()).select(
        "set", "slice.*", "predicate", "average_precision"
    )
    measured = pin(evaluation.multilabel(sliced, predicates, ["set", *keys], precise=precise))
    positives = F.aggregate("targets", F.lit(0).cast("long"), lambda s, t: s + t.cast("long"))
    described = sliced.where(F.col("set") == "teacher").groupBy(*keys).agg(
        F.sum(positives).alias("positive_labels"),
        F.avg(flag(F.col("available"))).alias("tracklet_availability"),
        F.avg(flag(F.col("identity_error"))).alias("identity_error_rate"),
        F.avg("correct_joint_steps").alias("mean_correct_joint_steps"),
    )
    figures = ["macro_f1", "mean_average_precision", "micro_precision", "micro_recall", "micro_f1", "exact_match_accuracy"]

    def side(name: str, *extra: str) -> DataFrame:
        return measured.where(F.col("set") == name).select(*keys, *extra, *[F.col(f).alias(f"{name}_{f}") for f in figures])

    joined = described.join(side("teacher", "examples"), keys).join(side("predicted"), keys)
    differences = {
        f"difference_{f}": F.col(f"predicted_{f}") - F.col(f"teacher_{f}")
        for f in ("macro_f1", "mean_average_precision", "micro_recall")
    }
    return joined.withColumns(differences)


def reason_counts(quality: DataFrame) -> DataFrame:
    """(kind, name, relations) over unavailability reasons and quality bins; bins without relations count 0."""
    by_reason = quality.groupBy(F.col("unavailable_reason").alias("name")).agg(F.count(F.lit(1)).alias("relations"))
    one_row = quality.agg(*[count_where(F.col("quality_bin") == b).alias(b) for b in QUALITY_BINS])
    by_bin = one_row.unpivot([], list(QUALITY_BINS), "name", "relations")
    return by_reason.select(F.lit("reason").alias("kind"), "name", "relations").unionByName(
        by_bin.select(F.lit("quality_bin").alias("kind"), "name", "relations")
    )


def summary_table(stratified_: DataFrame) -> DataFrame:
    """The flat summary: one row per sequence (or ALL) and bin (or overall)."""
    return stratified_.where(F.col("stratum") != AVAILABLE).select(
        F.col("slice_sequence").alias("sequence"),
        F.col("stratum").alias("quality_bin"),
        "examples",
        "positive_labels",
        "tracklet_availability",
        "identity_error_rate",
        "teacher_macro_f1",
        "predicted_macro_f1",
        "difference_macro_f1",
        "teacher_mean_average_precision",
        "predicted_mean_average_precision",
        "difference_mean_average_precision",
        "teacher_micro_recall",
        "predicted_micro_recall",
        "difference_micro_recall",
    )
