"""Links of one object over time, and candidates between the objects of adjacent samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficloom.functions.numbers import count_where, flag
from trafficloom.functions.tokens import stable_token
from trafficloom.operators.checks import resolve_samples
from trafficloom.plans.balanced import within_reach

DUSTBIN_LABEL = "__dustbin__"


def links(obs: DataFrame, samples: DataFrame) -> DataFrame:
    """Previous and next observation of the same object, only where the sample index differs by one."""
    over = Window.partitionBy("scene_token", "instance_token").orderBy("sample_index")
    here = F.col("sample_index")

    def neighbour(move) -> Column:
        adjacent = F.abs(move("sample_index").over(over) - here) == 1
        return F.coalesce(F.when(adjacent, move("token").over(over)), F.lit(""))

    linked = resolve_samples(obs, samples).select(
        F.col("token").alias("annotation_token"),
        "sample_token",
        "scene_token",
        "sample_index",
        neighbour(F.lag).alias("prev"),
        neighbour(F.lead).alias("next"),
    )
    return linked.withColumns({"has_prev": F.col("prev") != "", "has_next": F.col("next") != ""})


_END = ("token", "instance_token", "label", "center_x", "center_y", "center_z", "supervised_eligible")


def _ends(obs: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources with the sample that follows theirs, targets with the sample that precedes theirs."""
    pairs = samples.where(F.col("next") != "").select(
        F.col("token").alias("source_sample"), F.col("next").alias("target_sample")
    )

    def end(prefix: str, sample: str) -> DataFrame:
        return obs.select(
            F.col("sample_token").alias(sample), *[F.col(c).alias(f"{prefix}_{c}") for c in _END]
        ).join(pairs, sample)

    return end("s", "source_sample"), end("t", "target_sample")


def object_pairs(obs: DataFrame, samples: DataFrame, gate_distance: float = 15.0) -> DataFrame:
    """Objects of a sample with objects of the next: within the gate, or of the same identity at any distance."""
    sources, targets = _ends(obs, samples)
    keys = ["source_sample", "target_sample"]
    match = F.col("s_instance_token") == F.col("t_instance_token")
    near = within_reach(
        sources,
        targets,
        keys,
        ("s_center_x", "s_center_y"),
        ("t_center_x", "t_center_y"),
        gate_distance,
        ["s_token"],
        ["t_token"],
    )
    dx, dy = F.col("s_center_x") - F.col("t_center_x"), F.col("s_center_y") - F.col("t_center_y")
    same = sources.withColumn("_id", F.col("s_instance_token")).join(
        targets.withColumn("_id", F.col("t_instance_token")), [*keys, "_id"]
    )
    far = same.withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") > gate_distance)
    both = near.withColumn("forced", F.lit(False)).unionByName(far.drop("_id").withColumn("forced", F.lit(True)))
    return both.select(
        stable_token("association-pair", "s_token", "t_token").alias("token"),
        *keys,
        F.col("s_token").alias("source_token"),
        F.col("t_token").alias("target_token"),
        F.lit("object_pair").alias("candidate_type"),
        F.col("s_label").alias("source_label"),
        F.col("t_label").alias("target_label"),
        *[(F.col(f"t_center_{a}") - F.col(f"s_center_{a}")).alias(f"delta_{a}") for a in "xyz"],
        F.col("distance").alias("center_distance"),
        match.alias("is_match"),
        F.lit(False).alias("is_dustbin"),
        F.col("forced").alias("forced_outside_gate"),
        match.alias("forward_target"),
        match.alias("reverse_target"),
        (F.col("s_supervised_eligible") & F.col("t_supervised_eligible")).alias("supervised_eligible"),
    )


def dustbins(obs: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per source for "not seen again" and one per target for "not seen before"."""
    sources, targets = _ends(obs, samples)
    keys = ["source_sample", "target_sample"]

    def rows(own: DataFrame, other: DataFrame, p: str, q: str, kind: str, parts: tuple[str, str]) -> DataFrame:
        is_source = p == "s"
        seen = other.select(*keys, F.col(f"{q}_instance_token").alias("_id"), F.lit(True).alias("_seen"))
        joined = own.withColumn("_id", F.col(f"{p}_instance_token")).join(seen, [*keys, "_id"], "left")
        alone = F.col("_seen").isNull()
        blank, bin_label = F.lit(""), F.lit(DUSTBIN_LABEL)
        token, label = F.col(f"{p}_token"), F.col(f"{p}_label")
        return joined.select(
            stable_token(f"association-{kind}", *parts).alias("token"),
            *keys,
            (token if is_source else blank).alias("source_token"),
            (blank if is_source else token).alias("target_token"),
            F.lit(kind).alias("candidate_type"),
            (label if is_source else bin_label).alias("source_label"),
            (bin_label if is_source else label).alias("target_label"),
            *[F.lit(0.0).alias(f"delta_{a}") for a in "xyz"],
            F.lit(None).cast("double").alias("center_distance"),
            F.lit(False).alias("is_match"),
            F.lit(True).alias("is_dustbin"),
            F.lit(False).alias("forced_outside_gate"),
            (alone if is_source else F.lit(False)).alias("forward_target"),
            (F.lit(False) if is_source else alone).alias("reverse_target"),
            F.col(f"{p}_supervised_eligible").alias("supervised_eligible"),
        )

    left = rows(sources, targets, "s", "t", "source_to_dustbin", ("s_token", "target_sample"))
    return left.unionByName(
        rows(targets, sources, "t", "s", "dustbin_to_target", ("source_sample", "t_token"))
    )


def candidates(obs: DataFrame, samples: DataFrame, gate_distance: float = 15.0) -> DataFrame:
    return object_pairs(obs, samples, gate_distance).unionByName(dustbins(obs, samples))


def counts(rows: DataFrame) -> DataFrame:
    """(counter, value) over candidates."""
    pair = F.col("candidate_type") == "object_pair"
    gone = F.col("candidate_type") == "source_to_dustbin"
    born = F.col("candidate_type") == "dustbin_to_target"
    counted = rows.agg(
        F.countDistinct("source_sample", "target_sample").alias("adjacent_sample_pairs"),
        F.count(F.lit(1)).alias("association_candidates"),
        count_where(pair).alias("object_pair_candidates"),
        count_where(pair & F.col("is_match")).alias("positive_identity_pairs"),
        count_where(pair & ~F.col("is_match")).alias("negative_identity_pairs"),
        count_where(gone).alias("source_dustbin_candidates"),
        count_where(gone & F.col("forward_target")).alias("positive_disappearances"),
        count_where(born).alias("target_dustbin_candidates"),
        count_where(born & F.col("reverse_target")).alias("positive_births"),
        count_where(F.col("forced_outside_gate")).alias("forced_outside_gate"),
    )
    return counted.unpivot([], counted.columns, "counter", "value")


def violations(rows: DataFrame) -> DataFrame:
    """(rule, violations): one true choice per source and per target, unique tokens."""
    keys = ["source_sample", "target_sample"]

    def wrong(end: str, target: str, rule: str) -> DataFrame:
        chosen = rows.where(F.col(end) != "").groupBy(*keys, end).agg(F.sum(flag(F.col(target))).alias("n"))
        return chosen.agg(count_where(F.col("n") != 1).alias("violations")).select(F.lit(rule).alias("rule"), "violations")

    repeated = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return (
        wrong("source_token", "forward_target", "forward_choice_not_unique")
        .unionByName(wrong("target_token", "reverse_target", "reverse_choice_not_unique"))
        .unionByName(
            repeated.agg(count_where(F.col("n") > 1).alias("violations")).select(
                F.lit("token_not_unique").alias("rule"), "violations"
            )
        )
    )
