"""Relations and candidates joined to feature rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficloom.functions.numbers import add, clip, count_where, flag
from trafficloom.operators.checks import required
from trafficloom.params import SPATIAL_PREDICATES, TEMPORAL_PREDICATES
from trafficloom.plans.ordered import running_totals
from trafficloom.plans.pinning import pin

MISSING = -1


def is_complete(mask: str = "modality_mask") -> Column:
    return F.forall(mask, lambda m: m)


def complete_rows(features: DataFrame) -> DataFrame:
    return features.where(is_complete())


def feature_timeline(features: DataFrame, samples: DataFrame) -> DataFrame:
    """Feature rows with sample index and time; a row whose sample is unknown fails the job."""
    known = samples.select(
        F.col("token").alias("sample_token"),
        F.col("sample_index").alias("_index"),
        F.col("timestamp_ns").alias("_time"),
    )
    index = required(F.col("_index"), F.col("_index").isNotNull(), "a feature row does not resolve to a sample")
    return features.drop("sample_index", "timestamp_ns").join(known, "sample_token", "left").select(
        "*", index.alias("sample_index"), F.col("_time").alias("timestamp_ns")
    ).drop("_index", "_time")


def modality_counts(features: DataFrame, names: Sequence[str] = ("rgb", "lidar", "text")) -> DataFrame:
    counted = features.agg(
        F.count(F.lit(1)).alias("objects"),
        *[count_where(F.get("modality_mask", F.lit(i))).alias(n) for i, n in enumerate(names)],
        count_where(is_complete()).alias("complete"),
    )
    return counted.unpivot([], counted.columns, "counter", "value")


def metadata_checks(features: DataFrame) -> DataFrame:
    """(rule, violations): feature rows are unique and dense from 0."""
    counted = features.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("feature_row").alias("d"),
        F.min("feature_row").alias("lo"),
        F.max("feature_row").alias("hi"),
    )
    rules = counted.select(
        (F.col("n") - F.col("d")).alias("feature_row_not_unique"),
        flag(F.col("lo") != 0).alias("first_row_not_zero"),
        flag(F.col("hi") != F.col("n") - 1).alias("rows_not_dense"),
    )
    return rules.unpivot([], rules.columns, "rule", "violations")


def _lookup(features: DataFrame, token: str, end: str) -> DataFrame:
    return features.select(
        F.col("annotation_token").alias(token),
        F.col("feature_row").alias(f"{end}_row"),
        is_complete().alias(f"{end}_complete"),
    )


def spatial_ends(relations: DataFrame, features: DataFrame) -> DataFrame:
    """Relations with feature rows of both ends (null where missing) and `state`: kept, missing or incomplete."""
    joined = relations.join(_lookup(features, "subject_token", "source"), "subject_token", "left").join(
        _lookup(features, "object_token", "target"), "object_token", "left"
    )
    missing = F.col("source_row").isNull() | F.col("target_row").isNull()
    state = F.when(missing, F.lit("missing_features")).when(
        F.col("source_complete") & F.col("target_complete"), F.lit("complete")
    )
    return joined.withColumn("state", state.otherwise(F.lit("incomplete")))


def spatial_index(relations: DataFrame, features: DataFrame, complete_only: bool = True) -> DataFrame:
    states = ["complete"] if complete_only else ["complete", "incomplete"]
    return spatial_ends(relations, features).where(F.col("state").isin(states))


def spatial_counts(relations: DataFrame, features: DataFrame) -> DataFrame:
    state = F.col("state")
    counted = spatial_ends(relations, features).agg(
        F.count(F.lit(1)).alias("seen"),
        count_where(state == "complete").alias("kept"),
        count_where(state == "missing_features").alias("missing_features"),
        count_where(state == "incomplete").alias("non_multimodal_pairs"),
    )
    return counted.unpivot([], counted.columns, "counter", "value")


SPATIAL_GEOMETRY = (
    "delta_x delta_y delta_z center_distance box_distance bev_intersection bev_iou vertical_overlap image_overlap "
    "log_volume_ratio log_height_ratio lateral_margin longitudinal_margin subject_masked object_masked "
    "occlusion_supported"
).split()


def spatial_geometry(relations: DataFrame) -> DataFrame:
    """The 16 numbers of a spatial relation, as `geometry`."""
    tiny = F.lit(1e-8)
    parts = [F.col(c) for c in SPATIAL_GEOMETRY[:9]] + [
        F.log(F.greatest("volume_ratio", tiny)),
        F.log(F.greatest("height_ratio", tiny)),
        F.col("lateral_margin"),
        F.col("longitudinal_margin"),
        (F.col("subject_mask_pixels") > 0).cast("double"),
        (F.col("object_mask_pixels") > 0).cast("double"),
        F.col("occlusion_mask_supported").cast("double"),
    ]
    return relations.withColumn("geometry", F.array(*parts).cast("array<float>"))


def tracklet_rows(tracks: DataFrame, features: DataFrame, size: int = 5) -> DataFrame:
    """Per window: its members' feature rows (-1 where missing) and which of them are complete.

    Done once per window; relations, of which a window has many, pick it up by the window's token.
    """
    steps = tracks.select(F.col("token").alias("tracklet"), F.posexplode("annotation_tokens").alias("_step", "annotation_token"))
    found = steps.join(
        features.select("annotation_token", "feature_row", is_complete().alias("_complete")), "annotation_token", "left"
    )
    at = [F.col("_step") == i for i in range(size)]
    rows = [F.coalesce(F.max(F.when(a, F.col("feature_row"))), F.lit(MISSING).cast("long")) for a in at]
    complete = [F.coalesce(F.max(F.when(a, F.col("_complete"))), F.lit(False)) for a in at]
    return found.groupBy("tracklet").agg(F.array(*rows).alias("rows"), F.array(*complete).alias("complete"))


def temporal_ends(
    relations: DataFrame, tracklets: DataFrame, complete_only: bool = True, minimum_steps: int = 3, size: int = 5
) -> DataFrame:
    """Relations with rows and masks of both ends, and `state`: kept, insufficient or non-multimodal."""

    def end(name: str, token: str) -> DataFrame:
        return tracklets.select(
            F.col("tracklet").alias(token), F.col("rows").alias(f"{name}_rows"), F.col("complete").alias(f"{name}_complete")
        )

    joined = relations.join(end("source", "subject_tracklet"), "subject_tracklet").join(
        end("target", "object_tracklet"), "object_tracklet"
    )
    return with_state(joined, complete_only, minimum_steps, size)


def usable(rows: str, complete: str, minimum_steps: int = 3, size: int = 5) -> Column:
    """Whether a window can be an end of a kept relation of complete rows: both ends need these steps, whatever the other has."""
    at = range(size)
    listed = add([(F.get(rows, F.lit(i)) >= 0).cast("long") for i in at])
    seen = add([F.get(complete, F.lit(i)).cast("long") for i in at])
    return (listed >= minimum_steps) & (seen >= minimum_steps) & F.get(complete, F.lit(size // 2))


def with_state(joined: DataFrame, complete_only: bool = True, minimum_steps: int = 3, size: int = 5) -> DataFrame:
    """Masks, `state` and `group_id` of relations that have rows and completeness of both ends (`source_rows`, `source_complete`, ..)."""
    counts = {n: add([(F.get(f"{n}_rows", F.lit(i)) >= 0).cast("long") for i in range(size)]) for n in ("source", "target")}
    joint = F.zip_with("source_complete", "target_complete", lambda a, b: a & b)
    masked = joined.withColumn("joint_mask", joint).withColumns(
        {
            f"{n}_mask": F.col("joint_mask") if complete_only else F.transform(f"{n}_rows", lambda r: r >= 0)
            for n in ("source", "target")
        }
    )
    few = (counts["source"] < minimum_steps) | (counts["target"] < minimum_steps)
    steps = add([F.get("joint_mask", F.lit(i)).cast("long") for i in range(size)])
    partial = (steps < minimum_steps) | ~F.get("joint_mask", F.lit(size // 2))
    state = F.when(few, F.lit("insufficient_tracklets"))
    if complete_only:
        state = state.when(partial, F.lit("non_multimodal_tracklets"))
    return masked.withColumns(
        {
            "state": state.otherwise(F.lit("kept")),
            "group_id": F.concat_ws(":", "scene_token", F.col("start_sample_index").cast("string")),
        }
    )


def temporal_index(
    relations: DataFrame, tracklets: DataFrame, complete_only: bool = True, minimum_steps: int = 3
) -> DataFrame:
    return temporal_ends(relations, tracklets, complete_only, minimum_steps).where(F.col("state") == "kept")


def temporal_counts(relations: DataFrame, tracklets: DataFrame, complete_only: bool = True) -> DataFrame:
    state = F.col("state")
    counted = temporal_ends(relations, tracklets, complete_only).agg(
        F.count(F.lit(1)).alias("seen"),
        count_where(state == "kept").alias("kept"),
        count_where(state == "insufficient_tracklets").alias("insufficient_tracklets"),
        count_where(state == "non_multimodal_tracklets").alias("non_multimodal_tracklets"),
        exploratory_count().alias("exploratory_ignored"),
    )
    return counted.unpivot([], counted.columns, "counter", "value")


def exploratory_count(predicate: str = "crossing_path") -> Column:
    """Kept relations with the untrained label; an aggregate over temporal ends."""
    return count_where((F.col("state") == "kept") & F.col(predicate))


def temporal_geometry(relations: DataFrame, size: int = 5) -> DataFrame:
    """The 24 numbers of a temporal relation, as `geometry`."""
    c = F.col
    velocities = [c(f"{e}_velocity_{a}") for e in ("subject", "object") for a in "xyz"]
    parts = [
        *[F.coalesce(F.get("relative_distances", F.lit(i)), F.lit(0.0)) for i in range(size)],
        c("distance_change"),
        c("decreasing_fraction"),
        c("increasing_fraction"),
        c("subject_speed"),
        c("object_speed"),
        *velocities,
        c("subject_radial_speed"),
        c("object_radial_speed"),
        c("direction_cosine"),
        c("middle_distance"),
        *[c(f"{e}_visible_steps") / 5.0 for e in ("subject", "object", "joint")],
        F.coalesce(c("path_distance"), F.lit(0.0)),
    ]
    return relations.withColumn("geometry", F.array(*parts).cast("array<float>"))


_GROUP = ["source_sample", "target_sample"]


def _association_states(candidates: DataFrame, features: DataFrame) -> DataFrame:
    """Ends of eligible candidates, one row per (group, side, token), with their feature row."""
    eligible = candidates.where("supervised_eligible")

    def side(name: str) -> DataFrame:
        token = F.col(f"{name}_token")
        return eligible.where(token != "").select(*_GROUP, F.lit(name).alias("side"), token.alias("annotation_token"))

    ends = side("source").union(side("target")).distinct()
    return ends.join(
        features.select("annotation_token", "feature_row", is_complete().alias("_complete")), "annotation_token", "left"
    )


def _association_groups(states: DataFrame, complete_only: bool) -> DataFrame:
    """Per group: whether a feature is missing, and how many usable rows each side has."""
    usable = F.col("feature_row").isNotNull() & (F.col("_complete") | F.lit(not complete_only))
    return states.groupBy(*_GROUP).agg(
        F.max(F.col("feature_row").isNull()).alias("_missing"),
        count_where(usable & (F.col("side") == "source")).alias("_ns"),
        count_where(usable & (F.col("side") == "target")).alias("_nt"),
    )


def association_ends(candidates: DataFrame, features: DataFrame, complete_only: bool = True) -> DataFrame:
    """Rows of every kept group with their local `index` and `choice`, the local index of the true partner.

    A group is skipped when one of its objects has no features or a side is empty. Without a partner among
    the kept rows the choice is the dustbin, whose index is the size of the other side.
    """
    states = _association_states(candidates, features)
    groups = _association_groups(states, complete_only).where(
        ~F.col("_missing") & (F.col("_ns") > 0) & (F.col("_nt") > 0)
    )
    usable = states.where(F.col("feature_row").isNotNull() & (F.col("_complete") | F.lit(not complete_only)))
    kept = usable.join(groups, _GROUP).drop("_complete", "_missing")
    placed = running_totals(kept, [*_GROUP, "side"], [F.col("feature_row")], {"_n": F.lit(1).cast("long")})
    indexed = placed.withColumn("index", F.col("_n") - 1).drop("_n")
    pairs = candidates.where(F.col("supervised_eligible") & (F.col("candidate_type") == "object_pair"))

    def partners(own: str, other: str, target: str) -> DataFrame:
        matched = pairs.where(target).select(
            *_GROUP, F.lit(own).alias("side"), F.col(f"{own}_token").alias("annotation_token"), F.col(f"{other}_token").alias("_other")
        )
        there = indexed.where(F.col("side") == other).select(
            *_GROUP, F.col("annotation_token").alias("_other"), F.col("index").alias("_choice")
        )
        return matched.join(there, [*_GROUP, "_other"]).drop("_other")

    chosen = partners("source", "target", "forward_target").unionByName(
        partners("target", "source", "reverse_target")
    )
    bin_index = F.when(F.col("side") == "source", F.col("_nt")).otherwise(F.col("_ns"))
    return indexed.join(chosen, [*_GROUP, "side", "annotation_token"], "left").select(
        *_GROUP, "side", "annotation_token", "feature_row", "index", F.coalesce("_choice", bin_index).alias("choice")
    )


def association_counts(candidates: DataFrame, features: DataFrame, complete_only: bool = True) -> DataFrame:
    states = _association_states(candidates, features)
    groups = _association_groups(states, complete_only)
    of_groups = groups.agg(
        F.count(F.lit(1)).alias("sample_pairs_seen"),
        count_where(~F.col("_missing") & (F.col("_ns") > 0) & (F.col("_nt") > 0)).alias("sample_pairs_kept"),
        count_where(F.col("_missing")).alias("missing_features"),
    )
    whole = states.join(groups.where(~F.col("_missing")).select(*_GROUP), _GROUP)
    lost = ~F.col("_complete") if complete_only else F.lit(False)
    of_objects = whole.agg(
        *[
            count_where(lost & (F.col("side") == s)).alias(f"non_multimodal_{s}_objects")
            for s in ("source", "target")
        ]
    )
    return of_groups.unpivot([], of_groups.columns, "counter", "value").unionByName(
        of_objects.unpivot([], of_objects.columns, "counter", "value")
    )


def association_pairs(candidates: DataFrame, ends: DataFrame, features: DataFrame) -> DataFrame:
    """Candidate pairs of kept groups with rows, local indices and measured ends (s_ and t_ columns)."""
    pairs = candidates.where(F.col("supervised_eligible") & (F.col("candidate_type") == "object_pair"))
    measured = features.select(
        "annotation_token",
        *["center_x", "center_y", "center_z", "length", "width", "height", "modality_mask"],
    )

    def end(side: str, p: str) -> DataFrame:
        rows = ends.where(F.col("side") == side).join(measured, "annotation_token")
        named = ["center_x", "center_y", "center_z", "length", "width", "height", "modality_mask"]
        return rows.select(
            *_GROUP,
            F.col("annotation_token").alias(f"{side}_token"),
            F.col("feature_row").alias(f"{side}_row"),
            F.col("index").alias(f"{side}_index"),
            *[F.col(c).alias(f"{p}_{c}") for c in named],
        )

    return (
        pairs.select(*_GROUP, "source_token", "target_token", "forward_target", "reverse_target")
        .join(end("source", "s"), [*_GROUP, "source_token"])
        .join(end("target", "t"), [*_GROUP, "target_token"])
    )


def association_geometry(pairs: DataFrame) -> DataFrame:
    """The 16 numbers of a pair: offset, distance, direction, size difference and log ratio, shared modalities.

    Computed for candidate pairs; the scores of all others are masked and never looked at.
    """
    delta = [F.col(f"t_center_{a}") - F.col(f"s_center_{a}") for a in "xyz"]
    placed = pairs.withColumns({f"_d{a}": d for a, d in zip("xyz", delta)}).withColumn(
        "_distance", F.sqrt(add([F.col(f"_d{a}") * F.col(f"_d{a}") for a in "xyz"]))
    )
    floor = F.greatest("_distance", F.lit(1e-6))
    sizes = [
        (F.greatest(f"s_{n}", F.lit(1e-4)), F.greatest(f"t_{n}", F.lit(1e-4))) for n in ("length", "width", "height")
    ]
    shared = [
        (F.get("s_modality_mask", F.lit(i)) & F.get("t_modality_mask", F.lit(i))).cast("double") for i in range(3)
    ]
    parts = [
        *[F.col(f"_d{a}") for a in "xyz"],
        F.col("_distance"),
        *[F.col(f"_d{a}") / floor for a in "xyz"],
        *[t - s for s, t in sizes],
        *[F.log(t / s) for s, t in sizes],
        *shared,
    ]
    return placed.withColumn("geometry", F.array(*parts).cast("array<float>")).drop("_dx", "_dy", "_dz", "_distance")


def class_weights(
    features: DataFrame, classes: int = 26, maximum: float = 5.0, complete_only: bool = False
) -> DataFrame:
    """Weight per class: square root of inverse share, mean 1 over seen classes, capped; 0 for unseen ones."""
    rows = complete_rows(features) if complete_only else features
    counts = rows.groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    listed = (
        features.sparkSession.range(classes)
        .select(F.col("id").alias("category"))
        .join(counts, "category", "left")
        .withColumn("count", F.coalesce("count", F.lit(0)))
    )
    # One row per class of a fixed vocabulary.
    over = Window.partitionBy()
    seen = F.col("count") > 0
    total, supported = F.sum("count").over(over), F.sum(seen.cast("long")).over(over)
    raw = listed.withColumn("_raw", F.when(seen, F.sqrt(total / (supported * F.col("count")))))
    weight = F.coalesce(clip(F.col("_raw") / F.avg("_raw").over(over), 0.0, maximum), F.lit(0.0))
    return raw.select("category", "count", F.when(seen, weight).otherwise(0.0).alias("weight"))


def pos_weights(index: DataFrame, predicates: Sequence[str] = SPATIAL_PREDICATES, maximum: float = 20.0) -> DataFrame:
    """Negatives over positives per predicate, within [1, maximum]; 1 without positives."""
    counted = index.agg(F.count(F.lit(1)).alias("total"), *[count_where(F.col(p)).alias(p) for p in predicates])
    long = counted.unpivot(["total"], list(predicates), "predicate", "positives")
    ratio = F.when(F.col("positives") > 0, (F.col("total") - F.col("positives")) / F.col("positives"))
    return long.withColumn("weight", F.coalesce(clip(ratio, 1.0, maximum), F.lit(1.0)))


TASKS = ("spatial_examples", "temporal_examples", "association_sample_pairs")


def audit_counts(
    features: DataFrame,
    spatial: DataFrame,
    temporal: DataFrame,
    associations: DataFrame,
    splits: DataFrame,
    classes: Sequence[int] = (),
    strictness: bool = False,
) -> DataFrame:
    """(split, sequence, counter, value) with `ALL` sequence totals, for what has rows.

    The three indices carry `sequence` and the label columns; `associations` has one row per kept group. Complete objects
    are also counted per class, as `class_<category>`, for the classes asked for. With `strictness` rows of the indices whose column
    `strict` does not hold are counted as `loose_<task>`.
    """
    seen = [F.count(F.lit(1)).alias("n")]

    def long(rows: DataFrame, aggregates: Mapping[str, Column]) -> DataFrame:
        rolled = (
            rows.join(splits, "sequence")
            .rollup("split", "sequence")
            .agg(*[a.alias(n) for n, a in aggregates.items()])
            .where(F.col("split").isNotNull())
            .withColumn("sequence", F.coalesce(F.col("sequence").cast("string"), F.lit("ALL")))
        )
        return rolled.unpivot(["split", "sequence"], list(aggregates), "counter", "value")

    def task(rows: DataFrame, name: str, labels: Sequence[str] = ()) -> DataFrame:
        loose = {f"loose_{name}": count_where(~F.coalesce("strict", F.lit(False)))} if strictness else {}
        return long(rows, {name: seen[0], **{p: count_where(F.col(p)) for p in labels}, **loose})

    parts = [
        long(
            features,
            {
                "objects": seen[0],
                "complete_objects": count_where(is_complete()),
                **{f"class_{c}": count_where(is_complete() & (F.col("category") == c)) for c in classes},
            },
        ),
        task(spatial, TASKS[0], SPATIAL_PREDICATES),
        task(temporal, TASKS[1], TEMPORAL_PREDICATES),
        task(associations, TASKS[2]),
    ]
    return reduce(DataFrame.unionByName, parts)


def multimodal_audit(
    features: DataFrame,
    spatial: DataFrame,
    temporal: DataFrame,
    associations: DataFrame,
    splits: DataFrame,
    classes: Sequence[int] = (),
) -> DataFrame:
    """(split, sequence, counter, value): counts of every sequence listed and, as sequence `ALL`, of every split, 0 where there are no rows.

    Inputs as of `audit_counts`, the indices with `strict`, which tells whether a row keeps to complete objects. Every split also has its
    `complete_percent`, the errors found in it, their sum as `errors` and in `passed` 1 if there are none; split `ALL` has the
    latter two for the audit as a whole. Errors are sequences without feature rows (`missing_shards`), sequences with rows that are
    not strict (`loose_shards`), tasks without examples (`empty_tasks`) and predicates without positives (`unsupported_predicates`).
    """
    loose = [f"loose_{t}" for t in TASKS]
    predicates = [*SPATIAL_PREDICATES, *TEMPORAL_PREDICATES]
    names = ["objects", "complete_objects", *[f"class_{c}" for c in classes], *TASKS, *predicates, *loose]
    counts = audit_counts(features, spatial, temporal, associations, splits, classes, strictness=True)
    listed = splits.where(F.col("split").isNotNull()).select("split", F.explode(F.array(F.col("sequence").cast("string"), F.lit("ALL"))).alias("sequence"))
    every = listed.where(F.col("sequence").isNotNull()).distinct().withColumn("counter", F.explode(F.array(*[F.lit(n) for n in names])))
    key = ["split", "sequence", "counter"]
    filled = pin(every.join(counts, key, "left").select(*key, F.coalesce(F.col("value"), F.lit(0)).cast("double").alias("value")))

    def of(*counters: str) -> Column:
        return F.col("counter").isin(*counters)

    def total(counter: str) -> Column:
        return F.sum(F.when(of(counter), F.col("value")).otherwise(0.0))

    each = filled.groupBy("split", "sequence").agg(
        total("objects").alias("objects"),
        total("complete_objects").alias("complete_objects"),
        count_where(of(*loose) & (F.col("value") > 0)).alias("loose"),
        count_where(of(*TASKS) & (F.col("value") == 0)).alias("empty_tasks"),
        count_where(of(*predicates) & (F.col("value") == 0)).alias("unsupported_predicates"),
    )
    whole = F.col("sequence") == "ALL"
    errors = ["missing_shards", "loose_shards", "empty_tasks", "unsupported_predicates"]
    found = each.groupBy("split").agg(
        *[F.sum(F.when(whole, F.col(c))).alias(c) for c in ("objects", "complete_objects", *errors[2:])],
        count_where(~whole & (F.col("objects") == 0)).alias("missing_shards"),
        count_where(~whole & (F.col("loose") > 0)).alias("loose_shards"),
    )
    percent = F.coalesce(100.0 * F.try_divide("complete_objects", "objects"), F.lit(0.0))
    summed = found.withColumns({"complete_percent": percent, "errors": add([F.col(e) for e in errors])})
    verdict = flag(F.col("errors") == 0)

    def long(rows: DataFrame, counters: Sequence[str]) -> DataFrame:
        kept = rows.select("split", F.lit("ALL").alias("sequence"), *[F.col(c).cast("double").alias(c) for c in counters])
        return kept.unpivot(["split", "sequence"], list(counters), "counter", "value")

    of_splits = summed.withColumn("passed", verdict)
    of_all = summed.agg(F.coalesce(F.sum("errors"), F.lit(0)).alias("errors")).select(F.lit("ALL").alias("split"), "errors", verdict.alias("passed"))
    return filled.unionByName(long(of_splits, ["complete_percent", *errors, "errors", "passed"])).unionByName(long(of_all, ["errors", "passed"]))


def audit_errors(audit: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, error, counter): tasks without examples and predicates without positives, per split."""
    names = [*TASKS, *SPATIAL_PREDICATES, *TEMPORAL_PREDICATES]
    wanted = splits.select("split").distinct().withColumn("counter", F.explode(F.array(*[F.lit(n) for n in names])))
    totals = audit.where(F.col("sequence") == "ALL").select("split", "counter", "value")
    empty = wanted.join(totals, ["split", "counter"], "left").where(F.coalesce("value", F.lit(0)) == 0)
    return empty.select(
        "split",
        F.when(F.col("counter").isin(*TASKS), F.lit("empty_task")).otherwise(F.lit("unsupported_predicate")).alias("error"),
        "counter",
    )


def audit_summary(audit: DataFrame, errors: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, objects, complete_objects, complete_percent, errors, passed) of every split, and of all of them as `ALL`.

    A split without objects is 0 percent complete; the audit as a whole passes when no split has an error.
    """
    wanted = splits.select("split").distinct()
    value = [F.sum(F.when(F.col("counter") == c, F.col("value"))).alias(c) for c in ("objects", "complete_objects")]
    counted = audit.where((F.col("sequence") == "ALL") & F.col("counter").isin("objects", "complete_objects"))
    found = errors.groupBy("split").agg(F.count(F.lit(1)).alias("errors"))
    each = (
        wanted.join(counted.groupBy("split").agg(*value), "split", "left")
        .join(found, "split", "left")
        .na.fill(0, ["objects", "complete_objects", "errors"])
    )
    sums = [F.sum(c).alias(c) for c in ("objects", "complete_objects", "errors")]
    rolled = each.rollup("split").agg(*sums).withColumn("split", F.coalesce("split", F.lit("ALL")))
    percent = F.coalesce(100.0 * F.try_divide("complete_objects", "objects"), F.lit(0.0))
    return rolled.withColumns({"complete_percent": percent, "passed": F.col("errors") == 0})


def vocabulary_audit(categories: DataFrame, configured: DataFrame) -> DataFrame:
    """(finding, label): labels that are not configured, never seen, or used with several semantic ids."""
    observed, wanted = categories.select("label").distinct(), configured.select("label").distinct()
    ambiguous = categories.groupBy("label").agg(F.countDistinct("semantic_id").alias("n")).where(F.col("n") > 1)
    parts = [
        observed.exceptAll(wanted).select(F.lit("not_configured").alias("finding"), "label"),
        wanted.exceptAll(observed).select(F.lit("not_observed"), "label"),
        ambiguous.select(F.lit("several_semantic_ids"), "label"),
    ]
    return reduce(DataFrame.union, parts)


def split_overlap(shards: DataFrame) -> DataFrame:
    """Sequences listed under more than one split."""
    return (
        shards.select("sequence", "split")
        .distinct()
        .groupBy("sequence")
        .agg(F.count(F.lit(1)).alias("splits"))
        .where(F.col("splits") > 1)
    )
