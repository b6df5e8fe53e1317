"""Five-step windows of one object and relations between two of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficloom.functions.boxes import box_array, has_area
from trafficloom.functions.numbers import add, clip, count_where, flag
from trafficloom.functions.paths import path_distance as _path
from trafficloom.functions.tokens import stable_token
from trafficloom.operators.checks import resolve_samples
from trafficloom.operators.spatial import encode_labels
from trafficloom.params import EXPLORATORY_PREDICATES, TEMPORAL_PREDICATES, TemporalParams
from trafficloom.plans.balanced import within_reach

ALL_TEMPORAL = (*TEMPORAL_PREDICATES, *EXPLORATORY_PREDICATES)


STEPS = {
    "sample_token": "sample_tokens",
    "annotation_token": "annotation_tokens",
    "raw_frame_index": "raw_frame_indices",
    "filename": "filenames",
    "box": "boxes",
}


def windows(
    obs: DataFrame, samples: DataFrame, size: int = 5, steps: Mapping[str, str] = STEPS
) -> DataFrame:
    """Every run of `size` consecutive samples of one object, with its members as arrays.

    `steps` names what is kept of every member, besides its time and place, and the array it is kept in: what is not asked for is
    neither shuffled nor written. Other names than those of STEPS are columns of `obs`.

    The window function runs per (scene, object): at most as many rows as a scene has samples.
    """
    resolved = resolve_samples(obs, samples)
    over = Window.partitionBy("scene_token", "instance_token").orderBy("sample_index")
    made = {"annotation_token": F.col("token"), "box": box_array()}
    kept = [made.get(c, F.col(c)).alias(c) for c in steps]
    member = F.struct("timestamp_ns", "center_x", "center_y", "center_z", *kept)
    last = size - 1
    spans = resolved.select(
        "scene_token",
        "sequence",
        "instance_token",
        "semantic_id",
        "instance_id",
        "label",
        "dynamic",
        "supervised_eligible",
        F.col("sample_index").alias("start_sample_index"),
        F.lead("sample_index", last).over(over).alias("_end"),
        F.collect_list(member).over(over.rowsBetween(0, last)).alias("steps"),
    ).where(F.col("_end") - F.col("start_sample_index") == last)

    first, final = F.get("steps", F.lit(0)), F.get("steps", F.lit(last))
    timed = spans.withColumn("duration_seconds", (final["timestamp_ns"] - first["timestamp_ns"]) / 1e9).where(
        F.col("duration_seconds") > 0
    )
    velocity = {
        f"velocity_{a}": (final[f"center_{a}"] - first[f"center_{a}"]) / F.col("duration_seconds") for a in "xyz"
    }
    vx, vy = F.col("velocity_x"), F.col("velocity_y")
    moved = timed.withColumns(velocity).withColumn("speed", F.sqrt(vx * vx + vy * vy))
    return moved.select(
        stable_token("tracklet", "scene_token", "start_sample_index", "instance_token").alias("token"),
        "scene_token",
        "sequence",
        "instance_token",
        "semantic_id",
        "instance_id",
        "label",
        "dynamic",
        "supervised_eligible",
        "start_sample_index",
        (F.col("start_sample_index") + size // 2).alias("middle_sample_index"),
        F.col("_end").alias("end_sample_index"),
        *[F.col(f"steps.{c}").alias(name) for c, name in steps.items()],
        F.col("steps.timestamp_ns").alias("timestamps_ns"),
        F.col("steps.center_x").alias("xs"),
        F.col("steps.center_y").alias("ys"),
        F.col("steps.center_z").alias("zs"),
        *([F.transform("steps.box", has_area).alias("visible")] if "box" in steps else []),
        "duration_seconds",
        "velocity_x",
        "velocity_y",
        "velocity_z",
        "speed",
    )


_END = (
    "token instance_token label supervised_eligible annotation_tokens raw_frame_indices filenames boxes visible "
    "xs ys velocity_x velocity_y velocity_z speed"
).split()


MOTION = "token instance_token raw_frame_indices xs ys velocity_x velocity_y velocity_z speed".split()


def candidate_pairs(
    tracks: DataFrame, params: TemporalParams = TemporalParams(), columns: Sequence[str] = _END
) -> DataFrame:
    """Ordered pairs of windows of one scene and start, near each other in the middle, at least one moving.

    `columns` of the windows are kept for both ends, as a_ and b_; `measure_pairs` needs the default, `motion` those of MOTION.
    """
    keys = ["scene_token", "start_sample_index"]
    middle = F.lit(params.window_size // 2)

    def end(prefix: str, *extra: str) -> DataFrame:
        return tracks.select(
            *keys,
            *extra,
            *[F.col(c).alias(f"{prefix}_{c}") for c in columns],
            F.get("xs", middle).alias(f"{prefix}_mid_x"),
            F.get("ys", middle).alias(f"{prefix}_mid_y"),
        )

    moving = F.greatest("a_speed", "b_speed") >= params.minimum_motion_speed
    return within_reach(
        end("a", "sequence", "middle_sample_index"),
        end("b"),
        keys,
        ("a_mid_x", "a_mid_y"),
        ("b_mid_x", "b_mid_y"),
        params.candidate_distance,
        ["a_token"],
        ["b_token"],
        condition=(F.col("a_instance_token") != F.col("b_instance_token")) & moving,
    ).withColumnRenamed("distance", "middle_distance")


def distance_trend(pairs: DataFrame, params: TemporalParams = TemporalParams()) -> DataFrame:
    """Distances per step, their change, and the shares of clearly falling and rising steps."""
    steps = range(params.window_size)

    def distance(i: int) -> Column:
        dx = F.get("a_xs", F.lit(i)) - F.get("b_xs", F.lit(i))
        dy = F.get("a_ys", F.lit(i)) - F.get("b_ys", F.lit(i))
        return F.sqrt(dx * dx + dy * dy)

    listed = pairs.withColumn("relative_distances", F.array(*[distance(i) for i in steps]))
    at = [F.get("relative_distances", F.lit(i)) for i in steps]
    change = [b - a for a, b in zip(at, at[1:])]
    eps = params.step_distance_epsilon
    return listed.withColumns(
        {
            "distance_change": at[-1] - at[0],
            "decreasing_fraction": add([flag(c <= -eps) for c in change]) / float(len(change)),
            "increasing_fraction": add([flag(c >= eps) for c in change]) / float(len(change)),
        }
    )


def radial_speed(pairs: DataFrame) -> DataFrame:
    """Speed of each end along the line towards the other end, at the middle step."""
    dx, dy = F.col("b_mid_x") - F.col("a_mid_x"), F.col("b_mid_y") - F.col("a_mid_y")
    norm = F.col("middle_distance")
    ux, uy = dx / norm, dy / norm
    apart = norm > 1e-6
    return pairs.withColumns(
        {
            "subject_radial_speed": F.when(apart, F.col("a_velocity_x") * ux + F.col("a_velocity_y") * uy).otherwise(0.0),
            "object_radial_speed": F.when(
                apart, F.col("b_velocity_x") * -ux + F.col("b_velocity_y") * -uy
            ).otherwise(0.0),
        }
    )


def _both_moving(params: TemporalParams) -> Column:
    return F.least("a_speed", "b_speed") >= params.minimum_motion_speed


def direction_cosine(pairs: DataFrame, params: TemporalParams = TemporalParams()) -> DataFrame:
    dot = F.col("a_velocity_x") * F.col("b_velocity_x") + F.col("a_velocity_y") * F.col("b_velocity_y")
    cosine = clip(dot / (F.col("a_speed") * F.col("b_speed")), -1.0, 1.0)
    return pairs.withColumn("direction_cosine", F.when(_both_moving(params), cosine).otherwise(0.0))


def path_distance(pairs: DataFrame, params: TemporalParams = TemporalParams()) -> DataFrame:
    """Smallest distance of the two paths, null unless both objects move."""

    return pairs.withColumn("_path", _path("a_xs", "a_ys", "b_xs", "b_ys")).withColumn(
        "path_distance", F.when(_both_moving(params), F.col("_path"))
    )


def visibility(pairs: DataFrame, size: int = 5) -> DataFrame:
    seen = {e: [F.get(f"{e}_visible", F.lit(i)) for i in range(size)] for e in "ab"}
    joint = [a & b for a, b in zip(seen["a"], seen["b"])]
    return pairs.withColumns(
        {
            "subject_visible_steps": add([flag(v) for v in seen["a"]]),
            "object_visible_steps": add([flag(v) for v in seen["b"]]),
            "joint_visible_steps": add([flag(v) for v in joint]),
        }
    )


def review_eligibility(pairs: DataFrame, params: TemporalParams = TemporalParams()) -> DataFrame:
    supervised = F.col("a_supervised_eligible") & F.col("b_supervised_eligible")
    enough = F.col("joint_visible_steps") >= params.minimum_joint_visible_steps
    return pairs.withColumns(
        {
            "supervised_eligible": supervised,
            "review_eligible": supervised & enough,
            "review_reason": F.when(~supervised, F.lit("not_supervised_eligible"))
            .when(~enough, F.lit("insufficient_joint_rgb_visibility"))
            .otherwise(F.lit("eligible")),
        }
    )


def motion(pairs: DataFrame, params: TemporalParams = TemporalParams()) -> DataFrame:
    """The measurements that labels are made from."""
    return path_distance(direction_cosine(radial_speed(distance_trend(pairs, params)), params), params)


def measure_pairs(pairs: DataFrame, params: TemporalParams = TemporalParams()) -> DataFrame:
    return review_eligibility(visibility(motion(pairs, params), params.window_size), params)


def label_pairs(pairs: DataFrame, params: TemporalParams = TemporalParams(), rules: str = "directed") -> DataFrame:
    """The four predicates as boolean columns.

    `directed` asks that the subject itself moves towards or away from the object; `pairwise` looks at the
    distance of the pair only, which makes all four labels symmetric.
    """
    if rules not in ("directed", "pairwise"):
        raise ValueError(f"unknown rules: {rules}")
    both = _both_moving(params)
    subject_moves = F.col("a_speed") >= params.minimum_motion_speed
    radial, cosine = F.col("subject_radial_speed"), F.col("direction_cosine")
    change = F.col("distance_change")
    toward = subject_moves & (radial >= params.minimum_radial_speed)
    away = subject_moves & (radial <= -params.minimum_radial_speed)
    falling = (change <= -params.minimum_distance_change) & (F.col("decreasing_fraction") >= params.trend_fraction)
    rising = (change >= params.minimum_distance_change) & (F.col("increasing_fraction") >= params.trend_fraction)
    crossing = (
        both & (cosine <= params.crossing_max_cosine) & (F.col("path_distance") <= params.crossing_path_distance)
    )
    directed = rules == "directed"
    labels = {
        "approaching": toward & falling if directed else falling,
        "moving_away": away & rising if directed else rising,
        "same_motion_direction": both & (cosine >= params.same_direction_cosine),
        "crossing_path": F.coalesce(crossing, F.lit(False)),
    }
    evidence = {
        "subject_motion_toward_object": toward,
        "subject_motion_away_from_object": away,
        "pair_distance_decreasing": falling,
        "pair_distance_increasing": rising,
    }
    return pairs.withColumns({**evidence, **labels})


def relation_token() -> Column:
    return stable_token("temporal-relation", "a_token", "b_token")


def relations(
    tracks: DataFrame, params: TemporalParams = TemporalParams(), rules: str = "directed"
) -> DataFrame:
    """One row per ordered pair of windows, with measurements, evidence and labels."""
    pairs = measure_pairs(candidate_pairs(tracks, params), params)
    labelled = encode_labels(label_pairs(pairs, params, rules), ALL_TEMPORAL)
    middle = params.window_size // 2
    return labelled.select(
        relation_token().alias("token"),
        "scene_token",
        "sequence",
        "start_sample_index",
        "middle_sample_index",
        F.get("a_raw_frame_indices", F.lit(middle)).alias("middle_raw_frame_index"),
        F.col("a_raw_frame_indices").alias("raw_frame_indices"),
        F.col("a_filenames").alias("filenames"),
        F.col("a_token").alias("subject_tracklet"),
        F.col("b_token").alias("object_tracklet"),
        F.col("a_annotation_tokens").alias("subject_annotation_tokens"),
        F.col("b_annotation_tokens").alias("object_annotation_tokens"),
        F.col("a_instance_token").alias("subject_instance"),
        F.col("b_instance_token").alias("object_instance"),
        F.col("a_label").alias("subject_label"),
        F.col("b_label").alias("object_label"),
        F.col("a_boxes").alias("subject_boxes"),
        F.col("b_boxes").alias("object_boxes"),
        F.col("a_speed").alias("subject_speed"),
        F.col("b_speed").alias("object_speed"),
        *[F.col(f"a_velocity_{x}").alias(f"subject_velocity_{x}") for x in "xyz"],
        *[F.col(f"b_velocity_{x}").alias(f"object_velocity_{x}") for x in "xyz"],
        "subject_radial_speed",
        "object_radial_speed",
        "relative_distances",
        "distance_change",
        "decreasing_fraction",
        "increasing_fraction",
        "subject_motion_toward_object",
        "subject_motion_away_from_object",
        "pair_distance_decreasing",
        "pair_distance_increasing",
        (F.col("subject_motion_toward_object") & F.col("pair_distance_decreasing")).alias("approaching_agreement"),
        (F.col("subject_motion_away_from_object") & F.col("pair_distance_increasing")).alias("moving_away_agreement"),
        "subject_visible_steps",
        "object_visible_steps",
        "joint_visible_steps",
        F.lit(params.minimum_joint_visible_steps).alias("minimum_joint_visible_steps"),
        "review_eligible",
        "review_reason",
        "direction_cosine",
        "path_distance",
        "middle_distance",
        "predicate_vector",
        "positive_predicates",
        "no_relation",
        "supervised_eligible",
        *ALL_TEMPORAL,
    )


def symmetry_violations(
    rels: DataFrame, symmetric: tuple[str, ...] = ("same_motion_direction", "crossing_path")
) -> DataFrame:
    """Pairs whose reverse is missing or carries other symmetric labels."""
    ends = ["subject_tracklet", "object_tracklet"]
    here = rels.select(*ends, *symmetric)
    back = rels.select(
        F.col("object_tracklet").alias("subject_tracklet"),
        F.col("subject_tracklet").alias("object_tracklet"),
        *[F.col(p).alias(f"r_{p}") for p in symmetric],
    )
    differs = F.lit(False)
    for p in symmetric:
        differs = differs | (F.col(p) != F.col(f"r_{p}"))
    missing = F.col(f"r_{symmetric[0]}").isNull()
    return (
        here.join(back, ends, "left")
        .where(missing | differs)
        .select(
            *ends,
            F.when(missing, F.lit("missing_reverse_pair")).otherwise(F.lit("symmetric_label_mismatch")).alias("error"),
        )
    )


def statistics(tracks: DataFrame, rels: DataFrame) -> DataFrame:
    """(counter, value) over windows and relations."""
    of_tracks = tracks.agg(
        F.count(F.lit(1)).alias("tracklet_windows"),
        F.countDistinct("instance_token").alias("tracklet_instances"),
        count_where(F.col("dynamic")).alias("dynamic_tracklet_windows"),
    )
    of_rels = rels.agg(
        F.count(F.lit(1)).alias("relation_candidates"),
        count_where(F.col("no_relation")).alias("no_relation"),
        count_where(F.col("review_eligible")).alias("review_eligible"),
        count_where(F.col("review_reason") == "insufficient_joint_rgb_visibility").alias("insufficient_visibility"),
        *[count_where(F.col(p)).alias(p) for p in ALL_TEMPORAL],
    )
    return of_tracks.unpivot([], of_tracks.columns, "counter", "value").unionByName(
        of_rels.unpivot([], of_rels.columns, "counter", "value")
    )
