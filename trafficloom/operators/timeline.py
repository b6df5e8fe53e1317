"""Frames, scenes, samples and poses of driving sequences.

A sequence may hold a large share of all frames, so nothing here orders a whole sequence in one task: order
within a sequence goes through `block_scan` / `with_runs`, which cut it by frame number.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficloom.functions import rigid
from trafficloom.functions.numbers import count_where, flag
from trafficloom.functions.tokens import stable_token
from trafficloom.operators.checks import required
from trafficloom.params import CHANNELS, MODALITIES
from trafficloom.plans.ordered import block_scan, exact_median, running_totals, with_runs

DEFAULT_PERIOD_NS = 100_000_000


def complete_sequences(
    rgb: DataFrame, lidar: DataFrame, poses: DataFrame, requested: DataFrame | None = None
) -> DataFrame:
    """Sequences with images, sweeps and poses. A requested one that is not among them fails the job."""
    found = rgb.select("sequence").intersect(lidar.select("sequence")).intersect(poses.select("sequence"))
    if requested is None:
        return found
    asked = requested.select("sequence").distinct().join(found.withColumn("_found", F.lit(True)), "sequence", "left")
    name = required(F.col("sequence"), F.col("_found"), "a requested sequence is incomplete or missing")
    return asked.select(name.alias("sequence"))


def frame_table(channels: DataFrame, names: Sequence[str] = CHANNELS) -> DataFrame:
    """Long channel rows to one row per (sequence, frame): path per channel (null when absent) and sweep time."""

    def of(channel: str, column: str) -> Column:
        return F.max(F.when(F.col("channel") == channel, F.col(column)))

    return channels.groupBy("sequence", "frame").agg(
        *[of(c, "path").alias(c) for c in names], of("LIDAR_TOP", "timestamp_ns").alias("timestamp_ns")
    )


def sync_frames(channels: DataFrame, wanted: Sequence[str] = ("CAM0", "LIDAR_TOP")) -> DataFrame:
    """Frames that have all wanted channels."""
    table = frame_table(channels)
    for channel in wanted:
        table = table.where(F.col(channel).isNotNull())
    return table


def manifest(channels: DataFrame, poses: DataFrame, subsets: DataFrame) -> DataFrame:
    """One record per synchronised frame. `subsets` lists (sequence, frame, subset) with train or val."""
    keys = ["sequence", "frame"]
    posed = poses.select(*keys).distinct().withColumn("_posed", F.lit(True))
    listed = subsets.groupBy(*keys).agg(
        F.max(F.col("subset") == "train").alias("_train"), F.max(F.col("subset") == "val").alias("_val")
    )
    return (
        sync_frames(channels)
        .join(posed, keys, "left")
        .join(listed, keys, "left")
        .select(
            *keys,
            F.col("CAM0").alias("rgb_left"),
            F.col("CAM1").alias("rgb_right"),
            F.col("LIDAR_TOP").alias("lidar"),
            F.col("SEMANTIC_CAM0").alias("semantic"),
            F.col("INSTANCE_CAM0").alias("instance"),
            F.coalesce("_posed", F.lit(False)).alias("exact_refined_pose"),
            F.when(F.col("_train"), F.lit("train"))
            .when(F.col("_val"), F.lit("val"))
            .otherwise(F.lit("unlabelled"))
            .alias("semantic_split"),
        )
    )


def manifest_summary(channels: DataFrame, window: int = 5) -> DataFrame:
    """Files, synchronised frames and full windows per sequence, and over all (`ALL`)."""
    table = frame_table(channels)
    files = table.groupBy("sequence").agg(
        count_where(F.col("CAM0").isNotNull()).alias("left_rgb"),
        count_where(F.col("LIDAR_TOP").isNotNull()).alias("lidar"),
        count_where(F.col("CAM0").isNotNull() & F.col("LIDAR_TOP").isNotNull()).alias("synchronized_frames"),
        count_where(F.col("INSTANCE_CAM0").isNotNull()).alias("instance_masks"),
    )
    full = (
        contiguous_runs(sync_frames(channels).select("sequence", "frame"), ["sequence"], "frame")
        .groupBy("sequence")
        .agg(F.sum(F.greatest(F.col("length") - (window - 1), F.lit(0))).alias("windows"))
    )
    counters = ["left_rgb", "lidar", "synchronized_frames", "instance_masks", "windows"]
    per = files.join(full, "sequence", "left").withColumn("windows", F.coalesce("windows", F.lit(0)))
    return (
        per.rollup("sequence")
        .agg(*[F.sum(c).alias(c) for c in counters])
        .select(F.coalesce(F.col("sequence").cast("string"), F.lit("ALL")).alias("sequence"), *counters)
    )


def contiguous_runs(df: DataFrame, partition: Sequence[str], id_col: str, stride: int = 1) -> DataFrame:
    """Maximal runs of ids that follow each other by `stride`."""
    return (
        with_runs(df, partition, id_col, stride)
        .groupBy(*partition, "run_index")
        .agg(F.min(id_col).alias("start"), F.max(id_col).alias("end"), F.count(F.lit(1)).alias("length"))
    )


def _chunks(frames: DataFrame, scene_frames: int, min_tail_frames: int) -> tuple[DataFrame, DataFrame]:
    """Frames with their piece of a run, and the pieces with `clip_index` counting the accepted ones."""
    cut = with_runs(frames, ["sequence"], "frame").withColumn("chunk", F.expr(f"run_position div {scene_frames}"))
    pieces = cut.groupBy("sequence", "run_index", "run_start", "chunk").agg(
        F.min("frame").alias("start_frame"),
        F.max("frame").alias("end_frame"),
        F.count(F.lit(1)).alias("frames"),
        F.min_by("timestamp_ns", "frame").alias("start_ns"),
        F.max_by("timestamp_ns", "frame").alias("end_ns"),
    )
    long_enough = F.col("frames") >= min(scene_frames, min_tail_frames)
    marked = pieces.withColumns({"complete": F.col("frames") == scene_frames, "long_enough": long_enough})
    counted = block_scan(
        marked, ["sequence"], "start_frame", sums={"_accepted": F.col("long_enough").cast("long")}
    )
    return cut, counted.withColumn("clip_index", F.col("_accepted") - 1).drop("_accepted")


def _scene_token() -> Column:
    return stable_token("scene", "sequence", "clip_index", "start_frame", "end_frame")


def _within(limit: int | None) -> Column:
    return F.lit(True) if limit is None else F.col("clip_index") < limit


def scene_clips(
    frames: DataFrame,
    scene_frames: int = 200,
    min_tail_frames: int = 100,
    max_scenes_per_log: int | None = None,
    sample_stride: int = 5,
) -> DataFrame:
    """Clips of at most `scene_frames` consecutive frames; a short last clip needs `min_tail_frames`."""
    _, pieces = _chunks(frames, scene_frames, min_tail_frames)
    return pieces.where(F.col("long_enough") & _within(max_scenes_per_log)).select(
        _scene_token().alias("token"),
        stable_token("log", "sequence").alias("log_token"),
        "sequence",
        "clip_index",
        "run_index",
        "start_frame",
        "end_frame",
        "frames",
        "start_ns",
        "end_ns",
        ((F.col("end_ns") - F.col("start_ns")) / 1e9).alias("duration_sec"),
        F.expr(f"(frames + {sample_stride - 1}) div {sample_stride}").alias("nbr_samples"),
        "complete",
    )


def rejected_segments(
    frames: DataFrame,
    sequences: DataFrame,
    scene_frames: int = 200,
    min_tail_frames: int = 100,
    max_scenes_per_log: int | None = None,
) -> DataFrame:
    """What did not become a clip, and why. The tail rule is tested before the scene limit."""
    _, pieces = _chunks(frames, scene_frames, min_tail_frames)
    columns = ["sequence", "run_index", "start_frame", "end_frame", "frames", "reason"]
    over = F.col("long_enough") & ~_within(max_scenes_per_log)
    # Once the limit is met inside a run, the rest of that run is one segment, short tail included.
    runs = pieces.groupBy("sequence", "run_index").agg(
        F.min(F.when(over, F.col("start_frame"))).alias("_limit_start"), F.max("end_frame").alias("_run_end")
    )
    limited = runs.where(F.col("_limit_start").isNotNull()).select(
        "sequence",
        "run_index",
        F.col("_limit_start").alias("start_frame"),
        F.col("_run_end").alias("end_frame"),
        (F.col("_run_end") - F.col("_limit_start") + 1).alias("frames"),
        F.lit("development_scene_limit").alias("reason"),
    )
    tails = (
        pieces.where(~F.col("long_enough"))
        .join(runs.where(F.col("_limit_start").isNotNull()), ["sequence", "run_index"], "left_anti")
        .withColumn("reason", F.lit("short_tail"))
        .select(*columns)
    )
    nothing = F.lit(None).cast("long")
    empty = (
        sequences.select("sequence")
        .distinct()
        .join(frames.select("sequence").distinct(), "sequence", "left_anti")
        .select(
            "sequence",
            nothing.alias("run_index"),
            nothing.alias("start_frame"),
            nothing.alias("end_frame"),
            nothing.alias("frames"),
            F.lit("no_synchronized_frames").alias("reason"),
        )
    )
    return empty.unionByName(limited).unionByName(tails)


def clip_frames(
    frames: DataFrame,
    scene_frames: int = 200,
    min_tail_frames: int = 100,
    max_scenes_per_log: int | None = None,
) -> DataFrame:
    """Frames of accepted clips with their scene, place in the clip and size of the clip."""
    cut, pieces = _chunks(frames, scene_frames, min_tail_frames)
    accepted = pieces.where(F.col("long_enough") & _within(max_scenes_per_log)).select(
        "sequence", "run_index", "chunk", _scene_token().alias("scene_token"), F.col("frames").alias("clip_frames")
    )
    return (
        cut.withColumn("raw_index", F.col("run_position") % scene_frames)
        .join(accepted, ["sequence", "run_index", "chunk"])
        .drop("run_index", "run_start", "run_position", "chunk")
    )


def keyframes(clips: DataFrame, sample_stride: int = 5) -> DataFrame:
    """Every `sample_stride`-th frame of a clip. Frames of a clip are consecutive, so the neighbours' tokens
    follow from the frame number."""
    index = F.expr(f"raw_index div {sample_stride}")
    last = F.expr(f"(clip_frames - 1) div {sample_stride}")

    def token(shift: int) -> Column:
        return stable_token("sample", F.col("sequence"), F.col("frame") + shift)

    return clips.where(F.col("raw_index") % sample_stride == 0).select(
        token(0).alias("token"),
        "scene_token",
        "sequence",
        F.col("frame").alias("raw_frame_index"),
        "timestamp_ns",
        index.alias("sample_index"),
        F.when(index > 0, token(-sample_stride)).otherwise(F.lit("")).alias("prev"),
        F.when(index < last, token(sample_stride)).otherwise(F.lit("")).alias("next"),
    )


def frame_to_sample(clips: DataFrame, sample_stride: int = 5) -> DataFrame:
    """Raw frames with the sample they belong to."""
    last = F.expr(f"(clip_frames - 1) div {sample_stride}")
    index = F.least(F.expr(f"raw_index div {sample_stride}"), last)
    key_frame = F.col("frame") - F.col("raw_index") + index * sample_stride
    return clips.withColumns(
        {
            "token": stable_token("raw_frame", "sequence", "frame"),
            "sample_index": index,
            "sample_token": stable_token("sample", F.col("sequence"), key_frame),
            "is_key_frame": F.col("raw_index") % sample_stride == 0,
        }
    )


def sample_data(raw_frames: DataFrame, channels: DataFrame) -> DataFrame:
    """One row per present channel of a frame, linked inside (scene, channel)."""
    modality = F.create_map(*[F.lit(v) for pair in MODALITIES.items() for v in pair])
    own = channels.select("sequence", "frame", "channel", "timestamp_ns", "path", "size")
    rows = raw_frames.select(
        "sequence",
        "frame",
        "scene_token",
        "sample_token",
        F.col("token").alias("raw_frame_token"),
        "is_key_frame",
    ).join(own, ["sequence", "frame"])
    # A scene has at most as many rows per channel as a clip has frames.
    over = Window.partitionBy("scene_token", "channel").orderBy("frame")
    token = stable_token("sample_data", "sequence", "frame", "channel")
    return (
        rows.withColumn("token", token)
        .withColumns(
            {
                "modality": modality[F.col("channel")],
                "calibrated_sensor_token": stable_token("calibrated_sensor", "channel"),
                "prev": F.coalesce(F.lag("token").over(over), F.lit("")),
                "next": F.coalesce(F.lead("token").over(over), F.lit("")),
            }
        )
    )


def nominal_fps(frames: DataFrame) -> DataFrame:
    """Median positive time step per sequence, in whole nanoseconds, and the frame rate it gives."""
    stepped = block_scan(frames, ["sequence"], "frame", lags={"_before": F.col("timestamp_ns")})
    steps = stepped.withColumn("step", F.col("timestamp_ns") - F.col("_before")).where(F.col("step") > 0)
    medians = exact_median(steps.select("sequence", "step"), ["sequence"], "step")
    period = F.coalesce(F.col("median").cast("long"), F.lit(DEFAULT_PERIOD_NS).cast("long"))
    return (
        frames.select("sequence")
        .distinct()
        .join(medians, "sequence", "left")
        .select("sequence", period.alias("period_ns"), (1e9 / period).alias("nominal_fps"))
    )


def pose_asof(frames: DataFrame, poses: DataFrame) -> DataFrame:
    """Nearest pose at or before and at or after every frame.

    `poses` holds (sequence, frame, matrix). Both nearest poses are found in one ordered pass over frames and
    poses together.
    """
    pose = F.struct(F.col("frame"), F.col("matrix"))
    kind = pose.alias("_pose")
    asked = frames.select("sequence", "frame", F.lit(True).alias("_asked"))
    known = poses.select("sequence", "frame", kind)
    both = known.unionByName(asked, allowMissingColumns=True)
    scanned = block_scan(
        both, ["sequence"], "frame", lasts={"left": F.col("_pose")}, nexts={"right": F.col("_pose")}
    ).where(F.col("_asked"))
    left, right = F.col("left.frame"), F.col("right.frame")
    exact = F.coalesce(left == F.col("frame"), F.lit(False))
    between = left.isNotNull() & right.isNotNull()
    return scanned.select(
        "sequence",
        "frame",
        left.alias("left_frame"),
        right.alias("right_frame"),
        F.col("left.matrix").alias("left_matrix"),
        F.col("right.matrix").alias("right_matrix"),
        F.when(exact, F.lit("exact")).when(between, F.lit("interpolated")).otherwise(F.lit("missing")).alias(
            "pose_source"
        ),
        F.when(exact, F.lit(0).cast("long")).when(between, right - left).alias("span_frames"),
    )


def interpolate_pose(bracketed: DataFrame) -> DataFrame:
    """World pose of every frame: straight line for the translation, shortest arc for the rotation."""
    between = F.col("pose_source") == "interpolated"
    alpha = F.when(between, (F.col("frame") - F.col("left_frame")) / (F.col("right_frame") - F.col("left_frame")))
    left, right = F.col("left_matrix"), F.col("right_matrix")
    place = [(1.0 - alpha) * rigid.at(left, i, 3) + alpha * rigid.at(right, i, 3) for i in range(3)]
    turn = rigid.slerp(rigid.quaternion(left), rigid.quaternion(right), alpha)
    found = F.when(F.col("pose_source") == "exact", left).when(between, rigid.from_quaternion(turn, *place))
    return bracketed.withColumn("matrix", found)


def ego_pose(interpolated: DataFrame, velo_from_camera: Sequence[float]) -> DataFrame:
    """Pose of the LiDAR in the world from the camera pose and the fixed calibration."""
    camera_from_velo = rigid.rigid_inverse(F.array(*[F.lit(float(v)) for v in velo_from_camera]))
    posed = interpolated.where(F.col("matrix").isNotNull()).withColumn(
        "world_from_velo", rigid.multiply(F.col("matrix"), camera_from_velo)
    )
    m = F.col("world_from_velo")
    return posed.select(
        stable_token("ego_pose", "sequence", "frame").alias("token"),
        stable_token("raw_frame", "sequence", "frame").alias("raw_frame_token"),
        "sequence",
        "frame",
        *[rigid.at(m, i, 3).alias(n) for i, n in enumerate(("x", "y", "z"))],
        rigid.quaternion(m).alias("rotation_xyzw"),
        "world_from_velo",
        F.col("matrix").alias("world_from_camera"),
        "pose_source",
        "span_frames",
    )


def pose_counts(bracketed: DataFrame) -> DataFrame:
    return bracketed.groupBy("sequence").agg(
        *[count_where(F.col("pose_source") == s).alias(s) for s in ("exact", "interpolated", "missing")]
    )


def sensor_table(rigs: DataFrame) -> DataFrame:
    """Five channel rows per rig.

    A rig row holds 4x4 matrices `velo_from_cam0`, `pose_from_cam0`, `pose_from_cam1`, rectifications
    `rect0`, `rect1` as 4x4, and per camera intrinsics `k0`/`k1`, projections `p0`/`p1`, distortions `d0`/`d1`
    and sizes `size0`/`size1`.
    """
    cam0_from_cam1 = rigid.multiply(rigid.rigid_inverse(F.col("pose_from_cam0")), F.col("pose_from_cam1"))
    chained = rigs.withColumn("_velo_from_cam1", rigid.multiply(F.col("velo_from_cam0"), cam0_from_cam1)).withColumns(
        {
            "_t0": rigid.multiply(F.col("velo_from_cam0"), rigid.rigid_inverse(F.col("rect0"))),
            "_t1": rigid.multiply(F.col("_velo_from_cam1"), rigid.rigid_inverse(F.col("rect1"))),
        }
    )
    identity = rigid.matrix([[1.0 if i == j else 0.0 for j in range(4)] for i in range(4)])
    numbers, whole = "array<double>", "int"

    def row(channel: str, transform: Column, n: str | None) -> Column:
        def camera(name: str, kind: str, index: int | None = None) -> Column:
            if n is None:
                return F.lit(None).cast(kind)
            value = F.col(f"{name}{n}")
            return (value if index is None else F.get(value, F.lit(index))).cast(kind)

        return F.struct(
            F.lit(channel).alias("channel"),
            F.lit(MODALITIES[channel]).alias("modality"),
            transform.alias("ego_from_sensor"),
            rigid.affine_inverse(transform).alias("sensor_from_ego"),
            camera("k", numbers).alias("intrinsic"),
            camera("p", numbers).alias("projection"),
            camera("d", numbers).alias("distortion"),
            camera("size", whole, 0).alias("width"),
            camera("size", whole, 1).alias("height"),
        )

    of = {"CAM0": ("_t0", "0"), "CAM1": ("_t1", "1"), "SEMANTIC_CAM0": ("_t0", "0"), "INSTANCE_CAM0": ("_t0", "0")}
    rows = [row(c, F.col(of[c][0]), of[c][1]) if c in of else row(c, identity, None) for c in CHANNELS]
    return chained.select("rig", F.explode(F.array(*rows)).alias("s")).select(
        stable_token("calibrated_sensor", F.col("rig"), F.col("s.channel")).alias("token"), "rig", "s.*"
    )


def log_summary(frames: DataFrame, scenes: DataFrame) -> DataFrame:
    """One row per sequence: synchronised and accepted frames, first and last scene."""
    of_frames = frames.groupBy("sequence").agg(
        F.min("frame").alias("first_raw_frame"),
        F.max("frame").alias("last_raw_frame"),
        F.count(F.lit(1)).alias("synchronized_frames"),
    )
    of_scenes = scenes.groupBy("sequence").agg(
        F.sum("frames").alias("accepted_raw_frames"),
        F.count(F.lit(1)).alias("scene_count"),
        F.min_by("token", "clip_index").alias("first_scene_token"),
        F.max_by("token", "clip_index").alias("last_scene_token"),
    )
    zero, blank = F.lit(0), F.lit("")
    return of_frames.join(of_scenes, "sequence", "left").select(
        stable_token("log", "sequence").alias("token"),
        "sequence",
        "first_raw_frame",
        "last_raw_frame",
        "synchronized_frames",
        *[F.coalesce(c, zero).alias(c) for c in ("accepted_raw_frames", "scene_count")],
        *[F.coalesce(c, blank).alias(c) for c in ("first_scene_token", "last_scene_token")],
    )


def manifest_hash(files: DataFrame, bits: int = 13) -> DataFrame:
    """Tree digest per sequence over the `path|size` entries in (frame, channel) order.

    A leaf is the SHA-256 of the entries of 2^bits frames, a node the SHA-256 of the hex digests of 2^bits children in
    order, and the root the SHA-256 of the nodes left when all bits of a frame number are used up. Every level is
    always built, so the value is defined alike at any length and no row holds a whole sequence. It is not the
    digest of the plain concatenation.
    """
    rank = F.create_map(*[F.lit(v) for i, c in enumerate(CHANNELS) for v in (c, i)])
    entry = F.concat_ws("|", "path", F.col("size").cast("string"))

    def folded(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        texts = F.transform(F.array_sort(F.collect_list(F.struct("_from", "_r", "_t"))), lambda s: s["_t"])
        return rows.groupBy(*by).agg(F.sha2(F.array_join(texts, ""), 256).alias("_t"))

    level = files.select(
        "sequence", F.col("frame").cast("long").alias("_from"), rank[F.col("channel")].alias("_r"), entry.alias("_t")
    )
    for _ in range(-(-64 // bits)):
        level = folded(level.withColumn("_at", F.shiftright("_from", bits)), ["sequence", "_at"]).select(
            "sequence", F.col("_at").alias("_from"), F.lit(0).alias("_r"), "_t"
        )
    return folded(level, ["sequence"]).select("sequence", F.col("_t").alias("manifest_sha256"))


def _rule(name: str, violations: DataFrame) -> DataFrame:
    return violations.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")


def validate(
    tables: Mapping[str, DataFrame],
    foreign_keys: Sequence[tuple[str, str, str]],
    scene_frames: int = 200,
    sample_stride: int = 5,
) -> DataFrame:
    """(rule, violations) over the timeline tables.

    Every table has a unique `token`; `foreign_keys` lists (table, column, target table), where an empty
    column value refers to nothing. `scenes` and `samples` are also checked for their cutting.
    """
    found = []
    for name, table in tables.items():
        repeated = table.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        found.append(_rule(f"duplicate_token:{name}", repeated))
    for name, column, target in foreign_keys:
        known = tables[target].select(F.col("token").alias(column))
        asked = tables[name].select(column).where(F.col(column) != "")
        found.append(_rule(f"unknown_reference:{name}.{column}", asked.join(known, column, "left_anti")))
    scenes, samples = tables["scenes"], tables["samples"]
    expected = -(-scene_frames // sample_stride)
    found.append(
        _rule("complete_scene_sample_count", scenes.where(F.col("complete") & (F.col("nbr_samples") != expected)))
    )
    ordered = block_scan(scenes, ["sequence"], "start_frame", lags={"_end": F.col("end_frame")})
    found.append(_rule("scene_clips_overlap", ordered.where(F.col("start_frame") <= F.col("_end"))))
    over = Window.partitionBy("scene_token").orderBy("sample_index")
    steps = samples.withColumn("_step", F.col("raw_frame_index") - F.lag("raw_frame_index").over(over))
    found.append(_rule("sample_stride", steps.where(F.col("_step") != sample_stride)))
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def parts_report(reports: DataFrame, expected: DataFrame, counters: Sequence[str]) -> DataFrame:
    """(section, name, value): state of every expected sequence, counters over complete ones, overall result.

    `reports` has one row per built sequence with `passed` and the counters. Value of a state row is 1.
    """
    joined = expected.select("sequence").distinct().join(
        reports.withColumn("_built", F.lit(True)), "sequence", "left"
    )
    state = (
        F.when(F.col("_built").isNull(), F.lit("missing"))
        .when(F.coalesce("passed", F.lit(False)), F.lit("complete"))
        .otherwise(F.lit("failed"))
    )
    stated = joined.withColumn("_state", state)
    complete = F.col("_state") == "complete"
    one_row = stated.agg(
        *[F.coalesce(F.sum(F.when(complete, F.col(c))), F.lit(0)).cast("long").alias(c) for c in counters],
        flag(F.count(F.lit(1)) == count_where(complete)).alias("passed"),
    )
    totals = one_row.unpivot([], [*counters, "passed"], "name", "value")
    return totals.select(
        F.when(F.col("name") == "passed", F.lit("result")).otherwise(F.lit("count")).alias("section"), "name", "value"
    ).unionByName(
        stated.select(
            F.concat(F.lit("sequence:"), "_state").alias("section"),
            F.col("sequence").cast("string").alias("name"),
            F.lit(1).cast("long").alias("value"),
        )
    )


def budget_prefix(files: DataFrame, priority: DataFrame, minimum_bytes: int) -> DataFrame:
    """Whole sequences in priority order until their files reach `minimum_bytes`; a path counts once.

    Fails the job when all sequences together stay below the minimum.
    """
    ranked = files.join(priority, "sequence")
    once = ranked.groupBy("path").agg(
        F.min(F.struct("priority", "sequence")).alias("_owner"), F.max("size").alias("size")
    )
    per = once.groupBy(F.col("_owner.sequence").alias("sequence"), F.col("_owner.priority").alias("priority")).agg(
        F.sum("size").alias("bytes")
    )
    summed = running_totals(per, [], [F.col("priority"), F.col("sequence")], {"cumulative_bytes": F.col("bytes")})
    whole = per.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("_all"))
    reached = required(F.col("cumulative_bytes"), F.col("_all") >= minimum_bytes, "the budget is never reached")
    # The total is one row.
    kept = summed.crossJoin(F.broadcast(whole)).withColumn("cumulative_bytes", reached).drop("_all")
    return kept.where(F.col("cumulative_bytes") - F.col("bytes") < minimum_bytes)


def selection_statistics(selected: DataFrame, frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """Frames, masks and dynamic boxes of the selected sequences."""
    chosen = selected.select("sequence", "bytes", "cumulative_bytes")
    of_frames = frames.groupBy("sequence").agg(
        F.min("frame").alias("start_frame"),
        F.max("frame").alias("end_frame"),
        F.count(F.lit(1)).alias("selected_frames"),
        count_where(F.col("INSTANCE_CAM0").isNotNull()).alias("frames_with_instance_masks"),
    )
    dynamic = (
        boxes.where("dynamic")
        .select("sequence", "frame")
        .join(frames.select("sequence", "frame"), ["sequence", "frame"])
        .groupBy("sequence")
        .agg(F.count(F.lit(1)).alias("dynamic_box_observations"))
    )
    return (
        chosen.join(of_frames, "sequence")
        .join(dynamic, "sequence", "left")
        .withColumn("dynamic_box_observations", F.coalesce("dynamic_box_observations", F.lit(0)))
    )


def split_assign(df: DataFrame, splits: DataFrame) -> DataFrame:
    return df.join(splits.select("sequence", "split"), "sequence", "left").withColumn(
        "split", F.coalesce("split", F.lit("unassigned"))
    )
