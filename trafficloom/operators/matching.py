"""From scored pairs between adjacent samples to links and tracks.

Pair tables hold candidates only, as (keys, source, target, score, source_dustbin, target_dustbin). A pair that
is not a candidate scores far below any dustbin and cannot be chosen, so it needs no row. Sources and targets
are listed in tables of their own, as (keys, source, source_dustbin) and (keys, target, target_dustbin): one
without candidates chooses the dustbin.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficloom.functions.numbers import add, clip, count_where, flag, ratio, sigmoid
from trafficloom.functions.paths import path_distance
from trafficloom.params import TemporalParams
from trafficloom.plans.components import ComponentStore
from trafficloom.plans.components import components as connected
from trafficloom.plans.lookup import lookup
from trafficloom.plans.ordered import positions
from trafficloom.plans.pinning import pin

MISSING = -1
TASK_CELLS = 1 << 20
CHUNK_CELLS = 1 << 16


def _best(scores: DataFrame, everyone: DataFrame, keys: Sequence[str], own: str, other: str) -> DataFrame:
    """Best partner of every row: highest score, then lowest partner; null where the dustbin scores higher."""
    best = scores.groupBy(*keys, own).agg(F.min(F.struct((-F.col("score")).alias("n"), F.col(other))).alias("_best"))
    score, bin_score = -F.col("_best.n"), F.col(f"{own}_dustbin")
    chosen = score >= bin_score
    return everyone.join(best, [*keys, own], "left").select(
        *keys,
        own,
        F.when(chosen, F.col(f"_best.{other}")).alias(other),
        F.when(chosen, score).otherwise(bin_score).alias("score"),
    )


def argmax_choices(
    scores: DataFrame, sources: DataFrame, targets: DataFrame, keys: Sequence[str] = ("sequence", "group")
) -> tuple[DataFrame, DataFrame]:
    """Choice of every source among targets and dustbin, and of every target among sources and dustbin."""
    return _best(scores, sources, keys, "source", "target"), _best(scores, targets, keys, "target", "source")


def mutual_matches(
    source_choices: DataFrame, target_choices: DataFrame, keys: Sequence[str] = ("sequence", "group")
) -> DataFrame:
    """Links on which both ends agree, with the confidence of the pair."""
    back = target_choices.where(F.col("source").isNotNull()).select(*keys, "source", "target")
    both = source_choices.where(F.col("target").isNotNull()).join(back, [*keys, "source", "target"])
    return both.withColumn("confidence", sigmoid(F.col("score")))


def link_checks(links: DataFrame, rows: DataFrame) -> DataFrame:
    """(rule, violations): links stay in one scene and connect adjacent samples."""

    def end(name: str) -> DataFrame:
        return rows.select(
            F.col("row").alias(name), F.col("scene_token").alias(f"_{name}_scene"), F.col("sample_index").alias(f"_{name}_at")
        )

    seen = links.select("source", "target").join(end("source"), "source", "left").join(end("target"), "target", "left")
    same = F.coalesce(F.col("_source_scene") == F.col("_target_scene"), F.lit(False))
    next_to = F.coalesce(F.col("_target_at") == F.col("_source_at") + 1, F.lit(False))
    counted = seen.agg(
        count_where(~same).alias("link_crosses_scene"), count_where(~next_to).alias("link_not_adjacent")
    )
    return counted.unpivot([], counted.columns, "rule", "violations")


def _eligible_links(rows: DataFrame, links: DataFrame) -> DataFrame:
    members = rows.where("eligible").select("row")
    known = links.select("source", "target").distinct()
    for end in ("source", "target"):
        known = known.join(members.withColumnRenamed("row", end), end, "left_semi")
    return known


def numbered(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(row, track_id) from components (node, component) of linked rows; `components` says how tracks are numbered."""
    members = rows.where("eligible").select("row")
    headed = members.join(found, F.col("row") == F.col("node"), "left").select(
        "row", F.coalesce("component", "row").alias("head")
    )
    smallest = headed.groupBy("head").agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ids = pin(positions(smallest, [F.col("_first")], "track_id").drop("_first"))
    told = lookup(headed, ids, "head", "_n", "row").select("row", "track_id")
    return rows.select("row").join(told, "row", "left").withColumn(
        "track_id", F.coalesce("track_id", F.lit(MISSING).cast("long"))
    )


def components(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(row, track_id) for rows with `eligible`; other rows get -1.

    Track ids are dense and follow the smallest row of each track. Links may form chains, rings or anything else.
    """
    return numbered(rows, connected(_eligible_links(rows, links), "source", "target"))


def add_links(store: ComponentStore, rows: DataFrame, links: DataFrame, number: int) -> None:
    """Take a delivery of links into stored components; links of rows that aren't eligible are left out.

    `numbered(rows, store.labels())` are the tracks after it, the same as those of all links at once.
    """
    store.add(_eligible_links(rows, links), "source", "target", number)


def members(rows: DataFrame, tracks: DataFrame) -> DataFrame:
    """Rows on tracks with their frame: the table predicted rows are looked up in."""
    return tracks.where(F.col("track_id") >= 0).join(rows, "row")


def duplicate_rows(members_: DataFrame) -> DataFrame:
    """Tracks that hold two rows of one sample, or one frame."""
    return (
        members_.groupBy("track_id", "scene_token", "sample_index")
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > 1)
    )


def purity(members_: DataFrame) -> DataFrame:
    """Per track: length and share of its most frequent identity."""
    counted = members_.groupBy("track_id", "identity").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("track_id").agg(
        F.sum("n").alias("length"), (F.max("n") / F.sum("n")).alias("purity")
    )


def association_counters(
    source_choices: DataFrame,
    target_choices: DataFrame,
    links: DataFrame,
    truth: DataFrame,
    keys: Sequence[str] = ("sequence", "group"),
    part: str = "sequence",
) -> DataFrame:
    """Decisions and links per part, against `truth` (keys, source, target) of matches that really exist."""
    real = truth.select(*keys, "source", "target")

    def decided(choices: DataFrame, own: str, other: str) -> DataFrame:
        right = real.withColumnRenamed(other, "_true")
        return choices.join(right, [*keys, own], "left").select(
            part, *[k for k in keys if k != part], F.col(other).eqNullSafe(F.col("_true")).alias("_ok")
        )

    decisions = decided(source_choices, "source", "target").unionByName(decided(target_choices, "target", "source"))
    group_keys = [k for k in keys if k != part]
    of_decisions = decisions.groupBy(part).agg(
        F.countDistinct(*group_keys).alias("association_groups"),
        F.count(F.lit(1)).alias("association_decisions"),
        count_where(F.col("_ok")).alias("association_correct"),
    )
    of_truth = real.groupBy(part).agg(F.count(F.lit(1)).alias("true_links"))
    hit = links.join(real.withColumn("_hit", F.lit(True)), [*keys, "source", "target"], "left")
    of_links = hit.groupBy(part).agg(
        F.count(F.lit(1)).alias("predicted_links"), count_where(F.col("_hit")).alias("correct_links")
    )
    joined = of_decisions.join(of_truth, part, "left").join(of_links, part, "left")
    return joined.select(part, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in COUNTERS])


COUNTERS = (
    "association_groups",
    "association_decisions",
    "association_correct",
    "true_links",
    "predicted_links",
    "correct_links",
)


def with_ratios(counters: DataFrame) -> DataFrame:
    c = F.col
    return counters.withColumns(
        {
            "association_accuracy": ratio(c("association_correct"), c("association_decisions")),
            "link_precision": ratio(c("correct_links"), c("predicted_links")),
            "link_recall": ratio(c("correct_links"), c("true_links")),
        }
    )


def report(counters: DataFrame, members_: DataFrame, part: str = "sequence") -> DataFrame:
    """Per part: counters, their ratios, and number, lengths and purity of tracks."""
    identities = members_.groupBy(part, "track_id", "identity").agg(F.count(F.lit(1)).alias("n"))
    tracks = identities.groupBy(part, "track_id").agg(F.sum("n").alias("length"), (F.max("n") / F.sum("n")).alias("purity"))
    of_tracks = tracks.groupBy(part).agg(
        F.count(F.lit(1)).alias("predicted_tracks"),
        F.avg("length").alias("mean_track_length"),
        F.max("length").alias("maximum_track_length"),
        F.avg("purity").alias("identity_purity"),
    )
    return with_ratios(counters).join(of_tracks, part)


def association_summary(counters: DataFrame) -> DataFrame:
    """Counters summed over the parts, then ratios."""
    return with_ratios(counters.agg(*[F.sum(c).alias(c) for c in COUNTERS]))


# Relations on predicted tracks. A relation holds `source_rows`, `target_rows` (five feature rows, -1 where
# missing), `frames` and `timestamps_ns`.


def _at(column: str, i: int) -> Column:
    return F.get(column, F.lit(i))


def track_steps(ends: DataFrame, tracks: DataFrame, rows: DataFrame, size: int = 5) -> DataFrame:
    """`ends` (middle_row, frames, ..) whose middle row is known, with its `track`, and the `predicted_rows` and `spots` of that track at
    the frames; `own` is the middle row's spot. No two ends have the same middle row and first frame."""
    end_keys = ["middle_row", "_start"]
    spot = F.struct("row", "center_x", "center_y", "center_z")
    placed = rows.join(tracks, "row").select("row", "track_id", "frame", spot.alias("spot"))
    spots = placed.where(F.col("track_id") >= 0).select(F.col("track_id").alias("track"), "frame", "spot")
    own = placed.select(F.col("row").alias("middle_row"), F.col("track_id").alias("track"), F.col("spot").alias("own"))
    known = ends.withColumn("_start", _at("frames", 0)).join(own, "middle_row")
    # Ends without a track find nothing; leaving them out keeps them from meeting on one key.
    steps = known.where(F.col("track") >= 0).select(*end_keys, "track", F.posexplode("frames").alias("_step", "frame"))
    looked_up = (
        steps.join(spots, ["track", "frame"])
        .groupBy(*end_keys)
        .agg(*[F.max(F.when(F.col("_step") == i, F.col("spot"))).alias(f"_p{i}") for i in range(size)])
    )
    found = [F.col(f"_p{i}") for i in range(size)]
    return known.join(looked_up, end_keys, "left").select(
        *known.columns,
        F.array(*[F.coalesce(p["row"], F.lit(MISSING)) for p in found]).alias("predicted_rows"),
        F.array(*found).alias("spots"),
    )


def predicted_rows(relations: DataFrame, tracks: DataFrame, rows: DataFrame, size: int = 5) -> DataFrame:
    """Rows that the tracks of the two middle rows hold at the relation's frames, with their centres.

    Many relations share an end, so each end (middle row and frames) is looked up once and joined back. Where the windows
    that relations are made from are at hand, `track_steps` on them before they are paired saves the way back.
    """
    mid = size // 2

    def keyed(end: str) -> list[Column]:
        return [_at(f"{end}_rows", mid).alias("middle_row"), _at("frames", 0).alias("_start")]

    ends = (
        relations.select(*keyed("source"), "frames").union(relations.select(*keyed("target"), "frames")).distinct()
    ).where(F.col("middle_row") >= 0)
    whole = track_steps(ends, tracks, rows, size)

    def prefixed(end: str) -> DataFrame:
        return whole.select(
            F.col("middle_row").alias(f"{end}_middle_row"),
            "_start",
            F.col("track").alias(f"{end}_track"),
            F.col("predicted_rows").alias(f"predicted_{end}_rows"),
            F.col("spots").alias(f"{end}_spots"),
            F.col("own").alias(f"{end}_own"),
        )

    asked = relations.withColumns(
        {
            "source_middle_row": _at("source_rows", mid),
            "target_middle_row": _at("target_rows", mid),
            "_start": _at("frames", 0),
        }
    )
    joined = asked.join(prefixed("source"), ["source_middle_row", "_start"], "left").join(
        prefixed("target"), ["target_middle_row", "_start"], "left"
    )
    nothing = F.array(*[F.lit(MISSING).cast("long") for _ in range(size)])
    fill = {}
    for end in ("source", "target"):
        fill[f"{end}_track"] = F.coalesce(f"{end}_track", F.lit(MISSING).cast("long"))
        fill[f"predicted_{end}_rows"] = F.coalesce(f"predicted_{end}_rows", nothing)
    return joined.drop("_start").withColumns(fill)


def availability(rows: DataFrame, size: int = 5, minimum_steps: int = 3) -> DataFrame:
    """`joint_mask`, `joint_steps`, `unavailable_reason` (first that applies) and `available`."""
    joint = [(_at("predicted_source_rows", i) >= 0) & (_at("predicted_target_rows", i) >= 0) for i in range(size)]
    source, target = F.col("source_track"), F.col("target_track")
    masked = rows.withColumn("joint_mask", F.array(*joint))
    steps = add([_at("joint_mask", i).cast("long") for i in range(size)])
    reason = (
        F.when((source < 0) & (target < 0), F.lit("both_middle_rows_unassigned"))
        .when(source < 0, F.lit("source_middle_row_unassigned"))
        .when(target < 0, F.lit("target_middle_row_unassigned"))
        .when(source == target, F.lit("source_target_track_collision"))
        .when(~_at("joint_mask", size // 2), F.lit("middle_step_missing"))
        .when(F.col("joint_steps") < minimum_steps, F.lit("fewer_than_three_joint_steps"))
        .otherwise(F.lit("available"))
    )
    counted = masked.withColumn("joint_steps", steps).withColumn("unavailable_reason", reason)
    return counted.withColumn("available", F.col("unavailable_reason") == "available")


def availability_by_part(rows: DataFrame, part: str = "sequence") -> DataFrame:
    return rows.groupBy(part).agg(
        F.count(F.lit(1)).alias("relations"),
        count_where(F.col("available")).alias("available"),
        count_where(~F.col("available")).alias("unavailable"),
    )


def fallback_rows(rows: DataFrame, size: int = 5) -> DataFrame:
    """Where the joint middle step is missing, keep the relation's own rows and only their middle step."""
    mid = size // 2
    lost = ~_at("joint_mask", mid)
    changed = {}
    for end in ("source", "target"):
        own = F.array(*[F.col(f"{end}_own") if i == mid else F.lit(None) for i in range(size)])
        changed[f"{end}_used_rows"] = F.when(lost, F.col(f"{end}_rows")).otherwise(F.col(f"predicted_{end}_rows"))
        changed[f"{end}_spots"] = F.when(lost, own).otherwise(F.col(f"{end}_spots"))
    own_middle = (_at("source_rows", mid) >= 0) & (_at("target_rows", mid) >= 0)
    alone = F.array(*[own_middle if i == mid else F.lit(False) for i in range(size)])
    changed["used_mask"] = F.when(lost, alone).otherwise(F.col("joint_mask"))
    return rows.withColumns(changed)


def _filled(values: Sequence[Column], valid: Sequence[Column]) -> list[Column]:
    """Linear fill over the steps; values before the first and after the last valid step are held."""
    n = len(values)
    result = []
    for i in range(n):
        back = [j for j in range(i, -1, -1)]
        ahead = list(range(i, n))
        li = F.coalesce(*[F.when(valid[j], F.lit(j)) for j in back])
        lv = F.coalesce(*[F.when(valid[j], values[j]) for j in back])
        ri = F.coalesce(*[F.when(valid[j], F.lit(j)) for j in ahead])
        rv = F.coalesce(*[F.when(valid[j], values[j]) for j in ahead])
        slope = (rv - lv) / (ri - li)
        result.append(F.when(ri > li, slope * (i - li) + lv).otherwise(F.coalesce(lv, rv)))
    return result


def interpolate_steps(rows: DataFrame, size: int = 5) -> DataFrame:
    """Centres of both ends at all steps (`source_xs`, ... as arrays), filled where a joint step is missing."""
    valid = [_at("used_mask", i) for i in range(size)]
    filled = {}
    for end in ("source", "target"):
        for axis in "xyz":
            values = [_at(f"{end}_spots", i)[f"center_{axis}"] for i in range(size)]
            filled[f"{end}_{axis}s"] = F.array(*_filled(values, valid))
    return rows.withColumns(filled)


def predicted_geometry(rows: DataFrame, params: TemporalParams = TemporalParams()) -> DataFrame:
    """Measurements of a relation from predicted tracks; needs a valid middle step."""
    size = params.window_size
    mid = size // 2
    valid = [_at("used_mask", i) for i in range(size)]

    def gap(i: int, axis: str) -> Column:
        return _at(f"source_{axis}s", i) - _at(f"target_{axis}s", i)

    raw = [F.sqrt(gap(i, "x") * gap(i, "x") + gap(i, "y") * gap(i, "y")) for i in range(size)]
    held = rows.withColumn("_raw", F.array(*raw))
    spread = held.withColumn("distances", F.array(*_filled([_at("_raw", i) for i in range(size)], valid)))
    first = F.coalesce(*[F.when(valid[i], F.lit(i)) for i in range(size)])
    last = F.coalesce(*[F.when(valid[i], F.lit(i)) for i in reversed(range(size))])
    timed = spread.withColumns({"_first": first, "_last": last}).withColumn(
        "_seconds",
        (F.get("timestamps_ns", F.col("_last")) - F.get("timestamps_ns", F.col("_first"))) / 1e9,
    )
    moving = F.coalesce(F.col("_seconds") > 0, F.lit(False))
    velocities = {}
    for end in ("source", "target"):
        for axis in "xyz":
            path = f"{end}_{axis}s"
            step = F.get(path, F.col("_last")) - F.get(path, F.col("_first"))
            velocities[f"{end}_velocity_{axis}"] = F.when(moving, step / F.col("_seconds")).otherwise(0.0)
    sped = timed.withColumns(velocities).withColumns(
        {
            f"{end}_speed": F.sqrt(
                F.col(f"{end}_velocity_x") * F.col(f"{end}_velocity_x")
                + F.col(f"{end}_velocity_y") * F.col(f"{end}_velocity_y")
            )
            for end in ("source", "target")
        }
    )
    d = [_at("distances", i) for i in range(size)]
    change = [b - a for a, b in zip(d, d[1:])]
    eps = params.step_distance_epsilon
    c = F.col
    both = F.least("source_speed", "target_speed") >= params.minimum_motion_speed
    dot = c("source_velocity_x") * c("target_velocity_x") + c("source_velocity_y") * c("target_velocity_y")
    dx, dy = -gap(mid, "x"), -gap(mid, "y")
    norm = _at("_raw", mid)
    apart = norm > 1e-6

    share = add([v.cast("long") for v in valid]) / float(size)
    measured = {
        "distance_change": d[-1] - d[0],
        "decreasing_fraction": add([flag(x <= -eps) for x in change]) / float(len(change)),
        "increasing_fraction": add([flag(x >= eps) for x in change]) / float(len(change)),
        "source_radial_speed": F.when(
            apart, c("source_velocity_x") * (dx / norm) + c("source_velocity_y") * (dy / norm)
        ).otherwise(0.0),
        "target_radial_speed": F.when(
            apart, c("target_velocity_x") * -(dx / norm) + c("target_velocity_y") * -(dy / norm)
        ).otherwise(0.0),
        "direction_cosine": F.when(both, clip(dot / (c("source_speed") * c("target_speed")), -1.0, 1.0)).otherwise(0.0),
        "middle_distance": d[mid],
        "visible_fraction": share,
        "path_distance": F.when(both, F.col("_path")).otherwise(0.0),
    }
    # Filled-in steps lie on the paths or repeat their ends, so the filled paths are the observed ones.
    paths = path_distance("source_xs", "source_ys", "target_xs", "target_ys", touching_counts=True)
    return sped.withColumn("_path", paths).withColumns(measured).drop("_path", "_raw", "_first", "_last", "_seconds")


GEOMETRY = (
    "distance_change decreasing_fraction increasing_fraction source_speed target_speed source_velocity_x "
    "source_velocity_y source_velocity_z target_velocity_x target_velocity_y target_velocity_z source_radial_speed "
    "target_radial_speed direction_cosine middle_distance visible_fraction path_distance"
).split()


def geometry_vector(measured: DataFrame, size: int = 5) -> DataFrame:
    """The 24 numbers in their fixed order; the visible share stands for all three visibility entries."""
    plain = [F.col(n) for n in GEOMETRY[:15]] + [F.col("visible_fraction")] * 3 + [F.col("path_distance")]
    vector = F.array(*[_at("distances", i) for i in range(size)], *plain)
    return measured.withColumn("geometry", vector.cast("array<float>"))


def _normalised(value: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of every code, given to each of its entries."""
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    length = np.diff(np.append(starts, len(codes)))
    top = np.maximum.reduceat(value[order], starts)
    summed = top + np.log(np.add.reduceat(np.exp(value[order] - np.repeat(top, length)), starts))
    out = np.empty(len(value))
    out[order] = np.repeat(summed, length)
    return out


def _balanced_groups(keys: Sequence[str], iterations: int):
    """All rounds for the groups of a partition, some whole groups at a time."""

    def weights(cells: pa.Table) -> pa.RecordBatch:
        frame = cells.select([*keys, "_i", "_j"]).to_pandas()
        rows = frame.groupby([*keys, "_i"], sort=False, dropna=False).ngroup().to_numpy()
        columns = frame.groupby([*keys, "_j"], sort=False, dropna=False).ngroup().to_numpy()
        value = cells.column("_s").to_numpy()
        u = v = np.zeros(len(value))
        for _ in range(iterations):
            u = _normalised(value - v, rows)
            v = _normalised(value - u, columns)
        whole = cells.drop_columns(["_s"]).append_column("weight", pa.array(np.exp(value - u - v)))
        return whole.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK_CELLS:
                cells = pa.Table.from_batches(held)
                last = [cells.column(k)[-1] for k in keys]
                # the last group may go on
                same = np.ones(cells.num_rows, dtype=bool)
                for k, value in zip(keys, last, strict=True):
                    column = cells.column(k)
                    equal = pc.equal(column, value) if value.is_valid else pc.is_null(column)
                    same &= pc.fill_null(equal, False).to_numpy()
                open_from = int(np.argmax(same))
                if open_from:
                    yield weights(cells.slice(0, open_from))
                held = cells.slice(open_from).combine_chunks().to_batches()
                size = sum(b.num_rows for b in held)
        if size:
            yield weights(pa.Table.from_batches(held))

    return run


def sinkhorn(
    scores: DataFrame,
    sources: DataFrame,
    targets: DataFrame,
    keys: Sequence[str] = ("sequence", "group"),
    temperature: float = 0.10,
    iterations: int = 8,
    corner: float = 0.0,
    task_cells: int = TASK_CELLS,
) -> DataFrame:
    """Soft assignment over candidates and dustbins; `source` or `target` is null for a dustbin.

    The normalisations subtract one number per source row and one per target column, so only these two vectors change
    from round to round. Pairs without a row weigh exp(-1e5) = 0. Groups of up to `task_cells` cells go through all rounds in
    one task each, after one exchange; larger ones have every round distributed.
    """
    keys = list(keys)
    none = F.lit(MISSING).cast("long")
    i, j = F.col("source").cast("long").alias("_i"), F.col("target").cast("long").alias("_j")
    corners = sources.select(*keys).union(targets.select(*keys)).distinct()
    cells = (
        scores.select(*keys, i, j, F.col("score").cast("double").alias("_s"))
        .union(sources.select(*keys, i, none.alias("_j"), F.col("source_dustbin")))
        .union(targets.select(*keys, none.alias("_i"), j, F.col("target_dustbin")))
        .union(corners.select(*keys, none.alias("_i"), none.alias("_j"), F.lit(corner)))
    )
    scaled = pin(cells.withColumn("_s", F.col("_s") / temperature))
    sized = scaled.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = pin(sized.where(F.col("_n") > task_cells).drop("_n"))

    def shown(column: str) -> Column:
        return F.when(F.col(column) != MISSING, F.col(column))

    def told(found: DataFrame) -> DataFrame:
        return found.select(*keys, shown("_i").alias("source"), shown("_j").alias("target"), "weight")

    if large.isEmpty():
        small, rest = scaled, None
    else:
        # at most one large group per `task_cells` cells
        small = scaled.join(F.broadcast(large), keys, "left_anti")
        rest = _by_rounds(pin(scaled.join(F.broadcast(large), keys, "left_semi")), keys, iterations)
    schema = T.StructType([*small.drop("_s").schema.fields, T.StructField("weight", T.DoubleType())])
    inside = small.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_balanced_groups(keys, iterations), schema)
    return told(inside if rest is None else inside.unionByName(rest))


def _by_rounds(scaled: DataFrame, keys: list[str], iterations: int) -> DataFrame:
    """(*keys, _i, _j, weight) of groups that no task holds as a whole, one distributed round after the other."""
    row_id, column_id = [*keys, "_i"], [*keys, "_j"]

    def log_sums(ids: list[str], value: Column, rows: DataFrame, name: str) -> DataFrame:
        """Log of the sum of exponentials per id: the largest value first, then the rest relative to it."""
        top = rows.groupBy(*ids).agg(F.max(value).alias("_top"))
        return (
            rows.join(top, ids)
            .groupBy(*ids)
            .agg((F.max("_top") + F.log(F.sum(F.exp(value - F.col("_top"))))).alias(name))
        )

    over_rows = over_columns = None
    for _ in range(iterations):
        shifted = scaled if over_columns is None else scaled.join(over_columns, column_id)
        value = F.col("_s") if over_columns is None else F.col("_s") - F.col("_v")
        # pinned once per round; the last row sums are only read twice
        over_rows = log_sums(row_id, value, shifted, "_u")
        over_columns = pin(log_sums(column_id, F.col("_s") - F.col("_u"), scaled.join(over_rows, row_id), "_v"))
    finished = scaled.join(over_rows, row_id).join(over_columns, column_id)
    return finished.select(*keys, "_i", "_j", F.exp(F.col("_s") - F.col("_u") - F.col("_v")).alias("weight"))
