"""Objects seen in a sample: active boxes, geometry, LiDAR points, masks and usability."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficloom.functions import rigid
from trafficloom.functions.boxes import CORNERS
from trafficloom.functions.numbers import add, all_of, count_where, field, finite
from trafficloom.functions.plane import convex_hull, point
from trafficloom.plans.balanced import balanced_join, during
from trafficloom.plans.ordered import block_scan

BOX_TOLERANCE = 1e-3


def uniform_subset(df: DataFrame, by: Sequence[str], order: str, maximum: int | None) -> DataFrame:
    """`maximum` evenly spaced rows per key in the order of the integer column `order`, repetitions once."""
    if maximum is None:
        return df
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    placed = block_scan(df, by, order, sums={"_p": F.lit(1).cast("long")}).join(sizes, list(by))
    steps = maximum - 1
    if steps > 0:
        # The i-th pick is floor(i * (n-1) / (m-1)); the smallest i that can reach this row decides.
        i = f"(((_p - 1) * {steps} + greatest(_n - 1, 1) - 1) div greatest(_n - 1, 1))"
        picked = F.expr(f"_n <= {maximum} OR ({i} * (_n - 1)) div {steps} = _p - 1")
    else:
        picked = F.col("_p") == 1
    return placed.where(picked).drop("_p", "_n")


def active_boxes(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes of every frame: static ones during their interval, dynamic ones at their time stamp.

    `boxes` has (sequence, document_order, semantic_id, instance_id, dynamic, timestamp, start_frame,
    end_frame). One box per identity and frame: dynamic before static, then the later in document order.
    """
    asked = frames.select("sequence", "frame")
    static = boxes.where(~F.col("dynamic"))
    standing = during(
        asked, static, ["sequence"], "frame", "start_frame", "end_frame", ["frame"], ["document_order"]
    )
    moving = asked.join(
        boxes.where("dynamic").withColumn("frame", F.col("timestamp")), ["sequence", "frame"]
    )
    both = standing.unionByName(moving)
    identity = ["sequence", "frame", "semantic_id", "instance_id"]
    rest = [c for c in boxes.columns if c not in identity]
    kept = F.max_by(F.struct(*rest), F.struct(F.col("dynamic"), F.col("document_order"))).alias("_b")
    return both.groupBy(*identity).agg(kept).select(*identity, "_b.*")


def transform_corners(boxes: DataFrame) -> DataFrame:
    """World and ego corners of boxes, their centre, bounds and footprint.

    Boxes have `transform` (object to world), `vertices` (array of structs x, y, z) and `world_from_ego`. A box whose
    pose or transform is singular has null results; see `corner_failures`.
    """

    def moved(matrix: Column, points: Column) -> Column:
        def one(p: Column) -> Column:
            x, y, z = rigid.apply(matrix, p["x"], p["y"], p["z"])
            return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))

        return F.transform(points, one)

    sound = F.abs(rigid.determinant3(F.col("transform"))) > 1e-12
    world = boxes.withColumn("corners_world", F.when(sound, moved(F.col("transform"), F.col("vertices"))))
    ego = world.withColumn(
        "corners_ego",
        rigid.both(
            rigid.affine_inverse(F.col("world_from_ego")), F.col("corners_world"), lambda m, c: F.when(m.isNotNull(), moved(m, c))
        ),
    )
    count = F.greatest(F.size("corners_ego"), F.lit(1))
    added = {}
    for axis in "xyz":
        values = F.transform("corners_ego", field(axis))
        added[f"min_{axis}"] = F.array_min(values)
        added[f"max_{axis}"] = F.array_max(values)
        added[f"center_{axis}"] = F.when(
            F.col("corners_ego").isNotNull(), F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / count
        )
    lengths = {
        n: F.sqrt(add([rigid.at(F.col("transform"), r, i) * rigid.at(F.col("transform"), r, i) for r in range(3)]))
        for i, n in enumerate(("length", "width", "height"))
    }
    footprint = convex_hull(F.transform("corners_ego", lambda c: point(c["x"], c["y"])))
    return ego.withColumns({**added, **lengths}).withColumns(
        {"hull": footprint, "volume": F.col("length") * F.col("width") * F.col("height")}
    )


def corner_failures(transformed: DataFrame) -> DataFrame:
    return transformed.agg(
        F.count(F.lit(1)).alias("boxes"), count_where(F.col("corners_ego").isNull()).alias("singular_boxes")
    )


def project_box(
    boxes: DataFrame, width: int, height: int, corners: str = "corners_world", near: float = 0.10
) -> DataFrame:
    """Image box (x1..y2), its area and the median depth of the corners in front of the camera.

    Boxes carry `world_from_camera`, `rectification` (4x4) and `projection` (3x4 as 12 numbers). Fewer than
    two corners in front: no box, area 0, no depth; a box without extent in the image: no box, depth kept.
    """
    camera = rigid.both(
        F.col("rectification"), rigid.affine_inverse(F.col("world_from_camera")), lambda r, c: rigid.multiply(r, c)
    )

    def seen(m: Column, p: Column) -> Column:
        x, y, z = rigid.apply(m, p["x"], p["y"], p["z"])
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))

    def pixel(p: Column) -> Column:
        rows = [add([F.get("projection", F.lit(4 * r + i)) * v for i, v in enumerate((p["x"], p["y"], p["z"], F.lit(1.0)))]) for r in range(3)]
        return F.struct((rows[0] / rows[2]).alias("u"), (rows[1] / rows[2]).alias("v"))

    rectified = rigid.let(camera, lambda m: F.transform(F.col(corners), lambda p: seen(m, p)))
    front = boxes.withColumn("_front", F.filter(rectified, lambda p: p["z"] > near)).withColumn(
        "_pixels", F.transform("_front", pixel)
    )
    enough = F.size("_front") >= 2

    def edge(pick, part: str, limit: int) -> Column:
        value = pick(F.transform("_pixels", field(part)))
        return F.least(F.greatest(value, F.lit(0.0)), F.lit(float(limit - 1)))

    depths = F.array_sort(F.transform("_front", lambda p: p["z"]))
    half = F.size("_front")
    low, high = F.floor((half - 1) / 2).cast("int"), F.floor(half / 2).cast("int")
    bounded = front.withColumns(
        {
            "_x1": edge(F.array_min, "u", width),
            "_y1": edge(F.array_min, "v", height),
            "_x2": edge(F.array_max, "u", width),
            "_y2": edge(F.array_max, "v", height),
            "depth": F.when(enough, (F.get(depths, low) + F.get(depths, high)) / 2.0),
        }
    )
    real = enough & (F.col("_x2") > F.col("_x1")) & (F.col("_y2") > F.col("_y1"))
    sized = {c: F.when(real, F.col(f"_{c}")) for c in CORNERS}
    sized["image_area"] = F.when(real, (F.col("_x2") - F.col("_x1")) * (F.col("_y2") - F.col("_y1"))).otherwise(0.0)
    return bounded.withColumns(sized).drop("_front", "_pixels", "_x1", "_y1", "_x2", "_y2")


def leveled(boxes: DataFrame, tolerance: float, cell: float) -> DataFrame:
    """Boxes with the `_level` of the grid they lie in; boxes without bounds are left out."""
    wide = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) + 2 * tolerance
    level = F.when(wide > cell, F.ceil(F.log2(wide / cell))).otherwise(0).cast("int")
    return boxes.withColumn("_level", F.when(wide.isNotNull() & ~F.isnan(wide), level)).where("_level IS NOT NULL")


def box_cells(boxes: DataFrame, tolerance: float, cell: float) -> DataFrame:
    """Boxes once per cell (_level, _cx, _cy) they touch, widened by the tolerance."""
    size = F.lit(cell) * F.pow(F.lit(2.0), F.col("_level"))

    def cells(axis: str) -> Column:
        first, last = (F.floor((F.col(f"{s}_{axis}") + d) / size).cast("long") for s, d in (("min", -tolerance), ("max", tolerance)))
        return F.explode(F.sequence(first, last))

    known = leveled(boxes, tolerance, cell).where("min_x <= max_x AND min_y <= max_y")
    return known.withColumn("_cx", cells("x")).withColumn("_cy", cells("y"))


def object_points(
    points: DataFrame, boxes: DataFrame, tolerance: float = BOX_TOLERANCE, cell: float = 4.0, rotated: bool = False
) -> DataFrame:
    """Points inside boxes of their sample: (token, point_id, x, y, z).

    Boxes have bounds min_x..max_z in the points' frame; `rotated` ones also `local_from_ego` and the local
    bounds local_min_x..local_max_z, which then decide. Boxes and points meet in grid cells, in grids of several levels:
    a box lies in the one whose cells, `cell` times a power of two, are at least as wide as it is, where it touches four
    cells or a few more at their edges. A point is looked up once in every level that boxes use.
    """
    bounds = [f"{s}_{a}" for a in "xyz" for s in ("min", "max")]
    local = ["local_from_ego", *[f"local_{b}" for b in bounds]] if rotated else []
    spread = box_cells(boxes, tolerance, cell).select("sample_token", "token", *bounds, *local, "_level", "_cx", "_cy")
    # one row; there are no more levels than powers of two between the smallest box and the largest
    used = leveled(boxes, tolerance, cell).agg(F.collect_set("_level").alias("_levels"))
    placed = points.crossJoin(F.broadcast(used)).select(
        "sample_token", "point_id", "x", "y", "z", F.explode("_levels").alias("_level")
    )
    size = F.lit(cell) * F.pow(F.lit(2.0), F.col("_level"))
    placed = placed.withColumns({f"_c{a}": F.floor(F.col(a) / size).cast("long") for a in "xy"})
    met = balanced_join(placed, spread, ["sample_token", "_level", "_cx", "_cy"], ["point_id"], ["token"])
    place = rigid.apply(F.col("local_from_ego"), F.col("x"), F.col("y"), F.col("z")) if rotated else [F.col(a) for a in "xyz"]
    prefix = "local_" if rotated else ""
    inside = all_of(
        [
            (v >= F.col(f"{prefix}min_{a}") - tolerance) & (v <= F.col(f"{prefix}max_{a}") + tolerance)
            for a, v in zip("xyz", place)
        ]
    )
    return met.where(inside).select("token", "point_id", "x", "y", "z")


def points_in_box(points: DataFrame, boxes: DataFrame, tolerance: float = BOX_TOLERANCE, rotated: bool = False) -> DataFrame:
    """(token, lidar_points) for every box, 0 included."""
    counted = object_points(points, boxes, tolerance, rotated=rotated).groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    return boxes.select("token").join(counted, "token", "left").select(
        "token", F.coalesce("_n", F.lit(0)).alias("lidar_points")
    )


def mask_histogram(pixels: DataFrame, obs: DataFrame) -> DataFrame:
    """(token, mask_pixels): pixels of the object's own id in the mask of its sample, 0 when absent.

    `pixels` has (sample_token, value), `obs` the `combined_id` to look for.
    """
    counts = pixels.groupBy("sample_token", F.col("value").alias("combined_id")).agg(F.count(F.lit(1)).alias("_n"))
    return (
        obs.select("token", "sample_token", "combined_id")
        .join(counts, ["sample_token", "combined_id"], "left")
        .select("token", F.coalesce("_n", F.lit(0)).alias("mask_pixels"))
    )


def combined_id(semantic: str = "semantic_id", instance: str = "instance_id") -> Column:
    return F.col(semantic) * 1000 + F.col(instance)


def usability(
    obs: DataFrame, minimum_rgb_size: float = 20, minimum_mask_pixels: int = 20, minimum_lidar_points: int = 10
) -> DataFrame:
    """`rgb_usable` and `lidar_usable`; rows with neither are to be dropped."""
    large = (F.col("x2") - F.col("x1") >= minimum_rgb_size) & (F.col("y2") - F.col("y1") >= minimum_rgb_size)
    masked = ~F.col("mask_available") | (F.col("mask_pixels") >= minimum_mask_pixels)
    return obs.withColumns(
        {
            "rgb_usable": F.coalesce(F.col("x1").isNotNull() & large & masked, F.lit(False)),
            "lidar_usable": F.col("lidar_points") >= minimum_lidar_points,
        }
    )


def usability_counts(usable: DataFrame) -> DataFrame:
    rgb, lidar = F.col("rgb_usable"), F.col("lidar_usable")
    counted = usable.agg(
        F.count(F.lit(1)).alias("boxes"),
        count_where(rgb).alias("rgb_usable"),
        count_where(lidar).alias("lidar_usable"),
        count_where(~rgb & ~lidar).alias("unusable"),
    )
    return counted.unpivot([], counted.columns, "counter", "value")


def annotations(usable: DataFrame, posed: DataFrame) -> DataFrame:
    """Observation rows of samples that have a pose, of boxes usable in at least one modality.

    `posed` lists the sample tokens with a pose.
    """
    kept = usable.where(F.col("rgb_usable") | F.col("lidar_usable")).join(
        posed.select("sample_token").distinct(), "sample_token", "left_semi"
    )
    return kept.withColumns(
        {
            "modality_mask": F.array(F.col("rgb_usable").cast("int"), F.col("lidar_usable").cast("int")),
            "supervised_eligible": ~F.lower("label").startswith("unknown"),
        }
    )


def keyframe_files(sample_data: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row per sample with the file of each channel at the key frame."""
    named = [F.max(F.when(F.col("channel") == c, F.col("path"))).alias(c) for c in channels]
    return sample_data.where("is_key_frame").groupBy("sample_token").agg(*named)


def categories(obs: DataFrame) -> DataFrame:
    # Objects are counted on their own rows first, so that a common category does not gather all of them.
    per_object = obs.groupBy("semantic_id", "label", "instance_token").agg(F.count(F.lit(1)).alias("_n"))
    return per_object.groupBy("semantic_id", "label").agg(
        F.sum("_n").alias("observations"), F.count(F.lit(1)).alias("instances")
    )


def instances(obs: DataFrame) -> DataFrame:
    return obs.groupBy("instance_token").agg(
        F.max("dynamic").alias("dynamic"),
        F.min("raw_frame_index").alias("first_frame"),
        F.max("raw_frame_index").alias("last_frame"),
        F.count(F.lit(1)).alias("observations"),
        count_where(F.col("rgb_usable")).alias("rgb_usable"),
        count_where(F.col("lidar_usable")).alias("lidar_usable"),
    )


def crop_window(obs: DataFrame, width: int, height: int) -> DataFrame:
    """Integer crop rectangle crop_x1..crop_y2, null where no crop of at least two pixels each way exists."""

    def within(value: Column, limit: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(limit), value.cast("long")))

    sides = {
        "_x1": within(F.floor("x1"), width - 1),
        "_y1": within(F.floor("y1"), height - 1),
        "_x2": within(F.ceil("x2"), width),
        "_y2": within(F.ceil("y2"), height),
    }
    deep = F.col("depth").isNull() | (F.col("depth") > 0)
    sound = all_of([finite(F.col(c)) for c in CORNERS]) & deep
    guarded = obs.withColumns({n: F.when(sound, v) for n, v in sides.items()})
    real = (F.col("_x2") - F.col("_x1") >= 2) & (F.col("_y2") - F.col("_y1") >= 2)
    return guarded.withColumns({f"crop{n}": F.when(real, F.col(n)) for n in sides}).drop(*sides)


def crop_source(cropped: DataFrame, pixels: DataFrame) -> DataFrame:
    """Whether the mask shows the object inside its crop: `matched_instance_mask`, else `projected_3d_box`.

    `pixels` has (sample_token, px, py, value). Pixels of an id meet only the objects of that id.
    """
    wanted = cropped.where(F.col("crop_x1").isNotNull())
    own = pixels.select("sample_token", F.col("value").alias("combined_id"), "px", "py")
    inside = (
        (F.col("px") >= F.col("crop_x1"))
        & (F.col("px") < F.col("crop_x2"))
        & (F.col("py") >= F.col("crop_y1"))
        & (F.col("py") < F.col("crop_y2"))
    )
    found = (
        wanted.select("token", "sample_token", "combined_id", "crop_x1", "crop_y1", "crop_x2", "crop_y2")
        .join(own, ["sample_token", "combined_id"])
        .where(inside)
        .select("token")
        .distinct()
        .withColumn("_masked", F.lit(True))
    )
    source = F.when(F.col("_masked"), F.lit("matched_instance_mask")).otherwise(F.lit("projected_3d_box"))
    return wanted.join(found, "token", "left").withColumn("crop_source", source).drop("_masked")


def fixed_sample(hits: DataFrame, count: int = 128, minimum: int = 10) -> DataFrame:
    """Exactly `count` points per object in hash order, centred on their mean.

    Objects with fewer than `minimum` points are dropped; one with fewer than `count` repeats its points in
    turn. Only the first `count` ranks of an object reach its task.
    """
    order = Window.partitionBy("token").orderBy(F.md5(F.concat_ws("|", "token", F.col("point_id").cast("string"))), "point_id")
    ranked = hits.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= count)
    sizes = hits.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum)
    turn = F.explode(F.sequence(F.col("_rank") - 1, F.lit(count - 1), F.least("_n", F.lit(count)).cast("int")))
    drawn = ranked.join(sizes, "token").select("token", "point_id", "x", "y", "z", turn.alias("position"))
    over = Window.partitionBy("token")
    return drawn.select(
        "token", "point_id", "position", *[(F.col(a) - F.avg(a).over(over)).alias(a) for a in "xyz"]
    )


def normals(sampled: DataFrame, neighbours: int = 12) -> DataFrame:
    """Surface normal per sampled point: direction of least spread among its nearest neighbours, pointing away from the origin.

    Groups are the sampled points of one object, a fixed number each; of equally near points those of lower position count.
    `breadth` is the spread in the second least direction: where it is zero, the neighbours lie on a line (or are one point) and any
    direction across it will do.
    """

    def of_object(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        xyz = np.column_stack([table.column(a).to_numpy() for a in "xyz"])
        found, breadth = np.zeros_like(xyz), np.zeros(len(xyz))
        if len(xyz) >= 3:
            gaps = ((xyz[:, None, :] - xyz[None, :, :]) ** 2).sum(axis=-1)
            nearest = np.argsort(gaps, axis=1, kind="stable")[:, : min(neighbours, len(xyz))]
            local = xyz[nearest]
            local = local - local.mean(axis=1, keepdims=True)
            spread = np.einsum("nki,nkj->nij", local, local) / max(local.shape[1] - 1, 1)
            sizes, directions = np.linalg.eigh(spread)
            direction, breadth = directions[:, :, 0], np.maximum(sizes[:, 1], 0.0)
            outward = np.where((direction * xyz).sum(axis=1, keepdims=True) < 0, -1.0, 1.0)
            found = direction * outward
            found = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-8)
        result = table.select(["token", "position"])
        for i, name in enumerate(("nx", "ny", "nz")):
            result = result.append_column(name, pa.array(found[:, i]))
        return result.append_column("breadth", pa.array(breadth))

    return sampled.select("token", "position", "x", "y", "z").groupBy("token").applyInArrow(
        of_object, "token string, position int, nx double, ny double, nz double, breadth double"
    )


def decode_points(files: DataFrame) -> DataFrame:
    """Points of binary sweeps: little-endian float32 quadruples x, y, z, intensity.

    `files` has `path` and `content`; a size that is no multiple of 16 fails the job.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if len(content) % 16:
                    raise ValueError(f"not a multiple of 16 bytes: {path}")
                values = np.frombuffer(content, dtype="<f4").reshape(-1, 4)
                columns = [pa.array([path] * len(values), pa.string()), pa.array(np.arange(len(values), dtype=np.int64))]
                columns += [pa.array(values[:, i]) for i in range(4)]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "point_id", "x", "y", "z", "intensity"])

    return files.select("path", "content").mapInArrow(
        rows, "path string, point_id long, x float, y float, z float, intensity float"
    )
