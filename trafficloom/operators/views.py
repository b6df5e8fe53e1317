"""Frame selection and per-frame records for display."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficloom.functions.boxes import has_area
from trafficloom.functions.numbers import add, field, flag
from trafficloom.operators.checks import required
from trafficloom.params import SPATIAL_PREDICATES
from trafficloom.plans.ordered import block_scan, running_totals, with_runs

FRAME = ["sequence", "frame"]


def _labels(allowed: Sequence[str]) -> Column:
    return F.array_intersect("positive_predicates", F.array(*[F.lit(a) for a in allowed]))


def frame_support(rels: DataFrame, predicates: Sequence[str] = SPATIAL_PREDICATES) -> DataFrame:
    """Score of a frame: its labels, doubled where both boxes are visible; 0 for frames without labels."""
    both = F.col("subject_visible") & F.col("object_visible")
    points = add([flag(F.col(p)) for p in predicates]) * F.when(both, 2).otherwise(1)
    return rels.groupBy("sequence", F.col("raw_frame_index").alias("frame")).agg(
        F.sum(points).alias("score"), F.min("filename").alias("filename")
    )


def best_window(
    support: DataFrame, sample_count: int, stride: int, start_frame: int | None = None, by: Sequence[str] = ("sequence",)
) -> DataFrame:
    """Frames of the best run of `sample_count` frames per key: highest score, then earliest.

    With `start_frame`, the first full run at or after it. Keys without a full run fail the job. Window sums
    are differences of running sums, met by an equi-join of first and last frame.
    """
    if sample_count <= 0:
        raise ValueError("sample_count must be positive")
    by = list(by)
    runs = with_runs(support.select(*by, "frame", "score"), by, "frame", stride)
    summed = block_scan(runs, by, "frame", sums={"_upto": F.col("score")})
    first = summed.select(*by, "run_index", F.col("frame").alias("start"), (F.col("_upto") - F.col("score")).alias("_before"))
    last = summed.select(
        *by, "run_index", (F.col("frame") - (sample_count - 1) * stride).alias("start"), F.col("_upto").alias("_through")
    )
    full = first.join(last, [*by, "run_index", "start"]).withColumn("window_score", F.col("_through") - F.col("_before"))
    if start_frame is None:
        order = F.struct("window_score", -F.col("start"))
    else:
        full = full.where(F.col("start") >= start_frame)
        order = F.struct(-F.col("start"))
    best = full.groupBy(*by).agg(F.max_by(F.struct("start", "window_score"), order).alias("_best"))
    chosen = support.select(*by).distinct().join(best, by, "left")
    start = required(F.col("_best.start"), F.col("_best").isNotNull(), "no run has enough frames")
    placed = chosen.select(*by, start.alias("_start"), F.col("_best.window_score").alias("window_score"))
    end = F.col("_start") + (sample_count - 1) * stride
    return placed.select(*by, "window_score", F.explode(F.sequence("_start", end, F.lit(stride).cast("long"))).alias("frame"))


def _box(column: str) -> Column:
    return F.when(has_area(F.col(column)), F.col(column))


def temporal_at_middle(rels: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """Labelled temporal relations with frame and boxes of their middle step."""
    place = F.array_position("raw_frame_indices", F.col("middle_raw_frame_index"))
    middle = F.when(place > 0, place - 1).otherwise(F.floor(F.size("raw_frame_indices") / 2)).cast("int")
    return rels.withColumns({"predicates": _labels(predicates), "_at": middle}).where(F.size("predicates") > 0).select(
        "sequence",
        F.col("middle_raw_frame_index").alias("frame"),
        F.col("token").alias("relation_id"),
        "subject_instance",
        "object_instance",
        "subject_label",
        "object_label",
        F.get("subject_boxes", F.col("_at")).alias("subject_box"),
        F.get("object_boxes", F.col("_at")).alias("object_box"),
        "predicates",
        F.col("subject_radial_speed").alias("radial_speed"),
    )


def spatial_at_frame(rels: DataFrame, predicates: Sequence[str] = SPATIAL_PREDICATES) -> DataFrame:
    """Labelled spatial relations by frame."""
    return rels.withColumn("predicates", _labels(predicates)).where(F.size("predicates") > 0).select(
        "sequence",
        F.col("raw_frame_index").alias("frame"),
        F.col("token").alias("relation_id"),
        "subject_instance",
        "object_instance",
        "subject_label",
        "object_label",
        "subject_box",
        "object_box",
        "predicates",
    )


def frame_relations(spatial: DataFrame, temporal: DataFrame) -> DataFrame:
    """Spatial and temporal relations of all frames in one table."""
    return spatial.withColumn("kind", F.lit("spatial")).unionByName(
        temporal.withColumn("kind", F.lit("temporal")), allowMissingColumns=True
    )


def frame_objects(obs: DataFrame, relations: DataFrame) -> DataFrame:
    """Objects per frame from observations and both ends of relations: (frame, key, label, box).

    One row per key: one with a visible box before one without, then observations, spatial and temporal
    relations in this order.
    """
    own = obs.select(
        "sequence",
        F.col("raw_frame_index").alias("frame"),
        F.col("instance_token").alias("key"),
        "label",
        F.array("x1", "y1", "x2", "y2").alias("box"),
        F.lit(0).alias("_source"),
    )
    kind = F.when(F.col("kind") == "spatial", F.lit(1)).otherwise(F.lit(3))

    def end(name: str, shift: int) -> DataFrame:
        return relations.select(
            *FRAME, F.col(f"{name}_instance"), F.col(f"{name}_label"), F.col(f"{name}_box"), (kind + shift)
        )

    stacked = own.union(end("subject", 0)).union(end("object", 1)).withColumn("box", _box("box"))
    order = F.struct(F.col("box").isNull().alias("n"), F.col("_source").alias("s"), F.col("label").alias("l"))
    kept = F.min_by(F.struct("label", "box"), order).alias("_o")
    return stacked.groupBy(*FRAME, "key").agg(kept).select(*FRAME, "key", "_o.label", "_o.box")


def display_ids(objects: DataFrame) -> DataFrame:
    """Names O1, O2, ... within a frame by missing box, left edge, label and key."""
    order = [F.col("box").isNull(), F.coalesce(F.get("box", F.lit(0)), F.lit(1e9)), F.col("label"), F.col("key")]
    numbered = running_totals(objects, FRAME, order, {"_n": F.lit(1).cast("long")})
    return numbered.withColumn("display_id", F.concat(F.lit("O"), F.col("_n"))).drop("_n")


def frame_document(objects: DataFrame, relations: DataFrame, part_rows: int = 4096) -> DataFrame:
    """Nested records of frames as JSON, with totals, keyed by (sequence, frame, part).

    Part p always holds entries p * part_rows to (p + 1) * part_rows - 1 of the frame, at every size, in the order objects,
    spatial and temporal relations by key; so a record is bounded and a small frame's one part is part 0.
    """
    shown = display_ids(objects)
    entries = shown.select(
        *FRAME,
        F.lit("object").alias("_kind"),
        F.col("key").alias("_key"),
        F.struct("display_id", "key", "label", "box").alias("object"),
    ).unionByName(
        relations.select(
            *FRAME,
            F.col("kind").alias("_kind"),
            F.col("relation_id").alias("_key"),
            F.struct("relation_id", "subject_instance", "object_instance", "predicates", "radial_speed").alias("relation"),
        ),
        allowMissingColumns=True,
    )
    numbered = running_totals(entries, FRAME, [F.col("_kind"), F.col("_key")], {"_n": F.lit(1).cast("long")})
    parts = numbered.withColumn("part", F.expr(f"(_n - 1) div {part_rows}"))

    def listed(kind: str, column: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("_kind") == kind, F.struct("_n", column)))).alias(f"_{kind}")

    gathered = parts.groupBy(*FRAME, "part").agg(
        listed("object", "object"), listed("spatial", "relation"), listed("temporal", "relation")
    )
    body = F.struct(
        "sequence",
        "frame",
        *[
            F.transform(f"_{k}", field(c)).alias(n)
            for k, c, n in (("object", "object", "objects"), ("spatial", "relation", "spatial"), ("temporal", "relation", "temporal"))
        ],
    )
    return gathered.select(
        *FRAME,
        "part",
        *[F.size(f"_{k}").cast("long").alias(n) for k, n in (("object", "objects"), ("spatial", "spatial"), ("temporal", "temporal"))],
        F.to_json(body).alias("document"),
    )


_OBJECT = "struct<display_id:string,key:string,label:string,box:array<double>>"
_RELATION = (
    "struct<relation_id:string,subject_instance:string,object_instance:string,predicates:array<string>,radial_speed:double>"
)
_DOCUMENT = f"objects array<{_OBJECT}>, spatial array<{_RELATION}>, temporal array<{_RELATION}>"


def frame_entries(documents: DataFrame) -> DataFrame:
    """The entries of frame documents read back, one row each: kind, position in its list, object or relation."""
    read = documents.select(*FRAME, "part", F.from_json("document", _DOCUMENT, {"mode": "FAILFAST"}).alias("_d"))

    def of(name: str, kind: str, column: str) -> DataFrame:
        return read.select(
            *FRAME, "part", F.lit(kind).alias("kind"), F.posexplode(f"_d.{name}").alias("position", column)
        )

    return (
        of("objects", "object", "object")
        .unionByName(of("spatial", "spatial", "relation"), allowMissingColumns=True)
        .unionByName(of("temporal", "temporal", "relation"), allowMissingColumns=True)
    )
