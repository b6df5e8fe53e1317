"""Relations between objects seen in the same sample."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from trafficloom.functions.boxes import box_array, has_area, overlap_over_smaller
from trafficloom.functions.numbers import add, all_of, count_where, finite, flag
from trafficloom.functions.plane import area, intersection, polygon_distance
from trafficloom.functions.tokens import stable_token
from trafficloom.params import ASYMMETRIC_SPATIAL, SPATIAL_PREDICATES, SYMMETRIC_SPATIAL, SpatialParams
from trafficloom.plans.balanced import within_reach
from trafficloom.sources.writers import gathered

# Columns of an observation that the pair needs from both ends.
_OBJECT = (
    "token instance_token label center_x center_y center_z min_x max_x min_y max_y min_z max_z volume "
    "x1 y1 x2 y2 box visible depth mask_pixels mask_available supervised_eligible"
).split()
_SHARED = ("sequence", "raw_frame_index", "filename")


_GEOMETRY = [c for c in _OBJECT if c.startswith(("center_", "min_", "max_"))]


def _solid(obs: DataFrame) -> DataFrame:
    """Objects with geometry, every number without null, so that the pair stage needs no null checks.

    A missing image box becomes an empty one at the origin (the array `box` stays null) and a depth that is
    missing or not finite becomes NaN; both are settled here, once per object and not once per pair.
    """
    nan, zero = F.lit(float("nan")), F.lit(0.0)
    plain = {c: F.coalesce(F.col(c), nan) for c in [*_GEOMETRY, "volume"]}
    boxes = {c: F.coalesce(F.col(c), zero) for c in ("x1", "y1", "x2", "y2")}
    rest = {
        "depth": F.coalesce(F.when(finite(F.col("depth")), F.col("depth")), nan),
        "mask_pixels": F.coalesce("mask_pixels", F.lit(0)),
        "mask_available": F.coalesce("mask_available", F.lit(False)),
        "supervised_eligible": F.coalesce("supervised_eligible", F.lit(False)),
    }
    return obs.where(all_of([F.col(c).isNotNull() for c in _GEOMETRY])).withColumn("box", box_array()).withColumns(
        {**plain, **boxes, **rest, "visible": has_area(F.col("box"))}
    )


def candidate_pairs(obs: DataFrame, candidate_distance: float = 30.0) -> DataFrame:
    """Ordered pairs of different objects of one sample, at most `candidate_distance` apart in the plane.

    Ends come with prefixes a_ (subject) and b_ (object). A `hull` column, where present, is kept.
    """
    obs = _solid(obs)
    carried = [c for c in [*_OBJECT, "hull"] if c in obs.columns]
    a = obs.select("sample_token", *_SHARED, *[F.col(c).alias(f"a_{c}") for c in carried])
    b = obs.select("sample_token", *[F.col(c).alias(f"b_{c}") for c in carried])
    return within_reach(
        a,
        b,
        ["sample_token"],
        ("a_center_x", "a_center_y"),
        ("b_center_x", "b_center_y"),
        candidate_distance,
        ["a_token"],
        ["b_token"],
        condition=F.col("a_token") != F.col("b_token"),
    ).withColumnRenamed("distance", "center_distance")


def _extent(end: str, axis: str) -> Column:
    return F.col(f"{end}_max_{axis}") - F.col(f"{end}_min_{axis}")


def _shared_range(axis: str) -> Column:
    """Signed overlap of the two boxes' ranges on an axis; negative when apart."""
    return F.least(F.col(f"a_max_{axis}"), F.col(f"b_max_{axis}")) - F.greatest(
        F.col(f"a_min_{axis}"), F.col(f"b_min_{axis}")
    )


def bev_overlap(pairs: DataFrame, rotated: bool = False) -> DataFrame:
    """Footprint intersection, IoU and distance. Pairs with a flat footprint are dropped.

    Axis-aligned boxes need only their bounds; `rotated` clips the convex `a_hull` and `b_hull`.
    """
    zero = F.lit(0.0)
    if rotated:
        sized = pairs.withColumns({"_aa": area(F.col("a_hull")), "_ab": area(F.col("b_hull"))})
        kept = sized.where((F.col("_aa") > 0) & (F.col("_ab") > 0))
        common = kept.withColumn("_common", intersection(F.col("a_hull"), F.col("b_hull")))
        measured = common.withColumns(
            {
                "bev_intersection": area(F.col("_common")),
                "box_distance": F.when(F.size("_common") > 0, zero).otherwise(
                    polygon_distance(F.col("a_hull"), F.col("b_hull"))
                ),
            }
        ).drop("_common")
    else:
        sized = pairs.withColumns(
            {"_aa": _extent("a", "x") * _extent("a", "y"), "_ab": _extent("b", "x") * _extent("b", "y")}
        )
        kept = sized.where((F.col("_aa") > 0) & (F.col("_ab") > 0))
        dx, dy = _shared_range("x"), _shared_range("y")
        gap_x, gap_y = F.greatest(zero, -dx), F.greatest(zero, -dy)
        measured = kept.withColumns(
            {
                "bev_intersection": F.greatest(zero, dx) * F.greatest(zero, dy),
                "box_distance": F.sqrt(gap_x * gap_x + gap_y * gap_y),
            }
        )
    union = F.col("_aa") + F.col("_ab") - F.col("bev_intersection")
    return measured.withColumn(
        "bev_iou", F.when(union > 0, F.col("bev_intersection") / union).otherwise(zero)
    ).drop("_aa", "_ab")


def vertical_overlap(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns(
        {
            "vertical_overlap": F.greatest(F.lit(0.0), _shared_range("z")),
            "a_height": F.greatest(_extent("a", "z"), F.lit(1e-6)),
            "b_height": F.greatest(_extent("b", "z"), F.lit(1e-6)),
        }
    )


def margins(pairs: DataFrame, params: SpatialParams = SpatialParams()) -> DataFrame:
    def margin(least: float, axis: str) -> Column:
        return F.greatest(F.lit(least), 0.25 * (_extent("a", axis) + _extent("b", axis)))

    return pairs.withColumns(
        {
            "lateral_margin": margin(params.lateral_min_margin, "y"),
            "longitudinal_margin": margin(params.longitudinal_min_margin, "x"),
        }
    )


def image_overlap(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("image_overlap", overlap_over_smaller("a_", "b_"))


def measure_pairs(pairs: DataFrame, params: SpatialParams = SpatialParams(), rotated: bool = False) -> DataFrame:
    """All measurements of a pair; one projection chain that Spark collapses."""
    measured = image_overlap(margins(vertical_overlap(bev_overlap(pairs, rotated)), params))
    enough = F.lit(params.minimum_mask_pixels)
    masked = F.lit(True)
    for end in "ab":
        masked = masked & F.col(f"{end}_mask_available") & (F.col(f"{end}_mask_pixels") >= enough)
    small = F.lit(1e-6)
    return measured.withColumns(
        {
            "delta_x": F.col("a_center_x") - F.col("b_center_x"),
            "delta_y": F.col("a_center_y") - F.col("b_center_y"),
            "delta_z": F.col("a_center_z") - F.col("b_center_z"),
            "occlusion_mask_supported": masked,
            "volume_ratio": F.greatest(F.col("a_volume"), small) / F.greatest(F.col("b_volume"), small),
            "height_ratio": F.col("a_height") / F.col("b_height"),
        }
    )


def label_pairs(pairs: DataFrame, params: SpatialParams = SpatialParams()) -> DataFrame:
    """The five predicates as boolean columns."""
    local = F.col("center_distance") <= params.relation_distance
    # NaN sorts above all numbers: an unknown depth of the subject never lies in front.
    deeper = F.col("a_depth") + params.occlusion_depth_margin < F.col("b_depth")
    labels = {
        "left_of": local & (F.col("delta_y") > F.col("lateral_margin")),
        "in_front_of": local & (F.col("delta_x") > F.col("longitudinal_margin")),
        "near": F.col("box_distance") <= params.near_distance,
        "overlapping": (F.col("bev_iou") >= params.overlap_bev_iou)
        & (F.col("vertical_overlap") >= params.overlap_vertical),
        "occluding": F.col("occlusion_mask_supported")
        & (F.col("image_overlap") >= params.occlusion_overlap)
        & ~F.isnan("b_depth")
        & deeper,
    }
    return pairs.withColumns(labels)


def encode_labels(df: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """`predicate_vector`, `positive_predicates` and `no_relation` from boolean columns.

    Both arrays are looked up in constant tables by the labels' bit pattern: building them row by row would
    push the generated code of the pair stage over the size the JVM compiles.
    """
    patterns = range(1 << len(predicates))

    def table(entry) -> Column:
        return F.array(*[entry([i for i in range(len(predicates)) if pattern >> i & 1]) for pattern in patterns])

    def vector(chosen: list[int]) -> Column:
        return F.array(*[F.lit(int(i in chosen)) for i in range(len(predicates))])

    def names(chosen: list[int]) -> Column:
        return F.array(*[F.lit(predicates[i]) for i in chosen]).cast("array<string>")

    bits = add([F.col(p).cast("int") * (1 << i) for i, p in enumerate(predicates)])
    return df.withColumn("_bits", bits).withColumns(
        {
            "predicate_vector": F.get(table(vector), F.col("_bits")),
            "positive_predicates": F.get(table(names), F.col("_bits")),
            "no_relation": F.col("_bits") == 0,
        }
    )


def relations(obs: DataFrame, params: SpatialParams = SpatialParams(), rotated: bool = False) -> DataFrame:
    """One row per ordered pair within the candidate distance, with measurements and labels."""
    pairs = candidate_pairs(obs, params.candidate_distance)
    labelled = encode_labels(label_pairs(measure_pairs(pairs, params, rotated), params), SPATIAL_PREDICATES)
    return labelled.select(
        stable_token("spatial-relation", "sample_token", "a_token", "b_token").alias("token"),
        "sample_token",
        *_SHARED,
        F.col("a_token").alias("subject_token"),
        F.col("b_token").alias("object_token"),
        F.col("a_instance_token").alias("subject_instance"),
        F.col("b_instance_token").alias("object_instance"),
        F.col("a_label").alias("subject_label"),
        F.col("b_label").alias("object_label"),
        F.col("a_box").alias("subject_box"),
        F.col("b_box").alias("object_box"),
        F.col("a_visible").alias("subject_visible"),
        F.col("b_visible").alias("object_visible"),
        "delta_x",
        "delta_y",
        "delta_z",
        "center_distance",
        "box_distance",
        "bev_intersection",
        "bev_iou",
        "vertical_overlap",
        "image_overlap",
        F.col("a_mask_pixels").alias("subject_mask_pixels"),
        F.col("b_mask_pixels").alias("object_mask_pixels"),
        "occlusion_mask_supported",
        "lateral_margin",
        "longitudinal_margin",
        "volume_ratio",
        "height_ratio",
        *SPATIAL_PREDICATES,
        "predicate_vector",
        "positive_predicates",
        "no_relation",
        (F.col("a_supervised_eligible") & F.col("b_supervised_eligible")).alias("supervised_eligible"),
    )


def canonical_violations(rels: DataFrame) -> DataFrame:
    """Every pair must have its reverse, symmetric labels must agree, asymmetric ones must not both hold.

    One row per violated rule and pair; of the symmetric and of the asymmetric predicates the first one in
    vocabulary order is reported.
    """
    ends = ["sample_token", "subject_token", "object_token"]
    here = rels.select(*ends, *SPATIAL_PREDICATES)
    back = rels.select(
        "sample_token",
        F.col("object_token").alias("subject_token"),
        F.col("subject_token").alias("object_token"),
        *[F.col(p).alias(f"r_{p}") for p in SPATIAL_PREDICATES],
    )
    both = here.join(back, ends, "left")
    missing = F.col(f"r_{SPATIAL_PREDICATES[0]}").isNull()

    def first(names: Sequence[str], test) -> Column:
        return F.coalesce(*[F.when(test(F.col(n), F.col(f"r_{n}")), F.lit(n)) for n in names])

    def finding(error: str, predicate: Column) -> Column:
        return F.struct(F.lit(error).alias("error"), predicate.alias("predicate"))

    symmetric = first(SYMMETRIC_SPATIAL, lambda a, b: a != b)
    asymmetric = first(ASYMMETRIC_SPATIAL, lambda a, b: a & b)
    findings = F.array(
        F.when(missing, finding("missing_reverse_pair", F.lit(""))),
        F.when(symmetric.isNotNull(), finding("symmetric_predicate_mismatch", symmetric)),
        F.when(asymmetric.isNotNull(), finding("asymmetric_predicate_true_in_both_directions", asymmetric)),
    )
    return both.select(
        *ends, F.explode(F.filter(findings, lambda f: f.isNotNull())).alias("f")
    ).select(*ends, "f.error", "f.predicate")


def statistics(rels: DataFrame, predicates: Sequence[str] = SPATIAL_PREDICATES) -> DataFrame:
    """Per predicate: relations, relations without any label, positives and positive rate in percent."""
    one_row = rels.agg(
        F.count(F.lit(1)).alias("relations"),
        count_where(F.col("no_relation")).alias("no_relation"),
        *[count_where(F.col(p)).alias(p) for p in predicates],
    )
    return one_row.unpivot(["relations", "no_relation"], list(predicates), "predicate", "positives").withColumn(
        "positive_rate_percent",
        F.when(F.col("relations") > 0, 100.0 * F.col("positives") / F.col("relations")).otherwise(F.lit(0.0)),
    )


def support_flags(stats: DataFrame, rare_below: int = 100) -> DataFrame:
    """Predicates that have too few positives, and those that have none."""
    return stats.where(F.col("positives") < rare_below).select(
        "predicate",
        "positives",
        F.when(F.col("positives") == 0, F.lit("unsupported")).otherwise(F.lit("rare")).alias("support"),
    )


def part_counters(rels: DataFrame, predicates: Sequence[str] = SPATIAL_PREDICATES, part: str = "sequence") -> DataFrame:
    """Counters of every part in long form, the shape the part reports are merged from."""
    counted = rels.groupBy(part).agg(
        F.count(F.lit(1)).alias("relation_candidates"),
        count_where(F.col("no_relation")).alias("no_relation"),
        *[count_where(F.col(p)).alias(p) for p in predicates],
    )
    names = ["relation_candidates", "no_relation", *predicates]
    return counted.unpivot([part], names, "counter", "value")


def parts_summary(
    counters: DataFrame,
    expected: DataFrame,
    part: str = "sequence",
    versions: DataFrame | None = None,
    wanted_version: str | None = None,
) -> DataFrame:
    """Counters summed over the parts, and what is wrong with the set of parts.

    Rows are (section, name, value): `total` rows, and `missing` / `unexpected` / `schema` rows counting
    findings; `passed` is 1 when nothing was found.
    """
    totals = counters.groupBy("counter").agg(F.sum("value").alias("value"))
    found, wanted = counters.select(part).distinct(), expected.select(part).distinct()
    findings = [
        wanted.join(found, part, "left_anti").select(F.lit("missing").alias("section"), F.col(part).cast("string")),
        found.join(wanted, part, "left_anti").select(F.lit("unexpected"), F.col(part).cast("string")),
    ]
    if versions is not None:
        other = versions.where(F.col("schema_version") != wanted_version)
        findings.append(other.select(F.lit("schema"), F.col("schema_version")).distinct())
    listed = findings[0]
    for more in findings[1:]:
        listed = listed.union(more)
    listed = listed.toDF("section", "name")
    passed = listed.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("passed").alias("section"), F.lit("passed").alias("name"), flag(F.col("n") == 0).alias("value")
    )
    return (
        totals.select(F.lit("total").alias("section"), F.col("counter").alias("name"), "value")
        .unionByName(listed.withColumn("value", F.lit(1).cast("long")))
        .unionByName(passed)
    )


FILLED = ("raw_frame_index", "filename", "positive_predicates", "predicate_vector", "occlusion_mask_supported")
PRESENT = ("subject_box", "object_box")


def part_rules(columns: Sequence[str], vocabulary: Sequence[str] = SPATIAL_PREDICATES) -> dict[str, Column]:
    """Violations by rule of a part with these columns, as aggregates over its rows.

    The FILLED fields must be there in every row, the PRESENT ones may be null, as a box is where an object is not seen. A
    field that is no column at all counts once, and its rule on rows rests.
    """
    allowed = F.array(*[F.lit(p) for p in vocabulary])
    expected_vector = F.array(*[F.array_contains("positive_predicates", p).cast("int") for p in vocabulary])
    absent = F.lit(False)
    for name in FILLED:
        if name in columns:
            absent = absent | F.col(name).isNull()
    labels, vector = "positive_predicates" in columns, "predicate_vector" in columns
    none = F.sum(F.lit(0)).cast("long")
    disagrees = ~F.col("predicate_vector").eqNullSafe(expected_vector)
    return {
        "no_candidates": flag(F.count(F.lit(1)) == 0),
        "missing_column": F.lit(sum(c not in columns for c in (*FILLED, *PRESENT))).cast("long") + flag(F.count(F.lit(1)) < 0),
        "missing_required_field": count_where(absent),
        "wrong_vector_length": count_where(F.size("predicate_vector") != len(vocabulary)) if vector else none,
        "label_outside_vocabulary": (
            count_where(F.size(F.array_except("positive_predicates", allowed)) > 0) if labels else none
        ),
        "vector_disagrees_with_labels": count_where(disagrees) if labels and vector else none,
    }


def report_rules(schema_version: str, vocabulary: Sequence[str] = SPATIAL_PREDICATES) -> dict[str, Column]:
    """Violations by rule of the reports (schema_version, passed, relation_candidates, counted_predicates, predicate_order,
    canonical_inverse) that come with parts; a null breaks its rule."""
    order = F.array(*[F.lit(p) for p in vocabulary])

    def unless(condition: Column) -> Column:
        return count_where(~F.coalesce(condition, F.lit(False)))

    return {
        "missing_report": flag(F.count(F.lit(1)) == 0),
        "wrong_schema_version": unless(F.col("schema_version") == schema_version),
        "build_failed": unless(F.col("passed")),
        "no_reported_candidates": unless(F.col("relation_candidates") > 0),
        "wrong_predicate_vocabulary": unless(F.col("counted_predicates") == order),
        "wrong_predicate_order": unless(F.col("predicate_order") == order),
        "missing_canonical_inverse_encoding": unless(F.col("canonical_inverse")),
    }


def _told(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    one_row = rows.agg(*[rule.alias(name) for name, rule in rules.items()])
    return one_row.na.fill(0).unpivot([], list(rules), "rule", "violations")


def validate_part(rels: DataFrame, vocabulary: Sequence[str] = SPATIAL_PREDICATES) -> DataFrame:
    """(rule, violations) over all rows of a part."""
    return _told(rels, part_rules(rels.columns, vocabulary))


def validate_reports(
    reports: DataFrame, schema_version: str, vocabulary: Sequence[str] = SPATIAL_PREDICATES
) -> DataFrame:
    """(rule, violations) over the reports of parts."""
    return _told(reports, report_rules(schema_version, vocabulary))


def write_part(
    rels: DataFrame, path: str, vocabulary: Sequence[str] = SPATIAL_PREDICATES, by: str = "sequence"
) -> DataFrame:
    """(rule, violations) of a part that is written to `path` as Parquet: counted by the pass that writes, not by another.

    Rows of a sequence are gathered, so that files follow from the bytes and not from tasks times sequences.
    """
    rules = part_rules(rels.columns, vocabulary)
    seen = Observation()
    rows = gathered(rels, by) if by in rels.columns else rels
    watched = rows.observe(seen, *[rule.alias(name) for name, rule in rules.items()])
    watched.write.parquet(path)
    counted = seen.get
    rows = [(name, int(counted[name] or 0)) for name in rules]
    return rels.sparkSession.createDataFrame(rows, "rule string, violations long")
