"""Checks of relation parts while they are written, and of the audit's verdict."""

import pytest
from pyspark.sql import functions as F

from trafficloom.operators import relation_index, spatial
from trafficloom.params import SPATIAL_PREDICATES, TEMPORAL_PREDICATES
from trafficloom.params import SPATIAL_PREDICATES as P

ROW = "sequence long, raw_frame_index long, filename string, positive_predicates array<string>, predicate_vector array<int>, occlusion_mask_supported boolean, subject_box struct<x1:double>, object_box struct<x1:double>"
REPORT = "schema_version string, passed boolean, relation_candidates long, counted_predicates array<string>, predicate_order array<string>, canonical_inverse boolean"


def vector(*labels):
    return [int(p in labels) for p in P]


SOUND = (1, 5, "f", ["near"], vector("near"), True, None, None)
BROKEN = {
    "missing_required_field": [(1, None, "f", [], vector(), True, None, None), (1, 5, None, [], vector(), True, None, None), (1, 5, "f", [], vector(), None, None, None)],
    "wrong_vector_length": [(1, 5, "f", [], [0, 0], True, None, None)],
    "label_outside_vocabulary": [(1, 5, "f", ["flying"], vector(), True, None, None)],
    "vector_disagrees_with_labels": [(1, 5, "f", ["near"], vector(), True, None, None), (1, 5, "f", [], vector("near"), True, None, None)],
}


def told(df):
    return {r["rule"]: r["violations"] for r in df.collect()}


@pytest.mark.parametrize("rule", [None, *BROKEN])
def test_every_rule_on_rows(spark, tmp_path, rule):
    rows = [SOUND] * 3 + BROKEN.get(rule, [])
    df = spark.createDataFrame(rows, ROW)
    found = told(spatial.validate_part(df))
    assert found == told(spatial.write_part(df, f"{tmp_path}/p")) and spark.read.parquet(f"{tmp_path}/p").count() == len(rows)
    want = dict.fromkeys(found, 0)
    if rule:
        want[rule] = len(BROKEN[rule])
    if rule == "wrong_vector_length":
        want["vector_disagrees_with_labels"] = 1
    assert found == want


def test_no_rows_and_missing_columns(spark, tmp_path):
    empty = spark.createDataFrame([], ROW)
    assert {k for k, v in told(spatial.validate_part(empty)).items() if v} == {"no_candidates"}
    assert told(spatial.write_part(empty, f"{tmp_path}/e"))["no_candidates"] == 1
    fewer = spark.createDataFrame([SOUND], ROW).drop("subject_box", "predicate_vector")
    assert told(spatial.write_part(fewer, f"{tmp_path}/f")) == {**dict.fromkeys(told(spatial.validate_part(empty)), 0), "missing_column": 2}


def test_rows_are_computed_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([SOUND] * 50, ROW).repartition(4)
    assert told(spatial.write_part(df.mapInArrow(count, df.schema), f"{tmp_path}/p"))["no_candidates"] == 0
    assert made.value == 50


def test_reports(spark):
    sound = ("v2", True, 9, list(P), list(P), True)
    broken = {
        "wrong_schema_version": [("v1", *sound[1:]), (None, *sound[1:])],
        "build_failed": [("v2", False, *sound[2:]), ("v2", None, *sound[2:])],
        "no_reported_candidates": [(*sound[:2], 0, *sound[3:])],
        "wrong_predicate_vocabulary": [(*sound[:3], list(P)[:4], *sound[4:])],
        "wrong_predicate_order": [(*sound[:4], list(reversed(P)), True), (*sound[:4], None, True)],
        "missing_canonical_inverse_encoding": [(*sound[:5], None), (*sound[:5], False)],
    }
    every = spark.createDataFrame([sound, *[r for rows in broken.values() for r in rows]], REPORT)
    assert told(spatial.validate_reports(every, "v2")) == {"missing_report": 0, **{k: len(v) for k, v in broken.items()}}
    assert told(spatial.validate_reports(every.where("false"), "v2"))["missing_report"] == 1


def test_verdict_of_the_audit(spark):
    audit = spark.createDataFrame(
        [("train", "ALL", "objects", 8), ("train", "ALL", "complete_objects", 6), ("train", "1", "objects", 8), ("test", "ALL", "objects", 0)],
        "split string, sequence string, counter string, value long",
    )
    errors = spark.createDataFrame([("test", "empty_task", "spatial_examples")], "split string, error string, counter string")
    splits = spark.createDataFrame([("train",), ("test",), ("more",)], "split string").withColumn("sequence", F.lit(1))
    found = {r["split"]: (r["objects"], r["complete_objects"], r["complete_percent"], r["errors"], r["passed"]) for r in relation_index.audit_summary(audit, errors, splits).collect()}
    assert found == {"train": (8, 6, 75.0, 0, True), "test": (0, 0, 0.0, 1, False), "more": (0, 0, 0.0, 0, True), "ALL": (8, 6, 75.0, 1, False)}


def test_audit_tells_every_sequence_class_and_error(spark):
    mask = [[True, True, True], [True, False, True]]
    features = spark.createDataFrame(
        [(1, mask[0], 0), (1, mask[1], 0), (1, mask[0], 25), (2, mask[0], 13)], "sequence long, modality_mask array<boolean>, category long"
    )
    spatial = spark.createDataFrame([(1, *[True] * 5, True), (2, *[True] * 5, None)], "sequence long, " + ", ".join(f"{p} boolean" for p in (*SPATIAL_PREDICATES, "strict")))
    temporal = spark.createDataFrame([(1, False, True, True, True)], "sequence long, " + ", ".join(f"{p} boolean" for p in (*TEMPORAL_PREDICATES, "strict")))
    groups = spark.createDataFrame([(1, True)], "sequence long, strict boolean")
    splits = spark.createDataFrame([(1, "train"), (2, "train"), (3, "train"), (9, "test"), (None, "test")], "sequence long, split string")
    rows = relation_index.multimodal_audit(features, spatial, temporal, groups, splits, range(26)).collect()
    got = {(r["split"], r["sequence"], r["counter"]): r["value"] for r in rows}
    assert len(got) == len(rows) == (4 + 2) * (2 + 26 + 3 + len(SPATIAL_PREDICATES) + len(TEMPORAL_PREDICATES) + 3) + 2 * 7 + 2
    assert [got["train", "ALL", f"class_{c}"] for c in (0, 13, 25)] == [1, 1, 1] and got["train", "2", "class_13"] == 1
    assert got["train", "3", "objects"] == got["test", "9", "spatial_examples"] == got["train", "2", "temporal_examples"] == 0
    wanted = {"complete_percent": 75, "missing_shards": 1, "loose_shards": 1, "empty_tasks": 0, "unsupported_predicates": 1, "errors": 3, "passed": 0}
    assert {c: got["train", "ALL", c] for c in wanted} == wanted
    wanted = {"complete_percent": 0, "missing_shards": 1, "loose_shards": 0, "empty_tasks": 3, "unsupported_predicates": 8, "errors": 12, "passed": 0}
    assert {c: got["test", "ALL", c] for c in wanted} == wanted
    assert (got["ALL", "ALL", "errors"], got["ALL", "ALL", "passed"]) == (15, 0)
    sound = relation_index.multimodal_audit(
        features, spatial.where("strict"), temporal.withColumn("approaching", F.lit(True)), groups, splits.where("sequence = 1"), range(26)
    )
    assert {(r["split"], r["value"]) for r in sound.where("counter = 'passed'").collect()} == {("train", 1), ("ALL", 1)}


def test_files_do_not_grow_with_sequences(spark, tmp_path):
    rows = [(i % 60, *SOUND[1:]) for i in range(480)]
    df = spark.createDataFrame(rows, ROW).repartition(8)
    spatial.write_part(df, f"{tmp_path}/p")
    assert len(list(tmp_path.glob("p/**/*.parquet"))) <= 8
    read = spark.read.parquet(f"{tmp_path}/p")
    assert read.count() == 480 and read.groupBy("sequence").count().where("count = 8").count() == 60
