"""Matching, recovery, tracks and quality on tiny hand-made inputs."""

import random

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficloom.operators import matching, quality, recovery, relation_index, tracklets

KEYS = ["sequence", "group"]


def _group(spark, scores, source_bins=None, target_bins=None):
    """Pairs, sources and targets of one group from a score matrix."""
    n, m = len(scores), len(scores[0])
    sb, tb = source_bins or [0.0] * n, target_bins or [0.0] * m
    pairs = spark.createDataFrame(
        [(0, "g", i, j, float(scores[i][j]), float(sb[i]), float(tb[j])) for i in range(n) for j in range(m)],
        "sequence long, group string, source long, target long, score double, source_dustbin double, target_dustbin double",
    )
    sources = pairs.select(*KEYS, "source", "source_dustbin").distinct()
    targets = pairs.select(*KEYS, "target", "target_dustbin").distinct()
    return pairs, sources, targets


def test_mutual_matches(spark):
    given = _group(spark, [[5, 0], [0, 4]], [-2, -2], [-2, -2])
    by_source, by_target = matching.argmax_choices(*given)
    assert [r["target"] for r in by_source.orderBy("source").collect()] == [0, 1]
    assert [r["source"] for r in by_target.orderBy("target").collect()] == [0, 1]
    links = matching.mutual_matches(by_source, by_target).collect()
    assert sorted((r["source"], r["target"]) for r in links) == [(0, 0), (1, 1)]


def test_ties_go_to_the_lowest_index_and_the_dustbin_comes_last(spark):
    by_source, by_target = matching.argmax_choices(*_group(spark, [[1, 1], [0, -1]]))
    assert [r["target"] for r in by_source.orderBy("source").collect()] == [0, 0]
    assert [r["source"] for r in by_target.orderBy("target").collect()] == [0, 0]


@pytest.mark.parametrize(
    "mode, threshold, expected",
    [
        ("one_way", 0.0, [(0, 0, False), (1, 1, True)]),
        ("one_way", 3.1, [(0, 0, False)]),
        ("all", -1.0, [(0, 0, False), (1, 1, True)]),
    ],
)
def test_recovery_matrix(spark, mode, threshold, expected):
    links = recovery.select_links(*_group(spark, [[5, 0], [4, 3]]), mode, threshold)
    assert sorted((r["source"], r["target"], r["fallback"]) for r in links.collect()) == expected


def test_greedy_rounds_equal_the_sequential_choice(spark):
    rng = random.Random(11)
    rows = [
        (g % 3, f"g{g}", s, t, round(rng.uniform(-1, 1), 1), round(rng.uniform(-1, 1), 1))
        for g in range(6)
        for s in range(12)
        for t in range(12)
        if rng.random() < 0.6
    ]
    df = spark.createDataFrame(rows, "sequence long, group string, source long, target long, margin double, score double")
    got = {(r["group"], r["source"], r["target"]) for r in recovery.greedy_links(df).collect()}
    expected = set()
    for g in {r[1] for r in rows}:
        used_s, used_t = set(), set()
        for r in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[4], -r[5], r[2], r[3])):
            if r[2] not in used_s and r[3] not in used_t:
                expected.add((g, r[2], r[3]))
                used_s.add(r[2])
                used_t.add(r[3])
    assert got == expected


def test_recovered_tracks(spark):
    rows = spark.createDataFrame([(i, True) for i in range(4)] + [(9, False)], "row long, eligible boolean")
    links = spark.createDataFrame([(0, 2), (1, 3)], "source long, target long")
    ids = {r["row"]: r["track_id"] for r in matching.components(rows, links).collect()}
    assert ids == {0: 0, 1: 1, 2: 0, 3: 1, 9: -1}


def test_components_of_branching_links(spark):
    rows = spark.createDataFrame([(i, True) for i in range(9)], "row long, eligible boolean")
    links = spark.createDataFrame([(0, 4), (4, 7), (1, 7), (2, 3), (3, 2), (8, 5)], "source long, target long")
    ids = {r["row"]: r["track_id"] for r in matching.components(rows, links).collect()}
    assert ids == {0: 0, 4: 0, 7: 0, 1: 0, 2: 1, 3: 1, 5: 2, 8: 2, 6: 3}


def test_totals(spark):
    reports = spark.createDataFrame(
        [(3, 1, 0, 4, 3, 5), (1, 1, 1, 2, 2, 3)],
        "mutual_links long, fallback_links long, correct_fallback_links long, links long, correct_links long, true_links long",
    )
    row = recovery.totals(reports).first()
    assert [row[c] for c in recovery.TOTALS] == [4, 2, 1, 6, 5, 8]
    assert row["precision"] == pytest.approx(5 / 6) and row["recall"] == pytest.approx(5 / 8)


def test_sinkhorn_against_numpy(spark):
    scores = np.array([[1.0, 0.2, -0.5], [0.1, 0.9, 0.3]])
    soft = matching.sinkhorn(*_group(spark, scores.tolist(), [0.1, 0.2], [0.0, 0.1, -0.2]), corner=-0.3)
    full = np.zeros((3, 4))
    full[:2, :3], full[:2, 3], full[2, :3], full[2, 3] = scores, [0.1, 0.2], [0.0, 0.1, -0.2], -0.3
    log = full / 0.10
    for _ in range(8):
        log = log - np.logaddexp.reduce(log, axis=1, keepdims=True)
        log = log - np.logaddexp.reduce(log, axis=0, keepdims=True)
    for r in soft.collect():
        i = 2 if r["source"] is None else r["source"]
        j = 3 if r["target"] is None else r["target"]
        assert r["weight"] == pytest.approx(np.exp(log[i, j]), abs=1e-9)


@pytest.mark.parametrize(("task_cells", "chunk"), [(1 << 20, 1 << 16), (1 << 20, 1), (1 << 20, 37), (25, 10), (0, 10)])
def test_sinkhorn_of_many_groups_in_tasks_and_rounds(spark, monkeypatch, task_cells, chunk):
    monkeypatch.setattr(matching, "CHUNK_CELLS", chunk)
    rng = np.random.default_rng(chunk)
    scores, sources, targets, want = [], [], [], {}
    for g in range(12 if task_cells else 3):
        n, m = rng.integers(0, 6, 2)
        s, a, b = rng.normal(size=(n, m)).round(2), rng.normal(size=n).round(2), rng.normal(size=m).round(2)
        seen = rng.random((n, m)) < 0.7
        full = np.full((n + 1, m + 1), 0.4)
        full[:n, :m], full[:n, m], full[n, :m] = np.where(seen, s, -1e9), a, b
        log = full / 0.10
        for _ in range(8):
            log = log - np.logaddexp.reduce(log, axis=1, keepdims=True)
            log = log - np.logaddexp.reduce(log, axis=0, keepdims=True)
        name = f"g{g}"
        scores += [(7, name, i + 100, j, float(s[i, j])) for i in range(n) for j in range(m) if seen[i, j]]
        sources += [(7, name, i + 100, float(a[i])) for i in range(n)]
        targets += [(7, name, j, float(b[j])) for j in range(m)]
        if n or m:
            cells = [(i, j) for i in range(n) for j in range(m) if seen[i, j]] + [(i, m) for i in range(n)] + [(n, j) for j in range(m)] + [(n, m)]
            want |= {(name, i + 100 if i < n else None, j if j < m else None): math.exp(log[i, j]) for i, j in cells}
    kind = "sequence long, group string, "
    soft = matching.sinkhorn(
        spark.createDataFrame(scores, kind + "source long, target long, score double").repartition(3),
        spark.createDataFrame(sources, kind + "source long, source_dustbin double"),
        spark.createDataFrame(targets, kind + "target long, target_dustbin double"),
        corner=0.4,
        task_cells=task_cells,
    )
    got = {(r["group"], r["source"], r["target"]): r["weight"] for r in soft.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_availability_and_predicted_geometry(spark):
    frames = [0, 5, 10, 15, 20]
    rows = spark.createDataFrame(
        [(2 * k + t, frames[k], float(k) if t == 0 else 10.0, 0.0, 0.0) for k in range(5) for t in (0, 1)],
        "row long, frame long, center_x double, center_y double, center_z double",
    )
    tracks = spark.createDataFrame([(r, r % 2) for r in range(10)], "row long, track_id long")
    relation = spark.createDataFrame(
        [("r", [0, 2, 4, 6, 8], [1, 3, 5, 7, 9], frames, [k * 500_000_000 for k in range(5)])],
        "relation_id string, source_rows array<long>, target_rows array<long>, frames array<long>, timestamps_ns array<long>",
    )
    found = matching.availability(matching.predicted_rows(relation, tracks, rows))
    measured = matching.geometry_vector(
        matching.predicted_geometry(matching.interpolate_steps(matching.fallback_rows(found)))
    ).first()
    assert measured["available"] and measured["predicted_source_rows"] == [0, 2, 4, 6, 8]
    assert measured["predicted_target_rows"] == [1, 3, 5, 7, 9]
    vector = measured["geometry"]
    assert len(vector) == 24
    assert (vector[5], vector[8], vector[16], vector[19]) == (-4.0, 2.0, 2.0, 8.0)


def test_quality_bins(spark):
    cases = [(False, 5, False), (True, 5, False), (True, 4, False), (True, 3, False), (True, 5, True), (True, 2, False)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, available boolean, correct_joint_steps long, identity_error boolean")
    got = [r["quality_bin"] for r in quality.quality_bin(df).orderBy("i").collect()]
    assert got == ["missing", "perfect_5", "good_4", "partial_3", "poor_identity", "poor_identity"]


def test_complete_rows_and_joint_mask(spark):
    masks = [[True] * 3, [False, True, False], [True] * 3, [True] * 3, [True] * 3]
    features = spark.createDataFrame(
        [(i, f"t{i}", m, i) for i, m in enumerate(masks)], "feature_row long, annotation_token string, modality_mask array<boolean>, category long"
    )
    assert relation_index.complete_rows(features).count() == 4
    windows = spark.createDataFrame(
        [("s", ["t0"] * 5), ("o", ["t1", "t2", "t1", "t3", "t4"])], "token string, annotation_tokens array<string>"
    )
    rels = spark.createDataFrame([("r", "s", "o", "sc", 0)], "token string, subject_tracklet string, object_tracklet string, scene_token string, start_sample_index long")
    ends = relation_index.temporal_ends(rels, relation_index.tracklet_rows(windows, features)).first()
    assert ends["joint_mask"] == [False, True, False, True, True]
    # Three joint steps, but not the middle one.
    assert ends["state"] == "non_multimodal_tracklets"


def test_window_with_a_gap_gives_no_tracklet(spark):
    obs = spark.createDataFrame(
        [(f"t{i}", f"s{i}", "sc", "0", i, i, "car", 1, 1, True, True, float(i), 0.0, 0.0, "f", None, None, None, None, "o") for i in (0, 1, 2, 3, 4, 6, 7)],
        "token string, sample_token string, scene_token string, sequence string, sample_index long, raw_frame_index long, label string, "
        "semantic_id long, instance_id long, dynamic boolean, supervised_eligible boolean, center_x double, center_y double, center_z double, "
        "filename string, x1 double, y1 double, x2 double, y2 double, instance_token string",
    )
    samples = obs.select(F.col("sample_token").alias("token"), "scene_token", "sample_index", (F.col("sample_index") * 500000000).alias("timestamp_ns"))
    rows = tracklets.windows(obs, samples).collect()
    assert [(r["start_sample_index"], r["speed"], r["duration_seconds"]) for r in rows] == [(0, 2.0, 2.0)]
