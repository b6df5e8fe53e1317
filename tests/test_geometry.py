"""Matrices, rotations, polygons, paths, projection and normals against numpy and hand-computed values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficloom.functions import plane, rigid
from trafficloom.functions.paths import line_distance
from trafficloom.operators import observations, spatial, timeline


def _rotation(axis, angle):
    x, y, z = np.asarray(axis) / np.linalg.norm(axis)
    c, s, t = math.cos(angle), math.sin(angle), 1 - math.cos(angle)
    return np.array(
        [
            [t * x * x + c, t * x * y - s * z, t * x * z + s * y],
            [t * x * y + s * z, t * y * y + c, t * y * z - s * x],
            [t * x * z - s * y, t * y * z + s * x, t * z * z + c],
        ]
    )


def _pose(axis, angle, place):
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = _rotation(axis, angle), place
    return m


def test_matrix_functions(spark):
    a, b = _pose((1, 2, 3), 0.7, (1, -2, 3)), _pose((0, 1, 1), 2.9, (4, 5, -6))
    scaled = a.copy()
    scaled[:3, :3] = a[:3, :3] @ np.diag([2.0, 3.0, 4.0])
    df = spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist(), scaled.ravel().tolist())], "a array<double>, b array<double>, c array<double>")
    row = df.select(
        rigid.multiply(F.col("a"), F.col("b")).alias("ab"),
        rigid.rigid_inverse(F.col("a")).alias("ia"),
        rigid.affine_inverse(F.col("c")).alias("ic"),
        rigid.from_quaternion(rigid.quaternion(F.col("b")), F.lit(4.0), F.lit(5.0), F.lit(-6.0)).alias("back"),
    ).first()
    assert np.allclose(np.reshape(row["ab"], (4, 4)), a @ b)
    assert np.allclose(np.reshape(row["ia"], (4, 4)), np.linalg.inv(a))
    assert np.allclose(np.reshape(row["ic"], (4, 4)), np.linalg.inv(scaled))
    assert np.allclose(np.reshape(row["back"], (4, 4)), b)


def test_pose_interpolation_turns_along_the_shortest_arc(spark):
    axis = (1, 1, 0)
    known = [(10, _pose(axis, 0.2, (0, 0, 0))), (20, _pose(axis, 1.4, (10, 20, 30)))]
    poses = spark.createDataFrame([("s", f, m.ravel().tolist()) for f, m in known], "sequence string, frame long, matrix array<double>")
    frames = spark.createDataFrame([("s", f) for f in (9, 10, 13, 20, 21)], "sequence string, frame long")
    rows = {r["frame"]: r for r in timeline.interpolate_pose(timeline.pose_asof(frames, poses)).collect()}
    assert [rows[f]["pose_source"] for f in (9, 10, 13, 20, 21)] == ["missing", "exact", "interpolated", "exact", "missing"]
    assert [rows[f]["span_frames"] for f in (9, 10, 13)] == [None, 0, 10]
    assert np.allclose(np.reshape(rows[13]["matrix"], (4, 4)), _pose(axis, 0.2 + 0.3 * 1.2, (3, 6, 9)))


def _square(cx, cy, size, yaw):
    half = size / 2
    corners = [(-half, -half), (half, -half), (half, half), (-half, half)]
    return [
        (cx + x * math.cos(yaw) - y * math.sin(yaw), cy + x * math.sin(yaw) + y * math.cos(yaw)) for x, y in corners
    ]


def test_rotated_overlap(spark):
    # A unit square turned by 45 degrees over one of side 1: the common part is a regular octagon.
    octagon = 2 * (math.sqrt(2) - 1)
    pairs = [
        (_square(0, 0, 1, 0), _square(0, 0, 1, math.pi / 4), octagon, 0.0),
        (_square(0, 0, 2, 0), _square(1, 1, 2, 0), 1.0, 0.0),
        (_square(0, 0, 2, 0), _square(5, 0, 2, 0), 0.0, 3.0),
        (_square(0, 0, 2, 0), _square(4, 0, 2, math.pi / 4), 0.0, 3.0 - math.sqrt(2)),
    ]
    rows = [(i, [*a, *a], [*b, *reversed(b)]) for i, (a, b, _, _) in enumerate(pairs)]
    points = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame(rows, f"i int, a {points}, b {points}")
    hulls = df.select("i", plane.convex_hull(F.col("a")).alias("a_hull"), plane.convex_hull(F.col("b")).alias("b_hull"))
    got = {r["i"]: r for r in spatial.bev_overlap(hulls, rotated=True).collect()}
    for i, (_, _, common, gap) in enumerate(pairs):
        assert got[i]["bev_intersection"] == pytest.approx(common, abs=1e-9)
        assert got[i]["box_distance"] == pytest.approx(gap, abs=1e-9)


def test_rotated_and_axis_aligned_paths_agree(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        ends = [[float(v) for v in (*rng.uniform(0, 6, 2), *rng.uniform(0.5, 3, 2))] for _ in range(2)]
        row = {"i": i}
        for p, (x, y, w, h) in zip("ab", ends):
            row |= {f"{p}_min_x": x, f"{p}_max_x": x + w, f"{p}_min_y": y, f"{p}_max_y": y + h}
            row[f"{p}_c"] = [(x, y), (x + w, y), (x, y + h), (x + w, y + h)]
        rows.append(tuple(row.values()))
    names = [f"{p}_{m}_{a} double" for p in "ab" for a in "xy" for m in ("min", "max")]
    fields = ["i int", *names[:4], "a_c array<struct<x:double,y:double>>", *names[4:], "b_c array<struct<x:double,y:double>>"]
    df = spark.createDataFrame(rows, ", ".join(fields))
    hulls = df.withColumns({f"{p}_hull": plane.convex_hull(F.col(f"{p}_c")) for p in "ab"})
    keep = ["i", "bev_intersection", "bev_iou", "box_distance"]
    flat = {r["i"]: r for r in spatial.bev_overlap(df).select(*keep).collect()}
    turned = {r["i"]: r for r in spatial.bev_overlap(hulls, rotated=True).select(*keep).collect()}
    for i in flat:
        for k in keep[1:]:
            assert turned[i][k] == pytest.approx(flat[i][k], abs=1e-9)


def test_line_distance():
    a = np.array([[[0.0, i] for i in range(5)], [[i, 0.0] for i in range(5)], [[i, 0.0] for i in range(5)]])
    b = np.array([[[3.0, i] for i in range(5)], [[2.5, i - 2.0] for i in range(5)], [[i + 9.0, 0.0] for i in range(5)]])
    assert np.allclose(line_distance(a, b, False), [3.0, 0.0, 5.0])
    # Segments on one straight line count as touching on request.
    assert np.allclose(line_distance(a, b, True), [3.0, 0.0, 0.0])


def test_projection_cases(spark):
    eye = np.eye(4).ravel().tolist()
    lens = [float(v) for v in (100, 0, 50, 0, 0, 100, 50, 0, 0, 0, 1, 0)]
    half = [(x, y) for x in (-1.0, 1.0) for y in (-1.0, 1.0)]
    near = [(x, y, z) for x, y in half for z in (4.0, 6.0)]
    behind = [(x, y, z) for x, y in half for z in (-6.0, -4.0)]
    aside = [(x + 500.0, y, z) for x, y in half for z in (4.0, 6.0)]
    rows = [(n, c, eye, eye, lens) for n, c in (("near", near), ("behind", behind), ("aside", aside))]
    boxes = spark.createDataFrame(
        rows,
        "token string, corners_world array<struct<x:double,y:double,z:double>>, world_from_camera array<double>, "
        "rectification array<double>, projection array<double>",
    )
    got = {r["token"]: r for r in observations.project_box(boxes, 101, 101).collect()}
    assert [got["near"][c] for c in ("x1", "y1", "x2", "y2")] == [25.0, 25.0, 75.0, 75.0]
    assert got["near"]["image_area"] == 2500.0 and got["near"]["depth"] == 5.0
    assert (got["behind"]["x1"], got["behind"]["image_area"], got["behind"]["depth"]) == (None, 0.0, None)
    assert (got["aside"]["x1"], got["aside"]["image_area"], got["aside"]["depth"]) == (None, 0.0, 5.0)


def test_points_in_a_turned_box_and_normals(spark):
    turn = _pose((0, 0, 1), math.pi / 4, (2.0, 1.0, 0.0))
    inverse = np.linalg.inv(turn).ravel().tolist()
    rng = np.random.default_rng(5)
    cloud = rng.uniform(-3, 6, (300, 3))
    local = (np.c_[cloud, np.ones(300)] @ np.linalg.inv(turn).T)[:, :3]
    inside = int((np.abs(local) <= np.array([2.0, 1.0, 1.0]) + 1e-3).all(axis=1).sum())
    points = spark.createDataFrame([("s", i, *map(float, p)) for i, p in enumerate(cloud)], "sample_token string, point_id long, x double, y double, z double")
    box = spark.createDataFrame(
        [("s", "b", -1.0, 5.0, -2.0, 4.0, -1.0, 1.0, inverse, -2.0, 2.0, -1.0, 1.0, -1.0, 1.0)],
        "sample_token string, token string, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double, "
        "local_from_ego array<double>, local_min_x double, local_max_x double, local_min_y double, local_max_y double, "
        "local_min_z double, local_max_z double",
    )
    counted = observations.points_in_box(points, box, rotated=True).first()
    assert counted["lidar_points"] == inside > 5
    # Points of the plane z = 2: every normal is the z axis, pointing away from the origin.
    flat = spark.createDataFrame([("t", i, float(i % 4), float(i // 4), 2.0) for i in range(16)], "token string, position int, x double, y double, z double")
    for row in observations.normals(flat).collect():
        assert abs(row["nx"]) < 1e-6 and abs(row["ny"]) < 1e-6 and row["nz"] == pytest.approx(1.0)
