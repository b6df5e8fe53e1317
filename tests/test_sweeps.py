"""Sweeps as files: planning, filters that leave files closed, writing whole or not at all."""

import pickle
import struct
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from trafficloom.sources import sweeps


def put(root, name, *points):
    path = Path(root) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"".join(struct.pack("<4f", *p) for p in points))


@pytest.fixture
def folder(tmp_path):
    for sequence in ("a", "b c"):
        for frame in range(5):
            put(tmp_path, f"sequence={sequence.replace(' ', '%20')}/{frame:010d}.bin", *[(k, frame, -k, 0.5) for k in range(frame)])
    put(tmp_path, "0003_sync/velodyne_points/data/0000000007.bin", (1, 2, 3, 4))
    put(tmp_path, "12.bin", (9, 9, 9, 9), (8, 8, 8, 8))
    put(tmp_path, "sequence=a/thumb_1.bin", (0, 0, 0, 0))
    put(tmp_path, "sequence=a/7.png", (0, 0, 0, 0))
    put(tmp_path, "_temporary/job/1.bin", (0, 0, 0, 0))
    return str(tmp_path)


def test_names_and_points(spark, folder):
    rows = sweeps.read_sweeps(spark, folder).collect()
    got = {(r["sequence"], r["frame"], r["point_id"]): (r["x"], r["y"], r["z"], r["intensity"]) for r in rows}
    want = {(s, f, k): (k, f, -k, 0.5) for s in ("a", "b c") for f in range(5) for k in range(f)}
    want |= {("0003_sync", 7, 0): (1, 2, 3, 4), (None, 12, 0): (9, 9, 9, 9), (None, 12, 1): (8, 8, 8, 8)}
    assert got == want and len(rows) == len(want)
    assert {r["path"].rsplit("/", 1)[1] for r in rows if r["sequence"] is None} == {"12.bin"}
    few = sweeps.read_sweeps(spark, folder, ["y", "frame"])
    assert few.columns == ["frame", "y"] and few.count() == len(want)
    assert sweeps.read_sweeps(spark, f"{folder}/none").count() == 0


@pytest.mark.parametrize(
    ("condition", "want"),
    [
        ("sequence = 'a'", {("a", f) for f in range(1, 5)}),
        ("sequence = 'b c' AND frame BETWEEN 2 AND 3", {("b c", 2), ("b c", 3)}),
        ("frame IN (4, 12)", {("a", 4), ("b c", 4), (None, 12)}),
        ("frame > 3 AND sequence IS NOT NULL", {("a", 4), ("b c", 4), ("0003_sync", 7)}),
        ("sequence <=> null", {(None, 12)}),
        ("frame < 2 AND x + y > 0", {("a", 1), ("b c", 1)}),
        ("frame = 99", set()),
    ],
)
def test_filters_give_the_same_rows(spark, folder, condition, want):
    found = sweeps.read_sweeps(spark, folder).where(condition).select("sequence", "frame").distinct().collect()
    assert {tuple(r) for r in found} == want


def test_filtered_files_are_neither_planned_nor_opened(spark, folder, monkeypatch):
    (Path(folder) / "sequence=a" / "0000000099.bin").write_bytes(b"torn")
    read = sweeps.read_sweeps(spark, folder)
    with pytest.raises(Exception, match="multiple of 16 bytes"):
        read.count()
    assert read.where("sequence = 'b c'").count() == 10
    assert read.where("frame < 99 AND sequence = 'a'").count() == 10

    reader = sweeps.SweepSource({"path": folder, "opencostinbytes": "0"}).reader(read.schema)
    left = list(reader.pushFilters([ds.EqualTo(("sequence",), "a"), ds.In(("frame",), (2, 3)), ds.GreaterThan(("x",), 0.0)]))
    assert left == [ds.GreaterThan(("x",), 0.0)]
    opened, real = [], sweeps.opened

    class Watched:
        def __init__(self, inner):
            self.inner = inner

        def open_input_file(self, path):
            opened.append(path.rsplit("/", 2)[1:])
            return self.inner.open_input_file(path)

    parts = reader.partitions()
    monkeypatch.setattr(sweeps, "opened", lambda root: (Watched(real(root)[0]), real(root)[1]))
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 5
    assert sorted(opened) == [["sequence=a", "0000000002.bin"], ["sequence=a", "0000000003.bin"]]


def test_plans_cut_large_files_and_pack_small_ones():
    large, small = sweeps.Sweep("l", 1600, "a", 1), [sweeps.Sweep(f"s{k}", 32, "a", k) for k in range(40)]
    parts = sweeps.planned([large, *small], max_bytes=410, open_cost=16, tasks=1)
    ranges = sorted(r for p in parts for r in ((s.path, at, n) for s, at, n in p.ranges))
    assert [r for r in ranges if r[0] == "l"] == [("l", 0, 400), ("l", 400, 400), ("l", 800, 400), ("l", 1200, 400)]
    assert sorted(r[0] for r in ranges if r[0] != "l") == sorted(s.path for s in small)
    assert all(sum(n for _, _, n in p.ranges) <= 400 for p in parts) and len(parts) < 12
    assert len(sweeps.planned([large], 1 << 20, 16, tasks=10)) == 10
    assert sweeps.planned([], 100, 1, 1) == [] and sweeps.planned([sweeps.Sweep("e", 0, "a", 1)], 100, 1, 1) == []


def test_ranges_of_one_file_are_numbered_through(spark, tmp_path):
    put(tmp_path, "sequence=a/1.bin", *[(k, 0, 0, 0) for k in range(1000)])
    read = spark.read.format("sweeps").options(maxPartitionBytes="160", openCostInBytes="0").load(str(tmp_path))
    assert read.rdd.getNumPartitions() == 100
    assert sorted((r["point_id"], r["x"]) for r in read.collect()) == [(k, float(k)) for k in range(1000)]


def test_written_sweeps_come_back_in_order(spark, tmp_path):
    root = f"{tmp_path}/out"
    rows = [(s, f, 10 - k, float(k), None if k == 3 else 1.0, 0.0, 2.0, "more") for s in ("a/b", "é", None) for f in (0, 7, -2) for k in range(5)]
    df = spark.createDataFrame(rows, "sequence string, frame long, at int, x double, y double, z double, intensity double, path string").repartition(6)
    sweeps.write_sweeps(df, root, order="at")
    got = {(r["sequence"], r["frame"], r["point_id"]): (r["x"], r["y"]) for r in sweeps.read_sweeps(spark, root).collect()}
    assert len(got) == len(rows)
    for s, f, at, x, y, *_ in rows:
        back = got[(s, f, at - 6)]
        assert back[0] == x and (back[1] == y or (y is None and back[1] != back[1]))
    assert not list(Path(root).glob("**/_temporary"))
    with pytest.raises(Exception, match="sweep exists"):
        sweeps.write_sweeps(df.where("frame = 7"), root, order="at")
    assert sweeps.read_sweeps(spark, root).count() == len(rows)
    sweeps.write_sweeps(df.where("frame = 7"), root, order="at", force=True)
    assert {r[0] for r in sweeps.read_sweeps(spark, root).select("frame").distinct().collect()} == {7}
    sweeps.write_sweeps(df.where("false"), f"{tmp_path}/none", order="at")
    assert sweeps.read_sweeps(spark, f"{tmp_path}/none").count() == 0


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    root = f"{tmp_path}/out"
    rows = [("a", f, 1.0) for f in range(20)] + [("a", None, 1.0)]
    df = spark.createDataFrame(rows, "sequence string, frame long, x double").select("*", *[F.lit(0.0).alias(c) for c in ("y", "z", "intensity")], F.lit(1).alias("point_id"))
    with pytest.raises(Exception, match="without a frame"):
        sweeps.write_sweeps(df.repartition(3), root)
    assert not [p for p in Path(root).glob("**/*") if p.is_file()]
    with pytest.raises(Exception, match="no such column"):
        sweeps.read_sweeps(spark, root, ["x", "colour"]).count()


def test_many_small_sweeps_make_few_partitions_and_little_to_hold():
    many = (sweeps.Sweep(f"/root/sequence={k // 30}/{k % 30:010d}.bin", 320, str(k // 30), k % 30) for k in range(60000))
    parts = sweeps.planned(many, sweeps.MAX_BYTES, sweeps.OPEN_COST, tasks=4)
    # a partition per 32 files before, 1875 of them
    assert len(parts) <= 2 * 4 * sweeps.OPEN_TASKS
    # 20 bytes a file, where a sweep with its names has hundreds
    assert len(b"".join(pickle.dumps(p) for p in parts)) < 20 * 60000
    read = [s for p in parts for s, at, n in p.ranges if (at, n) == (0, 320)]
    assert len({s.path for s in read}) == len(read) == 60000


def test_what_was_written_is_told_in_few_bytes(tmp_path):
    writer = sweeps.SweepSource({"path": str(tmp_path)}).writer(None, False)
    n = sweeps.BLOCK + 5
    points = pa.table({"sequence": [str(k // 30) for k in range(n)], "frame": [k % 30 for k in range(n)], **{c: [0.5] * n for c in ("x", "y", "z", "intensity")}})
    told = writer.write(iter(points.to_batches(max_chunksize=1000)))
    assert len(pickle.dumps(told)) < 20 * n
    assert not list(sweeps.listed(str(tmp_path)))
    again = sweeps._Written(told.pending, [*told.blocks, told.blocks[-1]])
    with pytest.raises(ValueError, match="several tasks"):
        sweeps.SweepSource({"path": str(tmp_path)}).writer(None, False).commit([again])
    writer.commit([told, None])
    assert sum(1 for s in sweeps.listed(str(tmp_path)) if s.size == 16) == n
    assert not list(Path(tmp_path).glob("**/_temporary"))
