"""Readers, writers and resumable ingest on small files."""

import struct

import pytest
from pyspark.sql import functions as F

from trafficloom.operators import observations
from trafficloom.sources import readers, writers
from trafficloom.streaming.ingest import ingest_incremental, ingested


def test_file_listing(spark, tmp_path):
    assert readers.file_index(readers.list_files(spark, str(tmp_path / "none"))).count() == 0
    for name in ("0000000003.png", "0000000010.png", "thumb.png"):
        (tmp_path / name).write_bytes(b"abc")
    rows = readers.file_index(readers.list_files(spark, str(tmp_path), "*.png")).orderBy("frame").collect()
    assert [(r["frame"], r["length"]) for r in rows] == [(3, 3), (10, 3)]


def test_pose_lines_fail_on_other_counts(spark):
    lines = spark.createDataFrame([("7 " + " ".join(["1"] * 12),), ("  ",), ("8 1 2 3",)], "value string")
    with pytest.raises(Exception, match="malformed pose line"):
        readers.pose_lines(lines).collect()
    kept = readers.pose_lines(lines, strict=False).orderBy("frame").collect()
    assert [r["matrix"] is None for r in kept] == [False, True]
    assert kept[0]["matrix"][12:] == [0.0, 0.0, 0.0, 1.0]


def test_lines_are_numbered_per_file_and_times_keep_nanoseconds(spark, tmp_path):
    (tmp_path / "a.txt").write_text("2013-05-28 08:46:02.904660551\n2013-05-28 08:46:03.1\n")
    (tmp_path / "b.txt").write_text("1970-01-01 00:00:00\n")
    rows = readers.timestamps(readers.text_lines(spark, str(tmp_path))).collect()
    got = {(r["path"][-5], r["frame"]): r["timestamp_ns"] for r in rows}
    assert got == {("a", 0): 1369730762904660551, ("a", 1): 1369730763100000000, ("b", 0): 0}


def test_lines_of_a_file_read_in_pieces_are_numbered_through(spark, tmp_path):
    for name, count in (("a", 700), ("b", 1), ("c", 90)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} {i}\n" for i in range(count)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        rows = readers.text_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 791 and all(r["value"] == f"{r['path'][-5]} {r['line']}" for r in rows)


def test_time_stamps_are_written_in_a_file_per_sequence(spark, tmp_path, monkeypatch):
    """Sequences grow with the users; a file per day as well would be thirty times as many."""
    from trafficloom.workload import source_queries

    monkeypatch.setattr(source_queries, "scratch_path", lambda spark, label: str(tmp_path / label))
    rows = source_queries.src_timestamps_text(spark, "/root/testdata/sf0.001").collect()
    assert len({r["day"] for r in rows}) > 1
    assert len(list(tmp_path.rglob("part-*.txt"))) == len({r["sequence"] for r in rows})


def test_a_listing_takes_few_tasks_and_a_sequence_has_one_file_of_notes(spark, tmp_path, monkeypatch):
    from trafficloom.workload import source_queries, tables

    events = tables.events
    monkeypatch.setattr(source_queries, "scratch_path", lambda spark, label: str(tmp_path / label))
    monkeypatch.setattr(tables, "events", lambda spark, sf: events(spark, sf).repartition(3))
    spark.conf.set("spark.sql.files.openCostInBytes", "200m")
    try:
        found = source_queries.src_file_index(spark, "/root/testdata/sf0.001")
        assert found.rdd.getNumPartitions() <= readers.LISTING_TASKS * spark.sparkContext.defaultParallelism < found.count()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(list(tmp_path.rglob("part-*.txt"))) == found.select("sequence").distinct().count()


def test_boxes_take_defaults_and_drop_broken_matrices(spark):
    def matrix(name, rows, cols, data):
        return f"<{name}><rows>{rows}</rows><cols>{cols}</cols><dt>f</dt><data>\n{data}</data></{name}>"

    sound = matrix("transform", 4, 4, " ".join("1" * 16)) + matrix("vertices", 2, 3, "1 2 3\n 4 5 6")
    document = f"<?xml version=\"1.0\"?>\n<root>\n<object1>{sound}</object1><note>x</note><object2><label>car</label>{matrix('transform', 4, 4, '1 2')}{matrix('vertices', 1, 3, '1 2 3')}</object2></root>"
    rows = readers.boxes_xml(spark.createDataFrame([("p", document)], "path string, value string")).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row["label"], row["semantic_id"], row["dynamic"], row["timestamp"], row["start_frame"]) == ("unknown", -1, False, -1, -1)
    assert [tuple(v) for v in row["vertices"]] == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]


def test_split_layouts_and_errors(spark):
    def read(*texts):
        return readers.split_json(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, value string"))

    rows = read('{"train": ["a", "b"], "test": ["c"]}', '{"d": "validation"}').collect()
    assert {(r["sequence"], r["split"]) for r in rows} == {("a", "train"), ("b", "train"), ("c", "test"), ("d", "validation")}
    with pytest.raises(Exception, match="more than once"):
        read('{"train": ["a"], "test": ["a"]}').collect()
    with pytest.raises(Exception, match="unknown split"):
        read('{"a": "other"}').collect()


def test_sweeps(spark, tmp_path):
    (tmp_path / "1.bin").write_bytes(struct.pack("<8f", 1, 2, 3, 0.5, 4, 5, 6, 0.25))
    rows = readers.lidar_points(spark, str(tmp_path)).orderBy("point_id").collect()
    assert [(r["x"], r["z"], r["intensity"]) for r in rows] == [(1.0, 3.0, 0.5), (4.0, 6.0, 0.25)]
    broken = spark.createDataFrame([("x", bytearray(b"123"))], "path string, content binary")
    with pytest.raises(Exception, match="multiple of 16"):
        observations.decode_points(broken).collect()


def test_writers_refuse_to_overwrite_and_clean_numbers(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan"), [1.0, float("inf")])], "sequence string, x double, v array<double>")
    writers.write_tables({"t": df}, str(tmp_path))
    with pytest.raises(Exception, match="exists"):
        writers.write_tables({"t": df}, str(tmp_path))
    writers.write_tables({"t": df}, str(tmp_path), force=True)
    row = writers.json_safe(df).first()
    assert row["x"] is None and row["v"] == [1.0, None]


def test_tables_have_few_files_with_whole_sequences(spark, tmp_path):
    df = spark.range(600).selectExpr("id % 60 AS sequence", "id").repartition(8)
    writers.write_tables({"t": df}, str(tmp_path))
    assert len(list(tmp_path.glob("t/**/*.parquet"))) <= 8
    read = spark.read.parquet(f"{tmp_path}/t")
    assert read.selectExpr("sequence", "id").exceptAll(df).count() == 0 and read.count() == 600
    files = read.selectExpr("sequence", "input_file_name() AS f").distinct()
    assert files.count() == 60


def test_ingest_takes_new_files_once(spark, tmp_path):
    inbox, target, state = (str(tmp_path / n) for n in ("inbox", "target", "state"))
    schema = spark.range(1).schema

    def deliver(start, name):
        spark.range(start, start + 10).coalesce(1).write.parquet(f"{inbox}/{name}")
        ingest_incremental(spark, f"{inbox}/*", schema, target, state)

    deliver(0, "a")
    deliver(100, "b")
    ingest_incremental(spark, f"{inbox}/*", schema, target, state)
    rows = ingested(spark, target)
    assert rows.count() == 20 and rows.agg(F.countDistinct("id")).first()[0] == 20


def exchanges(df):
    """(columns dealt by, tables below) of every exchange of the executed plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    found = []
    for i, line in enumerate(plan):
        if "Exchange hashpartitioning" in line:
            depth = line.index("Exchange")
            below = []
            for later in plan[i + 1 :]:
                if len(later) - len(later.lstrip(" :+-*()0123456789")) <= depth:
                    break
                below += [w.rsplit(".", 1)[1].split("[")[0] for w in later.split() if w.startswith("spark_catalog.")]
            found.append((line[depth:].split("(")[1].split("#")[0], below))
    return found


@pytest.mark.parametrize("again", [False, True])
def test_bucketed_tables_are_not_shuffled_for_joins(spark, tmp_path, monkeypatch, again):
    from trafficloom.operators import relation_index as ri

    features = spark.range(300).select(
        F.concat(F.lit("t"), "id").alias("annotation_token"), F.col("id").alias("feature_row"), F.array(F.lit(True), F.col("id") % 3 > 0).alias("modality_mask")
    )
    rels = spark.range(900).select(
        "id", F.concat(F.lit("t"), F.col("id") % 310).alias("subject_token"), F.concat(F.lit("t"), F.col("id") * 7 % 320).alias("object_token")
    )
    want = sorted(map(str, ri.spatial_index(rels, features).select("id", "source_row", "target_row").collect()))
    root = f"{tmp_path}/it's"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = writers.write_bucketed(features, root, "features", "annotation_token", 6)
        by_subject = writers.write_bucketed(rels, root, "relations", "subject_token", 6)
        if again:
            rows, by_subject = writers.bucketed(spark, root, "features", "feature_rows"), writers.bucketed(spark, root, "relations")
        found = ri.spatial_index(by_subject, rows).select("id", "source_row", "target_row")
        assert sorted(map(str, found.collect())) == want
        dealt = exchanges(found)
        # one exchange, of the joined relations by object; none above a table's scan alone
        assert [d for d, _ in dealt] == ["object_token"] and any("relations" in t for t in dealt[0][1])
        with pytest.raises(Exception, match="non-empty|exists"):
            writers.write_bucketed(rels, root, "relations", "subject_token", 6)
        assert writers.write_bucketed(rels.limit(10), root, "relations", "object_token", 3, force=True).count() == 10
        assert writers.bucketed(spark, root, "relations").count() == 10
        files = list((tmp_path / "it's" / "features").glob("part-*"))
        assert len(files) <= 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_temporal_index_over_stored_windows(spark, tmp_path):
    from trafficloom.operators import relation_index as ri

    windows = spark.range(40).select(
        F.concat(F.lit("w"), "id").alias("tracklet"),
        F.array(*[F.when(F.col("id") % 7 == i, -1).otherwise(F.col("id") * 5 + i) for i in range(5)]).cast("array<long>").alias("rows"),
        F.array(*[F.col("id") % 6 != i for i in range(5)]).alias("complete"),
    )
    rels = spark.range(200).select(
        "id", F.concat(F.lit("w"), F.col("id") % 43).alias("subject_tracklet"), F.concat(F.lit("w"), F.col("id") * 3 % 41).alias("object_tracklet"), F.lit("s").alias("scene_token"), F.col("id").alias("start_sample_index")
    )
    want = sorted(map(str, ri.temporal_index(rels, windows).select("id", "joint_mask").collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = ri.temporal_index(
            writers.write_bucketed(rels, str(tmp_path), "relations", "subject_tracklet", 5), writers.write_bucketed(windows, str(tmp_path), "windows", "tracklet", 5)
        ).select("id", "joint_mask")
        assert sorted(map(str, found.collect())) == want and want
        assert [d for d, _ in exchanges(found)] == ["object_tracklet"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_last_sound_line_of_a_key_wins(spark, tmp_path):
    (tmp_path / "a.txt").write_text("P0: 1 2\nnote\nP1: 3\nP0: 4 5 6\nP1: x\n P0 : 7\n")
    (tmp_path / "b.txt").write_text("P0: 8\nP1:\n")
    lines = readers.text_lines(spark, str(tmp_path))
    last = {(r["path"][-5], r["key"]): r["numbers"] for r in readers.keyed_numbers(lines, order="line").collect()}
    assert last == {("a", "P0"): [7.0], ("a", "P1"): [3.0], ("b", "P0"): [8.0], ("b", "P1"): []}
    assert readers.keyed_numbers(lines).count() == 6


def frames(spark, path, *rows):
    spark.createDataFrame(rows, "sequence string, frame long, value string").coalesce(1).write.mode("append").parquet(path)


def test_frames_are_taken_once_and_only_when_new(spark, tmp_path):
    from trafficloom.streaming import ingest

    inbox, target, state = (str(tmp_path / n) for n in ("inbox", "target", "state"))
    schema = spark.createDataFrame([], "sequence string, frame long, value string").schema

    def deliver(name, *rows):
        frames(spark, f"{inbox}/{name}", *rows)
        ingest.ingest_frames(spark, f"{inbox}/*", schema, target, state)

    deliver("a", ("s", 3, "x"), ("s", 3, "y"), ("s", 5, "z"), ("t", 1, "t1"), (None, 2, "n"), ("t", None, "lost"))
    deliver("b", ("s", 4, "late"), ("s", 5, "again"), ("s", 6, "new"), ("t", 9, "t9"), ("u", -1, "u"), (None, 2, "again"), (None, 3, "n3"))
    deliver("c", ("s", 6, "again"))
    found = {(r["sequence"], r["frame"], r["value"], r[ingest.BATCH]) for r in ingest.committed(spark, target).collect()}
    assert found == {("s", 3, "x", 0), ("s", 3, "y", 0), ("s", 5, "z", 0), ("t", 1, "t1", 0), (None, 2, "n", 0), ("s", 6, "new", 1), ("t", 9, "t9", 1), ("u", -1, "u", 1), (None, 3, "n3", 1)}


def test_what_a_failed_batch_wrote_is_not_seen(spark, tmp_path):
    from trafficloom.streaming import ingest

    inbox, target, state = (str(tmp_path / n) for n in ("inbox", "target", "state"))
    schema = spark.createDataFrame([], "sequence string, frame long, value string").schema
    frames(spark, f"{inbox}/a", ("s", 1, "one"))
    ingest.ingest_frames(spark, f"{inbox}/*", schema, target, state)
    frames(spark, f"{inbox}/b", ("s", 2, "two"), ("s", 1, "again"))

    def written_then_lost(rows):
        rows.write.parquet(f"{target}/{ingest.BATCH}=1")
        raise RuntimeError("executor gone")

    with pytest.raises(Exception, match="executor gone"):
        ingest.ingest_frames(spark, f"{inbox}/*", schema, target, state, transform=written_then_lost)
    assert ingest.ingested(spark, target).count() == 2
    assert [r["value"] for r in ingest.committed(spark, target).collect()] == ["one"]
    ingest.ingest_frames(spark, f"{inbox}/*", schema, target, state)
    assert sorted(r["value"] for r in ingest.committed(spark, target).collect()) == ["one", "two"]
