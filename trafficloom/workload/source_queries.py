"""Queries on sources and sinks: text and files are written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trafficloom.plans.pinning import scratch_path
from trafficloom.sources import readers, sweeps, writers
from trafficloom.streaming import ingest
from trafficloom.workload import evaluation_queries, spatial_queries, tables
from trafficloom.workload.common import r6, registry

QUERIES, query = registry()


def _written(df: DataFrame, label: str) -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.text(path)
    return path


def _words(*values: Column | str) -> Column:
    return F.concat_ws(" ", *[F.col(v) if isinstance(v, str) else v for v in values])


def _sweeps(spark: SparkSession, sf: str) -> str:
    """Folder with one file per sequence and day that holds its events' points."""
    root = scratch_path(spark, "sweeps")
    points = tables.events(spark, sf).select(
        "sequence",
        F.col("day").alias("frame"),
        F.col("event_id").alias("point_id"),
        (F.col("cents") / 500.0).alias("x"),
        (F.col("k") / 5.0).alias("y"),
        (F.col("event_id") % 3).alias("z"),
        (F.col("event_id") % 7).alias("intensity"),
    )
    sweeps.write_sweeps(points, root)
    return root


@query
def src_file_index(spark, sf):
    """The sweeps of the events as they lie in their folder, beside files whose names are no numbers."""
    root = _sweeps(spark, sf)
    notes = tables.events(spark, sf).select("sequence", F.col("event_type").alias("value"))
    # brought together, so that a sequence gets one file of notes, not one of every task
    notes.repartition("sequence").write.mode("append").partitionBy("sequence").text(root)
    found = readers.file_index(readers.list_files(spark, root))
    sequence = F.regexp_extract("path", r"sequence=(\d+)", 1).cast("long")
    return found.select(sequence.alias("sequence"), "frame", "length")


@query
def src_keyed_text(spark, sf):
    """One calibration file per sequence, its lines in order of the events: a key comes again with every event of its user's
    number; views write a comment, values of errors are no numbers."""
    key = F.concat(F.lit("P_"), F.col("k"))
    lines = tables.events(spark, sf).select(
        "sequence",
        "event_id",
        F.when(F.col("event_type") == "view", _words(F.lit("# note"), F.col("event_id").cast("string")))
        .when(F.col("event_type") == "error", F.concat(key, F.lit(": 1.0 x 2.0")))
        .otherwise(F.concat(key, F.lit(":  "), _words(F.col("value").cast("string"), F.col("event_id").cast("string"))))
        .alias("value"),
    )
    path = scratch_path(spark, "calibration")
    ordered = lines.repartition("sequence").sortWithinPartitions("sequence", "event_id")
    ordered.select("sequence", "value").write.partitionBy("sequence").text(path)
    found = readers.keyed_numbers(readers.text_lines(spark, path), order="line")
    return found.select(
        F.regexp_extract("path", r"sequence=(\d+)", 1).cast("long").alias("sequence"),
        "key",
        F.size("numbers").alias("count"),
        r6(F.get("numbers", F.lit(0)), "first"),
        r6(F.get("numbers", F.lit(1)), "second"),
    )


@query
def src_pose_text(spark, sf):
    """Pose lines with 12 numbers, or 16 for signups; views write blank lines."""
    x, y = F.col("value").cast("string"), F.col("k").cast("string")
    body = _words(F.lit("1 0 0"), x, F.lit("0 1 0"), y, F.lit("0 0 1 0.5"))
    lines = tables.events(spark, sf).select(
        F.when(F.col("event_type") == "view", F.lit("  "))
        .when(F.col("event_type") == "signup", _words(F.col("event_id").cast("string"), body, F.lit("0 0 0 1")))
        .otherwise(_words(F.col("event_id").cast("string"), body))
        .alias("value")
    )
    poses = readers.pose_lines(spark.read.text(_written(lines, "poses")))
    m = F.col("matrix")
    return poses.select("frame", F.size(m).alias("entries"), *[r6(F.get(m, F.lit(i)), f"m{i}") for i in (0, 3, 7, 11, 15)])


@query
def src_timestamps_text(spark, sf):
    """Event times written per sequence in time order, with nanoseconds, a day's lines behind the day before; frames count the lines
    of a day."""
    micros = F.lpad((F.expr("time_ns div 1000 % 1000000")).cast("string"), 6, "0")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.expr("cast(time_ns div 86400000000000 as int)"))
    clock = F.concat_ws(":", *[F.lpad(F.expr(f"cast({e} as string)"), 2, "0") for e in ("time_ns div 3600000000000 % 24", "time_ns div 60000000000 % 60", "time_ns div 1000000000 % 60")])
    rows = tables.events(spark, sf).select(
        "sequence",
        "time_ns",
        F.concat(day.cast("string"), F.lit(" "), clock, F.lit("."), micros, F.lit("123")).alias("value"),
    )
    path = scratch_path(spark, "timestamps")
    # One ordered file per sequence, as a recorder writes it: a file per day as well would make thirty times as many.
    ordered = rows.repartition("sequence").sortWithinPartitions("sequence", "time_ns")
    ordered.select("sequence", "value").write.partitionBy("sequence").text(path)
    stamped = readers.timestamps(readers.text_lines(spark, path)).select(
        F.regexp_extract("path", r"sequence=(\d+)", 1).cast("long").alias("sequence"),
        F.datediff(F.substring("timestamp_text", 1, 10).cast("date"), F.lit(tables.FIRST_DAY).cast("date")).cast("long").alias("day"),
        "frame",
        "timestamp_ns",
        "timestamp_text",
    )
    # a day has few lines of a sequence
    first = F.min("frame").over(Window.partitionBy("sequence", "day"))
    return stamped.withColumn("frame", F.col("frame") - first)


def _matrix_xml(name: str, rows: int, cols: int, data: Column) -> Column:
    head = f"<{name} type_id=\"opencv-matrix\"><rows>{rows}</rows><cols>{cols}</cols><dt>f</dt><data>"
    return F.concat(F.lit(head), data, F.lit(f"</data></{name}>"))


@query
def src_boxes_xml(spark, sf):
    """Boxes of every user and day as XML children of changing tags with attributes and comments; users of one class write broken matrices."""
    n = F.col("raw_frame_index")
    corners = " ".join(f"{x} {y} {z}" for x in (-0.5, 0.5) for y in (-0.5, 0.5) for z in (-0.5, 0.5))
    numbers = F.when(F.col("user_id") % 11 == 0, F.lit("1 2 3")).otherwise(
        _words(F.lit("1 0 0"), F.col("center_x").cast("string"), F.lit("0 1 0"), F.col("center_y").cast("string"), F.lit("0 0 1 0 0 0 0 1"))
    )
    tag = F.concat(F.lit("object-"), F.col("user_id"), F.lit("."), n)

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))

    child = F.concat(
        F.lit("<"), tag, F.lit(' kind="box &gt; 0"><!-- <object><transform/><vertices/></object> -->'),
        field("index", F.col("user_id")),
        F.when(F.col("label") != "unknown", field("label", F.col("label"))).otherwise(F.lit("")),
        field("semanticId", F.col("semantic_id")),
        field("instanceId", F.col("instance_id")),
        field("timestamp", n),
        F.when(F.col("dynamic"), F.lit("<dynamic>1</dynamic>")).otherwise(
            F.concat(field("start_frame", n - 1), field("end_frame", n + 1))
        ),
        _matrix_xml("transform", 4, 4, numbers),
        _matrix_xml("vertices", 8, 3, F.lit(corners)),
        F.lit("</"), tag, F.lit(">"),
    )
    notes = F.concat(F.lit("<note"), n, F.lit("><text>no box</text></note"), n, F.lit(">"))
    # One document per user: a user has at most one box per day.
    document = F.concat(
        F.lit('<?xml version="1.0"?><opencv_storage>'),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("raw_frame_index", F.concat(child, notes).alias("x")))), lambda s: s["x"]), ""),
        F.lit("</opencv_storage>"),
    )
    documents = tables.observations(spark, sf).groupBy("user_id").agg(document.alias("value"))
    read = spark.read.text(_written(documents.select("value"), "boxes")).select(F.lit("").alias("path"), "value")
    t = F.col("transform")
    return readers.boxes_xml(read).select(
        "annotation_index",
        "semantic_id",
        "instance_id",
        "label",
        "dynamic",
        "timestamp",
        "start_frame",
        "end_frame",
        r6(F.get(t, F.lit(3)), "x"),
        r6(F.get(t, F.lit(7)), "y"),
        F.size("vertices").alias("corners"),
    )


@query
def src_split_json(spark, sf):
    """Split documents over 32 orders each, even ones in one layout and odd ones in the other."""
    orders = tables.read(spark, sf, "orders").select(
        F.expr("o_orderkey div 32").alias("document"),
        F.concat(F.lit("order_"), "o_orderkey").alias("sequence"),
        F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "validation").otherwise("test").alias("split"),
    )
    per_split = orders.groupBy("document", "split").agg(F.array_sort(F.collect_list("sequence")).alias("s"))
    lists = per_split.where("document % 2 = 0").groupBy("document").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("split", "s")))).alias("value")
    )
    single = orders.where("document % 2 = 1").groupBy("document").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("sequence", "split")))).alias("value")
    )
    path = _written(lists.union(single).select(F.to_json(F.struct("document", "value")).alias("value")), "splits")
    read = spark.read.text(path).select(F.from_json("value", "document long, value string").alias("d"))
    return readers.split_json(read.select(F.col("d.document").alias("path"), F.col("d.value").alias("value"))).select("sequence", "split")


@query
def src_json_array(spark, sf):
    """Turns of each conversation as arrays of up to 32 records, one array per line."""
    turns = tables.read(spark, sf, "conversations").select(
        "conv_id", F.to_json(F.struct("conv_id", "turn", "role")).alias("r"), "turn"
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "r"))), lambda s: s["r"]), ",")
    lines = turns.groupBy("conv_id", F.expr("turn div 32")).agg(F.concat(F.lit("["), body, F.lit("]")).alias("value")).select("value")
    path = _written(lines, "records")
    return readers.json_array(spark, path, "conv_id long, turn long, role string", multi_line=False)


@query
def src_lidar_bin(spark, sf):
    """Every event's point in the sweep of its sequence and day, written as files by tasks and read back."""
    read = sweeps.read_sweeps(spark, _sweeps(spark, sf), ["sequence", "frame", "point_id", "x", "y", "z", "intensity"])
    exact = [(F.round(F.col(c).cast("double"), 3) + 0.0).alias(c) for c in ("x", "y", "z", "intensity")]
    return read.select(F.col("sequence").cast("long").alias("sequence"), "frame", "point_id", *exact)


@query
def sink_tables(spark, sf):
    """Tables written by sequence and read back."""
    obs = tables.observations(spark, sf).select("token", "sequence", "label", "volume")
    root = scratch_path(spark, "tables")
    writers.write_tables({"sample_annotation": obs, "sample": tables.samples(spark, sf)}, root)
    boxes, samples = (spark.read.parquet(f"{root}/{t}") for t in ("sample_annotation", "sample"))
    every = boxes.select("sequence", "label", "volume").unionByName(
        samples.select("sequence", F.lit("(samples)").alias("label"), F.lit(0.0).alias("volume"))
    )
    return every.groupBy(F.col("sequence").cast("long").alias("sequence"), "label").agg(
        F.count(F.lit(1)).alias("rows"), r6(F.sum("volume"), "volume")
    )


@query
def sink_json_records(spark, sf):
    """Observations as JSON, with an infinite depth for boxes that are not seen."""
    unseen = F.when(F.col("x1").isNull(), F.lit(float("inf"))).when(F.col("n") > 2, F.lit(float("nan"))).otherwise(F.col("depth"))
    obs = tables.observations(spark, sf).select("token", "sequence", unseen.alias("depth"), F.array(unseen, F.col("volume")).alias("pair"))
    path = scratch_path(spark, "json")
    writers.write_json_records(obs, path)
    read = spark.read.schema("token string, sequence long, depth double, pair array<double>").json(path)
    return read.select("token", "sequence", r6("depth"), r6(F.get("pair", F.lit(0)), "first"), r6(F.get("pair", F.lit(1)), "second"))


@query
def sink_records_csv_gz(spark, sf):
    """Predictions with their quality facts as compressed CSV."""
    facts = evaluation_queries.order_quality(spark, sf).select("relation_id", "quality_bin", "identity_error")
    rows = tables.predictions(spark, sf).select("relation_id", "sequence", "targets").join(facts, "relation_id")
    path = scratch_path(spark, "csv")
    writers.write_records_csv(rows, path)
    schema = "relation_id long, sequence long, targets string, quality_bin string, identity_error boolean"
    return spark.read.schema(schema).option("header", "true").csv(path)


@query
def ingest_incremental(spark, sf):
    """Relations arriving in two deliveries; each call takes in what is new."""
    rels = spatial_queries.relations(spark, sf).select("token", "sequence", "raw_frame_index", "near", "no_relation")
    inbox, target, state = (scratch_path(spark, n) for n in ("inbox", "target", "state"))
    early = F.col("raw_frame_index") < 15
    rels.where(early).write.parquet(f"{inbox}/first")
    schema = rels.schema
    ingest.ingest_incremental(spark, f"{inbox}/*", schema, target, state)
    rels.where(~early).write.parquet(f"{inbox}/second")
    ingest.ingest_incremental(spark, f"{inbox}/*", schema, target, state)
    ingest.ingest_incremental(spark, f"{inbox}/*", schema, target, state)
    return ingest.ingested(spark, target).groupBy(F.col(ingest.BATCH).cast("long").alias("batch"), "sequence").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("token").alias("tokens"), F.sum(F.col("near").cast("long")).alias("near")
    )


@query
def ingest_frames(spark, sf):
    """Relations of which even sequences first deliver their later frames, then every row comes again, and once more."""
    rels = spatial_queries.relations(spark, sf).select("token", "sequence", "raw_frame_index", "near")
    inbox, target, state = (scratch_path(spark, n) for n in ("inbox", "target", "state"))
    late = F.when(F.col("sequence") % 2 == 0, F.col("raw_frame_index") >= 15).otherwise(F.col("raw_frame_index") < 15)
    for name, part in (("first", rels.where(late)), ("second", rels), ("third", rels)):
        part.write.parquet(f"{inbox}/{name}")
        ingest.ingest_frames(spark, f"{inbox}/*", rels.schema, target, state, frame="raw_frame_index")
    return ingest.committed(spark, target).groupBy(F.col(ingest.BATCH).cast("long").alias("batch"), "sequence").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("token").alias("tokens"), F.max("raw_frame_index").alias("last_frame")
    )
