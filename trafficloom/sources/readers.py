"""Readers of raw drive data: file listings, calibration, poses, time stamps, boxes, splits, sweeps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficloom.operators.checks import required
from trafficloom.operators.observations import decode_points
from trafficloom.plans.pinning import pin

SPLITS = ("train", "validation", "test")
LISTING_TASKS = 4


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length) of all files below a folder; the files' content is not read. Empty for a missing folder.

    Spark plans a task for some dozens of files, as if it would open them; a row per file needs only a few tasks a core.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    try:
        return reader.load(root).select("path", "length").coalesce(LISTING_TASKS * spark.sparkContext.defaultParallelism)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, length long")


def file_index(files: DataFrame) -> DataFrame:
    """Files whose name is a whole number, with that number as `frame`; other files are ignored."""
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    return files.withColumn("frame", F.when(stem.rlike(r"^[+-]?\d+$"), stem).try_cast("long")).where(
        F.col("frame").isNotNull()
    )


def _numbers(text: Column) -> Column:
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: w.try_cast("double"))


def keyed_numbers(lines: DataFrame, value: str = "value", order: str | None = None, by: Sequence[str] = ("path",)) -> DataFrame:
    """`key: numbers` lines; lines without a colon or with anything but numbers are skipped.

    With `order`, a column that places the lines of a file (`by`), the last sound line of a key wins and the others go.
    """
    parts = lines.where(F.col(value).contains(":")).select(
        *[c for c in lines.columns if c != value],
        F.trim(F.substring_index(value, ":", 1)).alias("key"),
        _numbers(F.expr(f"substr(`{value}`, instr(`{value}`, ':') + 1)")).alias("numbers"),
    )
    sound = parts.where(F.forall("numbers", lambda n: n.isNotNull()))
    if order is None:
        return sound
    return sound.groupBy(*by, "key").agg(F.max_by("numbers", order).alias("numbers"))


def pose_lines(lines: DataFrame, value: str = "value", strict: bool = True) -> DataFrame:
    """`frame` and a 4x4 `matrix` from 12 or 16 numbers per line; blank lines are skipped.

    A malformed line fails the job, or with `strict` off has a null matrix and stays for inspection.
    """
    others = [c for c in lines.columns if c != value]
    split = lines.where(F.trim(value) != "").select(*others, value, _numbers(F.col(value)).alias("_n"))
    frame = F.split(F.trim(F.col(value)), r"\s+")[0].try_cast("long")
    numbers = F.expr("slice(_n, 2, greatest(size(_n) - 1, 0))")
    whole = F.when(F.size("_n") == 13, F.concat(numbers, F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]))).when(
        F.size("_n") == 17, numbers
    )
    sound = frame.isNotNull() & whole.isNotNull() & F.forall("_n", lambda n: n.isNotNull())
    if strict:
        matrix = required(whole, sound, "malformed pose line")
        return split.select(*others, frame.alias("frame"), matrix.alias("matrix"))
    return split.select(*others, value, frame.alias("frame"), F.when(sound, whole).alias("matrix"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with `path` and 0-based `line`, numbered per file without reading a file in one task.

    The pieces that a file is read in are counted; a line follows from its place in the piece and the lines of the pieces before.
    Files are opened once, as the lines are pinned with the numbers they were read under.
    """
    read = pin(
        spark.read.option("recursiveFileLookup", "true").text(path).select(
            "value",
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_seen"),
        )
    )
    # a piece is read from end to end by one task, so its numbers have no gaps
    pieces = read.groupBy("path", "_block").agg(F.min("_seen").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = pieces.select("path", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return read.join(shifts, ["path", "_block"]).select("path", (F.col("_seen") + F.col("_shift")).alias("line"), "value")


def nanoseconds(text: Column) -> Column:
    """`yyyy-mm-dd hh:mm:ss[.fraction]` as whole nanoseconds since 1970, whatever the session's time zone."""
    clean = F.replace(F.trim(text), F.lit(" "), F.lit("T"))
    moment = F.substring(clean, 1, 19).try_cast("timestamp_ntz")
    days = F.datediff(F.to_date(moment), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = days * 86400 + F.hour(moment).cast("long") * 3600 + F.minute(moment) * 60 + F.second(moment)
    fraction = F.rpad(F.regexp_extract(clean, r"\.(\d{1,9})", 1), 9, "0").cast("long")
    return seconds * 1000000000 + fraction


def timestamps(lines: DataFrame) -> DataFrame:
    """Frame number (the line's), nanoseconds and the original text; an unreadable line fails the job."""
    ns = nanoseconds(F.col("value"))
    return lines.select(
        "path",
        F.col("line").alias("frame"),
        required(ns, ns.isNotNull(), "malformed time stamp").alias("timestamp_ns"),
        F.trim("value").alias("timestamp_text"),
    )


_MATRIX = T.StructType(
    [T.StructField("rows", T.IntegerType()), T.StructField("cols", T.IntegerType()), T.StructField("data", T.StringType())]
)
_BOX = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("dynamic", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("start_frame", T.StringType()),
        T.StructField("end_frame", T.StringType()),
        T.StructField("index", T.StringType()),
        T.StructField("semanticId", T.StringType()),
        T.StructField("instanceId", T.StringType()),
        T.StructField("transform", _MATRIX),
        T.StructField("vertices", _MATRIX),
    ]
)


_FIELDS = {f.name for f in _BOX.fields}


def _box_children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The children of each document's root that are boxes, cut down to the known fields, in one tag."""
    for batch in batches:
        for path, text in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
            orders, boxes = [], []
            for order, child in enumerate(ElementTree.fromstring(text) if text and text.strip() else ()):
                if child.find("transform") is None or child.find("vertices") is None:
                    continue
                box = ElementTree.Element("box")
                # the first of several fields of one name counts
                box.extend({field.tag: field for field in reversed(child) if field.tag in _FIELDS}.values())
                orders.append(order)
                boxes.append(ElementTree.tostring(box, encoding="unicode"))
            columns = [pa.array([path] * len(boxes), pa.string()), pa.array(orders, pa.int32()), pa.array(boxes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "document_order", "_xml"])


def boxes_xml(documents: DataFrame, value: str = "value") -> DataFrame:
    """Box records from XML documents, one document per row with its `path`.

    Children of the root may have any tag, attributes and nested elements; those with a transform and vertices of their
    own are boxes. Numbers that are missing or unreadable take their defaults, a matrix whose size does not fit its
    data drops the box. A document that is not well-formed fails the job.
    """
    parsed = (
        documents.select("path", F.col(value).alias("value"))
        .mapInArrow(_box_children, "path string, document_order int, _xml string")
        .withColumn("b", F.from_xml("_xml", _BOX, {"mode": "FAILFAST"}))
    )

    def numbers(name: str) -> Column:
        values = _numbers(F.col(f"b.{name}.data"))
        fits = (F.size(values) == F.col(f"b.{name}.rows") * F.col(f"b.{name}.cols")) & F.forall(
            values, lambda v: v.isNotNull()
        )
        return F.when(fits, values)

    def whole(name: str, default: Column) -> Column:
        return F.coalesce(F.trim(F.col(f"b.{name}")).try_cast("long"), default)

    stamp = whole("timestamp", F.lit(-1).cast("long"))
    rows = parsed.select(
        "path",
        "document_order",
        whole("index", F.lit(-1).cast("long")).alias("annotation_index"),
        whole("semanticId", F.lit(-1).cast("long")).alias("semantic_id"),
        whole("instanceId", F.lit(-1).cast("long")).alias("instance_id"),
        F.coalesce(F.trim("b.label"), F.lit("unknown")).alias("label"),
        (whole("dynamic", F.lit(0).cast("long")) != 0).alias("dynamic"),
        stamp.alias("timestamp"),
        whole("start_frame", stamp).alias("start_frame"),
        whole("end_frame", stamp).alias("end_frame"),
        numbers("transform").alias("transform"),
        numbers("vertices").alias("_v"),
    )
    # Three numbers per corner.
    corners = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("_v") / 3).cast("int") - 1),
        lambda i: F.struct(F.get("_v", 3 * i).alias("x"), F.get("_v", 3 * i + 1).alias("y"), F.get("_v", 3 * i + 2).alias("z")),
    )
    sound = F.col("transform").isNotNull() & F.col("_v").isNotNull() & (F.size("_v") >= 3)
    return rows.where(sound).withColumn("vertices", corners).drop("_v")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) with one row per file, for formats that are parsed as a document."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )


def split_json(documents: DataFrame, value: str = "value") -> DataFrame:
    """(path, sequence, split) from either layout: lists of sequences per split, or a split per sequence.

    A sequence named twice or an unknown split fails the job.
    """
    known = F.array(*[F.lit(s) for s in SPLITS])
    entries = documents.select("path", F.from_json(value, "map<string,string>").alias("_m")).select(
        "path",
        F.forall(F.map_keys("_m"), lambda k: F.array_contains(known, k)).alias("_lists"),
        F.explode("_m").alias("_key", "_value"),
    )
    listed = entries.where("_lists").select(
        "path", F.explode(F.from_json("_value", "array<string>")).alias("sequence"), F.col("_key").alias("split")
    )
    single = entries.where(~F.col("_lists")).select("path", F.col("_key").alias("sequence"), F.col("_value").alias("split"))
    grouped = listed.union(single).groupBy("path", "sequence").agg(
        F.count(F.lit(1)).alias("_n"), F.min("split").alias("split")
    )
    once = required(F.col("split"), F.col("_n") == 1, "a sequence is listed more than once")
    return grouped.select("path", "sequence", once.alias("split")).withColumn(
        "split", required(F.col("split"), F.array_contains(known, F.col("split")), "unknown split")
    )


def json_array(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = True) -> DataFrame:
    """Records of JSON arrays; an entry that is no object or an array that is cut off fails the job.

    `multi_line` reads one array per file; without it every line holds an array or a record, and files are split.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=multi_line)


def lidar_points(spark: SparkSession, root: str, pattern: str = "*.bin") -> DataFrame:
    """Points of all binary sweeps below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return decode_points(files.load(root).select("path", "content"))


def feature_metadata(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Feature metadata, one JSON record per line; see `relation_index.metadata_checks`."""
    return spark.read.schema(schema).json(path)

