"""Binary LiDAR sweeps as a Spark data source: one file per sweep, little-endian float32 quadruples x, y, z, intensity.

Reading plans partitions from file sizes: large files are cut at byte ranges, small ones are packed together. Filters on `sequence`
and `frame` are answered from the file names, so other files are neither planned nor opened. Writing gives each sweep a file of its own; files stand in
a temporary folder until the whole job has succeeded.

Sweeps are as many as a drive has frames, so the driver never holds them one by one: folders are listed in turn, and names of files wait in
compressed blocks, in partitions to be read as in messages of what was written.

Files are reached through `pyarrow.fs` (local paths, hdfs, s3, gs, ..). For stores that only Spark's own readers can open,
`readers.lidar_points` reads whole files.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

POINT_BYTES = 16
BATCH_POINTS = 1 << 16
MAX_BYTES = 128 << 20
OPEN_COST = 4 << 20
OPEN_TASKS = 32
BLOCK = 4096
THREADS = 16
SCHEMA = "path string, sequence string, frame long, point_id long, x float, y float, z float, intensity float"
_COORDINATES = ("x", "y", "z", "intensity")
_ARROW = {"path": pa.string(), "sequence": pa.string(), "frame": pa.int64(), "point_id": pa.int64()}
_PENDING = "_temporary"


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """File system and the path in it."""
    if root.startswith("file:"):
        root = "/" + root[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(root)


@dataclass(frozen=True)
class Sweep:
    path: str
    size: int
    sequence: str | None
    frame: int


def named(path: str, size: int, root: str) -> Sweep | None:
    """The sweep a file holds by its name; None if the name is no whole number.

    The sequence is the value of a folder `sequence=..`, or else the first folder below the root.
    """
    parts = path[len(root.rstrip("/")) + 1 :].split("/")
    if not re.fullmatch(r"[+-]?\d+\.bin", parts[-1]) or any(p.startswith(("_", ".")) for p in parts[:-1]):
        return None
    told = [p.removeprefix("sequence=") for p in parts[:-1] if p.startswith("sequence=")]
    sequence = unquote(told[-1]) if told else parts[0] if len(parts) > 1 else None
    return Sweep(path, size, sequence, int(parts[-1][:-4]))


def listed(root: str) -> Iterator[Sweep]:
    """All sweeps below a folder; the folders in it are listed some at a time, each as a whole."""
    system, folder = opened(root)
    top = sorted(system.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda f: f.path)

    def inside(path: str) -> list[fs.FileInfo]:
        found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        return sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path)

    def sweeps(files: Iterable[fs.FileInfo]) -> Iterator[Sweep]:
        return (s for f in files if (s := named(f.path, f.size, folder)) is not None)

    yield from sweeps(f for f in top if f.type == fs.FileType.File)
    folders = [f.path for f in top if f.type == fs.FileType.Directory and not f.base_name.startswith(("_", "."))]
    with ThreadPoolExecutor(THREADS) as pool:
        for some in _blocks(folders, 4 * THREADS):
            for files in pool.map(inside, some):
                yield from sweeps(files)


def _blocks(items: Iterable, size: int = BLOCK) -> Iterator[list]:
    held = []
    for item in items:
        held.append(item)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _packed(items: list) -> bytes:
    return zlib.compress(pickle.dumps(items, pickle.HIGHEST_PROTOCOL), 1)


def _unpacked(block: bytes) -> list:
    return pickle.loads(zlib.decompress(block))


_COMPARED = {
    ds.EqualTo: lambda a, b: a == b,
    ds.EqualNullSafe: lambda a, b: a == b,
    ds.GreaterThan: lambda a, b: a > b,
    ds.GreaterThanOrEqual: lambda a, b: a >= b,
    ds.LessThan: lambda a, b: a < b,
    ds.LessThanOrEqual: lambda a, b: a <= b,
    ds.In: lambda a, b: a in b,
}


def by_name(found: ds.Filter) -> bool:
    """The filter can be answered from a file's name."""
    known = type(found) in _COMPARED or isinstance(found, ds.IsNotNull)
    return known and found.attribute in (("sequence",), ("frame",))


def passes(sweep: Sweep, found: ds.Filter) -> bool:
    value = getattr(sweep, found.attribute[0])
    if isinstance(found, ds.IsNotNull):
        return value is not None
    if value is None or found.value is None:
        return isinstance(found, ds.EqualNullSafe) and value is found.value
    return _COMPARED[type(found)](value, found.value)


@dataclass
class Pieces(ds.InputPartition):
    """Byte ranges (sweep, first byte, number of bytes) for one task, packed."""

    packed: bytes

    @property
    def ranges(self) -> list[tuple[Sweep, int, int]]:
        return _unpacked(self.packed)


def planned(sweeps: Iterable[Sweep], max_bytes: int, open_cost: int, tasks: int) -> list[Pieces]:
    """Partitions of at most `max_bytes`, less if there would be fewer than `tasks`; opening a file counts as `open_cost` bytes.

    Where opening files would make more than OPEN_TASKS partitions for each of `tasks`, it counts less. A file whose size is no multiple
    of a point's fails the job.
    """
    blocks, n, total = [], 0, 0
    for block in _blocks(sweeps):
        for s in block:
            if s.size % POINT_BYTES:
                raise ValueError(f"not a multiple of {POINT_BYTES} bytes: {s.path}")
            n, total = n + 1, total + s.size
        blocks.append(_packed(block))
    share = (total + n * open_cost) // max(1, tasks)
    most = max(POINT_BYTES, min(max_bytes, max(open_cost, share)) // POINT_BYTES * POINT_BYTES)
    cost = min(open_cost, max(0, most * OPEN_TASKS * max(1, tasks) - total) // max(1, n))
    out: list[Pieces] = []
    small: list[tuple[Sweep, int, int]] = []
    room = most
    for s in (s for block in blocks for s in _unpacked(block)):
        for at in range(0, s.size, most):
            size = min(most, s.size - at)
            if size > most // 2:
                out.append(Pieces(_packed([(s, at, size)])))
                continue
            if small and room < size:
                out.append(Pieces(_packed(small)))
                small, room = [], most
            small.append((s, at, size))
            room -= size + cost
    return out + ([Pieces(_packed(small))] if small else [])


class _Reader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], columns: Sequence[str]) -> None:
        self.root, self.columns = options["path"], list(columns)
        self.max_bytes = int(options.get("maxpartitionbytes", MAX_BYTES))
        self.open_cost = int(options.get("opencostinbytes", OPEN_COST))
        self.tasks = int(options.get("tasks", 1))
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802
        for found in filters:
            if by_name(found):
                self.filters.append(found)
            else:
                yield found

    def partitions(self) -> Sequence[Pieces]:
        wanted = (s for s in listed(self.root) if all(passes(s, f) for f in self.filters))
        # Spark asks for a partition even where there is nothing to read
        return planned(wanted, self.max_bytes, self.open_cost, self.tasks) or [Pieces(_packed([]))]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.root)
        for sweep, start, length in partition.ranges:
            with system.open_input_file(sweep.path) as file:
                for at in range(start, start + length, BATCH_POINTS * POINT_BYTES):
                    size = min(BATCH_POINTS * POINT_BYTES, start + length - at)
                    content = file.read_at(size, at)
                    if len(content) != size:
                        raise ValueError(f"shorter than when it was listed: {sweep.path}")
                    yield self._batch(sweep, at // POINT_BYTES, np.frombuffer(content, dtype="<f4").reshape(-1, 4))

    def _batch(self, sweep: Sweep, first: int, values: np.ndarray) -> pa.RecordBatch:
        n, made = len(values), []
        for column in self.columns:
            if column in _COORDINATES:
                made.append(pa.array(values[:, _COORDINATES.index(column)]))
            elif column == "point_id":
                made.append(pa.array(np.arange(first, first + n)))
            else:
                made.append(pa.repeat(pa.scalar(getattr(sweep, column), _ARROW[column]), n))
        return pa.RecordBatch.from_arrays(made, names=self.columns)


@dataclass
class _Written(ds.WriterCommitMessage):
    """Files of one task: its folder, and in packed blocks their relative final paths; there they are numbered in this order."""

    pending: str
    blocks: list[bytes]

    def moves(self, root: str) -> Iterator[list[tuple[str, str]]]:
        """(from, to) of a block of files at a time."""
        at = 0
        for names in map(_unpacked, self.blocks):
            yield [(f"{self.pending}/{at + k}", f"{root}/{to}") for k, to in enumerate(names)]
            at += len(names)


class _Writer(ds.DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.root, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, root = opened(self.root)
        pending = f"{root}/{_PENDING}/{self.job}/{uuid.uuid4().hex}"
        blocks: list[bytes] = []
        names: list[str] = []
        now, out, to = None, None, None
        try:
            for batch in iterator:
                keys = list(zip(batch.column("sequence").to_pylist(), batch.column("frame").to_pylist(), strict=True))
                points = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _COORDINATES]).astype("<f4")
                cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    if keys[a] != now:
                        if out is not None:
                            out.close()
                        now = keys[a]
                        if now[1] is None:
                            raise ValueError("a point without a frame")
                        before, to = to, f"{'' if now[0] is None else f'sequence={quote(now[0], safe="")}/'}{now[1]:010d}.bin"
                        if to == before:
                            raise ValueError("points are not in order of sequence and frame")
                        if before is None:
                            system.create_dir(pending, recursive=True)
                        out = system.open_output_stream(f"{pending}/{len(blocks) * BLOCK + len(names)}")
                        names.append(to)
                        if len(names) == BLOCK:
                            blocks.append(_packed(names))
                            names = []
                    out.write(points[a:b].tobytes())
        finally:
            if out is not None:
                out.close()
        return _Written(pending, [*blocks, _packed(names)] if names else blocks)

    def _removed(self) -> None:
        system, root = opened(self.root)
        system.delete_dir(f"{root}/{_PENDING}/{self.job}") if self._pending(system, root) else None
        left = system.get_file_info(fs.FileSelector(f"{root}/{_PENDING}", allow_not_found=True))
        if not left and system.get_file_info(f"{root}/{_PENDING}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{_PENDING}")

    def _pending(self, system: fs.FileSystem, root: str) -> bool:
        return system.get_file_info(f"{root}/{_PENDING}/{self.job}").type == fs.FileType.Directory

    def commit(self, messages: list[_Written | None]) -> None:
        system, root = opened(self.root)
        written = [m for m in messages if m is not None]
        self._checked(written, system, root)
        with ThreadPoolExecutor(THREADS) as pool:
            if self.overwrite:
                for sweeps in _blocks(listed(self.root)):
                    list(pool.map(system.delete_file, [s.path for s in sweeps]))
            for block in (b for m in written for b in m.moves(root)):
                list(pool.map(lambda d: system.create_dir(d, recursive=True), {b.rpartition("/")[0] for _, b in block}))
                list(pool.map(lambda m: system.move(*m), block))
        self._removed()

    def _checked(self, written: list[_Written], system: fs.FileSystem, root: str) -> None:
        """Fails if a file was written twice, or is there already; files are told apart by 16 bytes each."""
        prints = []
        for block in (b for m in written for b in m.moves(root)):
            prints.append(np.frombuffer(b"".join(xxhash.xxh128_digest(b) for _, b in block), dtype="V16"))
            found = [] if self.overwrite else [f.path for f in system.get_file_info([b for _, b in block]) if f.type != fs.FileType.NotFound]
            if found:
                self._removed()
                raise FileExistsError(f"sweep exists: {found[0]}")
        if prints:
            every = np.concatenate(prints).view("<u8").reshape(-1, 2)
            every = every[np.lexsort((every[:, 1], every[:, 0]))]
            if (every[1:] == every[:-1]).all(axis=1).any():
                self._removed()
                raise ValueError("a sweep was written by several tasks; partition by sequence and frame")

    def abort(self, messages: list[_Written | None]) -> None:
        self._removed()


class SweepSource(ds.DataSource):
    """Format `sweeps`. Options: path, columns (comma-separated), maxPartitionBytes, openCostInBytes, tasks."""

    @classmethod
    def name(cls) -> str:
        return "sweeps"

    def _columns(self) -> list[str]:
        every = [c.split()[0] for c in SCHEMA.split(", ")]
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        if unknown := set(wanted) - set(every):
            raise ValueError(f"no such column of a sweep: {sorted(unknown)}")
        return [c for c in every if not wanted or c in wanted]

    def schema(self) -> str:
        kinds = dict(c.split() for c in SCHEMA.split(", "))
        return ", ".join(f"{c} {kinds[c]}" for c in self._columns())

    def reader(self, schema: StructType) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()}, [f.name for f in schema.fields])

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer({k.lower(): v for k, v in self.options.items()}, overwrite)


_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", text.strip().lower()).groups()
    return int(number) * _UNITS[unit]


def read_sweeps(spark: SparkSession, root: str, columns: Sequence[str] = ()) -> DataFrame:
    """Points of all sweeps below a folder: path, sequence, frame, point_id (place in the file), x, y, z, intensity.

    `columns` limits what is made of a point. Filters on sequence and frame reach the planning of partitions, for which this
    turns on Spark's setting for filters of Python data sources. Partition sizes follow Spark's settings for files.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SweepSource)
    options = {
        "columns": ",".join(columns),
        "maxPartitionBytes": str(_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))),
        "openCostInBytes": str(_bytes(spark.conf.get("spark.sql.files.openCostInBytes"))),
        "tasks": str(spark.sparkContext.defaultParallelism),
    }
    return spark.read.format("sweeps").options(**options).load(root)


def write_sweeps(points: DataFrame, root: str, order: str = "point_id", force: bool = False) -> None:
    """A file `sequence=<sequence>/<frame>.bin` per sweep, its points by `order`; existing sweeps are an error unless forced.

    `points` has sequence, frame, x, y, z, intensity and the order; missing numbers are written as NaN. With `force` the folder's
    other sweeps go. A point without a frame fails the job, and nothing of a failed job stays.
    """
    spark = points.sparkSession
    spark.dataSource.register(SweepSource)
    (
        points.select(
            F.col("sequence").cast("string"),
            F.col("frame").cast("long"),
            *[F.coalesce(F.col(c).cast("float"), F.lit(float("nan")).cast("float")).alias(c) for c in _COORDINATES],
            F.col(order).alias("_order"),
        )
        .repartition("sequence", "frame")
        .sortWithinPartitions("sequence", "frame", "_order")
        .drop("_order")
        .write.format("sweeps")
        .mode("overwrite" if force else "append")
        .save(root)
    )
