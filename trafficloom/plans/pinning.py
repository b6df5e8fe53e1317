"""Cutting lineage through the checkpoint folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it; a temporary one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    # Kept on the application, so that a session started later in the same process gets its own.
    kept = _LOCAL_FOLDERS.get(context.applicationId)
    if kept is None:
        kept = _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="trafficloom-")
    return kept


_LOCAL_FOLDERS: dict[str, str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, for a table or text folder written by a job."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


FILE_ROWS = 1 << 15


def gathered(df: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """`df`, of at most `rows` rows, in about `each` rows a partition, but two partitions per core at least.

    Partitions are only put together, never split or shuffled, so every row stays and none moves.
    """
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def pin(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write the rows once and go on from the written copy.

    Needed where a plan reads the same rows twice and both reads must agree (split numbers of a range
    partitioning), and inside loops, where the plan would otherwise grow with every round.

    Every partition is a file, be it empty, and a local file costs its writer two processes (Hadoop runs chmod for it and for its
    checksum). `rows`, where known that there are no more, lets the files follow from the rows.
    """
    if rows is not None:
        df = gathered(df, rows)
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
