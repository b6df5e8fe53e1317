"""Token counts from flat token files that have no index.

A file is a run of fixed-width ids, documents end with a separator id, and blocks are cut anywhere. Separators are searched with
one vector comparison per block; each block then only keeps its first and last stretch and the lengths in between. A prefix scan
over the blocks of a file gives every block the tokens and separators before it, and so closes the documents that span
blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trafficloom.llm.bpe import codec
from trafficloom.llm.texts import emitted, narrow, rows_of

BLOCK_TOKENS = 1 << 16
FILE_TOKENS = 1 << 27
_BLOCKS = "file string, block long, tokens binary, first_doc long, doc_ids array<long>"
_SCANNED = "file string, block long, n long, seps long, head long, last long, inner array<long>"


def token_blocks(docs: DataFrame, path: str, separator: int, kind: str = "<u2", block: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, tokens, first_doc, doc_ids): documents as flat token files, one or more per task, in blocks.

    Rows with tokens are the files' blocks and know nothing of documents. Rows without tokens are the writer's own list of
    which document came in which place, for checking and joining back. A new file starts after FILE_TOKENS tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, True)
        end = np.array([separator], dtype=kind).tobytes()
        width = np.dtype(kind).itemsize
        task = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            roll, number, docs_before, held, ids, written = 0, 0, 0, bytearray(), [], 0
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                held += bpe.encode(text.decode()).astype(kind).tobytes() + end
                ids.append(doc_id)
                while len(held) >= block * width:
                    yield f"{task}-{roll}", number, bytes(held[: block * width]), None, None
                    del held[: block * width]
                    number, written = number + 1, written + block
                if len(ids) >= 4096:
                    yield f"{task}-{roll}", None, None, docs_before, ids
                    docs_before, ids = docs_before + len(ids), []
                if written >= FILE_TOKENS:
                    yield from close(roll, number, held, docs_before, ids)
                    roll, number, docs_before, held, ids, written = roll + 1, 0, 0, bytearray(), [], 0
            yield from close(roll, number, held, docs_before, ids)

        def close(roll: int, number: int, held: bytearray, docs_before: int, ids: list[int]) -> Iterator[tuple]:
            if held:
                yield f"{task}-{roll}", number, bytes(held), None, None
            if ids:
                yield f"{task}-{roll}", None, None, docs_before, ids

        return emitted(_BLOCKS, rows())

    return narrow(docs).mapInArrow(run, _BLOCKS)


def read_token_files(spark: SparkSession, path: str, kind: str = "<u2", block: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, tokens) of binary token files below 2 GB each, as any writer leaves them."""
    width = np.dtype(kind).itemsize * block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                    data = memoryview(content.as_buffer())
                    for number, at in enumerate(range(0, len(data), width)):
                        yield name.as_py(), number, bytes(data[at : at + width])

        return emitted("file string, block long, tokens binary", rows())

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, block long, tokens binary")


def _scan(separator: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for file, number, blob in rows_of(batches, "file", "block", "tokens"):
                ids = np.frombuffer(blob, dtype=kind)
                at = np.flatnonzero(ids == separator)
                if len(at):
                    yield file, number, len(ids), len(at), int(at[0]), int(at[-1]), (np.diff(at) - 1).tolist()
                else:
                    yield file, number, len(ids), 0, len(ids), None, []

        return emitted(_SCANNED, rows())

    return run


def count_tokens(blocks: DataFrame, separator: int, kind: str = "<u2") -> DataFrame:
    """(file, doc_no, n_tokens, terminated): one row per document, numbered from 0 within its file, separators not counted.

    Two separators in a row enclose a document of no tokens. Tokens after the last separator of a file are a document that is
    not terminated; an empty file or table has none. The scan over a file's blocks orders one narrow row per block.
    Blocks must be numbered in order within a file and cut between ids; null blocks count as empty.
    """
    clean = blocks.select("file", "block", F.coalesce("tokens", F.lit(b"")).alias("tokens"))
    scanned = clean.mapInArrow(_scan(separator, kind), _SCANNED)
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = scanned.withColumn("tokens_before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn(
        "docs_before", F.coalesce(F.sum("seps").over(before), F.lit(0))
    )
    after_last = F.max(F.col("tokens_before") + F.col("last") + 1).over(before)
    carried = placed.withColumn("carry", F.col("tokens_before") - F.coalesce(after_last, F.lit(0))).withColumn(
        "is_last", F.lead("block").over(order).isNull()
    )
    closed = F.when(F.col("seps") > 0, F.array(F.col("head") + F.col("carry"))).otherwise(F.array().cast("array<bigint>"))
    rest = F.when(F.col("seps") > 0, F.col("n") - F.col("last") - 1).otherwise(F.col("carry") + F.col("n"))
    lengths = F.concat(closed, "inner", F.when(F.col("is_last"), F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    found = carried.select("file", "docs_before", "seps", F.posexplode(lengths).alias("k", "n_tokens"))
    return found.select(
        "file",
        (F.col("docs_before") + F.col("k")).alias("doc_no"),
        "n_tokens",
        (F.col("k") < F.col("seps")).alias("terminated"),
    ).where("terminated OR n_tokens > 0")
