"""Helpers shared by the operators on texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str = "text") -> Column:
    """The bytes of a text; null is the empty text."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias("text")


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text as bytes), whatever other columns the table has."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col))


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Python tuples, one Arrow slice of at most 1024 rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


_KINDS = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of "name kind, name kind, .."; workers have no session that could parse it."""
    return pa.schema([(name, _KINDS[kind]) for name, kind in (x.split(" ", 1) for x in ddl.split(", "))])


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def emitted(schema: str, rows: Iterator[tuple], size: int = 2000, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of bounded rows and bytes."""
    kind, held, weight = arrow_schema(schema), [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= size or weight >= max_bytes:
            yield batch_of(kind, held)
            held, weight = [], 0
    if held:
        yield batch_of(kind, held)
