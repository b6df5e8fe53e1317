"""Leaving rows out of a shuffle that can have no partner, by a Bloom filter of the keys they would be joined on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_KEY = 16
MOST_BITS = 1 << 26
HASHES = 2


def _place(key: str, k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits))


def _sieve(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """One row with the bits of all keys, 8 MB at most whatever their number, and the number of bits."""
    n = keys.count()
    bits = min(MOST_BITS, 1 << max(10, (BITS_A_KEY * n - 1).bit_length()))
    places = keys.select(F.explode(F.array(*[_place(key, k, bits) for k in range(HASHES)])).alias("at"))
    marks = places.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("mark"))
    found = marks.groupBy("word").agg(F.bit_or("mark").alias("marks")).toArrow()
    words = np.zeros(bits // 64, dtype=np.int64)
    words[found.column("word").to_numpy()] = found.column("marks").to_numpy()
    held = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words))
    return keys.sparkSession.createDataFrame(pa.table({"_words": held})), bits


def sieved(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The `rows` whose `key` may be one of `keys`, and those whose key is none of them; both read `rows` once, without a shuffle.

    No row with a key of `keys` is among the second, few others are among the first: about one in 70 for as many keys as the filter is
    made for (4 million), more beyond. So a join of the first has the partners that one of all `rows` would have. Rows and keys may
    have nulls, which count as a value. `keys` is read twice.
    """
    sieve, bits = _sieve(keys, key)
    at = [_place(key, k, bits) for k in range(HASHES)]
    marked = [F.getbit(F.get("_words", F.shiftright(a, 6).cast("int")), (a % 64).cast("int")) == 1 for a in at]
    may = marked[0] & marked[1]
    return rows.join(F.broadcast(sieve), may, "left_semi"), rows.join(F.broadcast(sieve), may, "left_anti")
