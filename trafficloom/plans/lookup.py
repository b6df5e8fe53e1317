"""Joining rows with a table of one row per key when a few keys hold much of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000
HOT_ROWS = 256
SALTS = 64


def lookup(
    rows: DataFrame, table: DataFrame, key: str, weight: str, by: str, how: str = "inner", total: int | None = None
) -> DataFrame:
    """`rows` joined with `table` on `key`; both keep their other columns.

    `table` has one row per key and in `weight` the number of `rows` with that key. Without `total`, the number of all
    `rows`, it is added up first. The table is read three times, or twice with `total`: pin it, unless it is an aggregate
    whose exchange Spark uses again.

    Keys with at least HOT_ROWS rows and one row in HOT_SHARE of all are at most HOT_SHARE keys, whatever the input:
    they are broadcast as a list, their rows are dealt over SALTS partitions by the hash of column `by`, and their
    table rows are repeated once per salt.
    """
    if total is None:
        total = table.agg(F.sum(weight)).first()[0] or 0
    is_hot = (F.col(weight) >= HOT_ROWS) & (F.col(weight) * HOT_SHARE >= F.lit(total))
    hot = table.where(is_hot).select(key, F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salted = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(table.withColumn("_salt", F.explode(salts)), [key, "_salt"], how).drop("_salt")
