"""Ordered computations (running totals, previous row, nearest row) that never put one key into one task.

Two ways of cutting a key's rows into pieces are used:

* by value: the position is an integer that is unique within the key, so `position div BLOCK` gives pieces
  of at most BLOCK rows. Deterministic, needs no extra pass to find the cuts.
* by sampled range: any sort order, the cuts come from Spark's range partitioning. The tagged rows are
  pinned, because the two reads that follow must see the same cuts.

In both cases each piece is scanned by a window of its own and a small table with one row per piece carries
the totals from piece to piece.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficloom.plans.pinning import pin

BLOCK = 1 << 20
PIECE = "_piece"


def _join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left")


def block_scan(
    df: DataFrame,
    by: Sequence[str],
    position: str,
    *,
    sums: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    nexts: Mapping[str, Column] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Add window results over (`by` ordered by the integer `position`).

    sums   inclusive running sums of integer expressions
    lags   value of the row before
    lasts  last non-null value at or before the position
    nexts  first non-null value at or after the position
    """
    sums, lags, lasts, nexts = (dict(x or {}) for x in (sums, lags, lasts, nexts))
    by = list(by)
    keys = [*by, PIECE]
    pos = F.col(position)
    cut = df.withColumn(PIECE, F.floor(pos / F.lit(block)).cast("long"))

    aggregates = []
    for name, expr in sums.items():
        aggregates.append(F.sum(expr).alias(f"_s_{name}"))
    for name, expr in lags.items():
        aggregates.append(F.max_by(F.struct(expr.alias("v")), pos).alias(f"_g_{name}"))
    for name, expr in lasts.items():
        aggregates.append(F.max_by(expr, F.when(expr.isNotNull(), pos)).alias(f"_l_{name}"))
    for name, expr in nexts.items():
        aggregates.append(F.min_by(expr, F.when(expr.isNotNull(), pos)).alias(f"_n_{name}"))
    pieces = cut.groupBy(*keys).agg(*aggregates)

    over = Window.partitionBy(*(by or [F.lit(0)])).orderBy(PIECE)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    # what follows is what precedes in the opposite order; a frame that runs to the end would be scanned anew per row
    backwards = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc(PIECE))
    after = backwards.rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(
        *keys,
        *[F.sum(f"_s_{n}").over(before).alias(f"_s_{n}") for n in sums],
        *[F.lag(f"_g_{n}").over(over).alias(f"_g_{n}") for n in lags],
        *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_l_{n}") for n in lasts],
        *[F.last(f"_n_{n}", ignorenulls=True).over(after).alias(f"_n_{n}") for n in nexts],
    )

    inside = Window.partitionBy(*keys).orderBy(position)
    upto = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    onward = Window.partitionBy(*keys).orderBy(F.desc(position)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.select(
        "*",
        *[F.sum(e).over(upto).alias(f"_ls_{n}") for n, e in sums.items()],
        *[F.lag(F.struct(e.alias("v"))).over(inside).alias(f"_lg_{n}") for n, e in lags.items()],
        *[F.last(e, ignorenulls=True).over(upto).alias(f"_ll_{n}") for n, e in lasts.items()],
        *[F.last(e, ignorenulls=True).over(onward).alias(f"_ln_{n}") for n, e in nexts.items()],
    )
    joined = _join_on(local, carried, keys)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.coalesce(F.col(f"_s_{n}"), F.lit(0)) + F.col(f"_ls_{n}")).alias(n) for n in sums],
        *[F.coalesce(F.col(f"_lg_{n}"), F.col(f"_g_{n}"))["v"].alias(n) for n in lags],
        *[F.coalesce(F.col(f"_ll_{n}"), F.col(f"_l_{n}")).alias(n) for n in lasts],
        *[F.coalesce(F.col(f"_ln_{n}"), F.col(f"_n_{n}")).alias(n) for n in nexts],
    )


def with_runs(df: DataFrame, by: Sequence[str], position: str, stride: int = 1, block: int = BLOCK) -> DataFrame:
    """Gaps and islands: add `run_index` (0-based per key), `run_start` and `run_position`."""
    lagged = block_scan(df, by, position, lags={"_before": F.col(position)}, block=block)
    begins = F.col("_before").isNull() | (F.col(position) - F.col("_before") != stride)
    flagged = lagged.withColumn("_begin", begins).drop("_before")
    scanned = block_scan(
        flagged,
        by,
        position,
        sums={"_runs": F.col("_begin").cast("long")},
        lasts={"run_start": F.when(F.col("_begin"), F.col(position))},
        block=block,
    )
    return scanned.select(
        *df.columns,
        (F.col("_runs") - 1).alias("run_index"),
        "run_start",
        F.expr(f"(`{position}` - run_start) div {stride}").alias("run_position"),
    )


def range_pieces(
    df: DataFrame, order: Sequence[Column | str], rows: int | None = None, at_most: int | None = None
) -> DataFrame:
    """Rows cut into ordered, evenly filled pieces, tagged and pinned.

    With `rows` they are counted first and a piece holds about that many, however large the input; otherwise the session
    decides how many pieces there are. `at_most`, where known that there are no more rows, keeps small pieces in few files.
    """
    dealt = df.repartitionByRange(*order) if rows is None else df.repartitionByRange(max(1, -(-df.count() // rows)), *order)
    return pin(dealt.withColumn(PIECE, F.spark_partition_id()), at_most)


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
    at_most: int | None = None,
) -> DataFrame:
    """Inclusive running sums per key over any total order; a key may span any number of pieces. `at_most` as in `range_pieces`."""
    by = list(by)
    values = {f"_v_{n}": e for n, e in totals.items()}
    cut = range_pieces(df.withColumns(values), [*[F.col(c) for c in by], *order], at_most=at_most)
    keys = [*by, PIECE]
    pieces = cut.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals])
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(*keys, *[F.sum(f"_s_{n}").over(before).alias(f"_s_{n}") for n in totals])
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.select("*", *[F.sum(f"_v_{n}").over(upto).alias(f"_l_{n}") for n in totals])
    return _join_on(local, carried, keys).select(
        *df.columns,
        *[(F.coalesce(F.col(f"_s_{n}"), F.lit(0)) + F.col(f"_l_{n}")).alias(n) for n in totals],
    )


def positions(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Dense 0-based position of every row in one global total order."""
    numbered = running_totals(df, [], order, {name: F.lit(1).cast("long")})
    return numbered.withColumn(name, F.col(name) - 1)


def exact_median(df: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Median per key (mean of the two middle values when even) from counts per distinct value."""
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    cumulated = running_totals(counts, by, [F.col(value)], {"_upto": F.col("_n")})
    sizes = counts.groupBy(*by).agg(F.sum("_n").alias("_size"))
    low, high = F.expr("(_size + 1) div 2"), F.expr("_size div 2 + 1")
    first = F.col("_upto") - F.col("_n")
    picked = cumulated.join(sizes, by).where(
        ((first < low) & (low <= F.col("_upto"))) | ((first < high) & (high <= F.col("_upto")))
    )
    return picked.groupBy(*by).agg(((F.min(value) + F.max(value)) / 2.0).alias(name))
