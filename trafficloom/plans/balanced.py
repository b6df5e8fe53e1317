"""Equi-joins and distance joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficloom.plans.pinning import pin

CHUNK = 4096
SALTS = 32
CROWD = 256
LISTED = 100_000


def _sizes(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both sides (_nl, _nr) per key that both have."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = left.select(*keys, one.alias("_l"), none.alias("_r")).union(right.select(*keys, none, one))
    counted = both.groupBy(*keys).agg(F.sum("_l").alias("_nl"), F.sum("_r").alias("_nr"))
    return counted.where((F.col("_nl") > 0) & (F.col("_nr") > 0))


def _listed(found: DataFrame) -> tuple[DataFrame, int]:
    """A table of large keys, counted once: broadcast where it is known to be short, else joined without a hint."""
    kept = pin(found)
    count = kept.count()
    return (F.broadcast(kept) if count <= LISTED else kept), count


def balanced_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: Sequence[str],
    right_id: Sequence[str],
    chunk: int = CHUNK,
) -> DataFrame:
    """Inner join on `keys` whose work per (key, left part, right part) is at most about chunk x chunk pairs.

    Keys with more than `chunk` rows on a side are cut into parts on that side, and the rows of the other
    side are repeated once per part; every matching pair meets exactly once. The keys are counted first: where
    none is cut, this is a plain join and no row is shuffled but for it. The table of cut keys has at most rows/chunk
    entries and is broadcast; a long one is repeated SALTS times and joined. The id columns identify a row of their
    side; a row's part follows from them, so that a recomputed task repeats it.
    """
    keys = list(keys)
    parts, count = _listed(
        _sizes(left, right, keys)
        .where((F.col("_nl") > chunk) | (F.col("_nr") > chunk))
        .select(
            *keys,
            F.ceil(F.col("_nl") / chunk).cast("int").alias("_pl"),
            F.ceil(F.col("_nr") / chunk).cast("int").alias("_pr"),
        )
    )
    if count == 0:
        return left.join(right, keys)

    def spread(side: DataFrame, ids: Sequence[str], own: str, other: str, own_parts: str, other_parts: str):
        if count <= LISTED:
            tagged = side.join(parts, keys, "left")
        else:
            # the look-up of cut keys would itself put a large key into one task: rows are salted, cut keys repeated
            salted = side.withColumn("_salt", F.pmod(F.xxhash64(*ids), F.lit(SALTS)).cast("int"))
            told = parts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            tagged = salted.join(told, [*keys, "_salt"], "left")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other_parts), F.lit(1)) - 1))
        return tagged.select(
            *side.columns,
            F.pmod(F.xxhash64(*ids), F.coalesce(F.col(own_parts), F.lit(1))).cast("int").alias(own),
            copies.alias(other),
        )

    spread_left = spread(left, left_id, "_i", "_j", "_pl", "_pr")
    spread_right = spread(right, right_id, "_j", "_i", "_pr", "_pl")
    return spread_left.join(spread_right, [*keys, "_i", "_j"]).drop("_i", "_j")


def within_reach(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_xy: tuple[str, str],
    right_xy: tuple[str, str],
    reach: float,
    left_id: Sequence[str],
    right_id: Sequence[str],
    condition: Column | None = None,
    chunk: int = CHUNK,
    crowd: int = CROWD,
) -> DataFrame:
    """Pairs that share `keys` and lie at most `reach` apart in the plane, with their `distance`.

    Where a key has at most `crowd` rows on each side, all its pairs are tested, at most `crowd` per row, and every row is
    shuffled once. For keys with more, a grid of cells of side `reach` turns the distance test into an equi-join: a left
    row sits in its cell, a right row is repeated in every cell its reach touches, nine times its size.
    """
    dx, dy = F.col(left_xy[0]) - F.col(right_xy[0]), F.col(left_xy[1]) - F.col(right_xy[1])

    def near(met: DataFrame) -> DataFrame:
        kept = met.withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") <= reach)
        return kept if condition is None else kept.where(condition)

    keys = list(keys)
    crowded, count = _listed(
        _sizes(left, right, keys).where((F.col("_nl") > crowd) | (F.col("_nr") > crowd)).select(*keys)
    )
    if count == 0:
        return near(left.join(right, keys))

    def of(side: DataFrame, ids: Sequence[str], how: str) -> DataFrame:
        if count <= LISTED:
            return side.join(crowded, keys, how)
        salted = side.withColumn("_salt", F.pmod(F.xxhash64(*ids), F.lit(SALTS)).cast("int"))
        told = crowded.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return salted.join(told, [*keys, "_salt"], how).select(*side.columns)

    few = of(left, left_id, "left_anti").join(of(right, right_id, "left_anti"), keys)
    left, right = of(left, left_id, "left_semi"), of(right, right_id, "left_semi")
    slack = reach * (1.0 + 1e-9) + 1e-9

    def cell(value: Column) -> Column:
        return F.floor(value / F.lit(reach)).cast("long")

    lx, ly = (F.col(c) for c in left_xy)
    rx, ry = (F.col(c) for c in right_xy)
    placed = left.withColumns({"_cx": cell(lx), "_cy": cell(ly)})
    repeated = right.withColumn("_cx", F.explode(F.sequence(cell(rx - slack), cell(rx + slack)))).withColumn(
        "_cy", F.explode(F.sequence(cell(ry - slack), cell(ry + slack)))
    )
    met = balanced_join(placed, repeated, [*keys, "_cx", "_cy"], left_id, right_id, chunk).drop("_cx", "_cy")
    return near(few).unionByName(near(met))


def during(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    position: str,
    start: str,
    end: str,
    point_id: Sequence[str],
    interval_id: Sequence[str],
    width: int = 64,
    chunk: int = CHUNK,
) -> DataFrame:
    """Interval join on integers: rows of `points` whose position lies in [start, end].

    Positions are grouped in buckets of `width`; an interval is repeated in each bucket it touches, about
    (end - start) / width times, which is `width` times fewer rows than the join emits on a dense axis.
    """
    placed = points.withColumn("_bucket", F.floor(F.col(position) / width).cast("long"))
    first, last = F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long")
    repeated = intervals.where(F.col(start) <= F.col(end)).withColumn("_bucket", F.explode(F.sequence(first, last)))
    return (
        balanced_join(placed, repeated, [*keys, "_bucket"], point_id, interval_id, chunk)
        .where(F.col(position).between(F.col(start), F.col(end)))
        .drop("_bucket")
    )
