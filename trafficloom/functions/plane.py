"""Plane geometry on columns: points are structs with x and y, polygons and lines are arrays of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trafficloom.functions.rigid import let

TINY_EDGE = 1e-6


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def _length(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def point_segment_distance(p: Column, a: Column, b: Column) -> Column:
    ux, uy = b["x"] - a["x"], b["y"] - a["y"]
    square = ux * ux + uy * uy
    along = F.when(square > 1e-12, ((p["x"] - a["x"]) * ux + (p["y"] - a["y"]) * uy) / square)
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    dx, dy = p["x"] - (a["x"] + t * ux), p["y"] - (a["y"] + t * uy)
    return F.when(square <= 1e-12, F.sqrt((p["x"] - a["x"]) ** 2 + (p["y"] - a["y"]) ** 2)).otherwise(
        F.sqrt(dx * dx + dy * dy)
    )


def segments(line: Column, closed: bool = False) -> Column:
    """Consecutive point pairs of a line, or of a ring when `closed`."""
    count = F.size(line)
    if closed:
        return F.transform(line, lambda p, i: F.struct(p.alias("a"), F.get(line, (i + 1) % count).alias("b")))
    starts = F.slice(line, 1, F.greatest(count - 1, F.lit(0)))
    return F.transform(starts, lambda p, i: F.struct(p.alias("a"), F.get(line, i + 1).alias("b")))


def convex_hull(points: Column) -> Column:
    """Counter-clockwise hull of a handful of points (the corners of one box)."""

    def apart(given: Column) -> Column:
        """Points without those that repeat an earlier one."""
        return F.filter(
            given, lambda p, i: ~F.exists(F.slice(given, 1, i), lambda q: _length(p, q) <= TINY_EDGE)
        )

    def outer(corners: Column) -> Column:
        """Points that start a hull edge: from them, some other point has all points on its left."""
        return F.filter(
            corners,
            lambda p: F.exists(
                corners,
                lambda q: (_length(p, q) > TINY_EDGE) & F.forall(corners, lambda r: _cross(p, q, r) >= -1e-9),
            ),
        )

    def around(ring: Column) -> Column:
        count = F.greatest(F.size(ring), F.lit(1))
        middle = point(
            F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["x"]) / count,
            F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["y"]) / count,
        )
        turned = let(
            middle,
            lambda m: F.transform(
                ring, lambda p: F.struct(F.atan2(p["y"] - m["y"], p["x"] - m["x"]).alias("t"), p.alias("p"))
            ),
        )
        return F.transform(F.array_sort(turned), lambda v: v["p"])

    return let(points, lambda given: let(apart(given), lambda corners: let(outer(corners), around)))


def area(polygon: Column) -> Column:
    twice = F.aggregate(
        segments(polygon, closed=True),
        F.lit(0.0),
        lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"],
    )
    return F.when(F.size(polygon) >= 3, F.abs(twice) / 2.0).otherwise(F.lit(0.0))


def _cut(polygon: Column, edge: Column) -> Column:
    """Part of a convex polygon on the left of a directed edge."""
    a, b = edge["a"], edge["b"]
    count = F.size(polygon)

    def keep(p: Column, i: Column) -> Column:
        q = F.get(polygon, (i + 1) % count)
        side_p, side_q = _cross(a, b, p), _cross(a, b, q)
        t = side_p / (side_p - side_q)
        crossing = point(p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"]))
        here = F.when(side_p >= 0, F.array(p)).otherwise(F.slice(F.array(p), 1, 0))
        there = F.when(side_p * side_q < 0, F.array(crossing)).otherwise(F.slice(F.array(p), 1, 0))
        return F.concat(here, there)

    cut = F.flatten(F.transform(polygon, keep))
    return F.when(_length(a, b) <= TINY_EDGE, polygon).otherwise(cut)


def intersection(first: Column, second: Column) -> Column:
    """Common part of two convex counter-clockwise polygons."""
    return F.aggregate(segments(second, closed=True), first, _cut)


def polygon_distance(first: Column, second: Column) -> Column:
    """Distance of two convex polygons known not to overlap."""

    def corners_to_edges(corners: Column, ring: Column) -> Column:
        return F.array_min(
            F.flatten(
                F.transform(
                    corners,
                    lambda p: F.transform(
                        segments(ring, closed=True), lambda e: point_segment_distance(p, e["a"], e["b"])
                    ),
                )
            )
        )

    return F.least(corners_to_edges(first, second), corners_to_edges(second, first))
