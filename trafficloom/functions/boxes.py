"""Image boxes given as four columns or as an array of four doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trafficloom.functions.numbers import all_of, finite

CORNERS = ("x1", "y1", "x2", "y2")


def box_array(prefix: str = "") -> Column:
    sides = [F.col(prefix + c) for c in CORNERS]
    return F.when(all_of([s.isNotNull() for s in sides]), F.array(*sides))


def has_area(box: Column) -> Column:
    """True for a box that exists, is finite and has positive width and height."""
    sides = [F.get(box, F.lit(i)) for i in range(4)]
    sound = all_of([finite(s) for s in sides]) & (sides[2] > sides[0]) & (sides[3] > sides[1])
    return F.coalesce(box.isNotNull() & (F.size(box) == 4) & sound, F.lit(False))


def overlap_over_smaller(a: str, b: str) -> Column:
    """Intersection of two boxes over the smaller area; 0 when a box is flat. Missing boxes come as empty ones."""
    ax1, ay1, ax2, ay2 = (F.col(a + c) for c in CORNERS)
    bx1, by1, bx2, by2 = (F.col(b + c) for c in CORNERS)
    zero = F.lit(0.0)
    width = F.greatest(zero, F.least(ax2, bx2) - F.greatest(ax1, bx1))
    height = F.greatest(zero, F.least(ay2, by2) - F.greatest(ay1, by1))
    area_a = F.greatest(zero, ax2 - ax1) * F.greatest(zero, ay2 - ay1)
    area_b = F.greatest(zero, bx2 - bx1) * F.greatest(zero, by2 - by1)
    smaller = F.least(area_a, area_b)
    return F.when(smaller > 0, width * height / smaller).otherwise(zero)
