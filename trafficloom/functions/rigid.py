"""4x4 matrices as row-major arrays of 16 doubles, and rotations as xyzw quaternions.

Results that a formula uses many times are bound to a name with `let`; written out, nested products would
repeat their whole input in every term.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trafficloom.functions.numbers import add

Number = Column | float


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def both(first: Column, second: Column, body: Callable[[Column, Column], Column]) -> Column:
    return let(F.struct(first.alias("a"), second.alias("b")), lambda s: body(s["a"], s["b"]))


def at(m: Column, row: int, col: int) -> Column:
    return F.get(m, F.lit(4 * row + col))


def matrix(rows: list[list[Number]]) -> Column:
    return F.array(*[v if isinstance(v, Column) else F.lit(float(v)) for row in rows for v in row])


def multiply(a: Column, b: Column) -> Column:
    def product(p: Column, q: Column) -> Column:
        return matrix([[add([at(p, i, k) * at(q, k, j) for k in range(4)]) for j in range(4)] for i in range(4)])

    return both(a, b, product)


def rigid_inverse(m: Column) -> Column:
    """Inverse of a rotation with translation."""

    def inverse(p: Column) -> Column:
        rows: list[list[Number]] = []
        for i in range(3):
            shift = add([at(p, k, i) * at(p, k, 3) for k in range(3)])
            rows.append([at(p, 0, i), at(p, 1, i), at(p, 2, i), -shift])
        return matrix([*rows, [0.0, 0.0, 0.0, 1.0]])

    return let(m, inverse)


def determinant3(m: Column) -> Column:
    return (
        at(m, 0, 0) * (at(m, 1, 1) * at(m, 2, 2) - at(m, 1, 2) * at(m, 2, 1))
        - at(m, 0, 1) * (at(m, 1, 0) * at(m, 2, 2) - at(m, 1, 2) * at(m, 2, 0))
        + at(m, 0, 2) * (at(m, 1, 0) * at(m, 2, 1) - at(m, 1, 1) * at(m, 2, 0))
    )


def affine_inverse(m: Column) -> Column:
    """Inverse of a matrix with last row 0 0 0 1; null when its 3x3 part is singular."""

    def cofactor(p: Column, i: int, j: int) -> Column:
        (r0, r1), (c0, c1) = [x for x in range(3) if x != i], [x for x in range(3) if x != j]
        minor = at(p, r0, c0) * at(p, r1, c1) - at(p, r0, c1) * at(p, r1, c0)
        return minor if (i + j) % 2 == 0 else -minor

    def linear(p: Column) -> Column:
        flat = [cofactor(p, j, i) for i in range(3) for j in range(3)]
        return let(
            determinant3(p),
            lambda det: F.when(F.abs(det) > 1e-12, F.transform(F.array(*flat), lambda c: c / det)),
        )

    def whole(p: Column, r: Column) -> Column:
        rows: list[list[Number]] = []
        for i in range(3):
            row = [F.get(r, F.lit(3 * i + j)) for j in range(3)]
            rows.append([*row, -add([row[k] * at(p, k, 3) for k in range(3)])])
        return F.when(r.isNotNull(), matrix([*rows, [0.0, 0.0, 0.0, 1.0]]))

    return let(m, lambda p: both(p, linear(p), whole))


def apply(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return tuple(at(m, i, 0) * x + at(m, i, 1) * y + at(m, i, 2) * z + at(m, i, 3) for i in range(3))


def quaternion(m: Column) -> Column:
    """Rotation part of a matrix as [x, y, z, w], from the largest of the four components."""

    def build(p: Column) -> Column:
        m00, m11, m22 = at(p, 0, 0), at(p, 1, 1), at(p, 2, 2)
        trace = m00 + m11 + m22
        d21, d02, d10 = at(p, 2, 1) - at(p, 1, 2), at(p, 0, 2) - at(p, 2, 0), at(p, 1, 0) - at(p, 0, 1)
        s10, s20, s21 = at(p, 0, 1) + at(p, 1, 0), at(p, 0, 2) + at(p, 2, 0), at(p, 1, 2) + at(p, 2, 1)

        def from_square(square: Column, parts: Callable[[Column], list[Column]]) -> Column:
            return let(2.0 * F.sqrt(square), lambda s: F.transform(F.array(*parts(s)), lambda v: v / s))

        return (
            F.when(
                trace >= F.greatest(m00, m11, m22), from_square(1.0 + trace, lambda s: [d21, d02, d10, s * s / 4.0])
            )
            .when(
                (m00 >= m11) & (m00 >= m22),
                from_square(1.0 + m00 - m11 - m22, lambda s: [s * s / 4.0, s10, s20, d21]),
            )
            .when(m11 >= m22, from_square(1.0 - m00 + m11 - m22, lambda s: [s10, s * s / 4.0, s21, d02]))
            .otherwise(from_square(1.0 - m00 - m11 + m22, lambda s: [s20, s21, s * s / 4.0, d10]))
        )

    return let(m, build)


def slerp(a: Column, b: Column, t: Column) -> Column:
    """Shortest-arc interpolation of two quaternions."""

    def blend(p: Column, q: Column) -> Column:
        dot = F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

        def weigh(d: Column) -> Column:
            angle = F.acos(F.least(F.abs(d), F.lit(1.0)))
            sign = F.when(d < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
            small = F.sin(angle) < 1e-9
            wa = F.when(small, 1.0 - t).otherwise(F.sin((1.0 - t) * angle) / F.sin(angle))
            wb = F.when(small, t).otherwise(F.sin(t * angle) / F.sin(angle))
            return both(wa, sign * wb, lambda u, v: F.zip_with(p, q, lambda x, y: u * x + v * y))

        return let(dot, weigh)

    return both(a, b, blend)


def from_quaternion(q: Column, x: Column, y: Column, z: Column) -> Column:
    def turn(u: Column) -> Column:
        qx, qy, qz, qw = (F.get(u, F.lit(i)) for i in range(4))
        return matrix(
            [
                [1.0 - 2.0 * (qy * qy + qz * qz), 2.0 * (qx * qy - qz * qw), 2.0 * (qx * qz + qy * qw), x],
                [2.0 * (qx * qy + qz * qw), 1.0 - 2.0 * (qx * qx + qz * qz), 2.0 * (qy * qz - qx * qw), y],
                [2.0 * (qx * qz - qy * qw), 2.0 * (qy * qz + qx * qw), 1.0 - 2.0 * (qx * qx + qy * qy), z],
                [0.0, 0.0, 0.0, 1.0],
            ]
        )

    def unit(p: Column) -> Column:
        norm = F.sqrt(F.aggregate(p, F.lit(0.0), lambda s, v: s + v * v))
        return let(norm, lambda n: F.transform(p, lambda v: v / n))

    return let(q, lambda p: let(unit(p), turn))
