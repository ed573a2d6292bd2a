"""Geometry as Catalyst expressions: minimum image, wrapping, angles, strain invariants and 3x3 matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import AXES

Vec = Sequence[Column]
Mat = Sequence[Column]  # nine columns, row by row


def min_image(d: Column, length: Column | float, periodic: Column | bool = True) -> Column:
    """d minus the nearest whole number of box lengths; halves go away from zero. d itself on open or empty axes."""
    length = F.lit(length) if not isinstance(length, Column) else length
    periodic = F.lit(periodic) if not isinstance(periodic, Column) else periodic
    q = d / length  # not F.round, which goes through decimals
    return F.when(periodic & (length > 0), d - length * (F.signum(q) * F.floor(F.abs(q) + 0.5))).otherwise(d)


def wrap(p: Column, lo: Column | float, length: Column | float) -> Column:
    """p moved by whole box lengths into [lo, lo + length)."""
    lo, length = (F.lit(v) if not isinstance(v, Column) else v for v in (lo, length))
    return F.when(length > 0, lo + F.pmod(p - lo, length)).otherwise(p)


def delta(a: str, b: str) -> list[Column]:
    """b's position minus a's, as columns; a and b are column prefixes ('' or 'r_')."""
    return [F.col(b + ax) - F.col(a + ax) for ax in AXES]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def angle_degrees(a: Vec, b: Vec) -> Column:
    """Angle between two vectors; null where one has no length."""
    cosine = dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))))


def mat_mul(a: Mat, b: Mat) -> list[Column]:
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]


def mat_t(a: Mat) -> list[Column]:
    return [a[3 * j + i] for i in range(3) for j in range(3)]


def mat_vec(a: Mat, v: Vec) -> list[Column]:
    return [dot(a[3 * i : 3 * i + 3], v) for i in range(3)]


def trace(a: Mat) -> Column:
    return a[0] + a[4] + a[8]


def det(a: Mat) -> Column:
    return a[0] * (a[4] * a[8] - a[5] * a[7]) - a[1] * (a[3] * a[8] - a[5] * a[6]) + a[2] * (a[3] * a[7] - a[4] * a[6])


def mat_norm(a: Mat) -> Column:
    return F.sqrt(sum((x * x for x in a[1:]), a[0] * a[0]))


def inverse(a: Mat) -> list[Column]:
    """Null where the determinant is no larger than 1e-10 of the norm's cube."""
    d = det(a)
    safe = F.when(F.abs(d) > 1e-10 * F.pow(mat_norm(a), 3), d)
    cof = [a[4] * a[8] - a[5] * a[7], a[2] * a[7] - a[1] * a[8], a[1] * a[5] - a[2] * a[4], a[5] * a[6] - a[3] * a[8], a[0] * a[8] - a[2] * a[6], a[2] * a[3] - a[0] * a[5], a[3] * a[7] - a[4] * a[6], a[1] * a[6] - a[0] * a[7], a[0] * a[4] - a[1] * a[3]]
    return [c / safe for c in cof]


def green_lagrange(f: Mat) -> list[Column]:
    """Half of (F transposed times F minus one)."""
    c = mat_mul(mat_t(f), f)
    return [(c[k] - (1.0 if k in (0, 4, 8) else 0.0)) * 0.5 for k in range(9)]


def von_mises(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> Column:
    """Shear invariant of a symmetric tensor."""
    diff = (xx - yy) * (xx - yy) + (yy - zz) * (yy - zz) + (zz - xx) * (zz - xx)
    return F.sqrt(xy * xy + xz * xz + yz * yz + diff / 6.0)


def von_mises_stress(*s: Column) -> Column:
    return F.sqrt(F.lit(3.0)) * von_mises(*s)


def nice_length(t: Column) -> Column:
    """The nearest of 1, 2, 5 and 10 times a power of ten; 10 for what isn't positive."""
    base = F.pow(F.lit(10.0), F.floor(F.log10(t)))
    options = [F.struct(F.abs(base * m - t).alias("d"), (base * m).alias("v")) for m in (1.0, 2.0, 5.0, 10.0)]
    return F.when(t > 0, F.least(*options)["v"]).otherwise(10.0)


def equivalent_diameter(n: Column, volume_per_atom: Column | float) -> Column:
    """Diameter of the sphere as large as n atoms."""
    return 2.0 * F.cbrt(3.0 * n * volume_per_atom / (4.0 * 3.141592653589793))


def disorientation_degrees(a: Sequence[Column], b: Sequence[Column], operators: Sequence[Sequence[float]]) -> Column:
    """Smallest rotation between two unit quaternions (w, x, y, z) up to the given symmetry operators."""
    w1, x1, y1, z1 = a[0], -a[1], -a[2], -a[3]
    w2, x2, y2, z2 = b
    q = [w1 * w2 - x1 * x2 - y1 * y2 - z1 * z2, w1 * x2 + x1 * w2 + y1 * z2 - z1 * y2, w1 * y2 - x1 * z2 + y1 * w2 + z1 * x2, w1 * z2 + x1 * y2 - y1 * x2 + z1 * w2]
    best = [F.abs(g[0] * q[0] - g[1] * q[1] - g[2] * q[2] - g[3] * q[3]) for g in operators]
    return F.degrees(2.0 * F.acos(F.least(F.lit(1.0), F.greatest(*best) if len(best) > 1 else best[0])))


def orientation_hue(q: Sequence[Column], hexagonal: Column) -> Column:
    """Hue from 0 to 1 of a crystal's orientation (w, x, y, z) against the z axis: for cubes that of the inverse pole figure,
    red along an edge, green along a face's diagonal and blue along the body's; for hexagons the c axis's tilt, 90 degrees as 1."""
    w, x, y, z = q
    up = 1 - 2 * (x * x + y * y)
    tilt = F.acos(F.least(F.lit(1.0), F.abs(up))) * (2 / 3.141592653589793)
    along = F.array_sort(F.array(F.abs(2 * (x * z - y * w)), F.abs(2 * (y * z + x * w)), F.abs(up)))
    small, middle, large = (F.get(along, k) for k in range(3))
    r, g, b = large - middle, F.sqrt(F.lit(2.0)) * (middle - small), F.sqrt(F.lit(3.0)) * small
    top = F.greatest(r, g, b)
    span = top - F.least(r, g, b)
    sixths = F.when(r == top, (g - b) / span).when(g == top, 2 + (b - r) / span).otherwise(4 + (r - g) / span)
    hue = F.when(span > 1e-9 * top, F.pmod(sixths / 6, F.lit(1.0))).otherwise(0.0)
    return F.when(hexagonal, tilt).otherwise(hue)


def rotation_group(order_axis: int) -> list[tuple[float, float, float, float]]:
    """Proper rotations as quaternions, generated from two turns: 4 gives the 24 of the cube, 6 the 12 of the hexagon."""
    import math
    from itertools import product

    half = math.pi / order_axis
    gens = [(math.cos(half), 0.0, 0.0, math.sin(half)), (math.cos(math.pi / 4), math.sin(math.pi / 4), 0.0, 0.0) if order_axis == 4 else (0.0, 1.0, 0.0, 0.0)]

    def times(p: tuple, q: tuple) -> tuple:
        return (p[0] * q[0] - p[1] * q[1] - p[2] * q[2] - p[3] * q[3], p[0] * q[1] + p[1] * q[0] + p[2] * q[3] - p[3] * q[2], p[0] * q[2] - p[1] * q[3] + p[2] * q[0] + p[3] * q[1], p[0] * q[3] + p[1] * q[2] - p[2] * q[1] + p[3] * q[0])

    def plain(q: tuple) -> tuple:
        lead = next((v for v in q if abs(v) > 1e-9), 1.0)
        return tuple(round(v if lead > 0 else -v, 9) + 0.0 for v in q)

    found = {(1.0, 0.0, 0.0, 0.0): (1.0, 0.0, 0.0, 0.0)}
    while True:
        more = {plain(q): q for q in (times(a, b) for a, b in product(found.values(), gens))}
        new = {k: v for k, v in more.items() if k not in found}
        if not new:
            return sorted(found.values())
        found |= new
