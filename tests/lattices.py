"""Analytic point sets with known answers."""

import math
import random
from itertools import product

from moteflow.schema import ATOMS, Box

FCC = [(0, 0, 0), (0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5)]
BCC = [(0, 0, 0), (0.5, 0.5, 0.5)]


def crystal(basis, a, n):
    pts = [((i + u) * a, (j + v) * a, (k + w) * a) for i, j, k in product(range(n), repeat=3) for u, v, w in basis]
    return pts, Box((0.0, 0.0, 0.0), (n * a, n * a, n * a))


def hcp(a, nx, ny, nz):
    c = a * 1.633
    cell = (a, a * math.sqrt(3), c)
    basis = [(0, 0, 0), (0.5, 0.5, 0), (0.5, 5 / 6, 0.5), (0, 1 / 3, 0.5)]
    pts = [((i + u) * cell[0], (j + v) * cell[1], (k + w) * cell[2]) for i, j, k in product(range(nx), range(ny), range(nz)) for u, v, w in basis]
    return pts, Box((0.0, 0.0, 0.0), (nx * cell[0], ny * cell[1], nz * cell[2]))


def shaken(pts, sigma, seed=7):
    r = random.Random(seed)
    return [tuple(x + r.gauss(0, sigma) for x in p) for p in pts]


def turned(pts, degrees):
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return [(c * x - s * y, s * x + c * y, z) for x, y, z in pts]


def table(spark, frames, element="Al", charge=None, labels=None, columns=None):
    rows = [
        (f, i, i + 1, element[i] if isinstance(element, list) else element, *map(float, p), charge[i] if charge else None, (columns[i] if columns else {}), (labels[i] if labels else {}))
        for f, pts in enumerate(frames)
        for i, p in enumerate(pts)
    ]
    return spark.createDataFrame(rows, ATOMS)
