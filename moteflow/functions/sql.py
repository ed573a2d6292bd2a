"""Geometry for SQL texts: temporary functions whose bodies are SQL, so that Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .geometry import rotation_group

MIN_IMAGE = "CASE WHEN length > 0 THEN d - length * (signum(d / length) * floor(abs(d / length) + 0.5D)) ELSE d END"
WRAP = "CASE WHEN length > 0 THEN lo + pmod(p - lo, length) ELSE p END"


def disorientation_body() -> str:
    """Smallest angle in degrees between quaternions a and b (w, x, y, z) under the turns of the cube, or of the hexagon."""
    turns = [f"array({', '.join(f'array({", ".join(f"{v!r}D" for v in g)})' for g in rotation_group(n))})" for n in (6, 4)]
    between = ["a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]", "a[0] * b[1] - a[1] * b[0] - a[2] * b[3] + a[3] * b[2]", "a[0] * b[2] + a[1] * b[3] - a[2] * b[0] - a[3] * b[1]", "a[0] * b[3] - a[1] * b[2] + a[2] * b[1] - a[3] * b[0]"]
    left = " ".join(f"{'-' if k else ''} g[{k}] * ({q})" for k, q in enumerate(between))
    return f"degrees(2 * acos(least(1D, array_max(transform(CASE WHEN hexagonal THEN {turns[0]} ELSE {turns[1]} END, g -> abs({left}))))))"


def register(spark: SparkSession) -> None:
    """min_image(d, length), wrap(p, lo, length) and disorientation(a, b, hexagonal) for this session's SQL; null gives null."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION min_image(d DOUBLE, length DOUBLE) RETURNS DOUBLE RETURN {MIN_IMAGE}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION wrap(p DOUBLE, lo DOUBLE, length DOUBLE) RETURNS DOUBLE RETURN {WRAP}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION disorientation(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>, hexagonal BOOLEAN) RETURNS DOUBLE RETURN {disorientation_body()}")
