"""Operators over an order of frames, rows or distances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import min_image
from ..schema import AXES
from .boxes import Cell, celled


def steps(atoms: DataFrame, box: Cell = None, reference: int = 0) -> DataFrame:
    """Each atom's step from the frame before: frame, atom, sx, sy, sz; null in the first frame.

    A step's image is that of the cell of the frame it leads to when walked away from the reference.
    """
    w = Window.partitionBy("atom").orderBy("frame")
    rows = celled(atoms.select("frame", "atom", *AXES), box)
    out = []
    for ax in AXES:
        size = F.when(F.col(f"cell_per_{ax}"), F.col(f"cell_size_{ax}")).otherwise(F.lit(0.0))
        size = F.when(F.col("frame") > reference, size).otherwise(F.lag(size).over(w))
        out.append(min_image(F.col(ax) - F.lag(ax).over(w), F.coalesce(size, F.lit(0.0))).alias("s" + ax))
    return rows.select("frame", "atom", *out)


def unwrapped(atoms: DataFrame, box: Cell = None, reference: int = 0) -> DataFrame:
    """Displacement of each atom from the reference frame: ux, uy, uz, summed step by step forwards and backwards."""
    moved = steps(atoms, box, reference)
    after = Window.partitionBy("atom").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("atom").orderBy(F.desc("frame")).rowsBetween(Window.unboundedPreceding, -1)
    forward = moved.where(F.col("frame") > reference).select("frame", "atom", *[F.sum("s" + a).over(after).alias("u" + a) for a in AXES])
    back = moved.where(F.col("frame") <= reference).select("frame", "atom", *[F.coalesce(-F.sum("s" + a).over(before), F.lit(0.0)).alias("u" + a) for a in AXES])
    return forward.unionByName(back)


def mean_square_displacement(atoms: DataFrame, box: Cell = None, reference: int = 0) -> DataFrame:
    """frame, msd."""
    u = unwrapped(atoms, box, reference)
    return u.groupBy("frame").agg(F.avg(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") + F.col("uz") * F.col("uz")).alias("msd"))


def moving_average(df: DataFrame, value: str, order: str, by: list[str], width: int = 5) -> DataFrame:
    """Centred mean with clamped ends, as column smooth; groups of at most width rows keep their values."""
    half = width // 2
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)
    n = F.count("*").over(Window.partitionBy(*by))
    return df.withColumn("smooth", F.when(n > width, F.avg(value).over(w)).otherwise(F.col(value)))


def first_peak(df: DataFrame, value: str, order: str, count: str, by: list[str], least: float = 1.2, least_count: int = 10) -> DataFrame:
    """by, peak (its order), minimum: the first local maximum over two rows on each side, then the end of the descent after it."""
    w = Window.partitionBy(*by).orderBy(order)
    v = F.col(value)
    around = [F.lag(value, 1).over(w), F.lag(value, 2).over(w), F.lead(value, 1).over(w), F.lead(value, 2).over(w)]
    is_peak = (v >= least) & (F.col(count) >= least_count)
    for o in around:
        is_peak = is_peak & o.isNotNull() & (v >= o)
    marked = df.withColumn("_peak", is_peak).withColumn("_next", F.lead(value).over(w))
    peaks = marked.where("_peak").groupBy(*by).agg(F.min(order).alias("peak"))
    low = marked.join(peaks, by).where((F.col(order) >= F.col("peak")) & (F.col("_next").isNull() | (F.col("_next") > v))).groupBy(*by).agg(F.min(order).alias("minimum"))
    return peaks.join(low, by, "left")


def islands(df: DataFrame, flag: str, order: str, by: list[str]) -> DataFrame:
    """by, start, stop, length of each run of rows where flag holds; order counts up by one."""
    w = Window.partitionBy(*by).orderBy(order)
    runs = df.where(F.col(flag)).withColumn("_run", F.col(order) - F.row_number().over(w))
    return runs.groupBy(*by, "_run").agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.count("*").alias("length")).drop("_run")


def occupancy(df: DataFrame, flag: str, order: str, by: list[str], frames: int, interval: float = 1.0) -> DataFrame:
    """by, occupancy (share of frames), lifetime (mean run times interval), events (runs)."""
    return islands(df, flag, order, by).groupBy(*by).agg((F.sum("length") / frames).alias("occupancy"), (F.sum("length") / F.count("*") * interval).alias("lifetime"), F.count("*").alias("events"))


def zero_from(df: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """by, start: the first row after which value stays 0; null if it never was positive or is at the end."""
    last = F.max(F.when(F.col(value) > 0, F.col(order)))
    end = F.max(order)
    return df.groupBy(*by).agg(F.when(last < end, last + 1).alias("start"))


def matched_by(by: list[str], other: DataFrame) -> tuple[DataFrame, Column]:
    """other with its by columns renamed, and the condition that a row belongs to it; nulls match."""
    renamed = other.withColumnsRenamed({b: "_of_" + b for b in by})
    return renamed, reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col("_of_" + b)) for b in by], F.lit(True))


def elastic_prefix(df: DataFrame, strain: str, order: str, by: list[str], limit: float) -> DataFrame:
    """Rows from the start until the travelled strain first exceeds the limit: those before the first row that does."""
    over, same = matched_by(by, df.where(F.abs(F.col(strain)) > limit).groupBy(*by).agg(F.min(order).alias("_over")))
    return df.join(over, same, "left").where(F.col("_over").isNull() | (F.col(order) < F.col("_over"))).select(*df.columns)


def engineering_strain(df: DataFrame, length: str, order: str, by: list[str], name: str = "strain") -> DataFrame:
    """df with the relative change of the length since the group's first row, which an aggregation finds."""
    first, same = matched_by(by, df.groupBy(*by).agg(F.min_by(length, order).alias("_first")))
    return df.join(first, same, "left").select(*df.columns, (F.col(length) / F.col("_first") - 1).alias(name))


def trapezoid(x: str, y: str, order: str, by: list[str]) -> Column:
    """Area of the strip between the row before and this one; 0 in the first."""
    w = Window.partitionBy(*by).orderBy(order)
    return F.coalesce(0.5 * (F.col(y) + F.lag(y).over(w)) * (F.col(x) - F.lag(x).over(w)), F.lit(0.0))
