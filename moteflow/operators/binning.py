"""Histograms and profiles over bins whose edges accumulate by repeated addition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bin_edges(lo: float, hi: float, bins: int, min_width: float = 0.5) -> list[tuple[float, float]]:
    """Ranges from lo to hi. Edges are sums, so rounding can add a bin; empty if hi is below lo."""
    if hi < lo or bins < 1:
        return []
    width, edge, out = max(min_width, (hi - lo) / bins), lo, []
    while edge < hi or not out:
        out.append((edge, edge + width))
        edge += width
        if width <= 0:
            break
    return out


def bins_table(spark: SparkSession, edges: list[tuple[float, float]]) -> DataFrame:
    """bin, lo, hi, centre, last: one row a bin, as many as the caller asked for."""
    rows = [(i, a, b, (a + b) / 2, i == len(edges) - 1) for i, (a, b) in enumerate(edges)]
    return spark.createDataFrame(rows, "bin int, lo double, hi double, centre double, last boolean")


def bin_of(value: F.Column, edges: list[tuple[float, float]]) -> F.Column:
    """Index of the value's bin, the last one closed at its end; null outside. One pass over the rows, no join."""
    if not edges:
        return F.lit(None).cast("int")
    starts = F.array(*[F.lit(a) for a, _ in edges])
    hi = edges[-1][1]
    width = edges[0][1] - edges[0][0]
    guess = F.least(F.lit(len(edges) - 1), F.greatest(F.lit(0), F.floor((value - edges[0][0]) / width).cast("int")))
    low = F.when(value < F.get(starts, guess), guess - 1).when((guess + 1 < len(edges)) & (value >= F.get(starts, guess + 1)), guess + 1).otherwise(guess)
    return F.when((value >= edges[0][0]) & (value <= hi), low)


def histogram(df: DataFrame, value: str, edges: list[tuple[float, float]]) -> DataFrame:
    """bin, lo, hi, centre, count of every bin, empty ones too."""
    counts = df.select(bin_of(F.col(value), edges).alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count("*").alias("count"))
    return bins_table(df.sparkSession, edges).join(counts, "bin", "left").select("bin", "lo", "hi", "centre", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def profile(df: DataFrame, position: str, value: str, edges: list[tuple[float, float]]) -> DataFrame:
    """histogram() with the mean of value in each bin, 0 in an empty one; a NaN makes its bin's mean NaN."""
    sums = df.select(bin_of(F.col(position), edges).alias("bin"), F.col(value).cast("double").alias("v")).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count("*").alias("count"), F.avg("v").alias("mean"))
    return bins_table(df.sparkSession, edges).join(sums, "bin", "left").select("bin", "lo", "hi", "centre", F.coalesce("count", F.lit(0)).cast("long").alias("count"), F.coalesce("mean", F.lit(0.0)).alias("value"))
