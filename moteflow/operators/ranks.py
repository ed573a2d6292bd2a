"""Values at ranks of many groups at once, exactly, without a sort or a buffer of a whole group.

A group's values are counted in bins of equal width; the counts say which bin holds a rank, and only that bin is looked into
again, between its least and largest value. What is left of a rank once its bin holds few rows is sorted, few rows a rank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written

BINS, FEW = 1024, 20_000


def _same(by: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(prefix + b)) for b in by], F.lit(True))


def _renamed(df: DataFrame, by: list[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({b: prefix + b for b in by})


def at_ranks(df: DataFrame, value: str, by: list[str], ranks: DataFrame, few: int = FEW, bins: int = BINS) -> DataFrame:
    """by, rank and value for each row of ranks (by, rank): the value with rank smaller or equal ones before it, from 0.

    df's values must be finite and not null; ties take as many ranks as they are. Ranks outside of a group have no row; a null
    in by is a group; empty tables give no rows.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v"))
    ends = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = ranks.select(*by, F.col("rank").cast("long").alias("rank")).distinct()
    # a span is a stretch of a group's values between two of them, and the rank within it that is looked for
    spans = written(wanted.join(_renamed(ends, by, "_e_"), _same(by, "_e_")).where((F.col("rank") >= 0) & (F.col("rank") < F.col("_n"))).select(*by, "rank", F.col("rank").alias("_left"), "_n", "_lo", "_hi"), "spans")
    out = []
    while True:
        out.append(spans.where("_lo = _hi").select(*by, "rank", F.col("_lo").alias("value")))
        small = spans.where((F.col("_lo") < F.col("_hi")) & (F.col("_n") <= few))
        # several ranks may share a span: its rows are sorted once
        inside = _renamed(small.select(*by, "_lo", "_hi").distinct(), by, "_s_").join(rows, _same(by, "_s_")).where(F.col("_v").between(F.col("_lo"), F.col("_hi"))).select(*by, "_lo", "_hi", "_v")
        order = inside.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_lo", "_hi").orderBy("_v")) - 1)
        out.append(_renamed(small, by, "_s_").withColumnsRenamed({"_lo": "_slo", "_hi": "_shi"}).join(order, _same(by, "_s_") & (F.col("_slo") == F.col("_lo")) & (F.col("_shi") == F.col("_hi")) & (F.col("_left") == F.col("_r"))).select(*by, "rank", F.col("_v").alias("value")))
        large = spans.where((F.col("_lo") < F.col("_hi")) & (F.col("_n") > few))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, out)
        share = (F.col("_v") * 0.5 - F.col("_lo") * 0.5) / (F.col("_hi") * 0.5 - F.col("_lo") * 0.5)  # halves don't overflow
        held = _renamed(large.select(*by, "_lo", "_hi").distinct(), by, "_s_").join(rows, _same(by, "_s_")).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        counts = held.groupBy(*by, "_lo", "_hi", F.least(F.lit(bins - 1), F.floor(share * bins)).alias("_bin")).agg(F.count("*").alias("_m"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        upto = F.sum("_m").over(Window.partitionBy(*by, "_lo", "_hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))  # BINS rows at most
        steps = _renamed(counts.withColumn("_upto", upto), by, "_c_").withColumnsRenamed({"_lo": "_clo", "_hi": "_chi"})
        hit = large.join(steps, _same(by, "_c_") & (F.col("_lo") == F.col("_clo")) & (F.col("_hi") == F.col("_chi")) & (F.col("_left") < F.col("_upto")) & (F.col("_left") >= F.col("_upto") - F.col("_m")))
        spans = written(hit.select(*by, "rank", (F.col("_left") - (F.col("_upto") - F.col("_m"))).alias("_left"), F.col("_m").alias("_n"), F.col("_low").alias("_lo"), F.col("_high").alias("_hi")), "spans")


def group_sizes(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def with_ranked(df: DataFrame, value: str, by: list[str], sizes: DataFrame, few: int = FEW, **ranks: Column) -> DataFrame:
    """sizes (by, n) with a column for each of ranks, the value at that rank, an expression of n; null where it is outside of the group."""
    each = sizes.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()])).alias("r")).select(*by, "r.name", "r.rank")
    found = at_ranks(df, value, by, each.select(*by, "rank"), few)
    named = each.join(found.withColumnsRenamed({b: "_f_" + b for b in by} | {"rank": "_frank"}), _same(by, "_f_") & (F.col("rank") == F.col("_frank")))
    wide = named.groupBy(*by).agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in ranks])
    return sizes.join(_renamed(wide, by, "_w_"), _same(by, "_w_"), "left").select(*sizes.columns, *ranks)
