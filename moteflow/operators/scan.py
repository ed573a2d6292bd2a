"""Running values over an order, without a task that holds a whole group.

Rows are dealt out in ranges of the order and stored with their range's number. Each range is scanned by itself; what a range
hands on (sums, counts, the last value) is one row a range and group, and only for groups that several ranges share. A running
value over those few rows is joined back. Rows are counted first, so that a range of a large table holds about RANGE_ROWS of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written

PART, SALT = "_range", "_salt"
RANGE_ROWS = 1 << 16


def share(rows: DataFrame, range_rows: int) -> int:
    """How many ranges a stored table makes; a number that is given isn't lowered by adaptive execution, which knows the size of packed rows only."""
    return -(-rows.count() // range_rows)


def pieces(df: DataFrame, by: list[str], order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """df in ranges of by and order, written, with the range's number; rows that tie in order may lie in two ranges and have a fixed order by salt."""
    salted = written(df.withColumn(SALT, F.monotonically_increasing_id()), "rows")
    keys, number = [*by, *order, SALT], share(salted, range_rows)
    dealt = salted.repartitionByRange(number, *keys) if number > 1 else salted.repartitionByRange(*keys)
    return written(dealt.withColumn(PART, F.spark_partition_id()), "ranges")


def scanned(df: DataFrame, by: list[str], order: list[str], range_rows: int = RANGE_ROWS, **running: tuple[str, Column]) -> DataFrame:
    """df with a column for each of running: (kind, value), the running value up to and with the row in the order within by.

    Kinds: sum and count (of non-nulls), max, min, last (non-null) and next (the first non-null from the row on). Nulls sort
    first; rows that tie in order have some fixed order, so give an order without ties where it matters. An empty table stays
    empty; a null in by is a group.
    """
    rows = pieces(df.withColumns({f"_in_{n}": v for n, (_, v) in running.items()}), by, order, range_rows)
    local, number = [*by, PART], share(rows, range_rows)
    dealt = rows.repartition(2 * number, *local) if number > 1 else rows  # two tasks a range: fewer ranges meet in one
    up = Window.partitionBy(*local).orderBy(*order, SALT)
    upto = up.rowsBetween(Window.unboundedPreceding, 0)
    # read backwards: a frame that only grows costs one pass, one that shrinks would start anew at each row
    down = Window.partitionBy(*local).orderBy(*[F.desc(o) for o in [*order, SALT]]).rowsBetween(Window.unboundedPreceding, 0)
    inside = {"sum": lambda c: F.sum(c).over(upto), "count": lambda c: F.count(c).over(upto), "max": lambda c: F.max(c).over(upto), "min": lambda c: F.min(c).over(upto), "last": lambda c: F.last(c, ignorenulls=True).over(upto), "next": lambda c: F.last(c, ignorenulls=True).over(down)}
    place = F.struct(*order, SALT)
    filled = lambda c, f: f(F.when(c.isNotNull(), F.struct(place.alias("at"), c.alias("v"))))["v"]
    whole = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "last": lambda c: filled(c, F.max), "next": lambda c: filled(c, F.min)}
    ends = rows.groupBy(*local).agg(*[whole[k](F.col(f"_in_{n}")).alias(f"_out_{n}") for n, (k, _) in running.items()])
    # of a group that lies in one range nothing is handed on
    shared = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ends = ends.withColumn("_ranges", F.count("*").over(shared)).where(F.col("_ranges") > 1)
    before, after = (shared.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc(PART), F.desc(PART)))
    over = {"sum": lambda c: F.sum(c).over(before), "count": lambda c: F.sum(c).over(before), "max": lambda c: F.max(c).over(before), "min": lambda c: F.min(c).over(before), "last": lambda c: F.last(c, ignorenulls=True).over(before), "next": lambda c: F.last(c, ignorenulls=True).over(after)}
    carry = ends.select(*[F.col(b).alias("_by_" + b) for b in by], F.col(PART).alias("_by" + PART), *[over[k](F.col(f"_out_{n}")).alias(f"_carry_{n}") for n, (k, _) in running.items()])
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col("_by_" + b)) for b in by] + [F.col(PART) == F.col("_by" + PART)])
    here = dealt.select("*", *[inside[k](F.col(f"_in_{n}")).alias(f"_here_{n}") for n, (k, _) in running.items()])
    both = here.join(written(carry, "carry"), same, "left")
    merge = {"sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: a + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least, "last": lambda a, b: F.coalesce(a, b), "next": lambda a, b: F.coalesce(a, b)}
    return both.select(*df.columns, *[merge[k](F.col(f"_here_{n}"), F.col(f"_carry_{n}")).alias(n) for n, (k, _) in running.items()])


def numbered_rows(df: DataFrame, name: str, by: list[str], order: list[str]) -> DataFrame:
    """df with the row's number within by, from 0."""
    return scanned(df, by, order, **{name: ("count", F.lit(1))}).withColumn(name, F.col(name) - 1)
