"""Statistics with the conventions of simulation reports, as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written
from .ranks import FEW, group_sizes, with_ranked


def population_std(c: Column) -> Column:
    """Root of the mean square minus the squared mean."""
    return F.sqrt(F.greatest(F.lit(0.0), F.avg(c * c) - F.avg(c) * F.avg(c)))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def settled(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by and the finite values, stored: ranks read them several times, and what makes them may be dear."""
    return written(df.select(*by, F.col(value).cast("double").alias(value)), "values").where(finite(F.col(value)))


def nearest_rank(df: DataFrame, value: str, p: float, by: list[str], few: int = FEW) -> DataFrame:
    """by, value: the finite value at rank round(p * (n - 1)), halves away from zero."""
    rows = settled(df, value, by)
    found = with_ranked(rows, value, by, group_sizes(rows, by), few, v=F.round(p * (F.col("n") - 1)))
    return found.select(*by, F.col("v").alias(value))


def linear_ranks(df: DataFrame, value: str, shares: dict[str, float], by: list[str], few: int = FEW) -> DataFrame:
    """by and a column for each of shares: between the finite values at the ranks around share * (n - 1), in proportion."""
    rows = settled(df, value, by)
    at = {k: p * (F.col("n") - 1) for k, p in shares.items()}
    found = with_ranked(rows, value, by, group_sizes(rows, by), few, **{f"_lo_{k}": F.floor(a) for k, a in at.items()}, **{f"_hi_{k}": F.ceil(a) for k, a in at.items()})
    return found.select(*by, *[(F.col(f"_lo_{k}") + (a - F.floor(a)) * (F.col(f"_hi_{k}") - F.col(f"_lo_{k}"))).alias(k) for k, a in at.items()])


def tukey_quartiles(df: DataFrame, value: str, by: list[str], few: int = FEW) -> DataFrame:
    """by, n, median, q1, q3: quartiles are medians of the halves without the middle value; null quartiles for one value."""
    rows = settled(df, value, by)
    n = F.col("n")
    half, middle = F.floor(n / 2), lambda start, m: (start + F.floor((m - 1) / 2), start + F.floor(m / 2))
    spots = {k: middle(start, m) for k, (start, m) in {"median": (F.lit(0), n), "q1": (F.lit(0), half), "q3": (n - half, half)}.items()}
    found = with_ranked(rows, value, by, group_sizes(rows, by), few, **{f"{k}_{side}": v for k, pair in spots.items() for side, v in zip("ab", pair, strict=True)})
    mean = lambda k: (F.col(f"{k}_a") + F.col(f"{k}_b")) / 2
    return found.select(*by, "n", mean("median").alias("median"), *[F.when(n > 1, mean(k)).alias(k) for k in ("q1", "q3")])


def ols(x: str, y: str) -> list[Column]:
    """slope, intercept and the slope's standard error as aggregates; null with fewer than three points or one x."""
    n, sxx, sxy, syy = F.regr_count(y, x), F.regr_sxx(y, x), F.regr_sxy(y, x), F.regr_syy(y, x)
    ok = (n >= 3) & (sxx > 0)
    slope = F.when(ok, sxy / sxx)
    rest = F.greatest(F.lit(0.0), syy - sxy * sxy / sxx)
    return [slope.alias("slope"), F.when(ok, F.regr_intercept(y, x)).alias("intercept"), F.when(ok, F.sqrt(rest / (n - 2) / sxx)).alias("slope_error")]


def jarzynski(work: str, kt: float, by: list[str], df: DataFrame, least: int = 10) -> DataFrame:
    """by, n, exponential (shifted by the smallest work) and second_cumulant (population variance); null below least values."""
    good = df.where(finite(F.col(work)))
    low = good.groupBy(*by).agg(F.min(work).alias("low"))
    shifted = good.join(low, by)
    ok = F.count("*") >= least
    return shifted.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.when(ok, F.min("low") - kt * F.ln(F.avg(F.exp(-(F.col(work) - F.col("low")) / kt)))).alias("exponential"),
        F.when(ok, F.avg(work) - F.var_pop(work) / (2 * kt)).alias("second_cumulant"),
    )


def bell_evans(df: DataFrame, rate: str, force: str, kt: float) -> DataFrame:
    """n_rates, distance, koff: the fit of median force on ln(rate); null below three rates or a slope that isn't positive."""
    points = linear_ranks(df, force, {"f": 0.5}, [rate]).select(F.ln(rate).alias("x"), "f")
    fit = points.agg(F.count("*").alias("n_rates"), *ols("x", "f"))
    ok = (F.col("n_rates") >= 3) & (F.col("slope") > 0)
    distance = kt / F.col("slope")
    return fit.select("n_rates", F.when(ok, distance).alias("distance"), F.when(ok, distance / (kt * F.exp(F.col("intercept") / F.col("slope")))).alias("koff"))


def half_survival_time(df: DataFrame, time: str, censored: str, by: list[str], few: int = FEW) -> DataFrame:
    """by, tau: censored runs count at the latest time of all; the time at which the linear distribution from (0, 0) reaches one half.

    Null where fewer than half of the runs ended, and then no row. Times are finite.
    """
    df = written(df.select(*by, time, censored), "runs")
    top = df.agg(F.max(time)).first()[0]
    runs = df.select(*by, F.when(F.col(censored), F.lit(top)).otherwise(F.col(time)).alias("t"), F.col(censored).alias("c"))
    sizes = runs.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~F.col("c")).alias("ended")).where(2 * F.col("ended") >= F.col("n"))
    half = F.ceil(F.col("n") / 2)  # the first share of at least one half is half / n
    found = with_ranked(runs, "t", by, sizes, few, before=half - 2, at=half - 1)
    t0 = F.coalesce("before", F.lit(0.0))
    return found.select(*by, (t0 + (0.5 - (half - 1) / F.col("n")) / (half / F.col("n") - (half - 1) / F.col("n")) * (F.col("at") - t0)).alias("tau"))
