"""Reproducible resampling in parallel: the generator's state after n draws is its seed and n steps, so any draw can be made anywhere."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import written
from .ranks import with_ranked
from .scan import numbered_rows, scanned

#: The step and the two multipliers of the 64-bit generator.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
HELD = 2_000_000  # runs whose times are sent to every task; of more, a task has a byte for each run of one seed
CHUNK = 1 << 16
WIDTH = 6  # a middle is looked for within so many roots of the number of runs
SHARES = 24  # parts that a seed's resamples are dealt out in
BELOW, AT_LOW, INSIDE, AT_HIGH, ABOVE, CENSORED = 0, 1, 2, 3, 4, 8


def splitmix(seed: int, first: int, count: int) -> np.ndarray:
    """Draws number first + 1 to first + count of the generator, as unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed & 0xFFFFFFFFFFFFFFFF) + np.uint64(STEP) * (np.arange(1, count + 1, dtype=np.uint64) + np.uint64(first & 0xFFFFFFFFFFFFFFFF))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND)
        return z ^ (z >> np.uint64(31))


def picked(seed: int, first: int, count: int, n: int) -> np.ndarray:
    """The runs, of n, that draws number first + 1 to first + count name; by quotients, which numpy divides faster than remainders."""
    z = splitmix(seed, first, count)
    return (z - z // np.uint64(n) * np.uint64(n)).astype(np.int64)


def packed(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """seed, start, codes, at, t: where each run's time lies against its seed's ends (lo, hi), a byte a run in the order of i, and place and time of those between."""
    t = F.col("t")
    code = F.when(t < F.col("lo"), BELOW).when(t == F.col("lo"), AT_LOW).when(t < F.col("hi"), INSIDE).when(t == F.col("hi"), AT_HIGH).otherwise(ABOVE) + F.when(F.col("c"), CENSORED).otherwise(0)
    coded = rows.join(F.broadcast(ends), "seed").select("seed", "i", code.cast("tinyint").alias("code"), "t")  # a row a seed
    kind = dict(rows.dtypes)["seed"]

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["seed", "start", "codes", "at", "t"]
        for b in batches:
            i, codes, times = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            cuts = [0, *(np.flatnonzero(np.diff(i) != 1) + 1).tolist(), b.num_rows]  # i starts anew with each seed
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo < hi:
                    between = lo + np.flatnonzero((codes[lo:hi] & 7) == INSIDE)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 1), pa.array([int(i[lo])], pa.int64()), pa.array([codes[lo:hi].astype(np.uint8).tobytes()], pa.binary()), pa.array([i[between]], pa.list_(pa.int64())), pa.array([times[between]], pa.list_(pa.float64()))], names)

    return written(coded.repartitionByRange("seed", "i").sortWithinPartitions("seed", "i").mapInArrow(pack, f"seed {kind}, start long, codes binary, at array<long>, t array<double>"), "codes")


def counted(rows: DataFrame, seeds: DataFrame, resamples: int, seed: int, total: int) -> DataFrame:
    """seed, resample, n, before, at: the two values at the middle of each resample of which half ended, without a row a draw.

    A resample's middle lies near that of the runs: of its draws only those between two times around it are looked at, the others
    are counted. A task holds a byte for each run of its seed and has a share of the resamples. Where the middle lies outside,
    the resample is counted again between wider ends, at last the least and the largest time.
    """
    kind, out, width = dict(rows.dtypes)["seed"], [], WIDTH
    left = seeds.select("seed", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
    middle = F.ceil(F.col("n") / 2) - 1
    while True:
        reach = F.ceil(width * F.sqrt("n"))
        ends = written(with_ranked(rows, "t", ["seed"], seeds.select("seed", "n"), lo=F.greatest(F.lit(0), middle - reach), hi=F.least(F.col("n") - 1, middle + reach)), "ends")
        parts = packed(rows, ends.select("seed", "lo", "hi"))
        shares = left.groupBy("seed", F.pmod("resample", F.lit(SHARES)).alias("share")).agg(F.array_sort(F.collect_list("resample")).alias("todo")).join(seeds, "seed").join(ends.select("seed", "lo", "hi"), "seed")
        dealt = shares.select("seed", "share", F.lit(-1).cast("long").alias("start"), "todo", "n", "before", "lo", "hi").unionByName(shares.select("seed", "share").join(parts, "seed"), allowMissingColumns=True)
        columns = ["seed", "share", "start", "todo", "n", "before", "lo", "hi", "codes", "at", "t"]

        def draw(key, job: dict, codes: np.ndarray, at: np.ndarray, times: np.ndarray) -> list:  # noqa: ANN001
            done, n = [], job["n"]
            half = (n + 1) // 2
            for resample in job["todo"]:
                counts, some = np.zeros(16, np.int64), []
                for first in range(0, n, CHUNK):
                    pick = picked(seed, resample * total + job["before"] + first, min(CHUNK, n - first), n)
                    c = codes[pick]
                    counts += np.bincount(c, minlength=16)
                    some.append(pick[(c & 7) == INSIDE])
                if 2 * counts[:CENSORED].sum() < n:
                    continue
                counts = counts[:CENSORED] + counts[CENSORED:]
                inside = np.sort(times[np.searchsorted(at, np.concatenate(some))])
                steps = np.cumsum(counts[: ABOVE])

                def value(place: int, steps: np.ndarray = steps, inside: np.ndarray = inside) -> float | None:
                    k = int(np.searchsorted(steps, place, side="right"))
                    return {AT_LOW: job["lo"], AT_HIGH: job["hi"]}.get(k) if k != INSIDE else float(inside[place - steps[AT_LOW]])

                got = (value(half - 2) if half > 1 else 0.0, value(half - 1))
                done.append((key, resample, n, *got, None not in got))
            return done

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            def close() -> pa.RecordBatch:
                codes = np.concatenate([np.frombuffer(h["codes"], np.uint8) for h in held])
                at, times = (np.concatenate([np.asarray(h[k], dtype) for h in held]) for k, dtype in (("at", np.int64), ("t", np.float64)))
                columns = list(zip(*draw(job["seed"], job, codes, at, times), strict=True)) or [[]] * len(shape)
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

            job, held, shape = {}, [], None
            for b in batches:
                shape = shape or pa.schema([("seed", b.schema.field(0).type), ("resample", pa.int32()), ("n", pa.int64()), ("before", pa.float64()), ("at", pa.float64()), ("ok", pa.bool_())])
                for row in b.to_pylist():
                    if row["start"] >= 0:
                        held.append(row)
                        continue
                    if held:
                        yield close()
                    job, held = row, []
            if held:
                yield close()

        halves = written(dealt.select(*columns).repartition(256, "seed", "share").sortWithinPartitions("seed", "share", "start").mapInArrow(run, f"seed {kind}, resample int, n long, before double, at double, ok boolean"), "halves")
        out.append(halves.where("ok").drop("ok"))
        left = halves.where("NOT ok").select("seed", "resample")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, out)
        width = 8 * width or 1


def half_times(runs: DataFrame, resamples: int, seed: int, held: int = HELD) -> DataFrame:
    """seed, resample, tau: the half time of each resample of each seed's runs, where at least half of it ended.

    runs has seed, t, censored and ord, the place in the file. The draws are those of one generator that goes through resamples,
    in each through the seeds that have a half time themselves, in each through as many draws as the seed has runs.
    """
    top = runs.agg(F.max("t")).first()[0]
    rows = runs.select("seed", F.when(F.col("censored"), F.lit(top)).otherwise(F.col("t")).alias("t"), F.col("censored").alias("c"), "ord")
    rows = written(numbered_rows(rows, "i", ["seed"], ["ord"]), "runs")
    sizes = rows.groupBy("seed").agg(F.count("*").alias("n"), F.count_if(~F.col("c")).alias("ended")).where(2 * F.col("ended") >= F.col("n"))
    seeds = written(scanned(sizes, [], ["seed"], upto=("sum", F.col("n"))), "seeds")
    total = seeds.agg(F.sum("n")).first()[0] or 0
    if total <= held:
        wanted = seeds.select("seed", "n", (F.col("upto") - F.col("n")).alias("before"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample")).repartition("seed", "resample")
        table = rows.join(seeds.select("seed"), "seed").select("seed", "i", "t", "c").orderBy("seed", "i").toPandas()  # held rows at most
        known = rows.sparkSession.sparkContext.broadcast({k: (g["t"].to_numpy(float), g["c"].to_numpy(bool)) for k, g in table.groupby("seed")})

        def middles(batches: Iterator) -> Iterator:
            import pandas as pd

            for b in batches:
                out = []
                for key, n, before, resample in b.itertuples(index=False):
                    t, c = known.value[key]
                    pick = (splitmix(seed, resample * total + before, n) % np.uint64(n)).astype(np.int64)
                    if 2 * np.count_nonzero(~c[pick]) >= n:
                        half = (n + 1) // 2
                        part = np.partition(t[pick], [max(0, half - 2), half - 1])
                        out.append((key, resample, n, part[half - 2] if half > 1 else np.nan, part[half - 1]))
                yield pd.DataFrame(out, columns=["seed", "resample", "n", "before", "at"])

        kind = dict(rows.dtypes)["seed"]
        found = wanted.select("seed", "n", "before", "resample").mapInPandas(middles, f"seed {kind}, resample int, n long, before double, at double").fillna(0.0, ["before"])
    else:
        found = counted(rows, seeds.select("seed", "n", (F.col("upto") - F.col("n")).alias("before")), resamples, seed, total)
    half = F.ceil(F.col("n") / 2)
    share = (half - 1) / F.col("n")
    return found.select("seed", "resample", (F.col("before") + (0.5 - share) / (half / F.col("n") - share) * (F.col("at") - F.col("before"))).alias("tau"))


def bootstrap_interval(runs: DataFrame, resamples: int, seed: int = 148, held: int = HELD) -> tuple[float | None, float | None]:
    """2.5 and 97.5 percent of the mean half time over resamples within seeds, in proportion between ranks; None below ten usable resamples.

    A seed adds to a resample's mean if at least half of its resample ended. Numbers add up in the order of seeds, so the
    interval is the same to the last bit wherever it is computed.
    """
    taus = half_times(runs, resamples, seed, held).groupBy("resample").agg(F.array_sort(F.collect_list(F.struct("seed", "tau"))).alias("s"))  # a row a seed
    means = taus.select((F.aggregate("s", F.lit(0.0), lambda a, x: a + x["tau"]) / F.size("s")).alias("m"))
    got = np.sort(np.array([r[0] for r in means.collect()]))  # a number a resample
    if len(got) < 10:
        return None, None

    def at(p: float) -> float:
        place = p / 100 * (len(got) - 1)
        lo, hi = int(np.floor(place)), int(np.ceil(place))
        return float(got[lo] if lo == hi else got[lo] + (place - lo) * (got[hi] - got[lo]))

    return at(2.5), at(97.5)
