import random

import numpy as np
import pytest

import __spark_entry__ as entry
from moteflow.operators import bootstrap

RUNS = "seed long, ord long, t double, censored boolean"


class SplitMix64:
    """The generator, one draw after the other."""

    def __init__(self, seed):
        self.state = seed & 0xFFFFFFFFFFFFFFFF

    def next(self):
        self.state = (self.state + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        z = self.state
        z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        return z ^ z >> 31


def half_time(times, top):
    """The half time of one seed's few replicas."""
    if 2 * sum(not cut for _, cut in times) < len(times):
        return None
    t = sorted(top if cut else v for v, cut in times)
    before, share = 0.0, 0.0
    for k, v in enumerate(t, 1):
        if k / len(t) >= 0.5:
            return before + (0.5 - share) / (k / len(t) - share) * (v - before)
        before, share = v, k / len(t)
    return None


def plain_interval(rows, resamples, seed=148):
    by = {}
    for s, _, t, cut in rows:
        by.setdefault(s, []).append((t, cut))
    top = max(t for _, _, t, _ in rows)
    by = {s: v for s, v in sorted(by.items()) if half_time(v, top) is not None}
    rng, out = SplitMix64(seed), []
    for _ in range(resamples):
        taus = [half_time([v[rng.next() % len(v)] for _ in v], top) for v in by.values()]
        taus = [t for t in taus if t is not None]
        if taus:
            total = 0.0
            for t in taus:
                total += t
            out.append(total / len(taus))
    out.sort()

    def at(p):
        place = p / 100 * (len(out) - 1)
        lo, hi = int(np.floor(place)), int(np.ceil(place))
        return out[lo] if lo == hi else out[lo] + (place - lo) * (out[hi] - out[lo])

    return (at(2.5), at(97.5)) if len(out) >= 10 else (None, None)


def test_any_draw_can_be_made_anywhere():
    rng = SplitMix64(148)
    one = [rng.next() for _ in range(50)]
    assert bootstrap.splitmix(148, 0, 50).tolist() == one and bootstrap.splitmix(148, 31, 7).tolist() == one[31:38]


@pytest.mark.parametrize("held", [0, 10**6])
@pytest.mark.parametrize("sizes", [(1, 2), (7, 12, 31), (40,)])
def test_interval_equals_plain_resampling_to_the_bit(spark, sizes, held):
    rng = random.Random(9)
    rows = [(s, i, round(rng.expovariate(0.01), 2), rng.random() < (0.9 if s == 1 and len(sizes) > 2 else 0.3)) for s, n in enumerate(sizes) for i in range(n)]
    assert bootstrap.bootstrap_interval(spark.createDataFrame(rows, RUNS).repartition(3), 60, held=held) == plain_interval(rows, 60)


def test_bootstrap_ci_covers_every_replica(spark, tmp_path):
    n = 24_000  # far from the smallest time of fifty groups
    spark.range(n).selectExpr("id % 8 as o_custkey", "id as o_orderkey", "cast(id as double) as o_totalprice", "'F' as o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    got = entry.queries()["bootstrap_ci"](spark, str(tmp_path)).first()
    assert abs(got["tau"] - n / 2) < 20 and got["low"] < n / 2 < got["high"] and 0 < got["high"] - got["low"] < n / 20


def test_many_runs_write_no_row_for_each_draw(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i % 2, i, round(rng.expovariate(0.01), 2), rng.random() < 0.3) for i in range(3000)]
    sizes, write = [], bootstrap.written

    def counted(df, what):
        out = write(df, what)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(bootstrap, "written", counted)
    assert bootstrap.bootstrap_interval(spark.createDataFrame(rows, RUNS), 50, held=0) == plain_interval(rows, 50)
    assert max(sizes) <= len(rows)  # not 50 times as many


def test_a_middle_outside_of_the_ends_is_looked_for_again(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "WIDTH", 0)
    rng = random.Random(4)
    rows = [(s, i, float(rng.randrange(900) // (1 if s == 5 else 40)), rng.random() < 0.4) for s in (5, 6) for i in range(200)]
    assert bootstrap.bootstrap_interval(spark.createDataFrame(rows, RUNS), 50, held=0) == plain_interval(rows, 50)
