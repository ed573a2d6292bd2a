"""Running values, nearest rows, ranks and logs over ranges of rows, against plain loops."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_bootstrap import half_time

from moteflow.operators import joins, ranks, scan, stats
from moteflow.plans import surfaces, tools
from moteflow.sources import tables


@pytest.fixture
def narrow(spark):
    """Ranges of few rows: adaptive execution may not put them together."""
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    for c, v in before.items():
        spark.conf.set(c, v)


def test_running_values_pass_from_range_to_range(narrow):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, rng.randrange(50)])) for i in range(300)]
    df = narrow.createDataFrame(rows, "g string, at long, v long")
    got = scan.scanned(df, ["g"], ["at"], s=("sum", F.col("v")), n=("count", F.col("v")), hi=("max", F.col("v")), lo=("min", F.col("v")), last=("last", F.col("v")), nxt=("next", F.col("v"))).collect()
    assert len(got) == 300
    for r in got:
        upto = [v for g, i, v in rows if g == r["g"] and i <= r["at"] and v is not None]
        on = [v for g, i, v in rows if g == r["g"] and i >= r["at"] and v is not None]
        assert (r["s"], r["n"], r["hi"], r["lo"], r["last"], r["nxt"]) == (sum(upto) if upto else None, len(upto), max(upto, default=None), min(upto, default=None), upto[-1] if upto else None, on[0] if on else None)
    whole = scan.numbered_rows(df, "k", [], ["at"]).collect()
    assert all(r["k"] == r["at"] for r in whole)
    tied = scan.numbered_rows(narrow.range(200).selectExpr("1 as at"), "k", [], ["at"]).collect()
    assert sorted(r["k"] for r in tied) == list(range(200))
    assert scan.numbered_rows(df.limit(0), "k", ["g"], ["at"]).count() == 0


def test_no_task_holds_a_whole_group(narrow):
    pieces = scan.pieces(narrow.range(1000).selectExpr("id % 2 as g", "1 as at"), ["g"], ["at"])
    assert pieces.groupBy("g").agg(F.count_distinct(scan.PART).alias("n")).agg(F.min("n")).first()[0] > 1


def test_ranges_are_as_many_as_the_rows_need(narrow):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), i, rng.randrange(9)) for i in range(1000)]
    df = narrow.createDataFrame(rows, "g string, at long, v long")
    ranges = scan.pieces(df, ["g"], ["at"], range_rows=50).groupBy(scan.PART).count().agg(F.count("*"), F.max("count")).first()
    assert ranges[0] > 10 and ranges[1] <= 200  # not 7 ranges, however many rows there are
    before, want = {"a": 0, "b": 0}, {}
    for g, i, v in rows:
        want[i] = before[g] = before[g] + v
    got = scan.scanned(df, ["g"], ["at"], range_rows=50, s=("sum", F.col("v")))
    assert {r["at"]: r["s"] for r in got.collect()} == want
    assert got.rdd.getNumPartitions() > 7


def test_wide_rows_equal_the_pivoted_log(spark, tmp_path):
    (tmp_path / "log.lammps").write_text(LOG + "Step B Temp B\n50 1 2 3\n60 4 5 6\n")
    rows, log = tables.log_rows(spark, str(tmp_path / "log.lammps")), tables.read_log(spark, str(tmp_path / "log.lammps"))
    assert tables.shared_names(rows) == tables.common_columns(log) == ["Step", "Temp"]
    names = ["Temp", "Step", "Press"]
    key = lambda df: df.select("block", "row", "global_row", *names).orderBy("global_row").collect()
    assert key(tables.wide_rows(rows, names)) == key(tables.wide_log(log, names)) and rows.count() == 6
    assert [r["B"] for r in tables.wide_rows(rows, ["B"]).orderBy("global_row").collect()] == [None] * 4 + [1.0, 4.0]


def test_nearest_equals_plain_search(narrow):
    rng = random.Random(2)
    left = [(rng.choice(["a", "b", "c"]), rng.randrange(100), i) for i in range(200)] + [("a", None, 999)]
    right = [(rng.choice(["a", "b"]), rng.randrange(0, 100, 3), i) for i in range(80)] + [("a", 30, 7), ("b", None, 1)]
    got = joins.nearest(narrow.createDataFrame(left, "g string, p long, i long"), narrow.createDataFrame(right, "g string, q long, t long"), "p", "q", "t", ["g"]).collect()
    assert len(got) == len(left)
    for r in got:
        near = min(((abs(q - r["p"]), t, q) for g, q, t in right if g == r["g"] and q is not None), default=None) if r["p"] is not None else None
        assert (r["q"], r["t"]) == ((near[2], near[1]) if near else (None, None))


@pytest.mark.parametrize("few", [3, 20_000])
def test_ranks_equal_sorting(spark, few):
    rng = random.Random(3)
    values = {"even": [rng.random() for _ in range(200)], "ties": [float(rng.randrange(4)) for _ in range(150)], "far": [1e300, -1e300, 0.0, 5e-324, *(rng.lognormvariate(0, 40) for _ in range(90))], "one": [2.5], "same": [1.0] * 40, None: [float(i) for i in range(30)]}
    df = spark.createDataFrame([(g, v) for g, x in values.items() for v in x] + [("even", float("nan")), ("even", None)], "g string, v double")
    clean = df.where(stats.finite(F.col("v")))
    want = {(g, k): sorted(x)[k] for g, x in values.items() for k in {0, len(x) // 3, len(x) // 2, len(x) - 1}}
    asked = spark.createDataFrame([*want, ("even", 200), ("even", -1), ("none", 0)], "g string, rank long")
    got = {(r["g"], r["rank"]): r["value"] for r in ranks.at_ranks(clean, "v", ["g"], asked, few, 8).collect()}
    assert got == want
    for p in (0.0, 0.025, 0.5, 0.95, 1.0):
        near = {r["g"]: r["v"] for r in stats.nearest_rank(df, "v", p, ["g"], few).collect()}
        assert near == {g: sorted(x)[math.floor(p * (len(x) - 1) + 0.5)] for g, x in values.items()}
        line = {r["g"]: r["q"] for r in stats.linear_ranks(df, "v", {"q": p}, ["g"], few).collect()}
        assert all(math.isclose(line[g], float(np.percentile(x, 100 * p)), rel_tol=1e-12, abs_tol=1e-300) for g, x in values.items() if g != "far")
    quart = {r["g"]: (r["n"], r["median"], r["q1"], r["q3"]) for r in stats.tukey_quartiles(df, "v", ["g"], few).collect()}
    for g, x in values.items():
        s, h = sorted(x), len(x) // 2
        assert quart[g] == (len(x), statistics.median(s), statistics.median(s[:h]) if h else None, statistics.median(s[-h:]) if h else None)
    assert ranks.at_ranks(clean.limit(0), "v", ["g"], asked, few).count() == 0


@pytest.mark.parametrize("few", [5, 20_000])
def test_surface_and_half_time(spark, few):
    rng = random.Random(4)
    rows = [(f, rng.choice("AB"), float(rng.randrange(20))) for f in range(3) for _ in range(90)]
    got = {r["frame"]: (r["surface"], r["top"]) for r in surfaces.surface(spark.createDataFrame(rows, "frame int, element string, z double"), "A", few).collect()}
    for f in range(3):
        z = sorted((z for g, e, z in rows if g == f and e == "A"), reverse=True)
        m = max(1, len(z) // 20)
        assert math.isclose(got[f][0], sum(z[:m]) / m) and got[f][1] == z[0]
    runs = [(s, float(rng.randrange(1, 40)), rng.random() < c) for s, c in enumerate((0.1, 0.45, 0.9)) for _ in range(31)] + [(7, 5.0, False)]
    top = max(t for _, t, _ in runs)
    taus = {r["seed"]: r["tau"] for r in stats.half_survival_time(spark.createDataFrame(runs, "seed long, t double, censored boolean"), "t", "censored", ["seed"], few).collect()}
    for s in (0, 1, 2, 7):
        want = half_time([(t, c) for q, t, c in runs if q == s], top)
        assert (taus.get(s) is None) == (want is None) and (want is None or math.isclose(taus[s], want))


def test_atoms_of_a_frame_are_not_gathered_for_its_surface(spark):
    atoms = spark.range(40_000).selectExpr("0 as frame", "if(id % 3 = 0, 'B', 'A') as element", "cast(id % 900 as double) as z", "1.0D as charge")
    depths = surfaces.penetration(atoms, "A", "B")
    plan = depths._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan and "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    z = sorted((float(i % 900) for i in range(40_000) if i % 3), reverse=True)
    top = sum(z[: len(z) // 20]) / (len(z) // 20)
    rel = [i % 900 - top for i in range(0, 40_000, 3)]
    r = depths.first()
    assert math.isclose(r["surface"], top) and (r["penetrated"], r["at_surface"], r["above"]) == (sum(x < 0 for x in rel), sum(0 <= x < 2.5 for x in rel), sum(x >= 2.5 for x in rel))


LOG = """noise
Step Temp Press
0 1.0 2.0
WARNING: x
10 3.0 4.0
20 nan 4.0
Loop time of 1.5 on 1 procs
30 5 6
Step Temp
30 7.0
ERROR
40 8.0
"""


@pytest.mark.parametrize("split", [16, 1 << 20])
def test_log_read_in_splits(narrow, tmp_path, split):
    before = narrow.conf.get("spark.sql.files.maxPartitionBytes")
    narrow.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        (tmp_path / "log.lammps").write_text(LOG + "Step A\n" + "".join(f"{i} {i}\n" for i in range(200)))
        rows = tables.read_log(narrow, str(tmp_path / "log.lammps"))
        got = [tuple(r) for r in rows.where("col <> 'A'").select("block", "row", "global_row", "col", "val", "loop_time").orderBy("global_row", "ord").collect()]
        assert got[:10] == [(0, 0, 0, "Step", 0.0, 1.5), (0, 0, 0, "Temp", 1.0, 1.5), (0, 0, 0, "Press", 2.0, 1.5), (0, 1, 1, "Step", 10.0, 1.5), (0, 1, 1, "Temp", 3.0, 1.5), (0, 1, 1, "Press", 4.0, 1.5), (1, 0, 2, "Step", 30.0, None), (1, 0, 2, "Temp", 7.0, None), (1, 1, 3, "Step", 40.0, None), (1, 1, 3, "Temp", 8.0, None)]
        last = rows.where("col = 'A'").orderBy("row").collect()
        assert [r["val"] for r in last] == [float(i) for i in range(200)] and [r["global_row"] for r in last] == list(range(4, 204)) and {r["block"] for r in last} == {2}
    finally:
        narrow.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_log_in_parts_and_logs_by_pattern(spark, tmp_path):
    (tmp_path / "part-0.log").write_text("Step T\n1 2\n")
    (tmp_path / "part-1.log").write_text("3 4\nLoop time of 2 on 1\n")
    one = tables.read_log(spark, str(tmp_path))
    assert [(r["block"], r["global_row"], r["val"]) for r in one.where("col = 'T'").orderBy("global_row").collect()] == [(0, 0, 2.0), (0, 1, 4.0)]
    each = tables.read_log(spark, f"{tmp_path}/*.log")
    assert [r["val"] for r in each.where("col = 'T'").collect()] == [2.0]


def test_bound_share_at_every_frame(spark):
    rng = random.Random(5)
    rows = [(0, i, float(rng.randrange(1, 30)), rng.random() < 0.3) for i in range(40)]
    runs = spark.createDataFrame(rows, "seed long, replica long, t double, censored boolean")
    share = lambda at: sum(c or t > at for _, _, t, c in rows) / 40
    frames = spark.range(250).selectExpr("cast(id as int) as frame")
    got = {r["frame"]: (r["at"], r["bound"]) for r in tools.bound_at_frames(runs, None, frames, 0.5).collect()}
    assert len(got) == 250 and all(at == 0.5 * f and math.isclose(b, share(at), abs_tol=1e-12) for f, (at, b) in got.items())
    axis = sorted({0.0, *(t for _, _, t, _ in rows)})
    got = {r["frame"]: (r["at"], r["bound"]) for r in tools.bound_at_frames(runs, None, frames, None).collect()}
    assert len(got) == 250 and all(at == axis[min(f, len(axis) - 1)] and math.isclose(b, share(at), abs_tol=1e-12) for f, (at, b) in got.items())
    assert tools.bound_at_frames(runs, None, None, None).count() == len(axis)
    grid = spark.createDataFrame([(2.0,), (9.0,)], "t double")
    assert [r["at"] for r in tools.bound_at_frames(runs, grid, None, None).orderBy("frame").collect()] == [2.0, 9.0]
    top = max(t for _, _, t, _ in rows)
    assert tools.bound_at_frames(runs, None, None, 7.0).count() == int(top / 7) + 1
