import numpy as np
import pytest
from lattices import FCC, crystal, table
from pyspark.sql import functions as F

from moteflow.functions import geometry, sql
from moteflow.plans import jobs, tools  # noqa: F401
from moteflow.plans.result import Context, run_tool
from moteflow.schema import Box
from moteflow.sources.trajectories import append_new_frames, decimated, read_trajectory


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("SELECT min_image(0.75D, 1.5D) a, min_image(-0.75D, 1.5D) b, min_image(2D, 0D) c, wrap(-0.1D, 0D, 1D) d, min_image(NULL, 1D) e, disorientation(array(1D,0D,0D,0D), array(cos(0.3D),0D,0D,sin(0.3D)), true) f").first()
    assert (r["a"], r["b"], r["c"], r["e"]) == (-0.75, 0.75, 2.0, None) and abs(r["d"] - 0.9) < 1e-12 and abs(r["f"] - np.degrees(np.pi / 3 - 0.6)) < 1e-6


def test_orientation_hue(spark):
    half = np.pi / 8  # of a turn by 45 degrees
    q = [(1.0, 0.0, 0.0, 0.0), (np.cos(half), np.sin(half), 0.0, 0.0), (np.cos(np.arccos(1 / np.sqrt(3)) / 2), np.sin(np.arccos(1 / np.sqrt(3)) / 2) / np.sqrt(2), np.sin(np.arccos(1 / np.sqrt(3)) / 2) / np.sqrt(2), 0.0)]
    df = spark.createDataFrame([tuple(map(float, x)) for x in q], "w double, x double, y double, z double").coalesce(1)
    at = [F.col(c) for c in "wxyz"]
    got = df.select(geometry.orientation_hue(at, F.lit(False)).alias("c"), geometry.orientation_hue(at, F.lit(True)).alias("h")).collect()
    assert np.allclose([r["c"] for r in got], [0, 1 / 3, 2 / 3], atol=1e-6) and np.allclose([r["h"] for r in got][:2], [0, 0.5])


def test_shear_of_a_strained_crystal(spark):
    p = np.array(crystal(FCC, 4.05, 4)) if not isinstance(crystal(FCC, 4.05, 4), tuple) else np.array(crystal(FCC, 4.05, 4)[0])
    stretch = np.array([1.02, 1.0, 1.0])
    box = Box((0, 0, 0), tuple(4 * 4.05 * stretch))
    r = run_tool("ptm", table(spark, [(p * stretch).tolist()]), Context(box=box), {"quantity": "shear"})
    still = run_tool("ptm", table(spark, [p.tolist()]), Context(box=Box((0, 0, 0), (4 * 4.05,) * 3)), {"quantity": "shear"})
    e = (1.02**2 - 1) / 2 / np.sqrt(3)
    values = [x["value"] for x in r.field.collect()]
    assert abs(np.mean(values) / e - 1) < 0.05 and max(x["value"] for x in still.field.collect()) < 1e-6


def test_jobs(spark):
    rows = [("a", "running", "1998-08-02 11:59:30", 0.004, None, None, ["x", " 5 300 "]), ("b", "failed", "1998-08-01 01:00:00", 1.5, 3700, "pod_lost", None), ("c", "done", None, None, None, "odd", None), ("d", "lost", "1997-01-02 00:00:00", 0.0, 59, None, None)]
    df = spark.createDataFrame(rows, "id string, state string, created string, cost_usd double, billed_s long, error string, thermo_tail array<string>")
    got = {r["id"]: r for r in jobs.job_rows(df, F.lit("1998-08-02 12:00:00").cast("timestamp")).collect()}
    assert [got[k]["title"] for k in "abcd"] == ["Today", "Yesterday", "Undated", "Jan 2, 1997"] and [got[k]["elapsed"] for k in "abcd"] == ["30s", "1h 1m", "—", "59s"]
    assert [got[k]["cost"] for k in "abcd"] == ["$0.0040", "$1.50", "$0", "$0"] and got["a"]["detail"] == "5 300" and "not billed" in got["b"]["detail"] and got["c"]["detail"] == "odd" and got["d"]["tint"] == "failed"
    assert got["b"]["summary"] == "b: failed  $1.5000 (3700 s billed)  error: pod_lost" and jobs.should_poll(jobs.job_rows(df, F.lit(None).cast("timestamp"))) and not jobs.should_poll(jobs.job_rows(df.limit(0), F.current_timestamp()))


def frames_text(n):
    return "".join(f"2\nf\nAl 0 0 {k}\nO 1 0 {k}\n" for k in range(n))


def test_growing_file_and_commands(spark, tmp_path, capsys):
    from moteflow import cli

    path, kept = tmp_path / "run.xyz", str(tmp_path / "table")
    path.write_text(frames_text(2) + "2\nf\nAl 0 0 9\n")
    assert append_new_frames(spark, str(path), kept) == 2 and append_new_frames(spark, str(path), kept) == 0
    path.write_text(frames_text(6))
    assert append_new_frames(spark, str(path), kept) == 4
    assert [(r[0], r[1]) for r in spark.read.parquet(kept).groupBy("frame").count().orderBy("frame").collect()] == [(k, 2) for k in range(6)]
    a, _ = read_trajectory(spark, str(path))
    assert sorted({r["frame"] for r in decimated(a, 3).collect()}) == [0, 3, 5]
    with pytest.raises(ValueError):
        decimated(a, 1)
    for k, args in enumerate((["export", str(path)], ["export", str(path), "--frame", "first", "--charges"], ["decimate", str(path), "2"])):
        out = str(tmp_path / f"out{k}")
        assert cli.main([*args, "-o", out]) == 0
        back, _ = read_trajectory(spark, out)
        assert sorted(r["z"] for r in back.where("element = 'Al'").collect()) == [[5.0], [0.0], [0.0, 2.0, 4.0, 5.0]][k]
    with pytest.raises(ValueError):
        cli.main(["export", str(path), "--frame", "9", "-o", str(tmp_path / "no")])


def test_colour_maps_and_palettes(spark):
    from moteflow.plans import views

    rows = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    at = lambda name, lo=0.0, hi=1.0: [tuple(round(x, 6) for x in r["c"]) for r in rows.select(views.color(F.col("v"), lo, hi, name).alias("c")).collect()]
    grey = (0.5, 0.5, 0.5)
    assert at("coolwarm") == [(0.23, 0.299, 0.754), (0.867, 0.867, 0.867), (0.706, 0.016, 0.15), (0.706, 0.016, 0.15), grey, grey, grey]
    assert at("grey")[:3] == [(0.1,) * 3, (0.525,) * 3, (0.95,) * 3] and at("inferno")[0] == (0.001, 0.0, 0.014) and at("unknown") == at("viridis")
    assert at("grey", 1.0, 1.0)[:2] == [(0.525,) * 3] * 2
    entries = [("a", (0.1, 0.2, 0.3)), ("b", (0.4, 0.5, 0.6))]
    got = [tuple(r["c"]) for r in spark.createDataFrame([(-3.0,), (0.4,), (0.6,), (9.0,)], "v double").select(views.category_color(F.col("v"), entries).alias("c")).collect()]
    assert got == [entries[k][1] for k in (0, 0, 1, 1)]
    assert views.palette({"kind": "continuous", "min": 0, "max": 2}) == {"kind": "continuous", "min": 0.0, "max": 2.0, "map": "viridis"}
    assert views.palette({"kind": "categorical", "entries": entries})["entries"][1] == ["b", [0.4, 0.5, 0.6]]
    with pytest.raises(ValueError):
        views.palette({"kind": "striped"})


def test_largest_trajectory(spark, tmp_path):
    from moteflow.sources.frame_index import largest_trajectory

    (tmp_path / "sub").mkdir()
    for name, n in (("a.xyz", 3), ("sub/b.dump", 9), ("c.txt", 99)):
        (tmp_path / name).write_text("x" * n)
    assert largest_trajectory(spark, str(tmp_path)).endswith("sub/b.dump")
