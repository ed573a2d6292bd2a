import time

import pytest
from lattices import table
from pyspark.sql import functions as F

from moteflow.plans.registry_queries import ORACLES, QUERIES
from moteflow.schema import Box
from moteflow.sources import sinks, tables
from moteflow.sources import trajectories as T
from moteflow.streaming import follow

DUMP = """ITEM: TIMESTEP
100
ITEM: NUMBER OF ATOMS
3
ITEM: BOX BOUNDS pp pp ff
-5 15
0 10
0 40
ITEM: ATOMS id type x y z q c_pe
3 1 3.0 0 0 -1.5 0.3
1 1 1.0 0 0 0.5 0.1
2 2 2.0 0 0 0.5 0.2
"""


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\r"])
def test_dump(spark, tmp_path, newline):
    p = tmp_path / "a.dump"
    cut = DUMP.replace("100", "200", 1) + "ITEM: TIMESTEP\n300\nITEM: NUMBER OF ATOMS\n9\nITEM: BOX BOUNDS pp pp pp\n0 1\n0 1\n0 1\nITEM: ATOMS id x y z\n1 0 0 0\n"
    p.write_text((DUMP + cut).replace("\n", newline), newline="")
    atoms, frames = T.read_trajectory(spark, str(p))
    rows = atoms.orderBy("frame", "atom").collect()
    assert [r["id"] for r in rows] == [1, 2, 3] * 2 and rows[2]["charge"] == -1.5 and rows[0]["element"] == "1"
    assert abs(rows[0]["columns"]["c_pe"] - 0.1) < 1e-6 and "q" in rows[0]["columns"]
    f = frames.orderBy("frame").collect()
    assert [r["timestep"] for r in f] == [100, 200] and f[0]["lo_x"] == -5 and f[0]["per_x"] and not f[0]["per_z"]
    assert T.map_elements(atoms, ["Fe", "O"]).select("element").distinct().count() == 2


def test_dump_scaled_tilted_and_bad_blocks():
    block = "\n7\nITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS xy xz yz pp pp pp\n-5 15 1.5\n0 10 0\n0 40 0\nITEM: ATOMS id element xs ys zs\n1 O 0.5 0.25 1.0\n"
    (r,) = T.dump_rows(block)
    assert (r["x"], r["y"], r["z"], r["element"], r["tilt_xy"]) == (5.0, 2.5, 40.0, "O", 1.5)
    assert list(T.dump_rows("\nx\nITEM: NUMBER OF ATOMS\n1\n")) == [] and list(T.dump_rows(block.replace(" xs ys zs", " a b c"))) == []
    assert list(T.dump_rows(block.replace("0.5 0.25", "nan 0.25"))) == []


XYZ = '2\nLattice="10 0 0 1 12 0 0 0 14" Properties=species:S:1:pos:R:3:charge:R:1:resname:S:1:vel:R:3 pbc="T T F"\nO 0 0 0 -1.5 WAT 1 2 3\nH 0 0 1 0.5 WAT 1 2 3\n'


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\r"])
def test_xyz(spark, tmp_path, newline):
    p = tmp_path / "a.xyz"
    p.write_text((XYZ + "junk\n" + XYZ + "2\ncut\nO 0 0 0\n").replace("\n", newline), newline="")
    atoms, frames = T.read_trajectory(spark, str(p))
    r = atoms.where("frame = 1").orderBy("atom").collect()
    assert len(r) == 2 and r[0]["labels"]["resname"] == "WAT" and r[0]["columns"]["vel_z"] == 3 and r[0]["charge"] == -1.5
    f = frames.where("frame = 0").first()
    assert (f["hi_x"], f["hi_z"], f["per_z"], f["tilt_xy"]) == (10, 14, False, 1) and frames.count() == 2
    assert T.read_xyz(spark, str(p), "first").select("frame").distinct().count() == 1
    assert T.dump_fields(spark, str(p)) is None


def test_a_frame_one_row_short_is_left_out():
    assert list(T.xyz_frames_of("2\nc\nO 0 0 0\n")) == [] and len(list(T.xyz_frames_of("2\nc\nO 0 0 0\nO 0 0 x\n"))) == 1


def test_writers_round_trip(spark, tmp_path):
    a = table(spark, [[(0.125, 1, 2), (3, 4, 5)], [(1, 1, 1), (2, 2, 2)]], element=["O", "H"])
    sinks.write_dump(a, str(tmp_path / "d"), Box((0, 0, 0), (9, 9, 9)))
    sinks.write_xyz(a, str(tmp_path / "x"), charges=True)
    for back in (T.read_dump(spark, str(tmp_path / "d")), T.read_xyz(spark, str(tmp_path / "x"))):
        got = [(r["frame"], r["element"], r["x"]) for r in back.orderBy("frame", "atom").collect()]
        assert got == [(0, "O", 0.125), (0, "H", 3.0), (1, "O", 1.0), (1, "H", 2.0)]


def test_reports(tmp_path):
    import zipfile

    assert sinks.quoted('a"b,c') == '"a""b,c"' and sinks.sheet_name("a:b/c" * 20) == ("abc" * 20)[:31]
    sinks.write_xlsx(str(tmp_path / "r.xlsx"), {"Summary": [["a", "1.5"], ["<&", None]]})
    assert b"<v>1.5</v>" in zipfile.ZipFile(tmp_path / "r.xlsx").read("xl/worksheets/sheet1.xml")


def test_side_file_places(tmp_path):
    (tmp_path / "results_1").mkdir()
    (tmp_path / "results_1" / "force_curve.csv").write_text("x")
    t = tmp_path / "a.xyz"
    assert tables.locate(str(t), ["force_curve.csv"]).endswith("results_1/force_curve.csv")
    assert tables.locate(str(tmp_path / "results_1" / "a.xyz"), ["none"]) is None
    for n in ("old.log", "new.log"):
        (tmp_path / n).write_text("x")
        time.sleep(0.02)
    assert tables.locate_log(str(t)).endswith("new.log")


def test_energy_tables(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("frame,time_ps,dG_bind_kJ_mol\n0,0,-50\n1,1,-40\n2,2,nan\n")
    r = tables.read_mmgbsa(spark, str(p)).agg(F.avg("dg"), F.stddev_samp("dg")).first()
    assert r[0] == -45 and abs(r[1] - 7.0710678) < 1e-6
    with pytest.raises(ValueError):
        tables.read_interaction_energy(spark, str(p))


def test_following_adds_each_file_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.dump").write_text(DUMP)
    follow.write_frames(follow.follow_frames(spark, src), out, ck).awaitTermination()
    (tmp_path / "in" / "2.xyz").write_text(XYZ + "3\ncut\n")
    follow.write_frames(follow.follow_frames(spark, src), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 5


def test_registry_names_match():
    import __spark_entry__ as e

    assert set(ORACLES) <= set(QUERIES) <= set(e.queries()) and len(QUERIES) >= 60


def test_a_frame_is_parsed_in_batches(monkeypatch):
    body = ["3 Fe 1.5 2 3 0.5 7", "1 O 1_0 2e1 .5 x 8", "", "2 H nan 0 0 0 9", "x Al 4abc 5 6 nan 1", "1 C 7 8 9 -1 2", "9 N 1 2", "6 S 1 2 3 4 inf"]
    block = "\n5\nITEM: NUMBER OF ATOMS\n7\nITEM: ATOMS id element x y z q c_1\n" + "\n".join(body) + "\nleft over"
    want = [(1, "O", 1.0, 20.0, 0.5, None, 8.0), (1, "C", 7.0, 8.0, 9.0, -1.0, 2.0), (3, "Fe", 1.5, 2.0, 3.0, 0.5, 7.0), (4, "Al", 4.0, 5.0, 6.0, None, 1.0), (6, "S", 1.0, 2.0, 3.0, 4.0, float("inf"))]
    for batch in (1, 2, 3, 100):
        monkeypatch.setattr(T, "BATCH", batch)
        tables = list(T.dump_frame(block))
        assert max(len(t) for t in tables) <= batch and len(tables) == -(-5 // batch)
        got = list(T.dump_rows(block))
        assert [(r["id"], r["element"], r["x"], r["y"], r["z"], r["charge"], r["columns"]["c_1"]) for r in got] == want
        assert [(r["pos"], r["n_atoms"], r["timestep"]) for r in got] == [(k, 5, 5) for k in range(5)]
        assert list(T.dump_rows(block.replace("\n7\n", "\n9\n"))) == [] and list(T.dump_rows(block.replace(" inf", ""))) == []


def test_frames_go_to_many_tasks(spark):
    from moteflow.sources.frame_index import dealt

    frames = dealt(spark.range(21), "id").mapInPandas(lambda batches: batches, "id long")
    assert frames.rdd.getNumPartitions() >= 8  # adaptive execution would make one of them
    assert sorted(r["id"] for r in frames.collect()) == list(range(21))


def test_a_written_frame_is_many_rows(spark, tmp_path):
    from moteflow.schema import Box
    from moteflow.sources import sinks

    atoms = spark.createDataFrame([(f, i, 9 - i, "Fe", float(i), 0.0, 1.0, None) for f in (1, 0) for i in (2, 0, 1)], "frame int, atom int, id long, element string, x double, y double, z double, charge double")
    sinks.write_dump(atoms, str(tmp_path / "d"), Box((0.0, 0.0, 0.0), (2.0, 2.0, 2.0)))
    text = "".join(p.read_text() for p in sorted((tmp_path / "d").glob("part-*")))
    head = "ITEM: TIMESTEP\n%d\nITEM: NUMBER OF ATOMS\n3\nITEM: BOX BOUNDS pp pp pp\n" + "0.0 2.0\n" * 3 + "ITEM: ATOMS id element x y z q\n9 Fe 0.0 0.0 1.0 0.0\n8 Fe 1.0 0.0 1.0 0.0\n7 Fe 2.0 0.0 1.0 0.0\n"
    assert text == head % 0 + head % 1
