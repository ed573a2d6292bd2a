"""Frames by byte: what is read, what is found, and files that grow."""

import os

import pytest
from lattices import table
from pyspark.sql import functions as F

from moteflow.operators.boxes import FrameBoxes, boxes_of
from moteflow.sources import frame_index as I
from moteflow.sources import sinks
from moteflow.sources import trajectories as T
from moteflow.streaming.growing import growing


def dump(step, n, size=10.0, cut=0):
    return f"ITEM: TIMESTEP\n{step}\nITEM: NUMBER OF ATOMS\n{n}\nITEM: BOX BOUNDS pp pp ff\n" + f"0 {size}\n" * 3 + "ITEM: ATOMS id element x y z\n" + "".join(f"{i + 1} Fe {step}.5 {i} 0\n" for i in range(n - cut))


def xyz(step, n):
    return f"{n}\nframe {step} 7\n" + "".join(f"O {step}.5 {i} 0\n" for i in range(n))


@pytest.mark.parametrize("range_bytes", [7, 64, 1 << 20])
@pytest.mark.parametrize("newline", ["\n", "\r\n", "\r"])
def test_index_of_ranges_equals_reading_whole(spark, tmp_path, range_bytes, newline):
    texts = {"a.dump": dump(1, 2) + dump(2, 3, 12.0) + dump(5, 4).replace("10.0", "x") + dump(3, 2, cut=1), "b.xyz": "junk\n" + xyz(0, 2) + "12\n"[:0] + "\n" + xyz(1, 1) + xyz(2, 3)[:-11], "c.dump": dump(7, 2), "d.xyz": xyz(9, 2).rstrip("\n")}
    for name, t in texts.items():
        (tmp_path / name).write_text(t.replace("\n", newline), newline="")
    index = I.frame_index(spark, str(tmp_path), range_bytes)
    atoms = I.atoms_of(index).groupBy("frame").agg(F.count("*").alias("n"), F.min("x").alias("x")).orderBy("frame").collect()
    assert [(r["frame"], r["n"], r["x"]) for r in atoms] == [(0, 2, 1.5), (1, 3, 2.5), (2, 4, 5.5), (3, 2, 0.5), (4, 1, 1.5), (5, 2, 7.5), (6, 2, 9.5)]
    frames = I.frames_of(index).orderBy("frame").collect()
    assert [r["n_atoms"] for r in frames] == [2, 3, 4, 2, 1, 2, 2] and [r["timestep"] for r in frames] == [1, 2, 5, None, None, 7, None]
    assert frames[1]["hi_x"] == 12.0 and not frames[1]["per_z"] and not frames[3]["has_box"]


def test_one_frame_reads_one_frames_bytes(spark, tmp_path):
    p = tmp_path / "a.dump"
    p.write_text("".join(dump(k, 50) for k in range(40)))
    index = I.frame_index(spark, str(p), 4096)
    last = index.where("frame = 39")
    assert last.agg(F.sum("bytes")).first()[0] < p.stat().st_size / 39
    # the other frames may be gone from the file by then: only the last one's bytes are asked for
    size = p.stat().st_size
    with open(p, "r+b") as f:
        f.write(b"\0" * (size - last.first()["bytes"]))
    assert I.atoms_of(last).agg(F.min("x")).first()[0] == 39.5
    assert I.frames_of(index).count() == 40
    assert I.atoms_of(I.first_and_last(index)).select("frame").distinct().count() == 1  # the first has been overwritten


def test_an_xyz_file_is_read_by_many_tasks(spark, tmp_path):
    p = tmp_path / "a.xyz"
    p.write_text("".join(xyz(k, 9) for k in range(60)))
    assert I.scan_ranges(spark, str(p), 200).where("size(found) > 0").count() > 10
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        atoms = I.atoms_of(I.frame_index(spark, str(p), 200))
        assert atoms.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert T.read_xyz(spark, str(p), "3-5").select("frame").distinct().orderBy("frame").collect() == [(3,), (4,), (5,)]


def test_empty_folders_and_files(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("")
    (tmp_path / "b.xyz").write_text("no frames\n")
    index = I.frame_index(spark, str(tmp_path))
    assert index.count() == 0 and I.atoms_of(index).count() == 0


def test_boxes_of_each_frame_round_trip(spark, tmp_path):
    a = table(spark, [[(0.125, 1, 2)], [(3, 4, 5)], [(1, 1, 1)]], element="O")
    rows = [(0, 0.0, 0.0, 0.0, 9.0, 9.0, 9.0, True, True, False), (1, -1.0, 0.0, 0.0, 8.0, 7.0, 6.0, True, True, True)]
    box = FrameBoxes(spark.createDataFrame(rows, "frame int, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double, per_x boolean, per_y boolean, per_z boolean"))
    sinks.write_dump(a, str(tmp_path / "d"), box)
    atoms, frames = T.read_trajectory(spark, str(tmp_path / "d"))
    got = [(r["has_box"], r["lo_x"], r["hi_z"], r["per_z"]) for r in frames.orderBy("frame").collect()]
    assert got == [(True, 0.0, 9.0, False), (True, -1.0, 6.0, True), (False, None, None, None)] and atoms.count() == 3
    assert isinstance(boxes_of(frames), FrameBoxes)


def grow(spark, src, out, ck, kind, range_bytes):
    growing(spark, src, kind, range_bytes).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@pytest.mark.parametrize("name,make", [("a.dump", dump), ("a.xyz", xyz)])
def test_a_growing_trajectory_gives_every_frame_once(spark, tmp_path, name, make):
    (tmp_path / "in").mkdir()
    p, out, ck = tmp_path / "in" / name, str(tmp_path / "out"), str(tmp_path / "ck")
    parts = [make(1, 3) + make(2, 3), make(3, 3)[:-25], make(3, 3)[-25:] + make(4, 2), make(5, 1)[:20]]
    want = [[1.5, 2.5], [1.5, 2.5], [1.5, 2.5, 3.5, 4.5], [1.5, 2.5, 3.5, 4.5]]
    for text, xs in zip(parts, want, strict=True):
        with open(p, "a") as f:
            f.write(text)
        rows = grow(spark, str(tmp_path / "in"), out, ck, "frames", 100)
        assert [r["x"] for r in rows.groupBy("x").count().orderBy("x").collect()] == xs
        assert rows.count() == rows.select("file", "start", "block", "pos").distinct().count()
    assert rows.count() == 3 + 3 + 3 + 2


def test_a_growing_log_gives_every_line_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    p, out, ck = tmp_path / "in" / "log", str(tmp_path / "out"), str(tmp_path / "ck")
    said = ""
    for text in ("Step T\n1 2\n", "3 4", " 5\n\n6", "\n" + "x" * 300 + "\nend"):
        said += text
        p.write_text(said)
        got = [r["value"] for r in grow(spark, str(tmp_path / "in"), out, ck, "lines", 16).orderBy("at").collect()]
        assert got == said.split("\n")[:-1]
    assert os.path.getsize(p) == len(said)
