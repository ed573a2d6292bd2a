"""Where frames lie in trajectory files, by byte: found by many tasks over ranges of bytes, and read back frame by frame.

A range reports how many lines begin in it and which of them may begin a frame: a time step's mark in a dump, a line with a whole
number alone in an XYZ file. Line numbers of ranges add up, and the candidates of a file, about one a frame, are walked from
frame to frame. Atoms are parsed only of the frames that are asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import written
from ..operators.scan import numbered_rows, scanned
from ..schema import ATOMS, FRAMES
from .trajectories import MARK, NAMES, ROW_SCHEMA, _frame, dump_frame, dump_rows, xyz_frames_of

RANGE_BYTES, HEAD_BYTES = 32 << 20, 1 << 16
FRAME_HEAD = re.compile(rb"^[ \t]*(\d{1,18})[ \t\r]*$", re.M)
INDEX = "file string, at long, bytes long, dump boolean, last boolean"


def stored_at(path: str):  # noqa: ANN201
    """The pyarrow file system that holds a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:/"):  # Spark doesn't escape names in paths, so they are no URIs
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def opened(path: str):  # noqa: ANN201
    """A file of any store that has a pyarrow file system, for reads at offsets."""
    files, inner = stored_at(path)
    return files.open_input_file(inner)


def dealt(df: DataFrame, *keys: str | Column) -> DataFrame:
    """df's rows over many tasks: each row stands for much to read, but adaptive execution sees a few bytes and would put all in one task."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def text_of(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def sniffed(head: bytes) -> tuple[bytes, bool]:
    """What ends a file's lines, and whether it is a dump: its first lines name a time step."""
    end = b"\n" if b"\n" in head else b"\r"
    return end, any(line.startswith(MARK.encode()) for line in head.split(end)[:64])


def candidates(data: bytes, end: bytes, dump: bool, begins: bool, upto: int) -> list[tuple[int, int, int]]:
    """(line, byte, n) of lines that may begin a frame and begin before upto: n is a whole number alone on its line, or -1 for a mark."""
    body = data if end == b"\n" else data.replace(b"\r", b"\n")
    found, line, at = [], 0 if begins else -1, 0
    for m in (re.finditer(rb"^" + MARK.encode(), body, re.M) if dump else FRAME_HEAD.finditer(body)):
        if m.start() >= upto:
            break
        if m.start() == 0 and not begins:
            continue
        line += body.count(b"\n", at, m.start())
        at = m.start()
        found.append((line, m.start(), -1 if dump else int(m[1])))
    return found


def scan_ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """file, size, start, dump, lines, found: a row for each range of bytes."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size")).where("size > 0")  # names, no contents
    ranges = dealt(files.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start")), "file", "start")

    def look(batches: Iterator) -> Iterator:
        for b in batches:
            rows = []
            for file, size, start in b.itertuples(index=False):
                with opened(file) as f:
                    end, dump = sniffed(f.read_at(min(size, HEAD_BYTES), 0))
                    stop = min(size, start + range_bytes)
                    begins = start == 0 or f.read_at(1, start - 1) == end
                    data = f.read_at(min(size, stop + 64) - start, start)  # a candidate's line ends soon
                own = data[: stop - start]
                # an empty line after the file's last end of line is none
                lines = own.count(end) + (1 if begins else 0) - (1 if own.endswith(end) else 0)
                rows.append((file, size, start, dump, lines, candidates(data, end, dump, begins, stop - start)))
            yield pd.DataFrame(rows, columns=["file", "size", "start", "dump", "lines", "found"])

    return ranges.mapInPandas(look, "file string, size long, start long, dump boolean, lines long, found array<struct<line:long,at:long,n:long>>")


def frame_places(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file, at, bytes, dump, last of every frame that may be whole: last tells that none follows it in its file.

    An XYZ frame has all its rows; of a dump's frames the rows are counted when it is read.
    """
    ranges = scanned(scan_ranges(spark, path, range_bytes), ["file"], ["start"], upto=("sum", F.col("lines")))
    total = ranges.groupBy("file").agg(F.max("upto").alias("total"))
    found = ranges.select("file", "size", "dump", (F.col("upto") - F.col("lines")).alias("before"), "start", F.explode("found").alias("c"))
    found = found.join(total, "file").select("file", "size", "dump", "total", (F.col("before") + F.col("c.line")).alias("line"), (F.col("start") + F.col("c.at")).alias("at"), "c.n")

    def walk(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("at")
        if t["dump"].iloc[0]:
            at = t["at"].tolist()
        else:
            at, free = [], -1
            for line, place, n, total in t[["line", "at", "n", "total"]].itertuples(index=False):
                if line >= free and n >= 1:
                    if line + 2 + n > total:
                        break
                    at.append(place)
                    free = line + 2 + n
        ends = [*at[1:], int(t["size"].iloc[0])]
        return pd.DataFrame({"file": key[0], "at": at, "bytes": [e - a for a, e in zip(at, ends[: len(at)], strict=True)], "dump": bool(t["dump"].iloc[0]), "last": [k == len(at) - 1 for k in range(len(at))]})

    return found.groupBy("file").applyInPandas(walk, INDEX)  # a row a frame


def parsed(data: bytes, dump: bool) -> list[dict]:
    """The rows of the frame that data begins with; none if it is malformed or cut off."""
    text = text_of(data)
    return list(dump_rows(text[len(MARK) :])) if dump else next(xyz_frames_of(text, True), [])


HEADS = "timestep bigint, n_atoms int, has_box boolean, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double, per_x boolean, per_y boolean, per_z boolean, tilt_xy double, tilt_xz double, tilt_yz double"


def head_of(data: bytes, dump: bool, whole: bool) -> dict | None:
    """Time step, number of atoms and box of a frame from its first bytes; None for a frame that gives no atoms.

    whole: data is all of the frame. Else a dump's frame counts as whole if its head is in order, as another frame follows it.
    """
    if whole or not dump:
        if dump:
            return next(iter(parsed(data, True)), None)
        count, _, rest = text_of(data).replace("\r\n", "\n").replace("\r", "\n").partition("\n")
        row = next((r for r in next(xyz_frames_of(f"1\n{rest.split(chr(10))[0]}\nX 0 0 0\n"), [])), None)
        return row and {**row, "n_atoms": int(count)}
    lines = re.sub(r"\r\n?", "\n", text_of(data)).split("\n")
    k = next((i for i, x in enumerate(lines) if x.startswith("ITEM: ATOMS")), None)
    if k is None:
        return None
    names = lines[k].split()[2:]
    n = next((lines[i + 1].strip() for i, x in enumerate(lines[:k]) if x.startswith("ITEM: NUMBER OF")), "")
    if not n.isdigit():
        return None
    # one made-up atom stands for those of the frame: what dump_rows checks of the head is checked by it
    mock = [*lines[1:k], lines[k], " ".join("0" for _ in names)]
    at = next(i for i, x in enumerate(mock) if x.startswith("ITEM: NUMBER OF"))
    mock[at + 1] = "1" if int(n) > 0 else "0"
    row = next(iter(dump_rows("\n" + "\n".join(mock))), None)
    return row and {**row, "n_atoms": int(n)}


def frame_index(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file, at, bytes, dump, frame and the frames table's columns, a row for each frame, stored.

    Frames are numbered over all files in the order of their names and places. Only heads are read, and each file's last frame,
    which may be cut off. A frame between others whose rows are too few keeps its number and has no atoms.
    """
    places = dealt(frame_places(spark, path, range_bytes), "file", "at")

    def heads(batches: Iterator) -> Iterator:
        names = [c.split()[0] for c in (INDEX + ", " + HEADS).split(", ")]
        for b in batches:
            rows = []
            for file, at, size, dump, last in b.itertuples(index=False):
                with opened(file) as f:
                    whole = bool(dump and last) or size <= 4096
                    head = head_of(f.read_at(size if whole else 4096, at), dump, whole)
                    if head is None and not whole:
                        head = head_of(f.read_at(size, at), dump, True)
                if head is not None:
                    rows.append([file, at, size, dump, last, *[head.get(n) for n in names[5:]]])
            yield pd.DataFrame(rows, columns=names)

    rows = places.mapInPandas(heads, INDEX + ", " + HEADS)
    return written(numbered_rows(rows, "frame", [], ["file", "at"]).withColumn("frame", F.col("frame").cast("int")), "frames")


def frames_of(index: DataFrame) -> DataFrame:
    """The frames table: a count of frames needs no atom parsed."""
    return index.select(*[c.split()[0] for c in FRAMES.split(", ")])


def atoms_of(index: DataFrame) -> DataFrame:
    """The atoms of the index's frames; of an index that is filtered, only the bytes of its frames are read."""
    names = [c.split()[0] for c in ATOMS.split(", ")]

    def read(batches: Iterator) -> Iterator:
        for b in batches:
            for file, at, size, dump, frame in b.itertuples(index=False):
                with opened(file) as f:
                    data = f.read_at(size, at)
                if dump:
                    for t in dump_frame(text_of(data)[len(MARK) :]):
                        yield t.assign(file=file, start=0, block=frame).reindex(columns=NAMES).astype({c: object for c in NAMES if c not in t})
                elif rows := parsed(data, dump):
                    yield _frame([{**r, "file": file, "start": 0, "block": frame} for r in rows])

    places = dealt(index.select("file", "at", "bytes", "dump", "frame"), "file", "at")
    return places.mapInPandas(read, ROW_SCHEMA).withColumn("frame", F.col("block").cast("int")).withColumnRenamed("pos", "atom").select(*names)


def first_and_last(index: DataFrame) -> DataFrame:
    """The index's first and last frame."""
    ends = index.agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    return index.join(ends, (F.col("frame") == F.col("a")) | (F.col("frame") == F.col("b")), "left_semi")


def largest_trajectory(spark: SparkSession, folder: str) -> str | None:
    """The largest traj, lammpstrj, xyz or dump file in the folder or below it; of equals the first by name. No contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    best = files.where(F.lower("path").rlike(r"\.(traj|lammpstrj|xyz|dump)$")).orderBy(F.desc("length"), "path").first()
    return best["path"] if best else None
