"""Tar archives, gzipped or not: members are listed from headers, read by offset, extracted and trajectories read from them; folders are packed in ranges of paths."""

from __future__ import annotations

import gzip
import posixpath
import re
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import excluded
from ..operators.graph import shared_folder, written
from ..operators.scan import scanned
from .frame_index import dealt, opened, stored_at
from .trajectories import read_trajectory

BLOCK, READ_BYTES, PART_BYTES, ARCHIVE_BYTES, LIST_ROWS = 512, 1 << 20, 4 << 20, 1 << 30, 10_000
MEMBERS = "archive string, gzipped boolean, path string, target string, kind string, at long, bytes long, error string"


def header(block: bytes) -> tuple[str, str, int]:
    """Path, type and size of a member; a ValueError says what is wrong with its header."""
    field = lambda at, n: block[at : at + n].split(b"\0")[0].decode("utf-8", "replace")
    name, prefix, size, check = field(0, 100), field(345, 155), field(124, 12).strip(), field(148, 8).strip()
    path = (f"{prefix}/{name}" if prefix else name).removeprefix("./")
    if not re.fullmatch("[0-7]+", check) or int(check, 8) != sum(block[:148]) + 8 * 32 + sum(block[156:]):
        raise ValueError("no tar header, or its checksum differs")
    if not re.fullmatch("[0-7]+", size):
        raise ValueError(f"bad size field of {path or '<unnamed>'}")
    return path, chr(block[156]), int(size, 8)


def inside(path: str) -> str | None:
    """A member's path below any root, without dots; None if it leaves the root."""
    clean = posixpath.normpath(path.lstrip("/") or ".")
    return None if clean == ".." or clean.startswith("../") else clean


def body_of(file, gzipped: bool):  # noqa: ANN001, ANN201
    return gzip.GzipFile(fileobj=file) if gzipped else file


def gzip_fault(file) -> str | None:  # noqa: ANN001
    """What is wrong with a gzip stream, read to its end piece by piece: lengths and checksums of all its parts are checked."""
    try:
        body = body_of(file, True)
        while body.read(READ_BYTES):
            pass
    except (EOFError, OSError, zlib.error) as e:
        return f"gzip: {e}"
    return None


def listed(archive: str) -> Iterator[tuple]:
    """Rows of MEMBERS of one archive, header by header; contents are passed over."""
    with opened(archive) as file:
        gzipped = file.read(2) == b"\x1f\x8b"
        file.seek(0)
        row = lambda path, kind, at, n, error: (archive, gzipped, path, path and inside(path), kind, at, n, error)
        if gzipped and (fault := gzip_fault(file)):
            yield row(None, None, None, None, fault)
            return
        file.seek(0)
        body, at = body_of(file, gzipped), 0
        while True:
            body.seek(at)
            block = body.read(BLOCK)
            if len(block) < BLOCK or not any(block):
                return  # two empty blocks end an archive; so does its last byte
            try:
                path, kind, n = header(block)
            except ValueError as e:
                yield row(None, None, at, None, str(e))
                return
            start, at = at + BLOCK, at + BLOCK + n + -n % BLOCK
            kinds = {"0": "file", "\0": "file", "5": "directory"}
            error = None
            if kind not in kinds:
                error = f"type {kind!r} is not read"
            elif inside(path) is None:
                error = "leaves the root"
            elif kind != "5" and n:
                body.seek(start + n - 1)
                error = None if len(body.read(1)) else "cut off"
            yield row(path, kinds.get(kind, "other"), start, n, error)


def members(spark: SparkSession, path: str) -> DataFrame:
    """archive, gzipped, path, target (path without dots), kind (file, directory, other), at, bytes, error: a row for each member of the tar files at path, stored.

    A plain archive is walked from header to header, a gzipped one is one stream that a task reads twice: its checksum comes last, and
    of a broken one nothing is used. at counts bytes of the unpacked archive. Rows with an error are no source of contents: links and
    other special types, paths that leave the root, files that are cut off. A broken archive gives one row with an error; a broken
    header gives one, and what stands behind it isn't found. An empty file holds no members.
    """
    files = dealt(spark.read.format("binaryFile").load(path).where("length > 0").select("path"), "path")

    def walk(batches: Iterator) -> Iterator:
        names, rows = [c.split()[0] for c in MEMBERS.split(", ")], []
        for b in batches:
            for archive in b["path"]:
                for r in listed(archive):
                    rows.append(r)
                    if len(rows) == LIST_ROWS:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return written(files.mapInPandas(walk, MEMBERS), "members")


def in_order(index: DataFrame) -> DataFrame:
    """The index's sound files: those of a plain archive are read by tasks of their own, those of a stream by one task in order."""
    files = index.where("kind = 'file' AND error IS NULL").select("archive", "gzipped", "path", "at", "bytes")
    return dealt(files, "archive", F.when(~F.col("gzipped"), F.col("at"))).sortWithinPartitions("archive", "at")


def pieces(batches: Iterator, part_bytes: int) -> Iterator[tuple[str, str, int, int, int, bytes]]:
    """archive, path, at, bytes, part, data of every member of in_order's rows; an empty file has one empty part."""
    held, file, body = None, None, None
    try:
        for b in batches:
            for archive, gzipped, path, at, n in b[["archive", "gzipped", "path", "at", "bytes"]].itertuples(index=False):
                if archive != held:
                    if file is not None:
                        file.close()
                    held, file = archive, opened(archive)
                    body = body_of(file, gzipped)
                body.seek(at)  # on in a stream, never back
                for part in range(max(1, -(-n // part_bytes))):
                    yield archive, path, at, n, part, body.read(min(part_bytes, n - part * part_bytes))
    finally:
        if file is not None:
            file.close()


def contents(index: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """archive, path, at, part, data: the sound files of members(), each in parts of at most part_bytes numbered from 0."""

    def read(batches: Iterator) -> Iterator:
        rows, held = [], 0
        for archive, path, at, _, part, data in pieces(batches, part_bytes):
            rows.append((archive, path, at, part, data))
            held += len(data)
            if held >= part_bytes or len(rows) == LIST_ROWS:
                yield pd.DataFrame(rows, columns=["archive", "path", "at", "part", "data"])
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["archive", "path", "at", "part", "data"])

    return in_order(index).mapInPandas(read, "archive string, path string, at long, part int, data binary")


def extract(index: DataFrame, folder: str) -> DataFrame:
    """Writes the sound files of members() below folder; archive, path, bytes of those written, stored.

    Of files with one path the last stays, as one reader would leave it: the last archive by name, the last place in it. A file
    appears under its name when it is whole, so that a task may run again.
    """
    sound = index.where("kind = 'file' AND error IS NULL")
    last = sound.groupBy(F.col("target").alias("path")).agg(F.max_by(F.struct("archive", "gzipped", "kind", "at", "bytes", "error"), F.struct("archive", "at")).alias("m")).select("path", "m.*")

    def write(batches: Iterator) -> Iterator:
        out, files, name, partial = None, None, None, None
        for archive, path, _, n, part, data in pieces(batches, PART_BYTES):
            if part == 0:
                files, name = stored_at(f"{folder.rstrip('/')}/{path}")
                files.create_dir(posixpath.dirname(name), recursive=True)
                partial = f"{posixpath.dirname(name)}/_{uuid.uuid4().hex}"
                out = files.open_output_stream(partial)
            out.write(data)
            if (part + 1) * PART_BYTES >= n:
                out.close()
                files.move(partial, name)
                yield pd.DataFrame({"archive": [archive], "path": [path], "bytes": [n]})

    return written(in_order(last).mapInPandas(write, "archive string, path string, bytes long"), "extracted")


def read_archived(spark: SparkSession, path: str, frames: str = "all", names: str = "*") -> tuple[DataFrame, DataFrame]:
    """atoms and frames of the trajectory files in tar archives, extracted to the shared folder; names is a pattern of paths below it."""
    folder = shared_folder(spark, "archived")
    extract(members(spark, path), folder).count()
    return read_trajectory(spark, f"{folder}/{names}", frames)


def files_below(spark: SparkSession, folder: str) -> DataFrame:
    """name (below folder), bytes, mtime of every file below folder, empty ones too, but for hidden ones, whose name or folder begins with a dot; a task lists each folder of the first level."""
    root = folder.rstrip("/")

    def listing(recursive: bool):  # noqa: ANN202
        def look(batches: Iterator) -> Iterator:
            from pyarrow import fs

            files, top = stored_at(root)
            for b in batches:
                for name in b["name"]:
                    found = files.get_file_info(fs.FileSelector(posixpath.join(top, name) if name else top, recursive=recursive))
                    rows = [(posixpath.relpath(i.path, top), i.type == fs.FileType.Directory, i.size, (i.mtime_ns or 0) // 10**9) for i in found]
                    rows = [r for r in rows if not any(part.startswith(".") for part in r[0].split("/"))]
                    yield pd.DataFrame(rows, columns=["name", "folder", "bytes", "mtime"]).astype({"bytes": "Int64"})

        return look

    schema = "name string, folder boolean, bytes long, mtime long"
    top = spark.range(1).select(F.lit("").alias("name")).mapInPandas(listing(False), schema)
    below = dealt(top.where("folder").select("name"), "name").mapInPandas(listing(True), schema)
    return top.unionByName(below).where("NOT folder").select("name", "bytes", "mtime")


def pack(spark: SparkSession, folder: str, out: str, excludes: tuple[str, ...] = (), archive_bytes: int = ARCHIVE_BYTES, gzipped: bool = True) -> DataFrame:
    """Packs the files below folder into tar archives in out, in order of their paths, each of about archive_bytes before compression; archive, files, bytes, stored.

    excludes are globs held against the path and each part of it. The same files give the same bytes. Names of over 100 bytes are
    an error; hidden files stay out; a folder without files gives no archive.
    """
    kept = scanned(files_below(spark, folder).where(~excluded(F.col("name"), excludes)), [], ["name"], upto=("sum", F.col("bytes")))
    parts = kept.withColumn("archive", F.floor((F.col("upto") - F.col("bytes")) / archive_bytes).cast("long")).select("archive", "name", "bytes", "mtime")
    root = folder.rstrip("/")

    def entry(name: str, size: int, mtime: int, folder: bool = False) -> tarfile.TarInfo:
        info = tarfile.TarInfo(f"./{name}")
        if len(info.name.encode()) > 100:
            raise ValueError(f"{name}: a tar header holds 100 bytes of a name")
        info.size, info.mtime, info.mode, info.type = size, mtime, 0o755 if folder else 0o644, tarfile.DIRTYPE if folder else tarfile.REGTYPE
        return info

    def write(number: int, rows: Iterator) -> pd.DataFrame:
        files, name = stored_at(f"{out.rstrip('/')}/part-{number:06d}.tar{'.gz' if gzipped else ''}")
        files.create_dir(posixpath.dirname(name), recursive=True)
        partial, folders, n, total = f"{posixpath.dirname(name)}/_{uuid.uuid4().hex}", set(), 0, 0
        with files.open_output_stream(partial) as raw:
            stream = gzip.GzipFile(filename="", fileobj=raw, mode="wb", compresslevel=6, mtime=0) if gzipped else raw
            with tarfile.open(fileobj=stream, mode="w|", format=tarfile.USTAR_FORMAT) as tar:
                for path, size, mtime in rows:
                    above = path.split("/")[:-1]
                    for k in range(len(above)):
                        if (part := "/".join(above[: k + 1])) not in folders:
                            folders.add(part)
                            tar.addfile(entry(part, 0, mtime, True))
                    with opened(f"{root}/{path}") as f:
                        tar.addfile(entry(path, size, mtime), f)
                    n, total = n + 1, total + size
            if gzipped:
                stream.close()
        files.move(partial, name)
        return pd.DataFrame({"archive": [name], "files": [n], "bytes": [total]})

    def archives(batches: Iterator) -> Iterator:
        rows = (r for b in batches for r in b.itertuples(index=False))
        for number, group in groupby(rows, key=lambda r: r.archive):
            yield write(number, ((r.name, r.bytes, r.mtime) for r in group))

    return written(dealt(parts, "archive").sortWithinPartitions("archive", "name").mapInPandas(archives, "archive string, files long, bytes long"), "packed")
