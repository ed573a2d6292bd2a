"""A streaming source of files that grow: its offset is, for each file, the end of the last whole frame or line.

What lies between two offsets is read once, in ranges of bytes; a frame or line belongs to the range that it begins in. What is
cut off at a file's end waits for the rest. To find the end of the last whole frame only a file's last frame is looked at; an
XYZ file, whose frames say where the next begins, is walked from the last offset on.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..sources.frame_index import FRAME_HEAD, HEAD_BYTES, opened, parsed, sniffed
from ..sources.trajectories import MARK, NAMES, ROW_SCHEMA, xyz_frames_of

LINES = "file string, at long, value string"
STEP = 1 << 20


def files_of(path: str) -> list[tuple[str, int]]:
    """The file, or the files of the folder, with their sizes."""
    from pyarrow import fs

    files, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = files.get_file_info(inner)
    found = files.get_file_info(fs.FileSelector(inner)) if info.type == fs.FileType.Directory else [info]
    base = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted((base + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def last_line_end(f, start: int, size: int) -> int:  # noqa: ANN001
    at = size
    while at > start:
        low = max(start, at - STEP)
        k = f.read_at(at - low, low).rfind(b"\n")
        if k >= 0:
            return low + k + 1
        at = low
    return start


def last_dump_end(f, start: int, size: int) -> int:  # noqa: ANN001
    """The end of the last whole frame of a dump: its last mark, or the end if the frame that begins there is whole and its last line ends."""
    at, mark, tail = size, MARK.encode(), b""
    while at > start:
        low = max(start, at - STEP)
        tail = f.read_at(at - low, low) + tail
        k = tail.rfind(mark)
        if k >= 0:
            # more may follow in the last line, and rows that the head promises may be missing
            return size if tail.endswith((b"\n", b"\r")) and parsed(tail[k:], True) else low + k
        at = low
    return start


def last_xyz_end(f, start: int, size: int) -> int:  # noqa: ANN001
    """The end of the last whole frame of an XYZ file, walked from start."""
    held, base, done = f.read_at(min(size - start, STEP), start), start, start
    while True:
        text = held[done - base :]
        m = FRAME_HEAD.search(text)
        while m is None or text.find(b"\n", m.start()) < 0 or not _rows_end(text, m):
            if base + len(held) >= size:
                return done
            held += f.read_at(min(size - base - len(held), STEP), base + len(held))
            text = held[done - base :]
            m = FRAME_HEAD.search(text)
        done += _rows_end(text, m)
        if done - base > STEP:
            held, base = held[done - base :], done


def _rows_end(text: bytes, m: re.Match) -> int:
    """Where the frame ends whose head m is; 0 if text doesn't hold all of it."""
    at = m.start()
    for _ in range(int(m[1]) + 2):
        at = text.find(b"\n", at) + 1
        if not at:
            return 0
    return at


class Part(InputPartition):
    def __init__(self, file: str, start: int, end: int, upto: int):
        self.file, self.start, self.end, self.upto = file, start, end, upto


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.lines = options["path"], options.get("kind", "frames") == "lines"
        self.range_bytes = int(options.get("rangebytes", 32 << 20))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        for file, size in files_of(self.path):
            start = self.known.get(file, 0)
            if size > start:
                with opened(file) as f:
                    dump = not self.lines and sniffed(f.read_at(min(size, HEAD_BYTES), 0))[1]
                    self.known[file] = last_line_end(f, start, size) if self.lines else last_dump_end(f, start, size) if dump else last_xyz_end(f, start, size)
        return {f: n for f, n in self.known.items() if n}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for file, upto in end.items():
            begin = start.get(file, 0)
            if begin < upto:
                with opened(file) as f:
                    cut = self.lines or sniffed(f.read_at(min(upto, HEAD_BYTES), 0))[1]
                step = self.range_bytes if cut else upto - begin  # an XYZ frame's place depends on those before it
                out += [Part(file, a, min(a + step, upto), upto) for a in range(begin, upto, step)]
        return out

    def read(self, p: Part) -> Iterator[tuple]:  # type: ignore[override]
        with opened(p.file) as f:
            if self.lines:
                yield from self._lines(f, p)
                return
            dump = sniffed(f.read_at(min(p.upto, HEAD_BYTES), 0))[1]
            if dump:
                for at, block in self._blocks(f, p):
                    yield from self._rows(p.file, at, parsed(block, True))
            else:
                text = f.read_at(p.end - p.start, p.start).decode("utf-8", "replace")
                for k, rows in enumerate(xyz_frames_of(text)):
                    yield from self._rows(p.file, p.start, rows, k)

    @staticmethod
    def _rows(file: str, at: int, rows: list[dict], block: int = 0) -> Iterator[tuple]:
        for r in rows:
            yield tuple({**r, "file": file, "start": at, "block": block}.get(c) for c in NAMES)

    @staticmethod
    def _lines(f, p: Part) -> Iterator[tuple]:  # noqa: ANN001
        at, held = p.start, b""
        if p.start and f.read_at(1, p.start - 1) != b"\n":  # the line goes on from the range before
            k = -1
            while k < 0 and at < p.end:
                data = f.read_at(min(STEP, p.upto - at), at)
                k = data.find(b"\n")
                at += k + 1 if k >= 0 else len(data)
        while at < p.end:
            held = f.read_at(min(STEP, p.upto - at), at)
            while b"\n" not in held:
                held += f.read_at(min(STEP, p.upto - at - len(held)), at + len(held))
            for line in held[: held.rfind(b"\n")].split(b"\n"):
                if at >= p.end:
                    return
                yield p.file, at, line.decode("utf-8", "replace").rstrip("\r")
                at += len(line) + 1

    @staticmethod
    def _blocks(f, p: Part) -> Iterator[tuple[int, bytes]]:  # noqa: ANN001
        """Place and bytes of each frame whose mark begins in the range."""
        mark = MARK.encode()
        data = f.read_at(min(p.end - p.start + len(mark), p.upto - p.start), p.start)
        starts = [m.start() for m in re.finditer(mark, data) if m.start() < p.end - p.start]
        for a, b in zip(starts, [*starts[1:], None], strict=False):
            if b is None:
                rest = data[a:]
                while p.start + a + len(rest) < p.upto and (k := rest.find(mark, 1)) < 0:
                    rest += f.read_at(min(STEP, p.upto - p.start - a - len(rest)), p.start + a + len(rest))
                k = rest.find(mark, 1)
                yield p.start + a, rest if k < 0 else rest[:k]
            else:
                yield p.start + a, data[a:b]


class GrowingSource(DataSource):
    """format("growing"), options path, kind (frames or lines) and rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "growing"

    def schema(self) -> str:
        return LINES if self.options.get("kind", "frames") == "lines" else ROW_SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return GrowingReader(json.loads(json.dumps(dict(self.options.items()))))


def growing(spark: SparkSession, path: str, kind: str = "frames", range_bytes: int = 32 << 20) -> DataFrame:
    """A stream of the atoms (keys: file and start, the frame's first byte; block counts frames of one XYZ batch) or lines of files that grow."""
    spark.dataSource.register(GrowingSource)
    return spark.readStream.format("growing").option("path", path).option("kind", kind).option("rangeBytes", range_bytes).load()
