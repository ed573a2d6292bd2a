"""Media columns: payloads in ZIP archives, written by Spark's own file writer and read by a Spark data source.

An archive holds deflated members at offsets of their own; after each piece stands one newline byte, the last one being the
archive's comment, so any ZIP reader opens it. The data source cuts each archive into byte ranges; a task reads the central
directory, takes the members whose headers begin in its range, streams them as Arrow batches, and reads a member that fails
its checks again by its offset, apart from the others.
"""

from __future__ import annotations

import struct
import time
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import filesystem, own_columns

LOCAL, CENTRAL, END = struct.Struct("<4s5H3I2H"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s4H2IH")
END64, LOCATOR = struct.Struct("<4sQ2H2I4Q"), struct.Struct("<4sIQI")
U16, U32 = 0xFFFF, 0xFFFFFFFF
WAV_HEAD = struct.Struct("<4sI4s4sIHHIIHH4sIQ4sI")
RATE, UNIT = 8000, 64
TAIL = LOCATOR.size + END.size + U16  # the end records and the longest comment after them


def wav(text: bytes) -> bytes:
    """8-bit mono samples: the text, then zero bytes up to a positive multiple of UNIT; a chunk of its own keeps the text's length."""
    data = text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0")
    return WAV_HEAD.pack(b"RIFF", WAV_HEAD.size - 8 + len(data), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"ulen", 8, len(text), b"data", len(data)) + data


def unwav(media: bytes) -> tuple[int, bytes]:
    """Length of the text and the padded samples."""
    *_, n, _, size = WAV_HEAD.unpack(media[: WAV_HEAD.size])
    return n, media[WAV_HEAD.size : WAV_HEAD.size + size]


class ArchiveWriter:
    """Pieces of one ZIP archive; keeps the central directory only."""

    def __init__(self) -> None:
        self.at, self.central, self.n = 0, bytearray(), 0

    def add(self, name: bytes, data: bytes) -> bytes:
        pack = zlib.compressobj(1, zlib.DEFLATED, -15)
        body = pack.compress(data) + pack.flush()
        crc, wide = zlib.crc32(data), self.at >= U32
        extra = struct.pack("<HHQ", 1, 8, self.at) if wide else b""
        piece = LOCAL.pack(b"PK\3\4", 20, 0x800, 8, 0, 33, crc, len(body), len(data), len(name), 0) + name + body
        self.central += CENTRAL.pack(b"PK\1\2", 45, 45 if wide else 20, 0x800, 8, 0, 33, crc, len(body), len(data), len(name), len(extra), 0, 0, 0, 0, U32 if wide else self.at) + name + extra
        self.at += len(piece) + 1
        self.n += 1
        return piece

    def finish(self) -> bytes:
        n, size, at = self.n, len(self.central), self.at
        out = bytes(self.central)
        if n >= U16 or at >= U32 or size >= U32:
            out += END64.pack(b"PK\6\6", END64.size - 12, 45, 45, 0, 0, n, n, size, at) + LOCATOR.pack(b"PK\6\7", 0, at + size, 1)
        return out + END.pack(b"PK\5\6", 0, 0, min(n, U16), min(n, U16), min(size, U32), min(at, U32), 1)


def write_archives(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """One archive for each input partition, members named by key (null for a null key) in the order of the rows.

    Null texts count as empty; repeated rows and keys are members of their own. No shuffle: a task streams its rows and keeps
    the directory of its archive. Extra columns are not read. An empty table writes no archive.
    """

    def write(batches: Iterable) -> Iterator:
        import pyarrow as pa

        out = None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = out or ArchiveWriter()
                pieces = [out.add(f"{'null' if k is None else k}.wav".encode(), wav((t or "").encode())) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.record_batch([pa.array(pieces, pa.binary())], ["data"])
        if out:
            yield pa.record_batch([pa.array([out.finish()], pa.binary())], ["data"])

    own_columns(docs, key, text).mapInArrow(write, "data binary").select(F.col("data").cast("string").alias("value")).write.text(path, lineSep="\n")


@dataclass
class ByteRange(InputPartition):
    path: str
    size: int
    start: int
    end: int


@dataclass
class Member:
    name: str
    offset: int
    crc: int
    packed: int
    size: int
    method: int


def read_directory(file, size: int) -> list[Member]:  # noqa: ANN001
    """The central directory of an open archive."""
    file.seek(max(0, size - TAIL))
    tail = file.read(min(size, TAIL))
    e = tail.rfind(b"PK\5\6")
    if e < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, n, length, at, _ = END.unpack(tail[e : e + END.size])
    if n == U16 or at == U32 or length == U32:
        _, _, where, _ = LOCATOR.unpack(tail[e - LOCATOR.size : e])
        file.seek(where)
        *_, n, length, at = END64.unpack(file.read(END64.size))
    file.seek(at)
    data, out, p = file.read(length), [], 0
    for _ in range(n):
        _, _, _, _, method, _, _, crc, packed, full, k, x, c, _, _, _, offset = CENTRAL.unpack(data[p : p + CENTRAL.size])
        p += CENTRAL.size
        if offset == U32 and x:
            offset = struct.unpack("<Q", data[p + k + 4 : p + k + 12])[0]
        out.append(Member(data[p : p + k].decode(), offset, crc, packed, full, method))
        p += k + x + c
    return out


def read_member(file, member: Member) -> bytes:  # noqa: ANN001
    file.seek(member.offset)
    head = LOCAL.unpack(file.read(LOCAL.size))
    if head[0] != b"PK\3\4":
        raise ValueError("no member begins here")
    file.seek(member.offset + LOCAL.size + head[9] + head[10])
    body = file.read(member.packed)
    data = zlib.decompress(body, -15) if member.method == 8 else body
    if len(data) != member.size or zlib.crc32(data) != member.crc:
        raise ValueError("the member's checksum differs")
    return data


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangeBytes", 8 << 20))
        self.retries, self.wait_s = int(options.get("retries", 3)), float(options.get("retryWaitSeconds", 0.2))
        self.batch_bytes = int(options.get("batchBytes", 4 << 20))

    def partitions(self) -> list[ByteRange]:
        from pyarrow import fs

        store, path = filesystem(self.path)
        info = store.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        out = []
        for f in files:
            if f.type == fs.FileType.File and f.size > END.size and not f.base_name.startswith(("_", ".")):
                out += [ByteRange(f.path, f.size, at, min(f.size, at + self.range_bytes)) for at in range(0, f.size, self.range_bytes)]
        return out or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator:
        import pyarrow as pa

        if not partition.path:
            return
        store, _ = filesystem(self.path)
        rows: list[tuple] = []
        held = 0
        make = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.string()), strict=True)], ["archive", "offset", "name", "media", "attempts", "error"])
        file = store.open_input_file(partition.path)
        try:
            for m in read_directory(file, partition.size):
                if not partition.start <= m.offset < partition.end:
                    continue
                data = error = None
                for attempt in range(1, self.retries + 1):
                    try:
                        data, error = read_member(file, m), None
                        break
                    except (OSError, ValueError, zlib.error, struct.error) as e:
                        error = f"{type(e).__name__}: {e}"
                        file.close()
                        if attempt < self.retries:
                            time.sleep(self.wait_s * attempt)
                        file = store.open_input_file(partition.path)
                rows.append((partition.path, m.offset, m.name, data, attempt, error))
                held += len(data or b"")
                if held >= self.batch_bytes or len(rows) >= 1000:
                    yield make(rows)
                    rows, held = [], 0
            if rows:
                yield make(rows)
        finally:
            file.close()


class ArchiveSource(DataSource):
    """spark.read.format("archive").load(path): archive, offset, name, media, attempts, error; one row for each member.

    A member that fails all its attempts is a row with a null media and the error; the others are not touched by it.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "archive string, offset long, name string, media binary, attempts int, error string"

    def reader(self, schema) -> ArchiveReader:  # noqa: ANN001
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").options(**options).load(path)


def with_features(media: DataFrame) -> DataFrame:
    """media's columns, and n_bytes, payload and feature; all three null where media is null.

    feature: mean, root mean square about 128, crossings of 128 and the counts of eight equal sample ranges.
    """

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sizes, payloads, features = [], [], []
                for m in part.column("media").to_pylist():
                    n, payload = unwav(m) if m is not None else (None, None)
                    sizes.append(n)
                    payloads.append(payload)
                    if payload is None:
                        features.append(None)
                        continue
                    x = np.frombuffer(payload, np.uint8)
                    counts, values = np.bincount(x, minlength=256), np.arange(256, dtype=np.int64) - 128
                    mean, square = float(counts @ values) / len(x) + 128, float(counts @ (values * values)) / len(x)
                    crossings = int(np.count_nonzero(np.diff(x >= 128)))
                    features.append(f"mean={mean:.4f};rms={square**0.5:.4f};crossings={crossings};bands={','.join(map(str, counts.reshape(8, 32).sum(1).tolist()))}")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes, pa.int64()), pa.array(payloads, pa.binary()), pa.array(features, pa.string())], [*part.schema.names, "n_bytes", "payload", "feature"])

    from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

    return media.mapInArrow(run, StructType([*media.schema.fields, StructField("n_bytes", LongType()), StructField("payload", BinaryType()), StructField("feature", StringType())]))


def digests(features: DataFrame) -> DataFrame:
    """Digest columns of with_features(read_archives(...))."""
    return features.select(
        F.expr("try_cast(substring_index(name, '.', 1) as long)").alias("doc_id"),
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
