"""Scratch space and small helpers that the training-data operators share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder name under spark.checkpoint.dir, the folder that driver and executors share.

    Where that setting is absent, a temporary folder becomes the checkpoint folder of a local context, as in tests; on a
    cluster a folder of one machine would lose data, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get()
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB of text or so: two tasks' batches, in the JVM and in Python, must fit beside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2048)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; a clash with extra columns of other names cannot arise after this."""
    return df.select(*[F.col(f"`{n}`") for n in names])


@functools.lru_cache(maxsize=None)
def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch, text: int | None = None, rows: int = 1024, most: int = 8 << 20) -> Iterator:  # noqa: ANN001
    """An Arrow batch in parts of so many rows and, going by its text column, about so many bytes; a longer text is one part."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.arange(1, batch.num_rows + 1)
    bytes_to = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if text is not None else ends * 0
    at = 0
    while at < batch.num_rows:
        before = bytes_to[at - 1] if at else 0
        to = int(min(at + rows, max(at + 1, np.searchsorted(bytes_to, before + most, "right"))))
        yield batch.slice(at, to - at)
        at = to


def release(*caches: Callable[[], None]) -> None:
    """Called when a task ends: workers are used again, and what they keep counts against the executor."""
    import ctypes
    import gc

    import pyarrow as pa

    for clear in caches:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc: its own allocator decides
        pass


def ending(batches: Iterable, *caches: Callable[[], None]) -> Iterator:
    """The batches that a task makes; release(*caches) follows them, also where the task ends early."""
    try:
        yield from batches
    finally:
        release(*caches)


def filesystem(path: str):  # noqa: ANN201
    """The file system of a path or URI, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
