"""Following growing trajectories and logs with Structured Streaming; frames and rows are keys, so a batch that runs twice adds nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.trajectories import MARK, NAMES, ROW_SCHEMA, dump_rows, xyz_frames_of


def follow_frames(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of atoms (timestep and file as keys) of dump or XYZ files that appear in a folder; cut frames give nothing."""
    text = spark.readStream.schema("value string").option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).format("text").load(folder).select(F.col("_metadata.file_path").alias("file"), "value")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, value in batch.itertuples(index=False):
                frames = (list(dump_rows(b)) for b in value.split(MARK)[1:]) if MARK in value[:2048] else xyz_frames_of(value)
                for block, rows in enumerate(frames):
                    if rows:
                        yield pd.DataFrame([[{**r, "file": file, "start": 0, "block": block}.get(c) for c in NAMES] for r in rows], columns=NAMES)

    return text.mapInPandas(parse, ROW_SCHEMA)


def write_frames(stream: DataFrame, table: str, checkpoint: str):  # noqa: ANN201
    """Starts the stream into Parquet, each file's atoms once; returns the running query."""
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_log(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of thermo lines (file, line's words) of logs that appear in a folder."""
    lines = spark.readStream.schema("value string").format("text").load(folder).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines.where(F.trim("value").rlike(r"^[0-9]+(\s+[-+0-9.eE]+){2,}$")).select("file", F.split(F.trim("value"), r"\s+").alias("words"))


def tail(rows: DataFrame, order: str, by: list[str], n: int = 10) -> DataFrame:
    """The last n rows of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def running_displacement(stream: DataFrame, lengths: tuple[float, float, float]) -> DataFrame:
    """Unwrapped displacement of each atom over a stream of (atom, frame, x, y, z): state is the last place and the sum so far."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("frame")
        out = []
        for r in rows.itertuples(index=False):
            here = [float(r.x), float(r.y), float(r.z)]
            if last is None:
                last = [int(r.frame), *here, 0.0, 0.0, 0.0]
            elif r.frame > last[0]:
                for k in range(3):
                    d = here[k] - last[1 + k]
                    if lengths[k] > 0:
                        q = d / lengths[k]
                        d -= lengths[k] * (int(abs(q) + 0.5) * (1 if q >= 0 else -1))
                    last[4 + k] += d
                last[0:4] = [int(r.frame), *here]
            else:
                continue
            out.append((key[0], int(r.frame), *last[4:7]))
        state.update(tuple(last))
        yield pd.DataFrame(out, columns=["atom", "frame", "ux", "uy", "uz"])

    return stream.groupBy("atom").applyInPandasWithState(step, "atom int, frame int, ux double, uy double, uz double", "frame int, x double, y double, z double, ux double, uy double, uz double", "append", GroupStateTimeout.NoTimeout)
