"""Connected components and greedy covers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder name in the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # one machine's folder would lose data on a cluster
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get()
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df through a Parquet table in the shared folder: a loop's lineage ends there."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BLOCK_EDGES = 1 << 18


def local_roots(a, b):  # noqa: ANN001, ANN201
    """The nodes of one block of edges and the smallest node that the block's edges join each with; numpy arrays of numbers or text."""
    import numpy as np

    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = root.copy()
        np.minimum.at(low, root[x], root[y])  # hang roots below smaller ones
        np.minimum.at(low, root[y], root[x])
        while (low[low] != low).any():
            low = low[low]
        new = low[root]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def contracted(edges: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """block, node, root: edges in blocks of near nodes, each node of a block with the smallest node that the block joins it with."""
    kind = dict(edges.dtypes)["a"]

    def solve(batches):  # noqa: ANN001, ANN202
        import uuid as ids

        import numpy as np
        import pyarrow as pa

        held: list = []

        def block():  # noqa: ANN202
            t = pa.Table.from_batches(held)
            a, b = (t.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in (0, 1))
            nodes, roots = local_roots(a, b)
            return pa.RecordBatch.from_arrays([pa.array([ids.uuid4().hex] * len(nodes), pa.string()), pa.array(nodes, t.schema.field(0).type), pa.array(roots, t.schema.field(0).type)], ["block", "node", "root"])

        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) >= block_edges:
                yield block()
                held = []
        if sum(h.num_rows for h in held):
            yield block()

    return written(edges.repartitionByRange("a", "b").sortWithinPartitions("a", "b").mapInArrow(solve, f"block string, node {kind}, root {kind}"), "roots")


def connected_components(nodes: DataFrame, edges: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """node, label for every node: the smallest node that edges (a, b) join it with.

    Blocks of edges are solved by themselves; only nodes that several blocks hold go on, with the roots that they have there.
    What remains is joined in rounds of least labels with pointer jumping. Nodes are whole numbers or texts and not null.
    """
    roots = contracted(edges.select("a", "b").where("a <> b"), block_edges)
    own = roots.groupBy("node").agg(F.min("root").alias("root"), F.count("*").alias("n"))
    crossing = roots.join(own.where("n > 1").select("node"), "node", "left_semi").select(F.col("node").alias("a"), F.col("root").alias("b"))
    joined = min_labels(crossing)
    first = nodes.select("node").distinct().join(own.select("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return first.join(joined.select(F.col("node").alias("root"), "label"), "root", "left").select("node", F.coalesce("label", "root").alias("label"))


def min_labels(edges: DataFrame) -> DataFrame:
    """node, label of every node of the edges (a, b): the smallest that they join it with, in rounds, each written."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while not both.isEmpty():
        low = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        moved = labels.join(low, "node", "left").select("node", "label", F.least("label", F.coalesce("low", "label")).alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        step = written(moved.join(jump, "to").select("node", F.least("to", "further").alias("label"), (F.least("to", "further") < F.col("label")).alias("moved")), "labels")
        labels = step.select("node", "label")
        if step.where("moved").isEmpty():
            break
    return labels


def greedy_cover(distances: list[list[float]], cutoff: float) -> list[int]:
    """Cluster of each item of a small matrix: the item with most neighbours within the cutoff takes them all, and so on."""
    import numpy as np

    d = np.asarray(distances)
    left, cluster, k = np.ones(len(d), bool), np.full(len(d), -1), 0
    while left.any():
        counts = ((d <= cutoff) & left[None, :]).sum(1)
        counts[~left] = -1
        centre = int(counts.argmax())
        took = left & ((d[centre] <= cutoff) | (np.arange(len(d)) == centre))
        cluster[took] = k
        left &= ~took
        k += 1
    return cluster.tolist()


def k_medoids(distances: list[list[float]], k: int, rounds: int = 50) -> tuple[list[int], list[int]]:
    """Medoids and assignment of a small matrix: the most central item first, then the farthest from those chosen."""
    import numpy as np

    d = np.asarray(distances)
    medoids = [int(d.sum(1).argmin())]
    while len(medoids) < min(k, len(d)):
        medoids.append(int(d[:, medoids].min(1).argmax()))
    for _ in range(rounds):
        own = d[:, medoids].argmin(1)
        new = []
        for c, m in enumerate(medoids):
            inside = np.flatnonzero(own == c)
            new.append(int(inside[d[np.ix_(inside, inside)].sum(1).argmin()]) if len(inside) else m)
        if new == medoids:
            break
        medoids = new
    return medoids, d[:, medoids].argmin(1).tolist()
