"""Exact nearest neighbours by a block matrix join over int8 tiles.

Vectors are quantised to int8 with a scale of their own and the exact length of the quantisation error. Queries and candidates
are dealt into blocks of bounded size by a hash of the row; each pair of blocks is a tile, and only int8 components, scales and
errors travel to it. In a tile one product of the int8 matrices (in float32, where products of up to 1,000 components are exact)
gives the distances of the quantised vectors, and by the triangle inequality each true distance lies within the sum of the two
vectors' errors of it. Pairs whose lower bound is over the query's k-th upper bound go, first within the tile and then over all
tiles; a join fetches the original vectors of the others, which are recomputed in double precision and meet in heaps.
"""

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import own_columns, stored

QUERY_BLOCK, CANDIDATE_BLOCK, SUB_BLOCK = 1024, 8192, 2048
EXACT_PRODUCTS = 1040  # components up to which sums of int8 products stay below 2**24


def quantise(x):  # noqa: ANN001, ANN201
    """int8 values as float32, scales, and the exact length of each vector's quantisation error."""
    import numpy as np

    scale = np.abs(x).max(1) / 127.0
    scale[scale == 0] = 1.0
    q = np.rint(x / scale[:, None])
    error = np.sqrt(np.square(x - q * scale[:, None]).sum(1))
    return q, scale, error + 1e-12 * np.sqrt(np.square(x).sum(1))


def tile_survivors(query_ids, queries, ids, candidates, k):  # noqa: ANN001, ANN201
    """Pairs of a tile that may be among a query's k nearest: positions of both, lower and upper bound of the distance.

    queries and candidates are (int8 values, scales, errors); a query's own id is left out.
    """
    import numpy as np

    qq, qs, qe = queries
    exact = np.float32 if qq.shape[1] <= EXACT_PRODUCTS else np.float64
    q_square, best, found = qs**2 * np.square(qq.astype(np.int32)).sum(1), np.full((len(query_ids), k), np.inf), []
    for at in range(0, len(ids), SUB_BLOCK):
        cq, cs, ce = (x[at : at + SUB_BLOCK] for x in candidates)
        dots = (qq.astype(exact) @ cq.astype(exact).T).astype(np.float64)
        square = q_square[:, None] + (cs**2 * np.square(cq.astype(np.int32)).sum(1))[None, :] - 2 * qs[:, None] * cs[None, :] * dots
        middle, slack = np.sqrt(np.maximum(square, 0)), qe[:, None] + ce[None, :]
        slack = slack + 1e-7 * np.sqrt(q_square)[:, None] + 1e-9 * (1 + middle)  # rounding of the bounds themselves
        own = query_ids[:, None] == ids[None, at : at + SUB_BLOCK]
        upper = np.where(own, np.inf, middle + slack)
        best = np.sort(np.concatenate([best, np.partition(upper, min(k, upper.shape[1]) - 1, axis=1)[:, :k]], 1), 1)[:, :k]
        row, col = np.nonzero((middle - slack <= best[:, -1:]) & ~own)
        found.append((row, col + at, (middle - slack)[row, col], upper[row, col]))
    row, col, lower, upper = (np.concatenate(x) for x in zip(*found, strict=True))
    fine = lower <= best[row, -1]
    return row[fine], col[fine], lower[fine], upper[fine]


def quantised(rows: DataFrame) -> DataFrame:
    """id, v, n and row (a number of the row), with q (int8 components as binary), scale and error."""

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            v = batch.column(1)
            sizes = np.diff(v.offsets.to_numpy())
            flat, q, scale, error = v.flatten().to_numpy(zero_copy_only=False), [b""] * len(sizes), np.zeros(len(sizes)), np.zeros(len(sizes))
            starts = np.cumsum(sizes) - sizes
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                values, scale[at], error[at] = quantise(flat[starts[at][:, None] + np.arange(n)])
                for i, x in zip(at.tolist(), values.astype(np.int8), strict=True):
                    q[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(q, pa.binary()), pa.array(scale), pa.array(error)], ["id", "v", "n", "q", "scale", "error"])

    return rows.select("id", "v", "n").mapInArrow(run, "id long, v array<double>, n int, q binary, scale double, error double").withColumn("row", F.monotonically_increasing_id())


def exact_best(pairs: DataFrame, k: int, held: int = 100_000) -> DataFrame:
    """query_id, vec_id, score from pairs (query_id, vec_id, a, b): distances in double precision, a heap of k for each query.

    Heaps are emptied when so many queries have one, so memory is bounded; the same query may have several.
    """

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        heaps: dict[int, list[tuple[float, int]]] = {}

        def emptied() -> pa.RecordBatch:
            out = [(q, -i, -s) for q, heap in heaps.items() for s, i in heap]
            heaps.clear()
            return pa.record_batch([pa.array([o[x] for o in out], kind) for x, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            square = np.square(a.flatten().to_numpy(zero_copy_only=False) - b.flatten().to_numpy(zero_copy_only=False))
            starts = a.offsets.to_numpy()[:-1] - a.offsets.to_numpy()[0]
            score = np.sqrt(np.add.reduceat(square, starts)) if len(starts) else np.zeros(0)
            for q, i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), score.tolist(), strict=True):
                heap = heaps.setdefault(q, [])
                if len(heap) < k:
                    heapq.heappush(heap, (-s, -i))
                elif (-s, -i) > heap[0]:
                    heapq.heapreplace(heap, (-s, -i))
            if len(heaps) > held:
                yield emptied()
        yield emptied()

    return pairs.select("query_id", "vec_id", "a", "b").mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance in double precision): each query's k nearest candidates.

    Both tables need key and vector; extra columns are not read. Vectors that are null, empty, zero, or hold a null or
    non-finite component, and rows with a null key, take no part, neither do vectors of another length than the query's.
    A row that is repeated exactly is one candidate. Rows with the query's own id are never its neighbours. Ties go to the
    smaller id. Several vectors of one id are candidates each, and as queries share one ranking, where the nearest to any of
    them counts. Where fewer than k candidates exist, all are returned; an empty table gives no rows. Of equal vectors only the
    k + 1 of the smallest ids can be among the nearest k, so only these are compared.
    """

    def usable(df: DataFrame) -> DataFrame:
        rows = own_columns(df, key, vector).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        fine = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        return rows.where(F.coalesce(fine, F.lit(False)) & F.col("v").isNotNull()).dropDuplicates(["id", "v"]).withColumn("n", F.size("v"))

    alike = Window.partitionBy("v").orderBy("id")
    few = usable(vectors).withColumn("r", F.row_number().over(alike)).where(F.col("r") <= k + 1)
    q, c = stored(quantised(usable(queries)), "ann-queries"), stored(quantised(few), "ann-candidates")
    q_blocks, c_blocks = max(1, -(-q.count() // QUERY_BLOCK)), max(1, -(-c.count() // CANDIDATE_BLOCK))
    block = lambda n, of: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias(of)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    small = ["id", "row", "n", "q", "scale", "error"]
    left = q.select(*small, block(q_blocks, "i"), every(c_blocks).alias("j"))
    right = c.select(*small, block(c_blocks, "j"), every(q_blocks).alias("i"))

    def tile(_: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        found = []
        for n in a["n"].unique():  # lengths are alike as a rule
            x, y = a[a["n"] == n], b[b["n"] == n]
            if len(y):
                packed = lambda t: (np.frombuffer(b"".join(t["q"]), np.int8).reshape(len(t), -1), t["scale"].to_numpy(), t["error"].to_numpy())  # noqa: B023, E731
                r, at, lower, upper = tile_survivors(x["id"].to_numpy(), packed(x), y["id"].to_numpy(), packed(y), k)
                found.append(pd.DataFrame({"query_row": x["row"].to_numpy()[r], "row": y["row"].to_numpy()[at], "lower": lower, "upper": upper}))
        return pd.concat(found) if found else pd.DataFrame({"query_row": np.zeros(0, "int64"), "row": np.zeros(0, "int64"), "lower": np.zeros(0), "upper": np.zeros(0)})

    pairs = stored(left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(tile, "query_row long, row long, lower double, upper double"), "ann-pairs")
    nearest_upper = Window.partitionBy("query_row").orderBy("upper")
    bounds = pairs.withColumn("r", F.row_number().over(nearest_upper)).where(F.col("r") <= k).groupBy("query_row").agg(F.when(F.count("*") == k, F.max("upper")).otherwise(float("inf")).alias("most"))
    left_over = pairs.join(bounds, "query_row").where(F.col("lower") <= F.col("most")).select("query_row", "row")
    both = left_over.join(c.select("row", F.col("id").alias("vec_id"), F.col("v").alias("b")), "row").join(q.select(F.col("row").alias("query_row"), F.col("id").alias("query_id"), F.col("v").alias("a")), "query_row")
    best = exact_best(both, k).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB: every query against every candidate.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
