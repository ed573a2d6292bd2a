"""Importance resampling towards a target's distribution of hashed n-grams, with a dictionary of distinct features.

A block is a slice of documents: its distinct features, and how often each document has each of them. Features are counted over
all blocks first; each distinct string is hashed once, buckets are sums over the dictionary, and a bucket's gain goes to its
strings. Gains come back to a block's features by a join on the string, in which a frequent word is one row a block and not one
a document, and from there to documents by the block's counts. The ranking needs no single task: scores are whole numbers of
bounded range, so their histogram says how many rows stand before each.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ending, own_columns, slices, stored
from .words import byte_classes, words_of

BUCKETS = 10_000
CLASSES = byte_classes(words=bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
BLOCK_ROWS, BLOCK_BYTES = 1024, 8 << 20
BLOCKS = "block binary, features array<string>, totals array<long>, ids array<long>, n_words array<long>, entries array<int>, packed binary"


def features_of(texts: pa.Array, longest: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Document and feature of each occurrence, the features, and the words of each document. Features are runs of 1 to longest words."""
    words, doc, _ = words_of(texts, CLASSES)
    runs, docs = [words], [doc]
    for n in range(2, longest + 1):
        inside = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1]) if len(doc) >= n else np.zeros(0, np.int64)
        runs.append(pc.binary_join_element_wise(*[words.take(pa.array(inside + o)) for o in range(n)], " ") if len(inside) else pa.array([], pa.string()))
        docs.append(doc[inside])
    coded = pa.concat_arrays(runs).dictionary_encode()
    return np.concatenate(docs), coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.bincount(doc, minlength=len(texts))


def blocks(docs: DataFrame, longest: int) -> DataFrame:
    """The blocks of docs, written to the shared folder, since their names and borders must not change when a task runs again."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text=1, rows=BLOCK_ROWS, most=BLOCK_BYTES):
                doc, features, ids, n_words = features_of(part.column(1), longest)
                m = max(1, len(features))
                code, n = np.unique(doc * m + ids, return_counts=True)
                entries = np.bincount(code // m, minlength=part.num_rows).astype(np.int32)
                packed = zlib.compress((code % m).astype("<u4").tobytes() + n.astype("<u4").tobytes(), 1)
                cells = [[uuid.uuid4().bytes], [features], [np.bincount(ids, minlength=len(features))], [part.column(0).to_pylist()], [n_words], [entries], [packed]]
                kinds = [pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v.to_pylist() if isinstance(v, pa.Array) else v for v in c], t) for c, t in zip(cells, kinds, strict=True)], [f.split()[0] for f in BLOCKS.split(", ")])

    return stored(own_columns(docs, "doc_id", "text").mapInArrow(lambda b: ending(pack(b)), BLOCKS), "feature-blocks")


def dictionary(packed: DataFrame) -> DataFrame:
    """feature, n and bucket of every distinct feature."""
    each = packed.select(F.explode(F.arrays_zip("features", "totals")).alias("f")).select(F.col("f.features").alias("feature"), F.col("f.totals").alias("n"))
    return each.groupBy("feature").agg(F.sum("n").alias("n")).withColumn("bucket", F.pmod(F.crc32(F.col("feature").cast("binary")), F.lit(BUCKETS)))


def bucket_gains(source: DataFrame, target: DataFrame) -> DataFrame:
    """bucket and gain of every bucket: at most BUCKETS rows."""
    counts = lambda d, name: d.groupBy("bucket").agg(F.sum("n").alias(name))
    both = source.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket")).join(counts(source, "s"), "bucket", "left").join(counts(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    totals = both.agg(F.sum("s").alias("sum_s"), F.sum("t").alias("sum_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("sum_s") + BUCKETS) / ((d("s") + 1) * (d("sum_t") + BUCKETS))
    return both.join(F.broadcast(totals), how="cross").select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # one row beside BUCKETS


def weights(packed: DataFrame, gains: DataFrame) -> DataFrame:
    """doc_id, n_features, n_words and weight: the floored mean gain of a document's features, 0 where it has none."""
    named = packed.select("block", F.posexplode("features").alias("i", "feature"))
    back = named.join(gains.select("feature", "gain"), "feature").groupBy("block").agg(F.collect_list("i").alias("at"), F.collect_list("gain").alias("gain"))
    whole = packed.select("block", "ids", "n_words", "entries", "packed").join(back, "block", "left").drop("block")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, n_words, entries, packed_, at, gain = (batch.column(i)[r] for i in range(6))
                both = np.frombuffer(zlib.decompress(packed_.as_py()), "<u4").astype(np.int64)
                feature, n = both[: len(both) // 2], both[len(both) // 2 :]
                gain_of = np.zeros(len(at) if at.is_valid else 0, np.int64)
                if len(gain_of):
                    gain_of[at.values.to_numpy()] = gain.values.to_numpy()
                ends = np.append(0, np.cumsum(entries.values.to_numpy(), dtype=np.int64))
                sums, times = (np.diff(np.append(0, np.cumsum(x))[ends]) for x in ((gain_of[feature] * n if len(feature) else n), n))
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(times), n_words.values, pa.array(np.where(times > 0, sums // np.maximum(times, 1), 0))], ["doc_id", "n_features", "n_words", "weight"])

    return whole.mapInArrow(lambda b: ending(spread(b)), "doc_id long, n_features long, n_words long, weight long")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """Every row's doc_id, n_features, weight, score and rank; percent of the rows with enough words are drawn and have a rank, from 1.

    score is the weight and a Gumbel number that only the seed and doc_id decide, both in thousandths; the highest are drawn,
    ties to the smaller doc_id. A row without doc_id has no score and is never drawn nor counted among the rows to draw from.
    Null texts have no features, rows that agree in doc_id and text have equal scores and ranks next to each other, texts may
    be of any length, empty tables give no rows, other columns are not read. target needs a column text.
    """
    packed = blocks(docs, longest)
    entries = stored(dictionary(packed), "feature-dictionary")
    goal = dictionary(blocks(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest))
    gains = F.broadcast(bucket_gains(entries, goal))  # at most BUCKETS rows
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0)))
    scored = stored(weights(packed, entries.join(gains, "bucket")).withColumn("score", F.col("weight") + noise), "resampling-scores")
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    ladder = scored.where(able).groupBy("score").agg(F.count("*").alias("m"))  # whole numbers between about plus and minus 200,000
    upto = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    ladder = ladder.select("score", F.sum("m").over(upto).alias("upto"), "m", F.sum("m").over(Window.partitionBy()).alias("total"))
    drawn = F.expr(f"total * {percent} div 100")
    steps = ladder.where(F.col("upto") - F.col("m") < drawn).select("score", (F.col("upto") - F.col("m")).alias("before"), drawn.alias("drawn"))
    tie = Window.partitionBy("score").orderBy("doc_id")
    ranked = scored.where(able).join(steps, "score").withColumn("rank", F.col("before") + F.row_number().over(tie))
    rank = F.when(F.col("rank") <= F.col("drawn"), F.col("rank"))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long")).unionByName(scored.where(able).join(steps, "score", "left_anti").withColumn("rank", F.lit(None).cast("long")))
    out = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*out, rank.alias("rank")).unionByName(rest.select(*out, "rank"))


ORACLE_SQL = r"""
WITH RECURSIVE shifts AS (SELECT i, i AS v, 0 AS n FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n + 1 FROM shifts WHERE n < 8),
tbl AS (SELECT list(v ORDER BY i) AS c FROM shifts WHERE n = 8),
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
goal AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
each AS (SELECT doc_id, unnest(w) AS f FROM words),
uses AS (SELECT doc_id, f, count(*) AS n FROM each GROUP BY ALL),
known AS (SELECT DISTINCT f FROM (SELECT f FROM each UNION ALL SELECT f FROM goal)),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(hex(f)) // 2), lambda i: ('0x' || substr(hex(f), 2 * i + 1, 2))::BIGINT)), lambda x, y: xor(c[(xor(x, y) & 255) + 1], x >> 8)), 4294967295::BIGINT) % 10000 AS b FROM known, tbl),
src AS (SELECT b, count(*) AS s FROM each JOIN hashed USING (f) GROUP BY b),
tgt AS (SELECT b, count(*) AS t FROM goal JOIN hashed USING (f) GROUP BY b),
gain AS (SELECT r.b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM each) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM goal) + 10000))))::BIGINT AS g FROM range(10000) r(b) LEFT JOIN src USING (b) LEFT JOIN tgt USING (b)),
sums AS (SELECT doc_id, sum(n)::BIGINT AS n, sum(n * g)::BIGINT AS total FROM uses JOIN hashed USING (f) JOIN gain USING (b) GROUP BY doc_id),
w AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE total // n - CASE WHEN total % n < 0 THEN 1 ELSE 0 END END AS weight FROM words LEFT JOIN sums USING (doc_id)),
scores AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w),
ranks AS (SELECT *, CASE WHEN n_features >= 20 AND doc_id IS NOT NULL THEN row_number() OVER (PARTITION BY n_features >= 20 AND doc_id IS NOT NULL ORDER BY score DESC, doc_id) END AS rank FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM scores WHERE n_features >= 20 AND doc_id IS NOT NULL) // 100 THEN rank END AS rank FROM ranks
"""
