"""Phrase collocations mined level by level.

Level 1 counts words, level k counts the k-grams both of whose overlapping (k-1)-grams occur often enough; no other k-gram can.
What the next level needs of a level is broadcast as a Bloom filter of fixed size. Its false positives cost rows but change no
result, as every level counts exactly and drops what is rare; so the broadcast is bounded whatever the corpus holds. A batch
counts its own grams before Spark adds the counts up, so a hot word is one row a batch. Scores are joins with the level tables,
which lie in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ending, own_columns, slices, stored
from .words import byte_classes, words_of

CLASSES = byte_classes(blanks=b" \t", pieces=b".,;:!?\n\x0b\x0c\r")
FILTER_BITS = 1 << 26  # 8 MB in the driver and in each worker
FILTER_HASHES = 3
SALT = 32
PART_BYTES = 4 << 20  # of text that are counted at a time
COUNTS = "lang string, phrase string, n long"


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _hashes(values: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(v) for v in values.cast(pa.binary()).to_pylist()), np.uint64, len(values))


def _bits(h: np.ndarray) -> np.ndarray:
    """hash function x gram: the filter's bits."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(j) * step) % np.uint64(FILTER_BITS) for j in range(FILTER_HASHES)]).astype(np.int64)


def _holds(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bits = _bits(h)
    return ((bitmap[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1).all(axis=0)


def grams(batch: pa.RecordBatch, level: int, filters: list[np.ndarray]) -> pa.RecordBatch:
    """lang, phrase and n of the k-grams of one batch of (lang, text), k being the level; level 1 adds each lang's word count as the empty phrase's."""
    langs = pc.fill_null(batch.column(0), "und").dictionary_encode()
    words, doc, piece = words_of(batch.column(1), CLASSES)
    lang_of = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
    coded = words.dictionary_encode()
    ids, known, m = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, max(1, len(coded.dictionary))
    code, n_at = lang_of * m + ids, np.arange(len(ids))
    if level == 1:
        found, n = np.unique(code, return_counts=True)
        total = np.bincount(lang_of, minlength=len(langs.dictionary))
        lang = pa.concat_arrays([langs.dictionary.take(pa.array(found // m)), langs.dictionary])
        phrase = pa.concat_arrays([known.take(pa.array(found % m)), pa.array([""] * len(total), pa.string())])
        return pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.append(n, total), pa.int64())], ["lang", "phrase", "n"])
    word_hash, lang_hash = _hashes(known), _hashes(langs.dictionary)
    follows = np.zeros(len(ids), bool)
    follows[:-1] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
    at = n_at
    for k in range(1, level + 1):
        # at: where a k-gram may start; code: its number there
        _, first, inverse, n = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        heads = at[first]
        if k == level:
            break
        h = lang_hash[lang_of[heads]] if len(heads) else np.zeros(0, np.uint64)
        for o in range(k):
            h = _mixed(h, word_hash[ids[heads + o]])
        often = _holds(filters[k - 1], h)[inverse] if len(heads) else np.zeros(0, bool)
        number = np.full(len(ids) + 1, -1)
        number[at[often]] = inverse[often]
        both = (number[:-1] >= 0) & (number[1:] >= 0) & follows
        at = np.flatnonzero(both)
        code = number[at] * (len(heads) + 1) + number[at + 1]
    parts = [known.take(pa.array(ids[heads + o])) for o in range(level)]
    phrase = pc.binary_join_element_wise(*parts, " ") if len(heads) else pa.array([], pa.string())
    return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang_of[heads])), phrase, pa.array(n, pa.int64())], ["lang", "phrase", "n"])


def _filter(spark: SparkSession, level: DataFrame, k: int) -> np.ndarray:
    """The Bloom filter of a level's phrases: FILTER_BITS bits, whatever the level's size."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                words = _hashes(pc.list_flatten(pc.split_pattern(b.column(1), " "))).reshape(-1, k)
                h = _hashes(b.column(0))
                for o in range(k):
                    h = _mixed(h, words[:, o])
                yield pa.RecordBatch.from_arrays([pa.array(_bits(h).ravel() + 1)], ["v"])

    rows = level.select("lang", "phrase").mapInArrow(lambda b: ending(bits(b)), "v long").groupBy(F.expr("bitmap_bucket_number(v)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(v))").alias("m"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for b, m in rows.toLocalIterator():
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(bytes(m), np.uint8)
    return out


def level_tables(docs: DataFrame, max_words: int, least: int) -> list[DataFrame]:
    """lang, phrase and n of all phrases of 1, 2, ... max_words words that occur at least so often; the first also has the empty phrase, which occurs as often as words."""
    spark = docs.sparkSession
    texts = own_columns(docs, "lang", "text")
    tables: list[DataFrame] = []
    filters: list = []
    for k in range(1, max_words + 1):
        if k > 1:
            filters.append(spark.sparkContext.broadcast(_filter(spark, tables[-1].where(F.col("phrase") != ""), k - 1)))

        def count(batches: Iterator[pa.RecordBatch], k: int = k, filters: list = list(filters)) -> Iterator[pa.RecordBatch]:  # noqa: B006
            held = [f.value for f in filters]
            whole = (grams(part, k, held) for b in batches for part in slices(b, text=1, rows=4096, most=PART_BYTES))
            return ending(g.slice(at, 1 << 16) for g in whole for at in range(0, g.num_rows, 1 << 16))

        counted = texts.mapInArrow(count, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        tables.append(stored(counted.where((F.col("n") >= least) | (F.col("phrase") == "")), f"grams-{k}"))
    for f in filters:
        f.unpersist()
    return tables


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, covered: int = 50, most: int = 2000) -> DataFrame:
    """The first phrases of each lang by how much more often they occur than their parts: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to max_words words that occurs a times is scored at each cut into two parts, which occur l and r times, as
    floor(1000000 * a * a / (l * r)), in exact decimals; its lowest score counts, of equal ones that of the shortest first part.
    Phrases whose words lie inside a longer one that occurs at least covered hundredths as often are dropped. most phrases a
    lang stay, by score, then a, both descending, then the phrase's UTF-8 bytes.

    Null texts are empty, a null lang is und, repeated rows count each time, words of any length are whole; an empty table or
    one without frequent phrases gives no row. Other columns are not read.
    """
    tables = level_tables(docs, max_words, least)
    counts = tables[0]
    for t in tables[1:]:
        counts = counts.unionByName(t)
    cuts, inside = None, None
    for k, t in enumerate(tables[1:], 2):
        words = F.split("phrase", " ")
        part = lambda a, n, w=words: F.array_join(F.slice(w, a, n), " ")
        own = t.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.array(*[F.struct(F.lit(c).alias("k"), part(1, c).alias("left"), part(c + 1, k - c).alias("right")) for c in range(1, k)])).alias("c")).select("lang", "phrase", "a", "c.*")
        cuts = own if cuts is None else cuts.unionByName(own)
        for j in range(2, k):
            sub = t.select("lang", F.explode(F.array_distinct(F.array(*[part(i, j) for i in range(1, k - j + 2)]))).alias("phrase"), F.col("n").alias("longer"))
            inside = sub if inside is None else inside.unionByName(sub)
    of = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    score = F.expr("cast((1000000BD * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0))) as long)")
    scored = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("b"))
    if inside is not None:
        longest = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        best = best.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    rows = best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    for keys in (["lang", "salt"], ["lang"]):  # each lang is ranked in parts first
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)
    totals = tables[0].where(F.col("phrase") == "").select("lang", "n")
    return salted.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
ws AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS k, unnest(w) AS p FROM ws
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM ws WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM ws WHERE len(w) > 2),
f AS (SELECT lang, k, p, count(*) AS n FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY ALL),
cand AS (SELECT lang, k, p, n AS a, string_split(p, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
cuts AS (SELECT lang, k, p, a, c, array_to_string(w[1:c], ' ') AS lp, array_to_string(w[c + 1:k], ' ') AS rp FROM cand, (VALUES (1), (2)) v(c) WHERE c < k),
scored AS (SELECT x.lang, x.p, x.a, x.c, l.n AS l, r.n AS r, ((1000000::HUGEINT * x.a * x.a) // (l.n::HUGEINT * r.n))::BIGINT AS score FROM cuts x JOIN f l ON l.lang = x.lang AND l.p = x.lp JOIN f r ON r.lang = x.lang AND r.p = x.rp),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, c) AS rn FROM scored),
longer AS (SELECT lang, s AS p, max(a) AS m FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS s FROM cand WHERE k = 3) GROUP BY ALL),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.p) AS rank FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.p = b.p WHERE b.rn = 1 AND (g.m IS NULL OR 100 * g.m < 50 * b.a))
SELECT ranked.lang, rank, p AS phrase, a, l, r, total.n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
