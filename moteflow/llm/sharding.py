"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets split on another bit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_columns, stored

KEY_BITS = 60  # bits of the key's own hash; further bits tell rows of one key apart
BITS = 2 * KEY_BITS
STEP = 8  # bits that one pass over the sizes looks ahead


def hash60(text: Column) -> Column:
    """The first 60 bits of md5, as a long: any SQL engine gives the same."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(depth: Column | int, h: str = "h", tie: str = "tie") -> Column:
    """The first depth bits as a string of 0 and 1: of the key's hash, then of the row's own."""
    bits = lambda c: F.lpad(F.bin(F.col(c)), KEY_BITS, "0")
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.substring(F.concat(bits(h), bits(tie)), F.lit(1), depth)


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """Leaves of the directory: depth, prefix, shard_bytes, shard_rows; sizes: h, tie, n_bytes, one row a document.

    Each pass sums the still open buckets' rows by prefixes of STEP more bits, and from those sums finds, bit by bit, the
    shallowest prefix that fits. What does not fit within these bits goes to the next pass; a lone row is a leaf however large.
    """
    done, depth, open_buckets = None, 0, None
    while True:
        top = min(BITS, depth + STEP)
        rows = sizes.withColumn("p", prefix(top))
        if open_buckets is not None:
            rows = rows.join(open_buckets.select(F.col("prefix").alias("open")), F.substring("p", 1, depth) == F.col("open"), "left_semi")
        fine = rows.groupBy("p").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n"))
        levels = fine.select(F.explode(F.sequence(F.lit(depth), F.lit(top))).alias("depth"), "p", "n_bytes", "n")
        sums = levels.groupBy("depth", F.expr("substring(p, 1, depth)").alias("prefix")).agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        sums = stored(sums.withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == BITS)), "shard-sums")
        parent = sums.where(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
        fits = sums.where("fits").drop("fits")
        first = fits.where(F.col("depth") == depth)
        if depth:  # the bucket itself was found too large before
            first = first.limit(0)
        below = fits.join(parent, (fits["depth"] == parent["depth"]) & (F.expr("substring(prefix, 1, greatest(length(prefix) - 1, 0))") == parent["above"]), "left_semi")
        leaves = first.unionByName(below)
        done = leaves if done is None else done.unionByName(leaves)
        open_buckets = sums.where(~F.col("fits") & (F.col("depth") == top)).select("prefix")
        depth = top
        if depth == BITS or open_buckets.isEmpty():
            return done


def with_shards(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, shard (its prefix bits), depth, shard_bytes, shard_rows: one row for each row of docs.

    A shard's bytes are the UTF-8 bytes of its texts; no shard is over the limit unless one text alone is. Null texts have 0
    bytes. Null keys hash as the empty text. Rows of one key stay together while they fit; a key that is too large by itself
    splits on bits of the row's own position, so copies and ties spread. An empty table gives no rows. Extra columns are not read.
    """
    rows = own_columns(docs, key, text).select(
        F.col(key),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        hash60(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("h"),
        hash60(F.monotonically_increasing_id().cast("string")).alias("tie"),
    )
    sizes = stored(rows, "shard-sizes")
    leaves = stored(directory(sizes.select("h", "tie", "n_bytes"), limit), "shard-directory")
    depths = [r["depth"] for r in leaves.select("depth").distinct().collect()]  # one for each level of the directory, 121 at most
    if not depths:
        return sizes.select(key, "n_bytes", F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_rows")).limit(0)
    tried = sizes.select(key, "n_bytes", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), prefix(d).alias("prefix")) for d in sorted(depths)])).alias("at"))
    return tried.select(key, "n_bytes", "at.depth", "at.prefix").join(leaves, ["depth", "prefix"]).select(key, "n_bytes", F.col("prefix").alias("shard"), "depth", "shard_bytes", "shard_rows")


def write_shards(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> None:
    """Writes key and text as Parquet folders, one for each shard, named by its bits (bits= for the one shard of depth 0).

    As with_shards(); rows of a key whose shards differ would join ambiguously, so positions are part of the assignment.
    """
    rows = stored(own_columns(docs, key, text).withColumn("tie", F.monotonically_increasing_id()), "shard-rows")
    sizes = rows.select(key, F.struct(key, "tie").alias("row"), text)
    named = sizes.select(F.col("row"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), hash60(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("h"), hash60(F.col("row.tie").cast("string")).alias("tie"))
    leaves = stored(directory(named.select("h", "tie", "n_bytes"), limit), "shard-directory")
    depths = sorted(r["depth"] for r in leaves.select("depth").distinct().collect())
    tried = rows.withColumn("h", hash60(F.coalesce(F.col(key).cast("string"), F.lit("")))).withColumn("tie", hash60(F.col("tie").cast("string")))
    options = F.array(*[F.struct(F.lit(d).alias("depth"), prefix(d).alias("prefix")) for d in depths])
    tried.withColumn("at", F.explode(options)).select(key, text, "at.depth", "at.prefix").join(leaves.select("depth", "prefix"), ["depth", "prefix"]).select(key, text, F.concat(F.lit("s"), "prefix").alias("bits")).repartition("bits").write.partitionBy("bits").parquet(path)


#: DuckDB: the same shards, level by level over all rows.
ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, CAST(COALESCE(strlen(text), 0) AS BIGINT) AS n_bytes,
         lpad(bin(CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)), 60, '0') AS bits
  FROM documents),
l AS (SELECT d.*, g.depth, substr(bits, 1, CAST(g.depth AS INTEGER)) AS prefix FROM d, (SELECT unnest(range(0, 61)) AS depth) g),
s AS (SELECT *, SUM(n_bytes) OVER (PARTITION BY depth, prefix) AS shard_bytes, COUNT(*) OVER (PARTITION BY depth, prefix) AS shard_rows FROM l),
f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY depth) AS r FROM s WHERE shard_bytes <= {limit} OR shard_rows = 1 OR depth = 60)
SELECT doc_id, n_bytes, prefix AS shard, CAST(depth AS INTEGER) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows
FROM f WHERE r = 1
"""
