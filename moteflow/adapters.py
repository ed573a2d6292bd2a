"""The driver's tables seen as trajectories, logs and result tables; the SQL beside each view says the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.scan import numbered_rows
from .schema import Box

N_FRAMES = 21
BOX = Box((-0.6, -0.6, -0.6), (0.6, 0.6, 0.6))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: 63 of 64 numbers are 21 frames of x, y, z, the last is the charge; the label names the element."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = e.select(F.explode(F.sequence(F.lit(0), F.lit(N_FRAMES - 1))).alias("frame"), F.col("vec_id").cast("int").alias("atom"), "vec_id", "label", "embedding")
    at = lambda k: F.get("embedding", F.col("frame") * 3 + k).cast("double")
    return rows.select("frame", "atom", F.col("vec_id").alias("id"), F.concat(F.lit("E"), F.col("label")).alias("element"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), F.get("embedding", F.lit(63)).cast("double").alias("charge"), "label")


ATOMS_SQL = """atoms AS (SELECT CAST(f.frame AS INTEGER) AS frame, CAST(vec_id AS INTEGER) AS atom, vec_id AS id, 'E' || label AS element,
  CAST(embedding[3 * f.frame + 1] AS DOUBLE) AS x, CAST(embedding[3 * f.frame + 2] AS DOUBLE) AS y, CAST(embedding[3 * f.frame + 3] AS DOUBLE) AS z,
  CAST(embedding[64] AS DOUBLE) AS charge, label FROM embeddings, (SELECT unnest(range(0, 21)) AS frame) f)"""


def species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """atoms() with symbols that the tables of masses and radii know."""
    return atoms(spark, sf_dir).withColumn("element", F.element_at(F.array(F.lit("Fe"), F.lit("O"), F.lit("Al")), (F.col("label") % 3 + 1).cast("int")))


SPECIES_SQL = f"""{ATOMS_SQL},
sp AS (SELECT * REPLACE (CASE label % 3 WHEN 0 THEN 'Fe' WHEN 1 THEN 'O' ELSE 'Al' END AS element), CASE label % 3 WHEN 0 THEN 55.845 WHEN 1 THEN 15.999 ELSE 26.982 END AS m, CASE label % 3 WHEN 0 THEN 1.32 WHEN 1 THEN 0.66 ELSE 1.21 END AS radius FROM atoms)"""


def thermo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a block for each type, rows by event_id, and k from the JSON properties."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.col("event_type").alias("block"), F.col("event_id").alias("step"), F.col("value").alias("press"), F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    return numbered_rows(rows, "row", ["block"], ["step"]).select("block", "row", "step", "press", "k")


THERMO_SQL = """thermo AS (SELECT event_type AS block, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS row, event_id AS step, value AS press,
  TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"""


def force_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as force curves: a pull for each user, rows by time; time in seconds, force the value, contacts id modulo 3."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("seed"), (F.row_number().over(w) - 1).cast("long").alias("row"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("force"), (F.col("event_id") % 3).alias("contacts"))


FORCE_SQL = """force AS (SELECT user_id AS seed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row, epoch_us(ts) AS us, value AS force,
  event_id % 3 AS contacts FROM events)"""


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as dissociation times: eight seeds, censored where the order is open."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select((F.col("o_custkey") % 8).alias("seed"), F.col("o_orderkey").alias("replica"), F.col("o_totalprice").alias("t"), (F.col("o_orderstatus") == "O").alias("censored"))


REPLICAS_SQL = "replicas AS (SELECT o_custkey % 8 AS seed, o_orderkey AS replica, o_totalprice AS t, o_orderstatus = 'O' AS censored FROM orders)"


def slab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as one frame of a slab: element from the return flag, height from quantity and discount, charge the tax."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.select(F.col("l_returnflag").alias("element"), (F.col("l_quantity") + F.col("l_discount")).alias("z"), F.col("l_tax").alias("charge"), F.col("l_extendedprice").alias("x"))


SLAB_SQL = "slab AS (SELECT l_returnflag AS element, l_quantity + l_discount AS z, l_tax AS charge, l_extendedprice AS x FROM lineitem)"
