"""Alignments of frames with rows of side tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import scanned


def nearest(left: DataFrame, right: DataFrame, left_at: str, right_at: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """Each row of left with the row of right nearest to it, the smaller tie on equal distance. No pair of tables is crossed.

    Both sides are merged into one order that ranges of rows share, and each left row looks back and ahead for the next right
    row, over the border of its range too. A left row whose place is null, or whose group has no right row, gets nulls.
    """
    by = by or []
    names = [c for c in right.columns if c not in (right_at, *by)]
    fields = F.struct(F.col(right_at).alias("_at"), *names)
    # of the right rows at one place only the smallest tie can be met
    place = right.where(F.col(right_at).isNotNull()).groupBy(*by, F.col(right_at).cast("double").alias("_p")).agg(F.min_by(fields, tie).alias("_r"))
    a = left.select(*by, F.col(left_at).cast("double").alias("_p"), F.struct(*left.columns).alias("_l"))
    both = a.withColumn("_side", F.lit(1)).unionByName(place.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    found = scanned(both, by, ["_p", "_side"], _b=("last", F.col("_r")), _a=("next", F.col("_r"))).where(F.col("_side") == 1)
    known = F.col("_p").isNotNull()
    found = found.withColumns({c: F.when(known, F.col(c)) for c in ("_a", "_b")})
    db, da = F.abs(F.col("_p") - F.col("_b._at")), F.abs(F.col("_a._at") - F.col("_p"))
    pick = F.when(F.col("_a").isNull() | (db < da) | ((db == da) & (F.col(f"_b.{tie}") <= F.col(f"_a.{tie}"))), F.col("_b")).otherwise(F.col("_a"))
    return found.withColumn("_m", F.when(F.col("_b").isNull(), F.col("_a")).otherwise(pick)).select("_l.*", F.col("_m._at").alias(right_at), *[F.col(f"_m.{c}") for c in names])


def reference_join(atoms: DataFrame, reference: int, use_ids: bool) -> DataFrame:
    """Every atom with its position in the reference frame as r_x, r_y, r_z; matched by id or by index."""
    key = "id" if use_ids else "atom"
    ref = atoms.where(F.col("frame") == reference).select(key, F.col("atom").alias("r_atom"), *[F.col(a).alias("r_" + a) for a in "xyz"])
    return atoms.join(ref, key)


def ids_usable(atoms: DataFrame, reference: int) -> bool:
    """Whether ids are complete and unique in every frame, and each frame holds as many as the reference."""
    per = atoms.groupBy("frame").agg(F.count("*").alias("n"), F.count("id").alias("k"), F.count_distinct("id").alias("u"))
    bad = per.where((F.col("n") != F.col("k")) | (F.col("n") != F.col("u")))
    return bad.isEmpty()


def residue_slots(atoms: DataFrame, chain: str, resname: str, resid: str) -> DataFrame:
    """atoms with slot: dense numbers of residues in the order in which a frame first names them."""
    key = [F.coalesce(F.trim(F.col(chain)), F.lit("")).alias("_c"), F.upper(F.trim(F.col(resname))).alias("_n"), F.trim(F.col(resid)).alias("_i")]
    rows = atoms.select("*", *key)
    first = rows.groupBy("frame", "_c", "_n", "_i").agg(F.min("atom").alias("_first"))
    first = first.withColumn("slot", F.row_number().over(Window.partitionBy("frame").orderBy("_first")) - 1)
    return rows.join(first, ["frame", "_c", "_n", "_i"]).drop("_first", "_c", "_n", "_i")


def outer_grid(rows: DataFrame, columns: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Every combination of two short lists with its cell, absent cells as nulls."""
    return rows.crossJoin(F.broadcast(columns)).join(cells, keys, "left")


def pair_key(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
