"""Bonds by covalent radii and backbones by residue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.units import covalent_radius
from ..operators.blocks import links
from ..operators.groups import HYDROGEN


def perceive_bonds(atoms: DataFrame, tolerance: float = 1.15, measured: bool = True) -> DataFrame:
    """frame, i, j and, with measured, d, with i < j: closer than tolerance times the radii's sum, farther than 0.05, not two hydrogens; open boundaries."""
    rows = atoms.withColumn("radius", covalent_radius(F.col("element"))).withColumn("h", F.upper(F.trim("element")).isin(*HYDROGEN))
    top = rows.agg(F.max("radius")).first()[0]
    if top is None:
        return atoms.select("frame", F.col("atom").alias("i"), F.col("atom").alias("j"), *([F.lit(0.0).alias("d")] if measured else [])).limit(0)
    other = (~F.col("h")).cast("double")  # certainly no hydrogen
    bonded = lambda d, a, b: (d > 0.05) & (d <= tolerance * (a[..., 0] + b[..., 0])) & (a[..., 1] + b[..., 1] > 0)
    return links(rows.where("radius IS NOT NULL"), 2 * tolerance * top, what="distance" if measured else "ids", half=True, keep=bonded, values=F.array(F.col("radius").cast("double"), F.coalesce(other, F.lit(0.0))))


def backbones(atoms: DataFrame) -> DataFrame:
    """frame, chain, trace: one atom for each residue (CA, else its first carbon) by residue number; chains of two or more."""
    lab = lambda k: F.trim(F.col("labels")[k])
    rows = atoms.select("frame", "atom", F.coalesce(lab("chain"), F.lit("")).alias("chain"), lab("resid").try_cast("int").alias("resid"), lab("name").alias("name"), "element")
    rank = F.when(F.upper("name") == "CA", 0).when(F.upper(F.trim("element")) == "C", 1)
    one = rows.withColumn("rank", rank).where("rank IS NOT NULL AND resid IS NOT NULL").groupBy("frame", "chain", "resid").agg(F.min(F.struct("rank", "atom")).alias("m"))
    return one.groupBy("frame", "chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("resid", F.col("m.atom").alias("atom")))), lambda s: s["atom"]).alias("trace")).where(F.size("trace") >= 2)
