"""Surface planes, penetration classes and depth profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import written
from ..operators.ranks import FEW, group_sizes, with_ranked
from ..operators.stats import settled


def surface(atoms: DataFrame, substrate: str, few: int = FEW) -> DataFrame:
    """frame, surface (mean height of the topmost twentieth of the substrate, one atom at least), top (its largest height).

    The height at the twentieth's rank is found first; all above it count, and of those at it as many as are missing. The rows a
    frame are stored: their size is known, so that few of them go to the atoms, not all atoms of a frame to one task.
    """
    rows = settled(atoms.where(F.col("element") == substrate), "z", ["frame"])
    sizes = group_sizes(rows, ["frame"]).withColumn("m", F.greatest(F.lit(1), F.floor(F.col("n") / 20)))
    edge = written(with_ranked(rows, "z", ["frame"], written(sizes, "sizes"), few, edge=F.col("n") - F.col("m")), "edges")
    above = F.col("z") > F.col("edge")
    per = rows.join(edge, "frame").groupBy("frame").agg(F.first("m").alias("m"), F.first("edge").alias("edge"), F.count_if(above).alias("k"), F.coalesce(F.sum(F.when(above, F.col("z"))), F.lit(0.0)).alias("s"), F.max("z").alias("top"))
    return written(per.select("frame", ((F.col("s") + (F.col("m") - F.col("k")) * F.col("edge")) / F.col("m")).alias("surface"), "top"), "surface")


def relative_heights(atoms: DataFrame, substrate: str, probe: str) -> DataFrame:
    """The probe's atoms with rel, their height over the surface."""
    return atoms.where(F.col("element") == probe).join(surface(atoms, substrate), "frame").withColumn("rel", F.col("z") - F.col("surface"))


def penetration(atoms: DataFrame, substrate: str, probe: str, reach: float = 2.5) -> DataFrame:
    """Per frame: counts below, at and above the surface, least, mean and largest depth, mean charge of what isn't above."""
    rel, below = F.col("rel"), F.col("rel") < 0
    return relative_heights(atoms, substrate, probe).groupBy("frame").agg(
        F.max("surface").alias("surface"),
        F.max("top").alias("top"),
        F.count_if(below).alias("penetrated"),
        F.count_if((rel >= 0) & (rel < reach)).alias("at_surface"),
        F.count_if(rel >= reach).alias("above"),
        F.max(F.when(below, -rel)).alias("deepest"),
        F.min(F.when(below, -rel)).alias("shallowest"),
        F.avg(F.when(below, -rel)).alias("mean_depth"),
        F.avg(F.when(rel < reach, F.col("charge"))).alias("bound_charge"),
    )
