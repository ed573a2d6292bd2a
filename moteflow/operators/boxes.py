"""The cell of each frame as data: a box for all frames, a table of boxes by frame, or none."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import min_image
from ..schema import AXES, Box


@dataclass(frozen=True, eq=False)
class FrameBoxes:
    """A box for each frame: frame, lo_*, hi_*, per_* and tilt_*; a frame without a row is open."""

    table: DataFrame
    _known: dict = field(default_factory=dict, repr=False)

    def columns(self) -> DataFrame:
        """frame, cell_lo_*, cell_size_* (never negative), cell_per_*."""
        t = self.table
        return t.select("frame", *[F.col(f"lo_{a}").alias(f"cell_lo_{a}") for a in AXES], *[F.greatest(F.lit(0.0), F.col(f"hi_{a}") - F.col(f"lo_{a}")).alias(f"cell_size_{a}") for a in AXES], *[F.coalesce(F.col(f"per_{a}"), F.lit(True)).alias(f"cell_per_{a}") for a in AXES])

    @property
    def tilted(self) -> bool:
        if "tilted" not in self._known:
            tilts = [c for c in ("tilt_xy", "tilt_xz", "tilt_yz") if c in self.table.columns]
            skew = " OR ".join(f"coalesce({c}, 0) <> 0" for c in tilts) or "false"
            self._known["tilted"] = not self.table.where(skew).isEmpty()
        return self._known["tilted"]

    def shortest(self) -> float | None:
        """The shortest edge of all frames, of edges that have a length."""
        edges = [F.min(F.when(F.col(f"cell_size_{a}") > 0, F.col(f"cell_size_{a}"))) for a in AXES]
        return min((v for v in self.columns().agg(*edges).first() if v is not None), default=None)


Cell = Box | FrameBoxes | None


def boxes_of(frames: DataFrame) -> Cell:
    """The box of a frames table: one Box if all frames have the same, a table if they differ, None if no frame has one."""
    names = [f"{e}_{a}" for e in ("lo", "hi", "per") for a in AXES] + ["tilt_xy", "tilt_xz", "tilt_yz"]
    row = frames.agg(F.count("*").alias("n"), F.count_if("has_box").alias("boxed"), *[f(F.when(F.col("has_box"), F.col(c).cast("double"))).alias(f"{k}_{c}") for c in names for k, f in (("least", F.min), ("most", F.max))], F.count_if(F.col("has_box") & F.col("tilt_xy").isNull()).alias("straight")).first()
    if not row["boxed"]:
        return None
    alike = row["boxed"] == row["n"] and row["straight"] in (0, row["n"]) and all(row[f"least_{c}"] == row[f"most_{c}"] for c in names)
    if not alike:
        return FrameBoxes(frames.where("has_box"))
    v = {c: row[f"least_{c}"] for c in names}
    at = lambda e: tuple(v[f"{e}_{a}"] for a in AXES)
    return Box(at("lo"), at("hi"), tuple(bool(p) for p in at("per")), tuple(v[t] or 0.0 for t in ("tilt_xy", "tilt_xz", "tilt_yz")))  # type: ignore[arg-type]


def tilted(cell: Cell) -> bool:
    return cell is not None and cell.tilted


def celled(df: DataFrame, cell: Cell) -> DataFrame:
    """df and the cell of its frame as cell_lo_*, cell_size_* and cell_per_*; an open frame has no size and isn't periodic."""
    if isinstance(cell, FrameBoxes):
        out = df.join(cell.columns(), "frame", "left")
        return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for a in AXES for c in (f"cell_lo_{a}", f"cell_size_{a}")} | {f"cell_per_{a}": F.coalesce(f"cell_per_{a}", F.lit(False)) for a in AXES})
    lo, size, per = (cell.lo, cell.lengths, cell.periodic) if cell else ((0.0,) * 3, (0.0,) * 3, (False,) * 3)
    return df.withColumns({f"cell_{k}_{a}": F.lit(v[i]) for k, v in (("lo", lo), ("size", size), ("per", per)) for i, a in enumerate(AXES)})


def uncelled(df: DataFrame) -> DataFrame:
    return df.drop(*[f"cell_{k}_{a}" for k in ("lo", "size", "per") for a in AXES])


def image(d: Column, axis: str) -> Column:
    """d by the minimum image of the row's cell, which celled() has put beside it."""
    return min_image(d, F.col(f"cell_size_{axis}"), F.col(f"cell_per_{axis}"))


def volumes(atoms: DataFrame, cell: Cell) -> DataFrame:
    """frame, volume: of the frame's cell, or of the atoms' bounding box where the cell is absent or flat."""
    if isinstance(cell, Box) and cell.volume > 0:
        return atoms.select("frame").distinct().withColumn("volume", F.lit(cell.volume))
    own = celled(atoms.groupBy("frame").agg(*[(F.max(a) - F.min(a)).alias("_e" + a) for a in AXES]), cell)
    boxed = F.col("cell_size_x") * F.col("cell_size_y") * F.col("cell_size_z")
    return own.select("frame", F.when(boxed > 0, boxed).otherwise(F.col("_ex") * F.col("_ey") * F.col("_ez")).alias("volume"))
