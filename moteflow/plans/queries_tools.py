"""The tools as registered queries: every tool's summary of all frames, on the driver's tables seen as trajectories and side files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import BOX, SPECIES_SQL, force_rows, replicas, species
from ..operators.graph import shared_folder
from . import tools  # noqa: F401  (they register)
from .queries_points import MSD_SQL
from .registry_queries import query
from .result import Context, ToolResult, run_tool


def told(r: ToolResult) -> DataFrame:
    return r.summary.select("frame", "label", (F.round("num", 6) + 0.0).alias("num"), "text")


def unpivot(table: str, rows: list[tuple[str, str, str]]) -> str:
    """DuckDB: a row for each label of each row of a table; num or text by the third of each."""
    return " UNION ALL ".join(f"SELECT frame, '{label}' AS label, {f'round(CAST({c} AS DOUBLE), 6) + 0.0' if kind == 'num' else 'CAST(NULL AS DOUBLE)'} AS num, {c if kind == 'text' else 'CAST(NULL AS VARCHAR)'} AS text FROM {table}" for label, c, kind in rows)


PROFILE_ROWS = [("Substrate / probe", "'Fe / O'", "text"), ("Surface z", "surface", "num"), ("Substrate max z", "top", "num"), ("Penetrated", "penetrated", "num"), ("Max penetration", "deepest", "num"), ("Mean penetration", "mean_depth", "num"), ("Min penetration", "shallowest", "num"), ("At surface", "at_surface", "num"), ("Above", "above", "num"), ("Bound charge", "bound_charge", "num")]


@query("tool_z_profile", f"""WITH {SPECIES_SQL}, t AS (SELECT frame, z, row_number() OVER (PARTITION BY frame ORDER BY z DESC) AS r, count(*) OVER (PARTITION BY frame) AS n FROM sp WHERE element = 'Fe'),
sf AS (SELECT frame, avg(z) FILTER (r <= greatest(1, n // 20)) AS surface, max(z) AS top FROM t GROUP BY frame), p AS (SELECT frame, z - surface AS rel, charge, surface, top FROM sp JOIN sf USING (frame) WHERE element = 'O'),
w AS (SELECT frame, max(surface) AS surface, max(top) AS top, count(*) FILTER (rel < 0) AS penetrated, max(-rel) FILTER (rel < 0) AS deepest, avg(-rel) FILTER (rel < 0) AS mean_depth, min(-rel) FILTER (rel < 0) AS shallowest,
  count(*) FILTER (rel >= 0 AND rel < 2.5) AS at_surface, count(*) FILTER (rel >= 2.5) AS above, avg(charge) FILTER (rel < 2.5) AS bound_charge FROM p GROUP BY frame) {unpivot('w', PROFILE_ROWS)}""")
def tool_z_profile(s: SparkSession, d: str) -> DataFrame:
    return told(run_tool("z_profile", species(s, d), Context(box=BOX), {"substrate": "Fe", "probe": "O"}))


COLUMN_ROWS = [("Column", "'charge'", "text"), ("Min", "lo", "num"), ("Mean", "mean", "num"), ("Max", "hi", "num"), ("Std", "std", "num"), ("Colour range from", "lo", "num"), ("Colour range to", "hi", "num")]


@query("tool_column_field", f"""WITH {SPECIES_SQL}, w AS (SELECT frame, min(c) AS lo, avg(c) AS mean, max(c) AS hi, stddev_pop(c) AS std FROM (SELECT frame, CAST(CAST(charge AS FLOAT) AS DOUBLE) AS c FROM sp) GROUP BY frame) {unpivot('w', COLUMN_ROWS)}""")
def tool_column_field(s: SparkSession, d: str) -> DataFrame:
    return told(run_tool("column_field", species(s, d), Context(box=BOX), {"column": "charge"}))


DIFFUSION_ROWS = [("Species", "'all'", "text"), ("Atoms followed", "n", "num"), ("MSD", "msd", "num"), ("Time since reference", "frame", "num"), ("D", "d", "num"), ("D error", "e", "num"), ("D in cm", "d * 1e-4", "num"), ("Frames fitted", "k", "num"), ("Unwrapped", "'yes'", "text")]


@query("tool_diffusion", f"""WITH {MSD_SQL}, f AS (SELECT regr_slope(msd, frame * 1.0) AS slope, count(*) AS k, regr_sxx(msd, frame * 1.0) AS sxx, regr_syy(msd, frame * 1.0) AS syy, regr_sxy(msd, frame * 1.0) AS sxy FROM msd WHERE frame >= 4),
w AS (SELECT frame, msd, (SELECT count(*) FROM atoms WHERE frame = 0) AS n, slope / 6 AS d, sqrt(greatest(0, syy - sxy * sxy / sxx) / (k - 2) / sxx) / 6 AS e, k FROM msd, f) {unpivot('w', DIFFUSION_ROWS)}""")
def tool_diffusion(s: SparkSession, d: str) -> DataFrame:
    return told(run_tool("diffusion", species(s, d), Context(box=BOX, reference=0)))


@query("tool_crystallinity")
def tool_crystallinity(s: SparkSession, d: str) -> DataFrame:
    return told(run_tool("crystallinity", species(s, d), Context(box=BOX)))


@query("tool_ptm")
def tool_ptm(s: SparkSession, d: str) -> DataFrame:
    return told(run_tool("ptm", species(s, d), Context(box=BOX), {"rmsdThreshold": 0.3}))


@query("tool_grains")
def tool_grains(s: SparkSession, d: str) -> DataFrame:
    return told(run_tool("grains", species(s, d), Context(box=BOX), {"rmsdThreshold": 0.3, "gbAngle": 15.0, "structure": "fcc"}))


@query("tool_conformation")
def tool_conformation(s: SparkSession, d: str) -> DataFrame:
    return told(run_tool("conformation", species(s, d), Context(box=BOX, reference=0), {"selection": "all"}))


@query("tool_rdf")
def tool_rdf(s: SparkSession, d: str) -> DataFrame:
    return told(run_tool("rdf", species(s, d), Context(box=BOX), {"speciesA": "Fe", "speciesB": "O", "rMax": 0.15, "bins": 25}))


@query("tool_deformation")
def tool_deformation(s: SparkSession, d: str) -> DataFrame:
    return told(run_tool("deformation", species(s, d), Context(box=BOX, reference=0), {"cutoff": 0.2, "d2minThreshold": 0.01}))


@query("tool_adhesion")
def tool_adhesion(s: SparkSession, d: str) -> DataFrame:
    return told(run_tool("adhesion", species(s, d), Context(box=BOX), {"contactCutoff": 0.1}))


@query("tool_kinetics")
def tool_kinetics(s: SparkSession, d: str) -> DataFrame:
    """orders as replica times, through a file of comma-separated values."""
    path = shared_folder(s, "times")
    replicas(s, d).select("seed", "replica", F.col("t").alias("t_diss_ps"), F.col("censored").cast("int").alias("censored")).write.csv(path, header=True)
    return told(run_tool("kinetics_tramd", None, Context(side_file=path), {"frameTime_ps": 5000.0}))


@query("tool_pulloff")
def tool_pulloff(s: SparkSession, d: str) -> DataFrame:
    """events as force curves, a file for each few pulls."""
    path = shared_folder(s, "curves")
    rows = force_rows(s, d).select("seed", "row", (F.col("us") / 1e6).alias("time_ps"), F.col("force").alias("force_pN"), F.col("contacts").alias("n_contacts_total"), F.col("row").alias("work_kJ_mol"))
    rows.repartition("seed").sortWithinPartitions("seed", "row").drop("row").write.csv(path, header=True)
    return told(run_tool("pulloff_energetics", None, Context(side_file=path)))


@query("tool_fep")
def tool_fep(s: SparkSession, d: str) -> DataFrame:
    """nations as ligands and each with the next of its region as an edge, through a document."""
    n = s.read.parquet(f"{d}/nation.parquet")
    ligand = n.agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("name"), (-F.col("n_nationkey") / 4).alias("dG_abs_kcal"), (F.col("n_nationkey") % 9).cast("int").alias("rank")))).alias("ligands"))  # 25 rows
    a, b = n.alias("a"), n.alias("b")
    edge = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.struct(F.col("a.n_name").alias("ligA"), F.col("b.n_name").alias("ligB"), ((F.col("b.n_nationkey") - F.col("a.n_nationkey")) / 8).alias("ddG_kcal"), (F.col("a.n_nationkey") / 50).alias("overlap_min"), F.lit(True).alias("converged")).alias("e"))
    doc = ligand.crossJoin(edge.agg(F.array_sort(F.collect_list("e")).alias("edges")))  # one row each
    path = shared_folder(s, "fep")
    doc.select(F.to_json(F.struct("ligands", "edges")).alias("value")).write.text(path)
    return told(run_tool("fep_results", None, Context(side_file=path)))


@query("tool_campaign")
def tool_campaign(s: SparkSession, d: str) -> DataFrame:
    """nations against regions as a screening matrix, through a document; a fifth of the cells aren't delivered."""
    n, r = s.read.parquet(f"{d}/nation.parquet"), s.read.parquet(f"{d}/region.parquet")
    cell = n.crossJoin(F.broadcast(r)).select(F.concat_ws("__", "n_name", "r_name").alias("id"), "n_name", "r_name", (F.col("n_nationkey") * 7 + F.col("r_regionkey") * 3).alias("k"))  # 25 by 5
    value = F.when(F.col("k") % 5 > 0, (F.col("k") % 31) / 4)
    doc = cell.agg(
        F.array_sort(F.collect_set("n_name")).alias("ligands"),
        F.array_sort(F.collect_set("r_name")).alias("receptors"),
        F.map_from_entries(F.collect_list(F.struct("id", F.struct(F.col("n_name").alias("ligand"), F.col("r_name").alias("receptor"), F.when(value.isNull(), "failed").otherwise("done").alias("state"), value.alias("value"), F.lit(1).alias("tier"))))).alias("cells"),
        F.array_sort(F.collect_list(F.when(F.col("r_name") == "ASIA", F.col("id")))).alias("asia"),
    )
    path = shared_folder(s, "campaign")
    doc.select(F.to_json(F.struct("ligands", "receptors", "cells", F.create_map(F.lit("ASIA"), F.col("asia")).alias("columns"), F.lit("ASIA").alias("primary_receptor"), F.lit("lower_is_better").alias("direction"), F.lit("kJ/mol").alias("unit"), F.lit("Score").alias("label"))).alias("value")).write.text(path)
    return told(run_tool("campaign_matrix", None, Context(side_file=path)))


@query("tool_thermo", None)
def tool_thermo(s: SparkSession, d: str) -> DataFrame:
    """All events as a log with a block for each type: a header, a line an event, and the closing line, in part files by ranges."""
    e = s.read.parquet(f"{d}/events.parquet")
    lines = e.select(F.col("event_type").alias("run"), F.col("event_id").alias("o"), F.concat_ws(" ", F.col("event_id").cast("string"), F.coalesce("value", F.lit(0.0)).cast("string")).alias("value"))
    runs = e.select(F.col("event_type").alias("run")).distinct()
    ends = runs.select("run", F.lit(-1).cast("long").alias("o"), F.lit("Step Temp").alias("value")).unionByName(runs.select("run", F.lit(2**62).alias("o"), F.lit("Loop time of 1.5 on 1 procs").alias("value")))
    path = shared_folder(s, "log")
    lines.unionByName(ends).repartitionByRange("run", "o").sortWithinPartitions("run", "o").select("value").write.text(path)
    return told(run_tool("thermo", None, Context(side_file=path), {"yColumns": ["Temp"], "stressStrain": False}))


@query("tool_backbones", None)
def tool_backbones(s: SparkSession, d: str) -> DataFrame:
    """Chains by charge's sign, residues by atom over four, and a C alpha first in each."""
    from .bonding import backbones

    a = species(s, d)
    lab = F.create_map(F.lit("chain"), F.when(F.col("charge") < 0, "A").otherwise("B"), F.lit("resid"), F.floor(F.col("atom") / 4).cast("string"), F.lit("name"), F.when(F.col("atom") % 4 == 0, "CA").otherwise("N"))
    return backbones(a.withColumn("labels", lab)).select("frame", "chain", F.size("trace").alias("residues"), F.array_join(F.transform("trace", lambda x: x.cast("string")), ",").alias("trace"))
