"""Readers of run logs, force curves, replica times, energy tables and result documents."""

from __future__ import annotations

import glob
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strict_double
from ..functions.units import PN_PER_KJ_MOL_NM
from ..operators.graph import written
from ..operators.scan import numbered_rows, scanned


def log_rows(spark: SparkSession, path: str) -> DataFrame:
    """A row a thermo row: file, block, row, global_row, names, vals, loop_time, stored but for numbers of its block.

    A header is a line whose first word is Step; rows after it have as many words, all numbers; Loop time closes the block;
    warnings, errors, blanks and prose are skipped; a block without an end is kept. A long file is read in splits: what a split
    needs of those before it, the open block and its names, is handed on. A folder is one log in parts, in the order of their
    names; of a pattern with * each file is a log.
    """
    log = F.col("_metadata.file_path") if "*" in path else F.lit(path)
    lines = spark.read.text(path).select(log.alias("file"), F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda t: t != "")
    rows = lines.select("file", "part", "at", "line", words.alias("words"), (F.get(words, F.lit(0)) == "Step").alias("head"), F.trim("text").startswith("Loop time of").alias("end")).where(F.size("words") > 0)
    order = ["part", "at", "line"]  # within a file: by where a split begins, then as it is read
    mark = F.when(F.col("head"), F.struct(F.lit(True).alias("open"), F.col("words").alias("names"))).when(F.col("end"), F.struct(F.lit(False).alias("open"), F.lit(None).cast("array<string>").alias("names")))
    rows = written(scanned(rows, ["file"], order, block=("count", F.when(F.col("head"), 1)), mark=("last", mark)).where("block > 0").withColumn("block", F.col("block") - 1), "lines")
    loops = rows.where("end").groupBy("file", "block").agg(F.max(strict_double(F.get("words", F.lit(3)))).alias("loop_time"))
    data = rows.where("NOT head AND mark.open").where(F.size("words") == F.size("mark.names")).withColumn("vals", F.transform("words", lambda t: strict_double(t)))
    data = data.where(F.forall("vals", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    data = written(numbered_rows(data.select("file", *order, "block", F.col("mark.names").alias("names"), "vals"), "global_row", ["file"], order), "log")
    starts = data.groupBy("file", "block").agg(F.min("global_row").alias("start"))
    blocks = written(starts.join(loops, ["file", "block"], "left"), "blocks")  # its size is known, so that few blocks go to the rows, not rows to the blocks
    return data.join(blocks, ["file", "block"]).select("file", "block", (F.col("global_row") - F.col("start")).alias("row"), "global_row", "names", "vals", "loop_time")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Long thermo table of log_rows: file, block, row, global_row, ord, col, val, loop_time."""
    return log_rows(spark, path).select("file", "block", "row", "global_row", F.posexplode(F.arrays_zip("names", "vals")).alias("ord", "c"), "loop_time").select("file", "block", "row", "global_row", "ord", F.col("c.names").alias("col"), F.col("c.vals").alias("val"), "loop_time")


def common_columns(log: DataFrame) -> list[str]:
    """Columns of every block, in the order of the first."""
    n = log.agg(F.count_distinct("file", "block")).first()[0]
    rows = log.groupBy("col").agg(F.count_distinct("file", "block").alias("n"), F.min(F.struct("block", "ord")).alias("at")).where(F.col("n") == n).orderBy("at").collect()
    return [r["col"] for r in rows]


def all_columns(log: DataFrame) -> list[str]:
    """Columns of any block, first seen first."""
    return [r["col"] for r in log.groupBy("col").agg(F.min(F.struct("block", "ord")).alias("at")).orderBy("at").collect()]


def shared_names(rows: DataFrame) -> list[str]:
    """common_columns of log_rows: a block's names are looked at once."""
    blocks = rows.groupBy("file", "block").agg(F.first("names").alias("names"))
    return common_columns(blocks.select("file", "block", F.posexplode("names").alias("ord", "col")))


def wide_rows(rows: DataFrame, names: list[str]) -> DataFrame:
    """file, block, row, global_row and a column for each name, of log_rows; the first of columns with one name."""
    return rows.select("file", "block", "row", "global_row", *[F.get("vals", F.array_position("names", n).cast("int") - 1).alias(n) for n in names])


def wide_log(log: DataFrame, names: list[str]) -> DataFrame:
    """file, block, row, global_row and a column for each name."""
    return log.groupBy("file", "block", "row", "global_row").pivot("col", names).agg(F.first("val"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A comma-separated file with a header, all text; # lines and blanks skipped; with ord, the row's place."""
    raw = spark.read.csv(path, header=True, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return raw.withColumn("ord", F.monotonically_increasing_id())


def column(df: DataFrame, name: str, missing: float | None = None) -> F.Column:
    """A number of a text table; missing where the column is absent."""
    if name not in df.columns:
        return F.lit(missing).cast("double")
    return F.coalesce(strict_double(F.col(f"`{name}`")), F.lit(missing).cast("double"))


def good(*names: str) -> F.Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    return out


def read_force_curve(spark: SparkSession, path: str) -> DataFrame:
    """seed, row, time_ps, ref_nm, com_nm, force_pn, force_kj, work, contacts; either force is derived from the other.

    Empty without a time or a force column. Rows without a finite time and force are dropped; other gaps are 0.
    """
    t = read_table(spark, path)
    has = [c for c in ("time_ps", "force_pN", "force_kJ_mol_nm") if c in t.columns]
    pn, kj = column(t, "force_pN"), column(t, "force_kJ_mol_nm")
    rows = t.select(F.coalesce(column(t, "seed"), F.lit(0.0)).cast("long").alias("seed"), "ord", column(t, "time_ps").alias("time_ps"), column(t, "ref_disp_nm", 0.0).alias("ref_nm"), column(t, "com_disp_nm", 0.0).alias("com_nm"), F.coalesce(pn, kj * PN_PER_KJ_MOL_NM).alias("force_pn"), F.coalesce(kj, pn / PN_PER_KJ_MOL_NM).alias("force_kj"), column(t, "work_kJ_mol", 0.0).alias("work"), column(t, "n_contacts_total", 0.0).alias("contacts"))
    rows = rows.where(good("time_ps", "force_pn")) if has else rows.limit(0)
    return rows.withColumn("row", F.row_number().over(Window.partitionBy("seed").orderBy("ord")) - 1).drop("ord")


def read_run_config(path: str) -> dict:
    """Velocity, spring constant, report interval, seeds and the loading rate of a run's JSON document."""
    with open(path, encoding="utf-8") as f:
        c = json.load(f)
    v, k = c.get("pull_velocity_A_per_ns"), c.get("spring_k_kJ_mol_nm2")
    rate = k * PN_PER_KJ_MOL_NM * v * 1e8 if v is not None and k is not None else None
    return {"velocity": v, "spring": k, "interval_ps": c.get("report_interval_ps"), "seeds": c.get("seeds", [c["seed"]] if "seed" in c else []), "loading_rate": rate}


def read_replica_times(spark: SparkSession, path: str) -> DataFrame:
    """seed, replica, t, censored, distance, ord (the row's place); censored is a number other than 0, true or yes."""
    t = read_table(spark, path)
    if "t_diss_ps" not in t.columns:
        raise ValueError("no column t_diss_ps")
    text = F.lower(F.trim("censored")) if "censored" in t.columns else F.lit("0")
    flag = F.coalesce(strict_double(text) != 0, text.isin("true", "yes"))
    rows = t.select(F.coalesce(column(t, "seed"), F.lit(0.0)).cast("long").alias("seed"), column(t, "replica").cast("long").alias("replica"), column(t, "t_diss_ps").alias("t"), flag.alias("censored"), column(t, "final_com_distance_nm").alias("distance"), "ord")
    rows = numbered_rows(rows.where(good("t")).withColumnRenamed("ord", "_ord"), "ord", [], ["_ord"]).drop("_ord")
    return rows.withColumn("replica", F.coalesce("replica", "ord"))


def read_survival(spark: SparkSession, path: str) -> DataFrame:
    t = read_table(spark, path)
    return t.select(column(t, "t_ps").alias("t"), F.coalesce(column(t, "seed"), F.lit(0.0)).cast("long").alias("seed"), column(t, "fraction_bound").alias("bound")).where(good("t", "bound"))


def read_interaction_energy(spark: SparkSession, path: str) -> DataFrame:
    """frame, resname, resid, chain, vdw, elec; a missing term is 0."""
    t = read_table(spark, path)
    if not {"e_vdw_kJ_mol", "e_elec_kJ_mol"} & set(t.columns):
        raise ValueError("no energy column")
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) if c in t.columns else F.lit("")
    return t.select(column(t, "frame", 0.0).cast("int").alias("frame"), text("resname").alias("resname"), text("resid").alias("resid"), text("chain").alias("chain"), column(t, "e_vdw_kJ_mol", 0.0).alias("vdw"), column(t, "e_elec_kJ_mol", 0.0).alias("elec")).where(good("vdw", "elec"))


def read_mmgbsa(spark: SparkSession, path: str) -> DataFrame:
    """frame, time_ps, dg, vdw, elec, solv of each frame with a finite binding energy."""
    t = read_table(spark, path)
    if "dG_bind_kJ_mol" not in t.columns:
        raise ValueError("no column dG_bind_kJ_mol")
    return t.select(column(t, "frame", 0.0).cast("int").alias("frame"), column(t, "time_ps").alias("time_ps"), column(t, "dG_bind_kJ_mol").alias("dg"), column(t, "e_vdw", 0.0).alias("vdw"), column(t, "e_elec", 0.0).alias("elec"), (column(t, "g_solv_complex", 0.0) - column(t, "g_solv_receptor", 0.0) - column(t, "g_solv_ligand", 0.0)).alias("solv")).where(good("dg"))


FEP = "edges array<struct<ligA:string,ligB:string,ddG_kcal:double,ddG_err:double,dG_solvent:double,dG_complex:double,overlap_min:double,converged:boolean,notes:string>>, ligands array<struct<name:string,dG_abs_kcal:double,dG_abs_err:double,rank:int>>, cycles array<struct<ligands:array<string>,closure_kcal:double,closure_err:double>>, flags array<string>, forcefield string, absolute_method string"
CAMPAIGN = "campaign string, quantity string, label string, direction string, unit string, ligands array<string>, receptors array<string>, primary_receptor string, n_cells int, n_delivered int, cells map<string,struct<ligand:string,receptor:string,state:string,value:double,uncertainty:double,n:int,tier:int>>, columns map<string,array<string>>, selectivity map<string,double>, compromises array<string>"


def read_fep(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEP).json(path, multiLine=True)


def fep_edges(doc: DataFrame) -> DataFrame:
    """One row an edge, with the better rank of its two ligands; edges keep the document's order as ord."""
    e = doc.select(F.posexplode("edges").alias("ord", "e")).select("ord", "e.*")
    rank = ligand_ranks(doc).select("name", "place")
    a, b = rank.select(F.col("name").alias("ligA"), F.col("place").alias("ra")), rank.select(F.col("name").alias("ligB"), F.col("place").alias("rb"))
    return e.join(a, "ligA", "left").join(b, "ligB", "left").withColumn("best", F.least("ra", "rb"))


def ligand_ranks(doc: DataFrame) -> DataFrame:
    """name, dG_abs_kcal, dG_abs_err, rank, place: by rank, then energy, then name; missing ones last."""
    rows = doc.select(F.explode("ligands").alias("l")).select("l.*")
    order = Window.orderBy(F.asc_nulls_last("rank"), F.asc_nulls_last("dG_abs_kcal"), "name")
    return rows.withColumn("place", F.row_number().over(order))


def sorted_edges(edges: DataFrame, by: str) -> DataFrame:
    """edges with place by rank, ddG or error."""
    order = {"ddG": [F.asc_nulls_last("ddG_kcal"), "ord"], "error": [F.desc_nulls_last("ddG_err"), "ord"]}.get(by, [F.asc_nulls_last("best"), "ligA", "ligB"])
    return edges.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)


def read_campaign(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CAMPAIGN).json(path, multiLine=True)


def campaign_cells(doc: DataFrame) -> DataFrame:
    """ligand, receptor, state, value, uncertainty, n, tier for every combination; what wasn't delivered is null, never 0."""
    grid = doc.select(F.posexplode("ligands").alias("ord", "ligand"), "receptors").select("ord", "ligand", F.explode("receptors").alias("receptor"))
    cells = doc.select(F.explode(F.map_values("cells")).alias("c")).select("c.*")
    return grid.join(cells, ["ligand", "receptor"], "left")


def campaign_column(doc: DataFrame, receptor: str, by: str) -> DataFrame:
    """The delivered cells of one receptor with place: the producer's order (tier), the better value first, or the widest band."""
    direction = (doc.select("direction").first() or ["lower"])[0] or "lower"
    ids = doc.select(F.posexplode(F.element_at("columns", receptor)).alias("ord", "id"))
    cells = doc.select(F.explode("cells").alias("id", "c")).select("id", "c.*")
    rows = ids.join(cells, "id").where("value IS NOT NULL")
    better = F.desc_nulls_last("value") if direction.startswith("higher") else F.asc_nulls_last("value")
    order = {"value": [better, "ord"], "band": [F.desc_nulls_last("uncertainty"), "ord"]}.get(by, ["ord"])
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)


def locate(trajectory: str, names: list[str], explicit: str | None = None, climb: int = 0) -> str | None:
    """A side file: the explicit one, beside the trajectory, in its results folders, in the parent of a results folder, or further up."""
    if explicit:
        return explicit if os.path.exists(explicit) else None
    here = Path(trajectory)
    here = here if here.is_dir() else here.parent
    places = [here, *sorted(p for p in here.glob("results*") if p.is_dir())]
    if here.name.startswith("results"):
        places += [here.parent, *sorted(p for p in here.parent.glob("results*") if p.is_dir())]
    up = here
    for _ in range(climb):
        up = up.parent
        places.append(up)
    for p in places:
        for n in names:
            if (p / n).exists():
                return str(p / n)
    return None


def locate_log(trajectory: str, explicit: str | None = None) -> str | None:
    """log.lammps as locate() finds it, else the newest *.log or log.* beside the trajectory."""
    if found := locate(trajectory, ["log.lammps"], explicit):
        return found
    here = Path(trajectory)
    here = here if here.is_dir() else here.parent
    logs = [*glob.glob(str(here / "*.log")), *glob.glob(str(here / "log.*"))]
    return max(logs, key=lambda p: (os.path.getmtime(p), p)) if logs and not explicit else None


