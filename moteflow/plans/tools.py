"""The fifteen tools: each one a query over all frames at once that returns a typed result."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import units
from ..functions.text import residue_key
from ..operators import boxes, groups, interactions, neighbors, stats, windows
from ..operators.bootstrap import bootstrap_interval
from ..operators.graph import written
from ..operators.joins import ids_usable, nearest, residue_slots
from ..operators.scan import numbered_rows, scanned
from ..sources import tables
from . import binding, conformation, mechanics, structure, surfaces
from .result import Context, MissingRequirement, NotApplicable, ToolResult, frame_profile, joined, summary_of, tool

ALL = ("perAtomField", "profile", "scalar", "series")


def column_of(atoms: DataFrame, name: str) -> Column:
    """x, y, z, charge (of the atom, else of its columns) or an extra column, as float and back."""
    if name in ("x", "y", "z"):
        return F.col(name)
    extra = F.col("columns")[name].cast("double") if "columns" in atoms.columns else F.lit(None).cast("double")
    if name == "charge" and "charge" in atoms.columns:
        return F.coalesce(F.col("charge"), extra)
    return extra


def available_columns(atoms: DataFrame) -> list[str]:
    extra = [r[0] for r in atoms.select(F.explode(F.map_keys("columns"))).distinct().collect()] if "columns" in atoms.columns else []
    return ["x", "y", "z", "charge", *sorted(c for c in extra if c != "charge")]


def field_of(df: DataFrame, value: Column) -> DataFrame:
    return df.select("frame", "atom", value.cast("float").alias("value"))


def cell_notes(cell: boxes.Cell, absent: str = "no box: boundaries are open") -> list[str]:
    return [absent] if cell is None else ["tilted box: images are those of an orthogonal one"] if boxes.tilted(cell) else []


@tool("z_profile", "Depth profile", "surfaces", functions=("profile", "scalar", "series"), substrate=None, probe=None, bins=12, profileOf="composition", field="")
def z_profile(atoms: DataFrame, c: Context, substrate: str | None, probe: str | None, bins: int, profileOf: str, field: str) -> ToolResult:  # noqa: N803
    """Where the probe's atoms lie below the substrate's surface."""
    if not (substrate and probe and substrate != probe):
        top = [r["key"] for r in groups.top_values(atoms, F.col("element")).collect()]
        if len(top) < 2:
            raise NotApplicable("fewer than two elements")
        substrate, probe = substrate or top[0], probe or next(e for e in top if e != (substrate or top[0]))
    wide = surfaces.penetration(atoms, substrate, probe)
    if wide.isEmpty():
        raise NotApplicable(f"no {substrate} and {probe}")
    rows = [("Substrate / probe", F.lit(f"{substrate} / {probe}"), ""), ("Surface z", "surface", "A"), ("Substrate max z", "top", "A"), ("Penetrated", "penetrated", ""), ("Max penetration", "deepest", "A"), ("Mean penetration", "mean_depth", "A"), ("Min penetration", "shallowest", "A"), ("At surface", "at_surface", ""), ("Above", "above", ""), ("Bound charge", "bound_charge", "e")]
    rel, notes = surfaces.relative_heights(atoms, substrate, probe), []
    value = None
    if profileOf == "charge":
        value = F.coalesce(column_of(atoms, "charge"), F.lit(0.0))
    elif profileOf == "field":
        if field in available_columns(atoms):
            value = column_of(atoms, field)
        else:
            notes.append(f"no column {field}: counts are shown")
    return ToolResult(summary_of(wide, rows), wide.select("frame", F.coalesce("deepest", F.lit(0.0)).alias("scalar")), profile=frame_profile(rel, F.col("rel"), value, bins), notes=notes, series_label="max penetration")


@tool("column_field", "Column", "export", functions=ALL, column="z", colormap="viridis", rangeMin=None, rangeMax=None, profileAxis="z", bins=24)
def column_field(atoms: DataFrame, c: Context, column: str, colormap: str, rangeMin: float | None, rangeMax: float | None, profileAxis: str, bins: int) -> ToolResult:  # noqa: N803
    """A column's statistics, its profile and its values as a field."""
    if column not in (have := available_columns(atoms)):
        raise NotApplicable(f"no column {column}; there are {', '.join(have)}")
    rows = atoms.withColumn("v", column_of(atoms, column).cast("float").cast("double"))
    wide = rows.where(stats.finite(F.col("v"))).groupBy("frame").agg(F.min("v").alias("lo"), F.avg("v").alias("mean"), F.max("v").alias("hi"), stats.population_std(F.col("v")).alias("std"))
    lo, hi = F.coalesce(F.lit(rangeMin), F.col("lo")), F.coalesce(F.lit(rangeMax), F.col("hi"))
    table = summary_of(wide, [("Column", F.lit(column), ""), ("Min", "lo", ""), ("Mean", "mean", ""), ("Max", "hi", ""), ("Std", "std", ""), ("Colour range from", lo, ""), ("Colour range to", hi, "")])
    return ToolResult(table, wide.select("frame", F.col("mean").alias("scalar")), field_of(rows, F.col("v")), frame_profile(rows, F.col(profileAxis), F.col("v"), bins), series_label=f"mean {column}", palette={"map": colormap})


@tool("crystallinity", "Crystallinity", "structure", functions=ALL, method="acna", q6Threshold=0.5, cutoff=None, profileAxis="z", bins=24)
def crystallinity(atoms: DataFrame, c: Context, method: str, q6Threshold: float, cutoff: float | None, profileAxis: str, bins: int) -> ToolResult:  # noqa: N803
    """Common-neighbour classes and averaged bond order; the method picks which is shown."""
    fixed = cutoff if cutoff and cutoff > 0 else None
    if fixed:
        pairs = written(neighbors.neighbours(atoms, fixed, c.box), "pairs")
        near, reach = neighbors.numbered(pairs, 16), atoms.select("frame").distinct().withColumn("cutoff", F.lit(fixed))
    else:
        near = structure.nearest_shells(atoms, 14, c.box)
        pairs, reach = near.where("rn <= 12"), neighbors.shell_reach(near, atoms)
    classes = structure.common_neighbour_classes(atoms, near, fixed)
    rows = atoms.join(classes, ["frame", "atom"]).join(structure.bond_orders(pairs, atoms, 6, 4), ["frame", "atom"])
    ordered = F.col("class") != structure.OTHER if method == "acna" else F.col("q6") > q6Threshold
    share = lambda cond: 100.0 * F.avg(cond.cast("int"))
    wide = rows.groupBy("frame").agg(*[share(F.col("class") == k).alias(f"s{k}") for k in range(5)], share(ordered).alias("ordered"), F.avg("q6").alias("q6"), F.avg("q4").alias("q4")).join(reach, "frame", "left")
    table = summary_of(wide, [*[(n, f"s{k}", "%") for k, n in enumerate(structure.CLASS_NAMES)], ("Crystalline", "ordered", "%"), ("Amorphicity", 100 - F.col("ordered"), "%"), ("Mean q6", "q6", ""), ("Mean q4", "q4", ""), ("Method", F.lit(method), ""), ("Cutoff", "cutoff", "A")])
    value = F.col("class") if method == "acna" else F.col("q6")
    profile = frame_profile(rows, F.col(profileAxis), ordered.cast("double"), bins)
    return ToolResult(table, wide.select("frame", (F.col("ordered") / 100).alias("scalar")), field_of(rows, value), profile, cell_notes(c.box), "crystalline fraction")


def matched(atoms: DataFrame, c: Context, names: tuple[str, ...], threshold: float) -> tuple[DataFrame, DataFrame]:
    """Template matches, and the pairs of neighbours within one and a half times the mean twelfth distance of each frame."""
    near = structure.nearest_shells(atoms, max(12, *(len(structure.TEMPLATES[n]) for n in names)), c.box)
    matches = written(structure.template_matches(atoms, near, names, threshold), "matches")
    return matches, written(neighbors.neighbours(atoms, neighbors.shell_reach(near, atoms), c.box).select("frame", "i", "j"), "pairs")


@tool("ptm", "Template matching", "structure", functions=ALL, quantity="structure", rmsdThreshold=0.1, gbAngle=5.0, profileAxis="z", bins=24, templates=["fcc", "hcp", "bcc", "ico"])
def ptm(atoms: DataFrame, c: Context, quantity: str, rmsdThreshold: float, gbAngle: float, profileAxis: str, bins: int, templates: list) -> ToolResult:  # noqa: N803
    """Structure and orientation of each atom by the ideal shell that fits best."""
    names = tuple(t for t in templates if t in structure.TEMPLATES)
    if not names:
        raise NotApplicable("no known template")
    notes = [] if quantity in ("structure", "orientation", "rmsd", "gb", "shear") else [f"unknown quantity {quantity}: structure is shown"]
    notes += cell_notes(c.box)
    m, pairs = matched(atoms, c, names, rmsdThreshold)
    g = structure.grains(atoms, m, pairs, gbAngle, 4)
    rows = atoms.join(m, ["frame", "atom"]).join(g, ["frame", "atom"])
    ok, edge = F.col("class") != structure.OTHER, F.col("grain") == 0
    wide = rows.groupBy("frame").agg((100.0 * F.avg((~ok).cast("int"))).alias("other"), *[(100.0 * F.avg((F.col("class") == structure.CODES[n]).cast("int"))).alias(n) for n in names], (100.0 * F.avg(ok.cast("int"))).alias("ordered"), F.avg(F.when(ok, F.col("rmsd"))).alias("rmsd"), (100.0 * F.avg(edge.cast("int"))).alias("gb"), F.max("grain").alias("grains"))
    table = summary_of(wide, [("Other", "other", "%"), *[(n.upper(), n, "%") for n in names], ("Crystalline", "ordered", "%"), ("Mean RMSD matched", "rmsd", ""), ("GB fraction", "gb", "%"), ("Grains", "grains", ""), ("Method", F.lit("template matching"), "")])
    hue = F.when(ok, G.orientation_hue([F.col(x) for x in structure.QUATERNION], F.col("class") == structure.HCP)).otherwise(0.0)
    value = {"rmsd": F.col("rmsd"), "gb": edge.cast("double"), "orientation": hue, "shear": F.coalesce(F.nanvl("shear", F.lit(0.0)), F.lit(0.0))}.get(quantity, F.col("class").cast("double"))
    return ToolResult(table, wide.select("frame", (F.col("ordered") / 100).alias("scalar")), field_of(rows, value), frame_profile(rows, F.col(profileAxis), ok.cast("double"), bins), notes, "crystalline fraction")


@tool("grains", "Grains", "structure", functions=ALL, quantity="grain", gbAngle=5.0, minimumGrainSize=4, rmsdThreshold=0.1, structure="any", profileAxis="misorientation", bins=18)
def grains(atoms: DataFrame, c: Context, quantity: str, gbAngle: float, minimumGrainSize: int, rmsdThreshold: float, structure: str, profileAxis: str, bins: int) -> ToolResult:  # noqa: N803
    """Grains as components of like orientation, their sizes, and the angles across their boundaries."""
    from . import structure as S

    names = (structure,) if structure in ("fcc", "bcc", "hcp") else ("fcc", "hcp", "bcc")
    m, near = matched(atoms, c, names, rmsdThreshold)
    g, sizes, pairs = S.grain_map(atoms, m, near, gbAngle, minimumGrainSize)
    n_atoms = g.groupBy("frame").agg(F.count("*").alias("atoms"), (100.0 * F.avg(F.col("edge").cast("int"))).alias("gb")).join(sizes.groupBy("frame").agg(F.max("grain").alias("grains")), "frame", "left").fillna(0, ["grains"])
    volume = F.nullif(F.col("cell_size_x") * F.col("cell_size_y") * F.col("cell_size_z"), F.lit(0.0))
    per = boxes.celled(sizes.join(n_atoms, "frame"), c.box).withColumn("d", G.equivalent_diameter(F.col("n"), volume / F.col("atoms"))).groupBy("frame").agg(F.avg("n").alias("mean_n"), F.median("n").alias("median_n"), F.avg("d").alias("mean_d"), F.median("d").alias("median_d"))
    mean = pairs.groupBy("frame").agg(F.avg("deg").alias("mean_deg"), F.count("*").alias("pairs"))
    ordered = m.groupBy("frame").agg((100.0 * F.avg((F.col("class") != S.OTHER).cast("int"))).alias("ordered"))
    wide = joined(n_atoms, per, mean, ordered)
    rows = [("Grains", "grains", ""), ("GB atoms", "gb", "%"), ("Crystalline", "ordered", "%"), ("Mean size", "mean_n", "atoms"), ("Median size", "median_n", "atoms")]
    if c.box is not None:
        rows += [("Mean diameter", "mean_d", "A"), ("Median diameter", "median_d", "A")]
    rows += [("Mean misorientation", "mean_deg", "deg"), ("Boundary pairs", F.coalesce("pairs", F.lit(0)), ""), ("Method", F.lit("template matching"), "")]
    if profileAxis in "xyz":
        profile = frame_profile(atoms.join(g, ["frame", "atom"]), F.col(profileAxis), F.col("edge").cast("double"), bins)
    else:
        top = 93.8 if names == ("hcp",) else 62.8
        width = top / bins
        counts = pairs.groupBy("frame", F.least(F.lit(bins - 1), F.floor(F.col("deg") / width)).cast("int").alias("bin")).agg(F.count("*").alias("count"))
        grid = n_atoms.select("frame", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        n = F.coalesce("count", F.lit(0)).cast("long")
        profile = grid.join(counts, ["frame", "bin"], "left").select("frame", "bin", (F.col("bin") * width).alias("lo"), ((F.col("bin") + 1) * width).alias("hi"), ((F.col("bin") + 0.5) * width).alias("centre"), n.cast("double").alias("value"), n.alias("count"))
    value = {"gb": F.col("edge").cast("double"), "misorientation": F.col("deg")}.get(quantity, F.col("grain"))
    return ToolResult(summary_of(wide, rows), wide.select("frame", F.col("grains").cast("double").alias("scalar")), field_of(g, value), profile, cell_notes(c.box), "grains")


@tool("conformation", "Conformation", "structure", functions=("perAtomField", "scalar", "series"), selection="ca", quantity="rmsf", clusterCount=4, clusterRMSDCutoff=None, pcaComponents=2)
def conformation_tool(atoms: DataFrame, c: Context, selection: str, quantity: str, clusterCount: int, clusterRMSDCutoff: float | None, pcaComponents: int) -> ToolResult:  # noqa: N803
    """Deviation from the reference frame, fluctuation, clusters and principal components of a chain's conformations."""
    have = atoms if "labels" in atoms.columns else atoms.withColumn("labels", F.create_map().cast("map<string,string>"))
    where, note = groups.atom_selection(have, selection)
    chosen = have.where(where)
    if chosen.isEmpty():
        raise NotApplicable("the selection is empty")
    ref = c.reference if c.reference is not None else chosen.agg(F.min("frame")).first()[0]
    fit = conformation.fits(chosen, ref).select("frame", "rmsd", "unfitted")
    wide = joined(fit, conformation.gyration(have))
    rows: list = [("RMSD (fitted)", "rmsd", "A"), ("RMSD (unfitted)", "unfitted", "A"), ("Radius of gyration", "rg", "A"), ("Selection", F.lit(selection), ""), ("Reference frame", F.lit(ref), "")]
    n = chosen.agg(F.count_distinct("frame")).first()[0]
    over = conformation.superposed(chosen, ref)
    rmsf = conformation.fluctuation(over)
    if n >= 2:
        mean, top = rmsf.agg(F.avg("rmsf"), F.max("rmsf")).first()
        wide = joined(wide, conformation.clusters(chosen, clusterCount, clusterRMSDCutoff))
        parts, shares = conformation.principal_components(over, pcaComponents)
        wide = joined(wide, parts)
        rows += [("Mean RMSF", F.lit(mean), "A"), ("Max RMSF", F.lit(top), "A"), ("Cluster", "cluster", ""), ("Population", "population", "frames")]
        rows += [(f"PC{k + 1} ({100 * s:.1f} %)", f"p{k + 1}", "A") for k, s in enumerate(shares)]
    values = have.select("frame", "atom").join(rmsf, "atom", "left").select("frame", "atom", F.col("rmsf").alias("v"))
    if quantity == "dssp":
        letters = conformation.secondary_structure(have)
        wide = joined(wide, letters.groupBy("frame").agg(*[(100.0 * F.avg(F.col("letter").isin(*s).cast("int"))).alias(k) for k, s in (("helix", ("H", "G", "I")), ("sheet", ("E", "B")))]))
        rows += [("Helix", "helix", "%"), ("Sheet", "sheet", "%")]
    elif quantity == "displacement":
        r = over.where(F.col("frame") == ref).select("atom", *[F.col(x).alias("r_" + x) for x in "xyz"])
        values = over.join(r, "atom").select("frame", "atom", G.norm(G.delta("r_", "")).alias("v"))
    return ToolResult(summary_of(wide, rows), fit.select("frame", F.col("rmsd").alias("scalar")), field_of(values, F.col("v")), notes=[note] if note else [], series_label="RMSD")


@tool("rdf", "Radial distribution", "structure", functions=ALL, speciesA=None, speciesB=None, rMax=10.0, bins=200, coordinationCutoff=None)
def rdf(atoms: DataFrame, c: Context, speciesA: str | None, speciesB: str | None, rMax: float, bins: int, coordinationCutoff: float | None) -> ToolResult:  # noqa: N803
    """Pair distribution, its first peak and minimum, and coordination up to there."""
    bins = max(4, bins)
    shortest = None if c.box is None else c.box.shortest()
    notes = cell_notes(c.box, "no box: the bounding box's volume is used") + (["rMax is over half of the box"] if shortest and rMax > shortest / 2 else [])
    g = structure.pair_distribution(atoms, c.box, rMax, bins, speciesA, speciesB)
    smooth = windows.moving_average(g, "g", "bin", ["frame"])
    found = windows.first_peak(smooth, "smooth", "bin", "n", ["frame"])
    dr = rMax / bins
    at = lambda b: (F.col(b) + 0.5) * dr
    peaks = found.join(g.select("frame", F.col("bin").alias("peak"), F.col("g").alias("height")), ["frame", "peak"], "left").select("frame", at("peak").alias("r_peak"), "height", at("minimum").alias("r_min"))
    pick = lambda e: atoms if e is None else atoms.where(F.col("element") == e)
    cut = F.least(F.lit(coordinationCutoff) if coordinationCutoff else F.col("r_min"), F.lit(rMax))
    peaks = written(peaks, "peaks")  # a row a frame
    counts = structure.coordination_by_frame(pick(speciesA), pick(speciesB), peaks.select("frame", cut.alias("cutoff")), rMax, c.box)
    per = counts.groupBy("frame").agg(F.avg("n").alias("coordination"), F.count("*").alias("centres"))
    wide = joined(per, peaks)
    table = summary_of(wide, [("Pair", F.lit(f"{speciesA or 'all'} - {speciesB or 'all'}"), ""), ("First peak", "r_peak", "A"), ("g at peak", "height", ""), ("First minimum", "r_min", "A"), ("Coordination cutoff", cut, "A"), ("Mean coordination", F.when(cut.isNotNull(), F.col("coordination")), ""), ("Centres", "centres", "")])
    lo = F.col("bin") * dr
    profile = g.select("frame", "bin", lo.alias("lo"), (lo + dr).alias("hi"), F.col("r").alias("centre"), F.col("g").alias("value"), F.col("n").alias("count"))
    return ToolResult(table, wide.select("frame", F.col("r_peak").alias("scalar")), field_of(counts, F.col("n")), profile, notes, "first peak")


@tool("diffusion", "Diffusion", "mechanics", requires=("referenceFrame",), functions=("perAtomField", "scalar", "series"), species=None, timestep_fs=1.0, frameInterval_ps=1.0, fitStartFraction=0.2, unwrap=True)
def diffusion(atoms: DataFrame, c: Context, species: str | None, timestep_fs: float, frameInterval_ps: float, fitStartFraction: float, unwrap: bool) -> ToolResult:  # noqa: N803
    """Mean squared displacement from the reference frame and the slope of its later part."""
    rows = atoms if species is None else atoms.where(F.col("element") == species)
    box = c.box if unwrap else None
    u = windows.unwrapped(rows, box, c.reference)
    square = F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") + F.col("uz") * F.col("uz")
    msd = u.groupBy("frame").agg(F.avg(square).alias("msd"), F.count("*").alias("followed"))
    steps = c.frames.select("frame", "timestep") if c.frames is not None else msd.select("frame", F.lit(None).cast("long").alias("timestep"))
    msd = msd.join(steps, "frame", "left").withColumn("t", units.time_ps(F.col("timestep"), F.col("frame"), timestep_fs, frameInterval_ps))
    t0 = msd.where(F.col("frame") == c.reference).select("t").first()[0]
    after = msd.where((F.col("frame") >= c.reference) & stats.finite(F.col("msd")))
    skip = math.floor(after.count() * min(0.9, max(0.0, fitStartFraction)))
    fit = after.withColumn("k", F.row_number().over(Window.orderBy("frame"))).where(F.col("k") > skip).agg(F.count("*").alias("points"), *stats.ols("t", "msd")).first()
    d = None if fit["slope"] is None else fit["slope"] / 6
    table = summary_of(msd, [("Species", F.lit(species or "all"), ""), ("Atoms followed", "followed", ""), ("MSD", "msd", "A^2"), ("Time since reference", F.col("t") - t0, "ps"), ("D", F.lit(d), "A^2/ps"), ("D error", F.lit(None if fit["slope_error"] is None else fit["slope_error"] / 6), "A^2/ps"), ("D in cm", F.lit(None if d is None else d * units.A2_PS_TO_CM2_S), "cm^2/s"), ("Frames fitted", F.lit(fit["points"]), ""), ("Unwrapped", F.lit("yes" if box is not None else "no"), "")])
    return ToolResult(table, msd.select("frame", F.col("msd").alias("scalar")), field_of(u, F.sqrt(square)), series_label="MSD")


@tool("deformation", "Deformation", "mechanics", requires=("referenceFrame",), functions=ALL, cutoff=3.5, quantity="shear", d2minThreshold=0.5, stressColumns=True, profileAxis="z", bins=24)
def deformation(atoms: DataFrame, c: Context, cutoff: float, quantity: str, d2minThreshold: float, stressColumns: bool, profileAxis: str, bins: int) -> ToolResult:  # noqa: N803
    """Local strain since the reference frame, rearrangements, displacement and stress."""
    key = "id" if "id" in atoms.columns and ids_usable(atoms, c.reference) else "atom"
    rows = atoms if key == "atom" else atoms.withColumn("atom", F.col("id").cast("int"))
    e = written(mechanics.deformation(rows, c.reference, cutoff, c.box), "deformation")
    ref = rows.where(F.col("frame") == c.reference).select("atom", *[F.col(x).alias("r_" + x) for x in "xyz"])
    moved = boxes.celled(rows.join(ref, "atom"), c.box).withColumn("displacement", G.norm([boxes.image(d, x) for d, x in zip(G.delta("r_", ""), "xyz", strict=True)]))
    all_ = boxes.uncelled(moved).join(e, ["frame", "atom"]).withColumn("rearranged", (F.coalesce("d2min", F.lit(0.0)) > d2minThreshold).cast("double"))
    names = mechanics.stress_components(available_columns(atoms)) if stressColumns and "columns" in atoms.columns else None
    all_ = all_.join(mechanics.atom_stress(rows, names), ["frame", "atom"]) if names else all_.withColumn("stress", F.lit(None).cast("double"))
    p95 = stats.nearest_rank(all_, "shear", 0.95, ["frame"]).withColumnRenamed("shear", "p95")
    wide = all_.groupBy("frame").agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"), *[F.avg(k).alias(k) for k in ("shear", "volumetric", "dilation", "d2min", "rearranged", "displacement", "stress")], F.avg(F.col("displacement") * F.col("displacement")).alias("msd"))
    wide = joined(wide, p95)
    rows_ = [("Atoms", "n", ""), ("Valid fits", "valid", ""), ("Mean shear", "shear", ""), ("p95 shear", "p95", ""), ("Mean volumetric", "volumetric", ""), ("Mean J - 1", "dilation", ""), ("Mean D2min", "d2min", "A^2"), ("Fraction rearranged", "rearranged", ""), ("Mean displacement", "displacement", "A"), ("MSD", "msd", "A^2"), ("Mean von Mises stress", "stress", "")]
    pick = {"vonmises_stress": "stress"}.get(quantity, quantity)
    pick = pick if pick in ("shear", "volumetric", "d2min", "displacement", "rearranged", "stress") else "shear"
    return ToolResult(summary_of(wide, rows_), wide.select("frame", F.col(pick).alias("scalar")), field_of(all_, F.col(pick)), frame_profile(all_, F.col(profileAxis), F.col(pick), bins), cell_notes(c.box), pick)


@tool("thermo", "Thermodynamics", "mechanics", requires=("sideFile",), logPath=None, xColumn="Step", yColumns=["Temp", "PotEng", "Press"], stressStrain=True, elasticStrain=0.02, alignBy="step")
def thermo(atoms: DataFrame, c: Context, logPath: str | None, xColumn: str, yColumns: list, stressStrain: bool, elasticStrain: float, alignBy: str) -> ToolResult:  # noqa: N803
    """Log columns at each frame, and the elastic modulus of a run that deforms the box."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = logPath or c.side_file or (tables.locate_log(c.path) if c.path else None)
    if path is None:
        raise MissingRequirement("no log")
    log = tables.log_rows(spark, path)
    common = tables.shared_names(log)
    if xColumn not in common:
        raise NotApplicable(f"no column {xColumn}")
    usable = [y for y in yColumns if y in common]
    notes = [f"no column {y}" for y in yColumns if y not in common]
    wanted = list(dict.fromkeys([xColumn, *usable, *[x for x in ("Step", "Lx", "Ly", "Lz", "Pxx", "Pyy", "Pzz") if x in common]]))
    rows = tables.wide_rows(log, wanted)
    fit = None
    if stressStrain and (axes := {a: f"L{a}" for a in "xyz" if f"L{a}" in wanted and f"P{a}{a}" in wanted}):
        if axis := mechanics.widest_axis(rows, axes):
            rows, m = mechanics.stress_strain(rows.withColumn("_one", F.lit(0)), f"L{axis}", f"P{axis}{axis}", "global_row", ["_one"], elasticStrain)
            fit = (axis, m.first(), rows.agg(F.max("stress").alias("top"), F.max_by("strain", "stress").alias("at")).first())
    frames = c.frames.select("frame", F.coalesce("timestep", F.col("frame").cast("long")).alias("timestep")) if c.frames is not None else rows.select(F.col("global_row").cast("int").alias("frame"), F.col("Step").cast("long").alias("timestep"))
    keep = [x for x in rows.columns if x not in ("file", "_one")]
    if alignBy == "index":
        n = rows.count()
        at = frames.withColumn("global_row", F.least(F.col("frame"), F.lit(n - 1))).join(rows.select(*keep), "global_row")
    else:
        side = rows.select(F.col("Step").alias("at_step"), *keep)
        at = nearest(frames, side, "timestep", "at_step", "global_row")
    table_rows: list = [("Log", F.lit(path), ""), ("Run", F.col("block") + 1, ""), (xColumn, xColumn, ""), *[(y, y, "") for y in usable], ("Aligned by", F.lit(alignBy), "")]
    scalar = F.col(usable[0]) if usable else F.lit(None).cast("double")
    if fit:
        axis, m, top = fit
        table_rows += [("Deformed axis", F.lit(axis), ""), ("Strain", F.col("strain") * 100, "%"), ("Stress", "stress", "GPa"), ("E", F.lit(m["modulus"]), "GPa"), ("Points fitted", F.lit(m["points"]), ""), ("Max stress", F.lit(top["top"]), "GPa"), ("At strain", F.lit(top["at"]), "")]
        scalar = F.col("stress")
    return ToolResult(summary_of(at, table_rows), at.select("frame", scalar.alias("scalar")), notes=notes, series_label="stress" if fit else (usable[0] if usable else ""))


@tool("adhesion", "Adhesion", "binding", requires=("groups",), functions=("perAtomField", "scalar", "series"), groupA=None, groupB=None, contactCutoff=4.5, hbondDistance=3.5, hbondAngle=120.0, perResidue=True, saltBridgeCutoff=4.0, quantity="contacts", lifetimes=True)
def adhesion(atoms: DataFrame, c: Context, groupA: dict | None, groupB: dict | None, contactCutoff: float, hbondDistance: float, hbondAngle: float, perResidue: bool, saltBridgeCutoff: float, quantity: str, lifetimes: bool) -> ToolResult:  # noqa: N803
    """Contacts, hydrogen bonds and interactions between two groups of atoms, frame by frame."""
    if "labels" not in atoms.columns:
        atoms = atoms.withColumn("labels", F.create_map().cast("map<string,string>"))
    pair = None if groupA and groupB else groups.suggest_pair(atoms)
    if not (groupA and groupB) and pair is None:
        raise MissingRequirement("two groups are needed")
    a, b = (groups.Selector.parse(g) if g else p for g, p in zip((groupA, groupB), pair or (None, None), strict=True))
    rows = atoms.withColumn("in_a", a.column()).withColumn("in_b", b.column())
    notes = [] if rows.where("in_a AND in_b").isEmpty() else ["the groups share atoms"]
    ends = written(interactions.contact_counts(rows, contactCutoff, c.box), "contacts")
    frames = rows.select("frame").distinct()
    both = lambda n: (F.sum(n) / 2).cast("long")  # each contact is at two atoms
    count = ends.groupBy("frame").agg(both("n").alias("contacts"))
    wide = frames.join(count, "frame", "left").withColumn("contacts", F.coalesce("contacts", F.lit(0)).cast("long"))
    far = interactions.interface_distance(rows.where(groups.heavy() & F.col("in_a")), rows.where(groups.heavy() & F.col("in_b")), contactCutoff, c.box)
    mass = units.mass(F.col("element"))
    centre = lambda g: [F.sum(F.when(F.col(g), mass * F.col(x))) / F.sum(F.when(F.col(g), mass)) for x in "xyz"]
    com = rows.groupBy("frame").agg(*[v.alias(f"a{x}") for v, x in zip(centre("in_a"), "xyz", strict=True)], *[v.alias(f"b{x}") for v, x in zip(centre("in_b"), "xyz", strict=True)])
    gap = [boxes.image(F.col(f"b{x}") - F.col(f"a{x}"), x) for x in "xyz"]
    wide = joined(wide, boxes.celled(com, c.box).select("frame", G.norm(gap).alias("com")), far)
    table: list = [("Groups", F.lit(f"{a.json()} / {b.json()}"), ""), ("Contacts", "contacts", "")]
    has_h = not rows.where(F.upper(F.trim("element")).isin(*groups.HYDROGEN)).isEmpty()
    if has_h:
        hb = interactions.hydrogen_bonds(rows, hbondDistance, hbondAngle, c.box)
        wide = joined(wide, hb.groupBy("frame").agg(F.count("*").alias("hbonds"))).withColumn("hbonds", F.coalesce("hbonds", F.lit(0)))
        table.append(("H-bonds", "hbonds", ""))
        if lifetimes and frames.count() > 1:
            n = frames.count()
            runs = windows.occupancy(hb.withColumn("on", F.lit(True)), "on", "frame", ["donor", "acceptor"], n)
            for r in bond_labels(runs.orderBy(F.desc("occupancy"), "donor", "acceptor").limit(10), rows).collect():
                notes.append(f"{r['donor_name']} → {r['acceptor_name']}: occupancy {r['occupancy']:.2f}, lifetime {r['lifetime']:.3f}, {r['events']} events")
    else:
        polar = ends.groupBy("frame").agg(both("polar").alias("polar"))
        wide = joined(wide, polar).withColumn("polar", F.coalesce("polar", F.lit(0)))
        table += [("H-bonds", F.lit("n/a (no hydrogens)"), ""), ("Polar contacts", "polar", "")]
    labelled = rows.withColumn("name", F.upper(F.trim(F.col("labels")["name"]))).withColumn("resname", F.upper(F.trim(F.col("labels")["resname"]))).withColumn("resid", F.trim(F.col("labels")["resid"])).withColumn("chain", F.col("labels")["chain"])
    marks, slots, found, hb = None, None, {}, hb if has_h else None
    if not labelled.where("name IS NOT NULL AND resname IS NOT NULL AND resid IS NOT NULL").isEmpty():
        slots = residue_slots(labelled, "chain", "resname", "resid")
        rings = interactions.rings(slots, c.box)
        found = {"salt": interactions.salt_bridges(slots, saltBridgeCutoff, c.box), "pi": interactions.pi_stacks(rings, c.box).select("frame", "a", "b"), "cation_pi": interactions.cation_pi(slots, rings, c.box).select("frame", F.col("cation").alias("a"), F.col("ring").alias("b")), "oily": interactions.hydrophobic_pairs(slots, box=c.box)}
        for label, k in (("Salt bridges", "salt"), ("π-stacking", "pi"), ("Cation–π", "cation_pi"), ("Hydrophobic", "oily")):
            wide = joined(wide, found[k].groupBy("frame").agg(F.count("*").alias(k))).withColumn(k, F.coalesce(k, F.lit(0)))
            table.append((label, k, ""))
        marks = binding.marked(slots, found)
    table += [("COM distance", "com", "A"), ("Min distance", "nearest", "A")]
    ends = ends.select("frame", "atom", "n")
    touched = F.when(F.col("n").isNull(), 0).when(F.col("in_a"), 1).otherwise(2)  # of A, of B
    per_atom, value = rows.select("frame", "atom", "in_a").join(ends, ["frame", "atom"], "left"), touched
    if quantity == "interactions" and (marks is not None or hb is not None):
        per_atom = per_atom.join(binding.strongest(marks, hb), ["frame", "atom"], "left")
        value = F.coalesce("code", touched)
    elif quantity == "interactions":
        notes.append("no interaction classes: contacts are shown")
    if perResidue:
        key = residue_key(F.col("labels")["chain"], F.col("labels")["resname"], F.coalesce(F.col("labels")["resid"], F.lit("")))
        named = rows.where("in_a").select("frame", "atom", key.alias("key")).where("key IS NOT NULL").join(ends, ["frame", "atom"]).groupBy("frame", "key").agg(F.sum("n").alias("n"))
        best5 = groups.ranked(named, ["frame"], 5, F.desc("n"), F.col("key")).groupBy("frame").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat("key", F.lit(" "), F.col("n").cast("string")).alias("t")))), lambda s: s["t"]), ", ").alias("best5"))
        wide = joined(wide, best5)
        table.append(("Top residues", F.coalesce("best5", F.lit("")), ""))
    more = []
    keyed = rows.where("in_a").withColumn("key", residue_key(F.col("labels")["chain"], F.col("labels")["resname"], F.coalesce(F.col("labels")["resid"], F.lit("")))).where("key IS NOT NULL").select("frame", "atom", "key")
    if slots is not None:
        more.append(binding.interaction_rows(binding.tallies(keyed, slots, ends, hb, found)))
    if lifetimes:
        more.append(binding.frequency_rows(binding.contact_frequency(keyed, ends), frames))
    if c.path:
        if energies := tables.locate(c.path, ["interaction_energy.csv"]):
            more.append(binding.energy_rows(tables.read_interaction_energy(rows.sparkSession, energies), frames))
        if bound := tables.locate(c.path, ["mmgbsa.csv"]):
            more.append(binding.mmgbsa_rows(tables.read_mmgbsa(rows.sparkSession, bound), frames))
    summary = summary_of(wide, table)
    for part in more:
        summary = summary.unionByName(part)
    return ToolResult(summary, wide.select("frame", F.col("contacts").cast("double").alias("scalar")), field_of(per_atom, value), notes=notes, series_label="contacts")


def bond_labels(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """runs with names of both ends: residue and atom name where the first frame has a residue, else the atom's name or element and its number."""
    first = rows.agg(F.min("frame")).first()[0]
    lab = lambda k: F.nullif(F.trim(F.col("labels")[k]), F.lit(""))
    key = residue_key(lab("chain"), lab("resname"), F.coalesce(lab("resid"), F.lit("")))
    plain = F.concat(F.col("element"), F.col("atom").cast("string"))
    name = F.coalesce(lab("name"), plain)
    placed = lab("resname").isNotNull() & lab("resid").isNotNull()
    names = rows.where(F.col("frame") == first).select("atom", F.when(placed, F.concat_ws(" ", key, name)).otherwise(F.concat(name, F.lit(" #"), F.col("atom").cast("string"))).alias("n"))
    out = runs
    for end in ("donor", "acceptor"):
        out = out.join(names.select(F.col("atom").alias(end), F.col("n").alias(f"{end}_name")), end, "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", F.concat(F.lit("atom #"), F.col(end).cast("string"))))
    return out.orderBy(F.desc("occupancy"), "donor", "acceptor")


def pull_at_times(one: DataFrame, interval: float | None, c: Context, atoms: DataFrame | None) -> DataFrame:
    """The row of a pull nearest to each frame's time, at most one interval away; frames without one have no row.

    The interval between frames is the given one, else that of the curve's rows.
    """
    first = one.agg(F.min("time_ps").alias("from"), F.max("time_ps").alias("to"), F.count("*").alias("n")).first()
    interval = interval or ((first["to"] - first["from"]) / (first["n"] - 1) if first["n"] > 1 else None)
    if not interval or interval <= 0:
        raise NotApplicable("time alignment needs a frame interval")
    frames = c.frames.select("frame") if c.frames is not None else atoms.select("frame").distinct() if atoms is not None else one.sparkSession.range(int((first["to"] - first["from"]) / interval + 1.5)).select(F.col("id").cast("int").alias("frame"))
    wanted = frames.select("frame", (F.lit(first["from"]) + F.col("frame") * interval).alias("want"))
    found = nearest(wanted, one.withColumn("at", F.col("time_ps")), "want", "at", "row")  # the rows of one pull
    return found.where(F.abs(F.col("at") - F.col("want")) <= interval).drop("want", "at")


@tool("pulloff_energetics", "Pull-off energetics", "binding", requires=("sideFile",), csvPath=None, seed=None, frameAlignment="row", frameInterval_ps=None, runDirs=[], temperature_K=300.0)
def pulloff_energetics(atoms: DataFrame | None, c: Context, csvPath: str | None, seed: int | None, frameAlignment: str, frameInterval_ps: float | None, runDirs: list, temperature_K: float) -> ToolResult:  # noqa: N803
    """Rupture force, work and free energy of pulls; frames are rows of the chosen pull."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = csvPath or c.side_file or (tables.locate(c.path, ["force_curve.csv"]) if c.path else None)
    if path is None:
        raise MissingRequirement("no force curve")
    curve = tables.read_force_curve(spark, path)
    sizes = {r["seed"]: r["n"] for r in curve.groupBy("seed").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        raise NotApplicable("the force curve is empty")
    want = c.frame or 0
    pick = seed if seed in sizes else min((s for s in sizes if sizes[s] > want), key=lambda s: (sizes[s], s), default=next(iter(sizes)))
    one = curve.where(F.col("seed") == pick)
    config = tables.locate(path, ["config.json"])
    run = tables.read_run_config(config) if config else {"velocity": None, "spring": None, "loading_rate": None}
    pulls = curve.withColumn("v", F.lit(run["velocity"]).cast("double")).withColumn("rate", F.lit(run["loading_rate"]).cast("double")).withColumn("run", F.lit(0))
    for i, d in enumerate(runDirs, 1):
        other, cfg = tables.locate(f"{d}/x", ["force_curve.csv"]), tables.locate(f"{d}/x", ["config.json"])
        if other and other != path:
            r = tables.read_run_config(cfg) if cfg else {"velocity": None, "loading_rate": None}
            pulls = pulls.unionByName(tables.read_force_curve(spark, other).withColumn("v", F.lit(r["velocity"]).cast("double")).withColumn("rate", F.lit(r["loading_rate"]).cast("double")).withColumn("run", F.lit(i)))
    last = F.max_by("work", "row")
    per = pulls.groupBy("run", "seed").agg(F.max("force_pn").alias("f"), F.max_by("row", F.struct("force_pn", -F.col("row"))).alias("at"), last.alias("w"), F.first("v").alias("v"), F.first("rate").alias("rate")).join(windows.zero_from(pulls, "contacts", "row", ["run", "seed"]), ["run", "seed"])
    mine = per.where((F.col("run") == 0) & (F.col("seed") == pick)).first()
    q = stats.tukey_quartiles(per.withColumn("g", F.lit(0)), "f", ["g"]).first()
    kt = units.KB_PN_NM_K * temperature_K
    be = stats.bell_evans(per.where("rate IS NOT NULL"), "rate", "f", kt).first()
    ja = stats.jarzynski("w", units.R_KJ_MOL_K * temperature_K, ["g"], per.where(F.coalesce("v", F.lit(0.0)) <= 1.0).withColumn("g", F.lit(0))).first()
    if frameAlignment == "time":
        wide = pull_at_times(one, frameInterval_ps or run.get("interval_ps"), c, atoms)
        if c.frame is not None and wide.where(F.col("frame") == want).isEmpty():
            raise NotApplicable(f"no row of the force curve near the time of frame {want}")
    else:
        wide = one.withColumn("frame", F.col("row").cast("int"))
        if c.frame is not None and want >= sizes[pick]:
            raise NotApplicable(f"frame {want} is past the end of the force curve")
    n_rates, shown = (be["n_rates"] if be else 0), be is not None and be["distance"] is not None
    table: list = [("Time", "time_ps", "ps"), ("Reference displacement", "ref_nm", "nm"), ("COM displacement", "com_nm", "nm"), ("Force", "force_pn", "pN"), ("Work", "work", "kJ/mol"), ("Contacts", "contacts", ""), ("F*", F.lit(mine["f"]), "pN"), ("F* row", F.lit(mine["at"]), ""), ("W", F.lit(mine["w"]), "kJ/mol"), ("Rupture frame", F.lit(mine["start"]), ""), ("Seed", F.lit(pick), ""), ("Velocity", F.lit(run["velocity"]).cast("double"), "A/ns"), ("Spring", F.lit(run["spring"]).cast("double"), "kJ/mol/nm^2"), ("F* median", F.lit(q["median"] if q else None), "pN"), ("F* q1", F.lit(q["q1"] if q else None), "pN"), ("F* q3", F.lit(q["q3"] if q else None), "pN")]
    table += [("Bell–Evans distance", F.lit(be["distance"]), "nm"), ("Bell–Evans k_off", F.lit(be["koff"]), "1/s")] if shown else [("Bell–Evans", F.lit(f"n/a ({n_rates} loading rates, 3 needed)"), "")]
    if ja and ja["exponential"] is not None:
        table += [("ΔG exponential", F.lit(ja["exponential"]), "kJ/mol"), ("ΔG second cumulant", F.lit(ja["second_cumulant"]), "kJ/mol")]
    else:
        table.append(("Free energy", F.lit(f"n/a ({ja['n'] if ja else 0} slow pulls, 10 needed)"), ""))
    return ToolResult(summary_of(wide, table), wide.select("frame", F.col("force_pn").alias("scalar")), series_label="force")


@tool("kinetics_tramd", "Unbinding kinetics", "binding", requires=("sideFile",), csvPath=None, temperature_K=300.0, frameTime_ps=None, resamples=2000)
def kinetics_tramd(atoms: DataFrame | None, c: Context, csvPath: str | None, temperature_K: float, frameTime_ps: float | None, resamples: int) -> ToolResult:  # noqa: N803
    """Residence time from replicas with censoring, its bootstrap interval, and what is still bound at a frame's time."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = csvPath or c.side_file or (tables.locate(c.path, ["tramd_times.csv"]) if c.path else None)
    if path is None:
        raise MissingRequirement("no dissociation times")
    runs = tables.read_replica_times(spark, path)
    taus = {r["seed"]: r["tau"] for r in stats.half_survival_time(runs, "t", "censored", ["seed"]).collect()}
    n, cut = runs.agg(F.count("*"), F.count_if("censored")).first()
    lo, hi = bootstrap_interval(runs, resamples)
    mean = sum(taus.values()) / len(taus) if taus else None
    survival = tables.locate(path, ["tramd_survival.csv"])
    wide = bound_at_frames(runs, tables.read_survival(spark, survival) if survival else None, frame_numbers(c, atoms), frameTime_ps)
    table = [("τ", F.lit(mean), "ps"), ("τ low", F.lit(lo), "ps"), ("τ high", F.lit(hi), "ps"), ("k_off", F.lit(None if not mean else 1 / mean), "1/ps"), *[(f"τ seed {s}", F.lit(t), "ps") for s, t in sorted(taus.items())], ("Replicas", F.lit(n), ""), ("Censored", F.lit(cut), ""), ("Method", F.lit("half of the linear distribution"), ""), ("Bound", "bound", "")]
    return ToolResult(summary_of(wide, table), wide.select("frame", F.col("bound").alias("scalar")), series_label="bound")


def frame_numbers(c: Context, atoms: DataFrame | None) -> DataFrame | None:
    """The frames of a trajectory, if there is one."""
    return c.frames.select("frame") if c.frames is not None else atoms.select("frame").distinct() if atoms is not None else None


def bound_at_frames(runs: DataFrame, survival: DataFrame | None, frames: DataFrame | None, interval: float | None) -> DataFrame:
    """frame, at, bound: the share of all runs that are censored or end after the frame's time, for every frame.

    A frame's time is a multiple of the interval; without one, frames walk an axis, the survival file's times if it has two at
    least, else 0 and the times of the runs, and stay at its end. Without a trajectory there is a frame for each place of the
    axis, or up to the last run's end. Runs and frames are merged into one order in time, no run is paired with a frame.
    """
    spark = runs.sparkSession
    if interval and interval > 0:
        if frames is None:
            top = runs.agg(F.max("t")).first()[0]
            frames = spark.range(0 if top is None else int(max(0.0, top) / interval) + 1).select(F.col("id").cast("int").alias("frame"))
        at = frames.select("frame", (F.col("frame") * interval).alias("at"))
    else:
        own = runs.select("t").union(spark.createDataFrame([(0.0,)], "t double")).distinct()
        axis = survival.select("t").distinct() if survival is not None else own
        axis = own if survival is not None and axis.limit(2).count() < 2 else axis
        axis = written(numbered_rows(axis.withColumnRenamed("t", "at"), "place", [], ["at"]), "time-axis")
        last = axis.agg(F.max("place")).first()[0]
        at = axis.select(F.col("place").cast("int").alias("frame"), "at") if frames is None else frames.withColumn("place", F.greatest(F.lit(0), F.least(F.col("frame"), F.lit(last))).cast("long")).join(axis, "place").select("frame", "at")
    n = runs.count()
    ended = runs.where(~F.col("censored")).groupBy(F.col("t").alias("at")).agg(F.count("*").alias("gone")).withColumn("side", F.lit(0))
    both = at.withColumn("side", F.lit(1)).unionByName(ended, allowMissingColumns=True)
    seen = scanned(both, [], ["at", "side"], gone_by=("sum", F.coalesce("gone", F.lit(0)))).where("side = 1")
    return seen.select("frame", "at", (1 - F.col("gone_by") / n).alias("bound"))


@tool("fep_results", "Relative free energies", "binding", requires=("sideFile",), jsonPath=None, sortBy="rank")
def fep_results(atoms: DataFrame | None, c: Context, jsonPath: str | None, sortBy: str) -> ToolResult:  # noqa: N803
    """Edges of a free-energy network as frames, in the order asked for, with the checks on overlap and closure."""
    from pyspark.sql import SparkSession

    path = jsonPath or c.side_file or (tables.locate(c.path, ["results.json"]) if c.path else None)
    if path is None:
        raise MissingRequirement("no results document")
    doc = tables.read_fep(SparkSession.active(), path)
    edges = tables.sorted_edges(tables.fep_edges(doc), sortBy).withColumn("frame", F.col("place").cast("int"))
    if c.frame is not None and c.frame >= edges.count():
        raise NotApplicable(f"there is no edge {c.frame}")
    notes = [f"low overlap: {r['ligA']} → {r['ligB']}" for r in edges.where(F.col("overlap_min") < 0.03).collect()]
    notes += [f"open cycle: {', '.join(r['ligands'])}" for r in doc.select(F.explode("cycles").alias("k")).select("k.*").where(F.abs("closure_kcal") > 1.0).collect()]
    table = [("Edge", F.concat("ligA", F.lit(" → "), "ligB"), ""), ("ΔΔG", "ddG_kcal", "kcal/mol"), ("Error", "ddG_err", "kcal/mol"), ("ΔG solvent", "dG_solvent", "kcal/mol"), ("ΔG complex", "dG_complex", "kcal/mol"), ("Overlap", "overlap_min", ""), ("Best rank", "best", ""), ("Converged", F.coalesce(F.col("converged").cast("string"), F.lit("–")), "")]
    return ToolResult(summary_of(edges, table), edges.select("frame", F.col("ddG_kcal").alias("scalar")), notes=notes, series_label="ΔΔG")


@tool("campaign_matrix", "Campaign matrix", "binding", requires=("sideFile",), jsonPath=None, receptor=None, sortBy="tier")
def campaign_matrix(atoms: DataFrame | None, c: Context, jsonPath: str | None, receptor: str | None, sortBy: str) -> ToolResult:  # noqa: N803
    """One receptor's column of a screening matrix as frames; cells that weren't delivered stay absent."""
    from pyspark.sql import SparkSession

    path = jsonPath or c.side_file or (tables.locate(c.path, ["matrix.json"], climb=3) if c.path else None)
    if path is None:
        raise MissingRequirement("no matrix document")
    doc = tables.read_campaign(SparkSession.active(), path)
    head = doc.select("primary_receptor", "unit", "label", "receptors").first()
    column = receptor or head["primary_receptor"]
    if column not in (head["receptors"] or []):
        raise NotApplicable(f"no receptor {column}")
    rows = tables.campaign_column(doc, column, sortBy).withColumn("frame", F.col("place").cast("int"))
    cells = tables.campaign_cells(doc)
    have, all_ = cells.agg(F.count("value"), F.count("*")).first()
    states = cells.where("value IS NULL").groupBy(F.coalesce("state", F.lit("absent")).alias("state")).agg(F.count("*").alias("n")).orderBy("state").collect()
    tiers = rows.agg(F.count_distinct("tier")).first()[0]
    base = rows if not rows.isEmpty() else rows.sparkSession.range(1).select(F.lit(0).alias("frame"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name != "frame"])
    table = [("Receptor", F.lit(column), ""), ("Ligand", F.coalesce("ligand", F.lit("–")), ""), (head["label"] or "Value", "value", head["unit"] or ""), ("Band", "uncertainty", head["unit"] or ""), ("Tier", "tier", ""), ("Tiers", F.lit(tiers), ""), ("Coverage", F.lit(f"{have} of {all_} ({100 * have / max(1, all_):.0f}%)"), ""), *[(f"Not delivered: {s['state']}", F.lit(s["n"]), "") for s in states]]
    return ToolResult(summary_of(base, table), base.select("frame", F.col("value").alias("scalar")), series_label=head["label"] or "value")
