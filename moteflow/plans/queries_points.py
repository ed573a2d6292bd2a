"""Registered queries on point trajectories: scans, predicates, geometry, range joins, binning, windows and transport."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..adapters import ATOMS_SQL, BOX, N_FRAMES, SLAB_SQL, SPECIES_SQL, atoms, slab, species
from ..cli import frame_filter
from ..functions import geometry as G
from ..functions import units
from ..operators import binning, blocks, graph, groups, joins, neighbors, stats, windows
from ..operators.boxes import FrameBoxes
from ..sources.trajectories import decimated
from .registry_queries import query

L, RC = 1.2, 0.15
MI = "({d} - 1.2 * round(({d}) / 1.2))"
PAIRS_SQL = f"""{ATOMS_SQL},
pd AS (SELECT a.frame, a.atom AS i, b.atom AS j, {MI.format(d='b.x - a.x')} AS dx, {MI.format(d='b.y - a.y')} AS dy, {MI.format(d='b.z - a.z')} AS dz,
  a.element AS ei, b.element AS ej FROM atoms a JOIN atoms b ON a.frame = b.frame AND a.atom <> b.atom),
pairs AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS d FROM pd WHERE dx*dx + dy*dy + dz*dz <= {RC} * {RC})"""


def r6(c: F.Column, name: str) -> F.Column:
    return (F.round(c, 6) + 0.0).alias(name)


@query("element_histogram", f"WITH {ATOMS_SQL} SELECT frame, element, count(*) AS n FROM atoms GROUP BY ALL")
def element_histogram(s: SparkSession, d: str) -> DataFrame:
    return atoms(s, d).groupBy("frame", "element").agg(F.count("*").alias("n"))


@query("trajectory_info", f"""WITH {ATOMS_SQL} SELECT frame, count(*) AS n_atoms, count(DISTINCT element) AS n_elements, round(min(x), 6) + 0.0 AS min_x, round(max(x), 6) + 0.0 AS max_x,
  round(min(y), 6) + 0.0 AS min_y, round(max(y), 6) + 0.0 AS max_y, round(min(z), 6) + 0.0 AS min_z, round(max(z), 6) + 0.0 AS max_z, round(min(charge), 6) + 0.0 AS min_charge, round(max(charge), 6) + 0.0 AS max_charge FROM atoms GROUP BY frame""")
def trajectory_info(s: SparkSession, d: str) -> DataFrame:
    return atoms(s, d).groupBy("frame").agg(F.count("*").alias("n_atoms"), F.count_distinct("element").alias("n_elements"), *[r6(f(c), f"{n}_{c}") for c in ("x", "y", "z", "charge") for n, f in (("min", F.min), ("max", F.max))])


@query("decimate", f"WITH {ATOMS_SQL}, m AS (SELECT max(frame) AS last FROM atoms) SELECT frame, count(*) AS n, round(sum(x), 6) + 0.0 AS sx FROM atoms, m WHERE frame % 6 = 0 OR frame = last GROUP BY frame")
def decimate(s: SparkSession, d: str) -> DataFrame:
    return decimated(atoms(s, d), 6).groupBy("frame").agg(F.count("*").alias("n"), r6(F.sum("x"), "sx"))


@query("frame_range", f"WITH {ATOMS_SQL} SELECT frame, count(*) AS n FROM atoms WHERE frame BETWEEN 3 AND 17 AND (frame - 3) % 4 = 0 GROUP BY frame")
def frame_range(s: SparkSession, d: str) -> DataFrame:
    return atoms(s, d).where(frame_filter("3-17:4", N_FRAMES - 1)).groupBy("frame").agg(F.count("*").alias("n"))


@query("group_elements", f"WITH {ATOMS_SQL} SELECT frame, atom, element FROM atoms WHERE element IN ('E0', 'E2')")
def group_elements(s: SparkSession, d: str) -> DataFrame:
    return atoms(s, d).where(groups.Selector("elements", symbols=(" e0", "E2")).column()).select("frame", "atom", "element")


@query("group_label", f"WITH {ATOMS_SQL} SELECT frame, atom FROM atoms WHERE label = 1")
def group_label(s: SparkSession, d: str) -> DataFrame:
    a = atoms(s, d).withColumn("labels", F.create_map(F.lit("chain"), F.concat(F.lit(" "), F.col("label").cast("string"))))
    return a.where(groups.Selector("label", name="chain", values=("1 ",)).column()).select("frame", "atom")


@query("group_slab", f"WITH {ATOMS_SQL} SELECT frame, atom, round(z, 6) + 0.0 AS z FROM atoms WHERE z BETWEEN -0.05 AND 0.1")
def group_slab(s: SparkSession, d: str) -> DataFrame:
    return atoms(s, d).where(groups.Selector("slab", axis="z", lo=0.1, hi=-0.05).column()).select("frame", "atom", r6(F.col("z"), "z"))


@query("suggest_pair", f"WITH {ATOMS_SQL}, c AS (SELECT frame, element AS key, count(*) AS count FROM atoms GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY count DESC, key) AS r FROM c) SELECT frame, key, count FROM r WHERE r <= 2")
def suggest_pair(s: SparkSession, d: str) -> DataFrame:
    return groups.top_values_by_frame(atoms(s, d), F.col("element"))


@query("stride_sample", f"WITH {ATOMS_SQL} SELECT frame, atom FROM atoms WHERE atom % 5 = 0")
def stride_sample(s: SparkSession, d: str) -> DataFrame:
    return atoms(s, d).where(F.col("atom") % 5 == 0).select("frame", "atom")


@query("min_image", f"WITH {ATOMS_SQL} SELECT frame, atom, round({MI.format(d='7 * x')}, 6) + 0.0 AS mx FROM atoms")
def min_image(s: SparkSession, d: str) -> DataFrame:
    return atoms(s, d).select("frame", "atom", r6(G.min_image(7 * F.col("x"), L), "mx"))


@query("wrap", f"WITH {ATOMS_SQL} SELECT frame, atom, round(-0.6 + ((9 * x + 0.6) - 1.2 * floor((9 * x + 0.6) / 1.2)), 5) + 0.0 AS wx FROM atoms")
def wrap(s: SparkSession, d: str) -> DataFrame:
    return atoms(s, d).select("frame", "atom", (F.round(G.wrap(9 * F.col("x"), -0.6, L), 5) + 0.0).alias("wx"))


@query("distance_angle", f"""WITH {ATOMS_SQL}, n AS (SELECT frame, atom, x, y, z, lead(x) OVER w AS bx, lead(y) OVER w AS by_, lead(z) OVER w AS bz FROM atoms WINDOW w AS (PARTITION BY atom ORDER BY frame))
SELECT frame, atom, round(sqrt((bx-x)*(bx-x) + (by_-y)*(by_-y) + (bz-z)*(bz-z)), 6) + 0.0 AS distance,
  round(degrees(acos(least(1.0, greatest(-1.0, (x*bx + y*by_ + z*bz) / (sqrt(x*x + y*y + z*z) * sqrt(bx*bx + by_*by_ + bz*bz)))))), 4) + 0.0 AS angle FROM n WHERE bx IS NOT NULL""")
def distance_angle(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("atom").orderBy("frame")
    a = atoms(s, d).withColumns({f"b{ax}": F.lead(ax).over(w) for ax in "xyz"}).where("bx IS NOT NULL")
    here, there = [F.col(c) for c in "xyz"], [F.col(f"b{c}") for c in "xyz"]
    return a.select("frame", "atom", r6(G.norm([q - p for p, q in zip(here, there, strict=True)]), "distance"), (F.round(G.angle_degrees(here, there), 4) + 0.0).alias("angle"))


@query("von_mises", f"WITH {ATOMS_SQL} SELECT frame, atom, round(sqrt(x*y*x*y + x*z*x*z + y*z*y*z + ((x-y)*(x-y) + (y-z)*(y-z) + (z-x)*(z-x)) / 6.0), 6) + 0.0 AS vm FROM atoms")
def von_mises(s: SparkSession, d: str) -> DataFrame:
    x, y, z = (F.col(c) for c in "xyz")
    return atoms(s, d).select("frame", "atom", r6(G.von_mises(x, y, z, x * y, x * z, y * z), "vm"))


@query("neighbours_periodic", f"WITH {PAIRS_SQL} SELECT frame, i, j, round(d, 6) + 0.0 AS d FROM pairs")
def neighbours_periodic(s: SparkSession, d: str) -> DataFrame:
    return blocks.links(atoms(s, d), RC, BOX).select("frame", "i", "j", r6(F.col("d"), "d"))


#: A box of its own for each frame: it grows, moves, and opens along z in every third frame.
FRAME_BOX_SQL = f"""{ATOMS_SQL}, cells AS (SELECT frame, 0.8 + 0.02 * frame AS size, frame % 3 <> 0 AS closed FROM (SELECT DISTINCT frame FROM atoms)),
fd AS (SELECT a.frame, a.atom AS i, b.atom AS j, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, size, closed FROM atoms a JOIN atoms b ON a.frame = b.frame AND a.atom <> b.atom JOIN cells c ON c.frame = a.frame),
fw AS (SELECT *, ux - size * round(ux / size) AS dx, uy - size * round(uy / size) AS dy, CASE WHEN closed THEN uz - size * round(uz / size) ELSE uz END AS dz FROM fd),
frame_pairs AS (SELECT frame, i, j, sqrt(dx*dx + dy*dy + dz*dz) AS d FROM fw WHERE dx*dx + dy*dy + dz*dz <= {RC} * {RC})"""


def frame_boxes(a: DataFrame) -> FrameBoxes:
    size, lo = 0.8 + 0.02 * F.col("frame"), 0.01 * F.col("frame") - 0.4
    return FrameBoxes(a.select("frame").distinct().select("frame", *[lo.alias(f"lo_{x}") for x in "xyz"], *[(lo + size).alias(f"hi_{x}") for x in "xyz"], F.lit(True).alias("per_x"), F.lit(True).alias("per_y"), (F.col("frame") % 3 != 0).alias("per_z")))


@query("neighbours_frame_box", f"WITH {FRAME_BOX_SQL} SELECT frame, i, j, round(d, 6) + 0.0 AS d FROM frame_pairs")
def neighbours_frame_box(s: SparkSession, d: str) -> DataFrame:
    a = atoms(s, d)
    return blocks.links(a, RC, frame_boxes(a)).select("frame", "i", "j", r6(F.col("d"), "d"))


@query("coordination_frame_box", f"WITH {FRAME_BOX_SQL}, n AS (SELECT a.frame, a.atom, count(p.j) AS n FROM atoms a LEFT JOIN frame_pairs p ON a.frame = p.frame AND a.atom = p.i GROUP BY 1, 2) SELECT frame, round(avg(n), 6) AS mean_coordination, max(n) AS most FROM n GROUP BY frame")
def coordination_frame_box(s: SparkSession, d: str) -> DataFrame:
    from .structure import coordination_numbers

    a = atoms(s, d)
    return coordination_numbers(a, a, RC, frame_boxes(a)).groupBy("frame").agg(F.round(F.avg("n"), 6).alias("mean_coordination"), F.max("n").alias("most"))


@query("k_nearest_frame_box", f"""WITH {ATOMS_SQL}, cells AS (SELECT frame, 0.8 + 0.02 * frame AS size, frame % 3 <> 0 AS closed FROM (SELECT DISTINCT frame FROM atoms)),
fd AS (SELECT a.frame, a.atom AS i, b.atom AS j, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, size, closed FROM atoms a JOIN atoms b ON a.frame = b.frame AND a.atom <> b.atom JOIN cells c ON c.frame = a.frame),
fw AS (SELECT frame, i, j, ux - size * round(ux / size) AS dx, uy - size * round(uy / size) AS dy, CASE WHEN closed THEN uz - size * round(uz / size) ELSE uz END AS dz FROM fd),
fr AS (SELECT frame, i, j, sqrt(dx*dx + dy*dy + dz*dz) AS d, row_number() OVER (PARTITION BY frame, i ORDER BY dx*dx + dy*dy + dz*dz, j) AS rn FROM fw) SELECT frame, i, j, CAST(rn AS INTEGER) AS rn, round(d, 6) + 0.0 AS d FROM fr WHERE rn <= 8""")
def k_nearest_frame_box(s: SparkSession, d: str) -> DataFrame:
    a = atoms(s, d)
    return neighbors.k_nearest(a, 8, frame_boxes(a)).select("frame", "i", "j", "rn", r6(F.col("d"), "d"))


OPEN_SQL = f"""{ATOMS_SQL}, open_pairs AS (SELECT a.frame, a.atom AS i, b.atom AS j, sqrt((b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) + (b.z-a.z)*(b.z-a.z)) AS d, a.element AS ei, b.element AS ej, a.label AS li, b.label AS lj
  FROM atoms a JOIN atoms b ON a.frame = b.frame AND a.atom <> b.atom WHERE (b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) + (b.z-a.z)*(b.z-a.z) <= {RC} * {RC})"""


@query("neighbours_open", f"WITH {OPEN_SQL} SELECT frame, i, j, round(d, 6) + 0.0 AS d FROM open_pairs")
def neighbours_open(s: SparkSession, d: str) -> DataFrame:
    return blocks.links(atoms(s, d), RC).select("frame", "i", "j", r6(F.col("d"), "d"))


@query("knn12", f"WITH {PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY frame, i ORDER BY d, j) AS rn FROM pairs) SELECT frame, i, j, CAST(rn AS INTEGER) AS rn, round(d, 6) + 0.0 AS d FROM r WHERE rn <= 12")
def knn12(s: SparkSession, d: str) -> DataFrame:
    return neighbors.nearest_within(atoms(s, d), 12, RC, BOX).select("frame", "i", "j", "rn", r6(F.col("d"), "d"))


@query("contacts_ab", f"WITH {OPEN_SQL} SELECT frame, count(*) AS contacts, round(min(d), 6) + 0.0 AS nearest FROM open_pairs WHERE li = 0 AND lj = 1 GROUP BY frame")
def contacts_ab(s: SparkSession, d: str) -> DataFrame:
    a = atoms(s, d)
    return neighbors.range_join(a.where("label = 0"), a.where("label = 1"), RC).groupBy("frame").agg(F.count("*").alias("contacts"), r6(F.min("d"), "nearest"))


@query("min_interface_distance", f"""WITH {ATOMS_SQL} SELECT a.frame, round(min(sqrt((b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) + (b.z-a.z)*(b.z-a.z))), 6) + 0.0 AS nearest
  FROM atoms a JOIN atoms b ON a.frame = b.frame WHERE a.label = 0 AND b.label = 1 GROUP BY a.frame""")
def min_interface_distance(s: SparkSession, d: str) -> DataFrame:
    from ..operators.interactions import interface_distance

    a = atoms(s, d)
    return interface_distance(a.where("label = 0"), a.where("label = 1"), 0.05).select("frame", r6(F.col("nearest"), "nearest"))


@query("ref_displacement", f"""WITH {ATOMS_SQL} SELECT a.frame, a.atom, round(sqrt(({MI.format(d='a.x - r.x')})*({MI.format(d='a.x - r.x')}) + ({MI.format(d='a.y - r.y')})*({MI.format(d='a.y - r.y')}) + ({MI.format(d='a.z - r.z')})*({MI.format(d='a.z - r.z')})), 6) + 0.0 AS moved
  FROM atoms a JOIN atoms r ON r.frame = 0 AND a.id = r.id""")
def ref_displacement(s: SparkSession, d: str) -> DataFrame:
    j = joins.reference_join(atoms(s, d), 0, use_ids=True)
    return j.select("frame", "atom", r6(G.norm([G.min_image(v, L) for v in G.delta("r_", "")]), "moved"))


@query("residue_slots", f"""WITH {ATOMS_SQL}, k AS (SELECT *, CAST(label AS VARCHAR) AS c, 'R' || (id % 7) AS n FROM atoms), f AS (SELECT frame, c, n, min(atom) AS first FROM k GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY first) - 1 AS slot FROM f) SELECT k.frame, k.atom, s.slot FROM k JOIN s USING (frame, c, n)""")
def residue_slots(s: SparkSession, d: str) -> DataFrame:
    a = atoms(s, d).select("frame", "atom", F.col("label").cast("string").alias("chain"), F.concat(F.lit("r"), F.col("id") % 7).alias("resname"), F.lit("1").alias("resid"))
    return joins.residue_slots(a, "chain", "resname", "resid").select("frame", "atom", F.col("slot").cast("long").alias("slot"))


@query("rdf", f"""WITH {PAIRS_SQL}, b AS (SELECT frame, least(24, CAST(floor(d / {RC / 25}) AS INTEGER)) AS bin, count(*) AS n FROM pairs WHERE d < {RC} GROUP BY ALL), c AS (SELECT frame, count(*) AS n_atoms FROM atoms GROUP BY frame),
g AS (SELECT frame, n_atoms, CAST(unnest(range(0, 25)) AS INTEGER) AS bin FROM c)
SELECT g.frame, g.bin, coalesce(b.n, 0) AS n, round(coalesce(b.n, 0) / (n_atoms * ((n_atoms - 1) / 1.728) * (4.0 / 3.0 * pi() * (pow((g.bin + 1) * {RC / 25}, 3) - pow(g.bin * {RC / 25}, 3)))), 6) + 0.0 AS g FROM g LEFT JOIN b ON g.frame = b.frame AND g.bin = b.bin""")
def rdf(s: SparkSession, d: str) -> DataFrame:
    from .structure import pair_distribution

    return pair_distribution(atoms(s, d), BOX, RC, 25).select("frame", "bin", "n", r6(F.col("g"), "g"))


@query("coordination", f"WITH {PAIRS_SQL}, n AS (SELECT frame, i, count(*) AS n FROM pairs GROUP BY ALL), c AS (SELECT frame, atom FROM atoms) SELECT c.frame, round(avg(coalesce(n.n, 0)), 6) + 0.0 AS mean_coordination, CAST(max(coalesce(n.n, 0)) AS BIGINT) AS most FROM c LEFT JOIN n ON c.frame = n.frame AND c.atom = n.i GROUP BY c.frame")
def coordination(s: SparkSession, d: str) -> DataFrame:
    from .structure import coordination_numbers

    a = atoms(s, d)
    return coordination_numbers(a, a, RC, BOX).groupBy("frame").agg(r6(F.avg("n"), "mean_coordination"), F.max("n").alias("most"))


@query("consecutive_step", f"WITH {ATOMS_SQL}, s AS (SELECT frame, atom, x - lag(x) OVER (PARTITION BY atom ORDER BY frame) AS d FROM atoms) SELECT frame, atom, round({MI.format(d='d')}, 6) + 0.0 AS step_x FROM s WHERE d IS NOT NULL")
def consecutive_step(s: SparkSession, d: str) -> DataFrame:
    return windows.steps(atoms(s, d), BOX).where("sx IS NOT NULL").select("frame", "atom", r6(F.col("sx"), "step_x"))


MSD_SQL = f"""{ATOMS_SQL}, st AS (SELECT frame, atom, {', '.join(f"coalesce({MI.format(d=f'{c} - lag({c}) OVER (PARTITION BY atom ORDER BY frame)')}, 0) AS s{c}" for c in 'xyz')} FROM atoms),
un AS (SELECT frame, atom, {', '.join(f'sum(s{c}) OVER (PARTITION BY atom ORDER BY frame) AS u{c}' for c in 'xyz')} FROM st), msd AS (SELECT frame, avg(ux*ux + uy*uy + uz*uz) AS msd FROM un GROUP BY frame)"""


@query("unwrap_msd", f"WITH {MSD_SQL} SELECT frame, round(msd, 6) + 0.0 AS msd FROM msd")
def unwrap_msd(s: SparkSession, d: str) -> DataFrame:
    return windows.mean_square_displacement(atoms(s, d), BOX).select("frame", r6(F.col("msd"), "msd"))


@query("msd_from_middle", f"""WITH {MSD_SQL}, r AS (SELECT atom, ux, uy, uz FROM un WHERE frame = 10)
SELECT u.frame, round(avg((u.ux-r.ux)*(u.ux-r.ux) + (u.uy-r.uy)*(u.uy-r.uy) + (u.uz-r.uz)*(u.uz-r.uz)), 6) + 0.0 AS msd FROM un u JOIN r USING (atom) GROUP BY u.frame""")
def msd_from_middle(s: SparkSession, d: str) -> DataFrame:
    return windows.mean_square_displacement(atoms(s, d), BOX, 10).select("frame", r6(F.col("msd"), "msd"))


@query("diffusion_fit", f"""WITH {MSD_SQL}, f AS (SELECT regr_slope(msd, frame * 1.0) AS slope, count(*) AS n, regr_sxx(msd, frame * 1.0) AS sxx, regr_syy(msd, frame * 1.0) AS syy, regr_sxy(msd, frame * 1.0) AS sxy FROM msd WHERE frame >= 4)
SELECT n AS fitted, round(slope / 6, 6) + 0.0 AS diffusion, round(sqrt(greatest(0, syy - sxy * sxy / sxx) / (n - 2) / sxx) / 6, 6) + 0.0 AS error FROM f""")
def diffusion_fit(s: SparkSession, d: str) -> DataFrame:
    msd = windows.mean_square_displacement(atoms(s, d), BOX).where("frame >= 4").withColumn("t", F.col("frame") * 1.0)
    return msd.agg(F.count("*").alias("fitted"), *stats.ols("t", "msd")).select("fitted", r6(F.col("slope") / 6, "diffusion"), r6(F.col("slope_error") / 6, "error"))


@query("smooth5", f"WITH {MSD_SQL} SELECT frame, round(avg(msd) OVER (ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0.0 AS smooth FROM msd")
def smooth5(s: SparkSession, d: str) -> DataFrame:
    msd = windows.mean_square_displacement(atoms(s, d), BOX).withColumn("one", F.lit(1))
    return windows.moving_average(msd, "msd", "frame", ["one"]).select("frame", r6(F.col("smooth"), "smooth"))


@query("com", f"WITH {SPECIES_SQL} SELECT frame, round(sum(m * x) / sum(m), 6) + 0.0 AS cx, round(sum(m * y) / sum(m), 6) + 0.0 AS cy, round(sum(m * z) / sum(m), 6) + 0.0 AS cz FROM sp GROUP BY frame")
def com(s: SparkSession, d: str) -> DataFrame:
    m = units.mass(F.col("element"))
    return species(s, d).groupBy("frame").agg(*[r6(F.sum(m * F.col(c)) / F.sum(m), f"c{c}") for c in "xyz"])


@query("radius_gyration", f"WITH {SPECIES_SQL}, c AS (SELECT frame, sum(m * x) / sum(m) AS cx, sum(m * y) / sum(m) AS cy, sum(m * z) / sum(m) AS cz FROM sp GROUP BY frame) SELECT frame, round(sqrt(sum(m * ((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz))) / sum(m)), 6) + 0.0 AS rg FROM sp JOIN c USING (frame) GROUP BY frame")
def radius_gyration(s: SparkSession, d: str) -> DataFrame:
    from .conformation import gyration

    return gyration(species(s, d)).select("frame", r6(F.col("rg"), "rg"))


@query("rmsf_unfitted", f"WITH {ATOMS_SQL} SELECT atom, round(sqrt(greatest(0, avg(x*x + y*y + z*z) - avg(x)*avg(x) - avg(y)*avg(y) - avg(z)*avg(z))), 6) + 0.0 AS rmsf FROM atoms GROUP BY atom")
def rmsf_unfitted(s: SparkSession, d: str) -> DataFrame:
    from .conformation import fluctuation

    return fluctuation(atoms(s, d)).select("atom", r6(F.col("rmsf"), "rmsf"))


@query("connected_components", f"""WITH RECURSIVE {OPEN_SQL}, e AS (SELECT frame, i, j FROM open_pairs), r AS (SELECT frame, atom AS node, atom AS label FROM atoms UNION SELECT e.frame, e.j, r.label FROM r JOIN e ON e.frame = r.frame AND e.i = r.node)
SELECT frame, node, min(label) AS label FROM r GROUP BY frame, node""")
def connected_components(s: SparkSession, d: str) -> DataFrame:
    a = atoms(s, d)
    key = lambda c: F.shiftleft(F.col("frame").cast("long"), 32) + F.col(c)
    pairs = blocks.spanning(a, RC).select(key("i").alias("a"), key("j").alias("b"))
    labels = graph.connected_components(a.select(key("atom").alias("node")), pairs)
    atom = lambda c: F.col(c).bitwiseAND(F.lit(2**32 - 1)).cast("int").alias(c)
    return labels.select(F.shiftright("node", 32).cast("int").alias("frame"), atom("node"), atom("label"))


@query("deformation_gradient", f"""WITH {ATOMS_SQL}, rp AS (SELECT a.atom AS i, b.atom AS j, {MI.format(d='b.x - a.x')} AS rx, {MI.format(d='b.y - a.y')} AS ry, {MI.format(d='b.z - a.z')} AS rz FROM atoms a JOIN atoms b ON a.frame = 0 AND b.frame = 0 AND a.atom <> b.atom),
n AS (SELECT * FROM rp WHERE rx*rx + ry*ry + rz*rz <= {0.2 * 0.2}), c AS (SELECT n.*, p.frame, {MI.format(d='q.x - p.x')} AS cx, {MI.format(d='q.y - p.y')} AS cy, {MI.format(d='q.z - p.z')} AS cz FROM n JOIN atoms p ON p.frame > 0 AND p.atom = i JOIN atoms q ON q.frame = p.frame AND q.atom = j)
SELECT frame, i AS atom, count(*) AS n, round(sum(rx*rx), 6) + 0.0 AS v00, round(sum(rx*ry), 6) + 0.0 AS v01, round(sum(rz*rz), 6) + 0.0 AS v22, round(sum(rx*cx), 6) + 0.0 AS w00, round(sum(ry*cx), 6) + 0.0 AS w10, round(sum(cx*cx + cy*cy + cz*cz), 6) + 0.0 AS dd FROM c GROUP BY frame, i""")
def deformation_gradient(s: SparkSession, d: str) -> DataFrame:
    from .mechanics import affine_sums

    sums = affine_sums(atoms(s, d), 0, 0.2, BOX).where("frame > 0")
    return sums.select("frame", "atom", "n", *[r6(F.col(c), c) for c in ("v00", "v01", "v22", "w00", "w10", "dd")])


@query("histogram_bins", f"""WITH RECURSIVE {SLAB_SQL}, m AS (SELECT min(x) AS lo, max(x) AS hi, greatest(0.5, (max(x) - min(x)) / 12) AS w FROM slab),
e AS (SELECT 0 AS bin, lo AS a, w, hi FROM m UNION ALL SELECT bin + 1, a + w, w, hi FROM e WHERE a + w < hi)
SELECT bin, round(a, 6) + 0.0 AS lo, (SELECT count(*) FROM slab WHERE x >= e.a AND (x < e.a + e.w OR (e.a + e.w >= e.hi AND x <= e.a + e.w))) AS count FROM e""")
def histogram_bins(s: SparkSession, d: str) -> DataFrame:
    rows = slab(s, d)
    lo, hi = rows.agg(F.min("x"), F.max("x")).first()
    return binning.histogram(rows, "x", binning.bin_edges(lo, hi, 12)).select("bin", r6(F.col("lo"), "lo"), "count")


@query("profile_mean", f"""WITH RECURSIVE {SLAB_SQL}, m AS (SELECT min(z) AS lo, max(z) AS hi, greatest(0.5, (max(z) - min(z)) / 24) AS w FROM slab),
e AS (SELECT 0 AS bin, lo AS a, w, hi FROM m UNION ALL SELECT bin + 1, a + w, w, hi FROM e WHERE a + w < hi)
SELECT e.bin, count(s.z) AS count, round(coalesce(avg(s.charge), 0), 6) + 0.0 AS value FROM e LEFT JOIN slab s ON s.z >= e.a AND (s.z < e.a + e.w OR (e.a + e.w >= e.hi AND s.z <= e.a + e.w)) GROUP BY e.bin""")
def profile_mean(s: SparkSession, d: str) -> DataFrame:
    rows = slab(s, d)
    lo, hi = rows.agg(F.min("z"), F.max("z")).first()
    return binning.profile(rows, "z", "charge", binning.bin_edges(lo, hi, 24)).select("bin", "count", r6(F.col("value"), "value"))


@query("column_stats", f"WITH {SLAB_SQL} SELECT element, round(min(z), 6) AS lo, round(avg(z), 6) AS mean, round(max(z), 6) AS hi, round(sqrt(avg(z*z) - avg(z)*avg(z)), 6) AS std, round(stddev_samp(z), 6) AS sample_std FROM slab GROUP BY element")
def column_stats(s: SparkSession, d: str) -> DataFrame:
    return slab(s, d).groupBy("element").agg(F.round(F.min("z"), 6).alias("lo"), F.round(F.avg("z"), 6).alias("mean"), F.round(F.max("z"), 6).alias("hi"), F.round(stats.population_std(F.col("z")), 6).alias("std"), F.round(F.stddev_samp("z"), 6).alias("sample_std"))


SURFACE_SQL = f"{SLAB_SQL}, t AS (SELECT z, row_number() OVER (ORDER BY z DESC) AS r, count(*) OVER () AS n FROM slab WHERE element = 'N'), sf AS (SELECT avg(z) FILTER (r <= greatest(1, n // 20)) AS surface, max(z) AS top FROM t)"


@query("surface_plane", f"WITH {SURFACE_SQL} SELECT round(surface, 6) AS surface, round(top, 6) AS top FROM sf")
def surface_plane(s: SparkSession, d: str) -> DataFrame:
    from .surfaces import surface

    return surface(slab(s, d).withColumn("frame", F.lit(0)), "N").select(F.round("surface", 6).alias("surface"), F.round("top", 6).alias("top"))


@query("penetration", f"""WITH {SURFACE_SQL}, p AS (SELECT z - surface AS rel, charge FROM slab, sf WHERE element = 'R')
SELECT count(*) FILTER (rel < 0) AS penetrated, count(*) FILTER (rel >= 0 AND rel < 2.5) AS at_surface, count(*) FILTER (rel >= 2.5) AS above, round(max(-rel) FILTER (rel < 0), 6) AS deepest, round(min(-rel) FILTER (rel < 0), 6) AS shallowest, round(avg(-rel) FILTER (rel < 0), 6) AS mean_depth, round(avg(charge) FILTER (rel < 2.5), 6) AS bound_charge FROM p""")
def penetration(s: SparkSession, d: str) -> DataFrame:
    from .surfaces import penetration as depths

    rows = depths(slab(s, d).withColumn("frame", F.lit(0)), "N", "R")
    return rows.select("penetrated", "at_surface", "above", *[F.round(c, 6).alias(c) for c in ("deepest", "shallowest", "mean_depth", "bound_charge")])


@query("nearest_rank_pct", f"WITH {SLAB_SQL}, r AS (SELECT element, z, row_number() OVER (PARTITION BY element ORDER BY z) - 1 AS r, count(*) OVER (PARTITION BY element) AS n FROM slab) SELECT element, round(z, 6) AS p95 FROM r WHERE r = CAST(round(CAST(0.95 * (n - 1) AS DOUBLE)) AS BIGINT)")
def nearest_rank_pct(s: SparkSession, d: str) -> DataFrame:
    return stats.nearest_rank(slab(s, d), "z", 0.95, ["element"]).select("element", F.round("z", 6).alias("p95"))


@query("linear_pct", f"WITH {SLAB_SQL} SELECT element, round(quantile_cont(x, 0.025), 6) AS lo, round(quantile_cont(x, 0.975), 6) AS hi FROM slab GROUP BY element")
def linear_pct(s: SparkSession, d: str) -> DataFrame:
    return stats.linear_ranks(slab(s, d), "x", {"lo": 0.025, "hi": 0.975}, ["element"]).select("element", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("class_fractions", f"WITH {ATOMS_SQL} SELECT frame, element, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY frame), 6) AS percent FROM atoms GROUP BY frame, element")
def class_fractions(s: SparkSession, d: str) -> DataFrame:
    c = atoms(s, d).groupBy("frame", "element").agg(F.count("*").alias("n"))
    return c.select("frame", "element", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("frame")), 6).alias("percent"))


@query("top5_per_frame", f"WITH {ATOMS_SQL}, r AS (SELECT frame, atom, charge, row_number() OVER (PARTITION BY frame ORDER BY x DESC, atom) AS rank FROM atoms) SELECT frame, atom, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def top5_per_frame(s: SparkSession, d: str) -> DataFrame:
    return groups.ranked(atoms(s, d), ["frame"], 5, F.desc("x"), F.col("atom")).select("frame", "atom", "rank")


FLAG_SQL = f"{ATOMS_SQL}, fl AS (SELECT frame, atom, x > 0 AS on_ FROM atoms), ru AS (SELECT atom, frame, frame - row_number() OVER (PARTITION BY atom ORDER BY frame) AS g FROM fl WHERE on_), il AS (SELECT atom, min(frame) AS start, max(frame) AS stop, count(*) AS length FROM ru GROUP BY atom, g)"


@query("islands_lifetime", f"WITH {FLAG_SQL} SELECT atom, start, stop, length FROM il")
def islands_lifetime(s: SparkSession, d: str) -> DataFrame:
    return windows.islands(atoms(s, d).withColumn("on", F.col("x") > 0), "on", "frame", ["atom"])


@query("occupancy", f"WITH {FLAG_SQL} SELECT atom, round(sum(length) / 21.0, 6) AS occupancy, round(sum(length) / count(*) * 2.0, 6) AS lifetime, count(*) AS events FROM il GROUP BY atom")
def occupancy(s: SparkSession, d: str) -> DataFrame:
    o = windows.occupancy(atoms(s, d).withColumn("on", F.col("x") > 0), "on", "frame", ["atom"], 21, 2.0)
    return o.select("atom", F.round("occupancy", 6).alias("occupancy"), F.round("lifetime", 6).alias("lifetime"), "events")


@query("nice_length", f"WITH {ATOMS_SQL}, t AS (SELECT frame, atom, abs(x) * 37 AS t FROM atoms WHERE x <> 0), b AS (SELECT *, pow(10.0, floor(log10(t))) AS b FROM t), o AS (SELECT frame, atom, b * unnest([1.0, 2.0, 5.0, 10.0]) AS v, t FROM b) SELECT frame, atom, round(min_by(v, abs(v - t)), 9) AS nice FROM o GROUP BY frame, atom")
def nice_length(s: SparkSession, d: str) -> DataFrame:
    return atoms(s, d).where("x <> 0").select("frame", "atom", F.round(G.nice_length(F.abs("x") * 37), 9).alias("nice"))


@query("equivalent_diameter", f"WITH {ATOMS_SQL} SELECT frame, element, round(2.0 * cbrt(3.0 * count(*) * 11.8 / (4.0 * {math.pi})), 6) AS diameter FROM atoms GROUP BY frame, element")
def equivalent_diameter(s: SparkSession, d: str) -> DataFrame:
    return atoms(s, d).groupBy("frame", "element").agg(F.round(G.equivalent_diameter(F.count("*"), 11.8), 6).alias("diameter"))


@query("bonds", f"WITH {SPECIES_SQL} SELECT a.frame, a.atom AS i, b.atom AS j FROM sp a JOIN sp b ON a.frame = b.frame AND a.atom < b.atom WHERE sqrt((b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) + (b.z-a.z)*(b.z-a.z)) * 20 BETWEEN 0.05000001 AND 1.15 * (a.radius + b.radius)")
def bonds(s: SparkSession, d: str) -> DataFrame:
    from .bonding import perceive_bonds

    scaled = species(s, d).withColumns({c: F.col(c) * 20 for c in "xyz"})
    return perceive_bonds(scaled, 1.15, measured=False).select("frame", "i", "j")


@query("model_space", f"WITH {ATOMS_SQL}, b AS (SELECT min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_, min(z) AS az, max(z) AS bz FROM atoms) SELECT frame, atom, round((x - (ax + bx) / 2) * 1.8 / greatest(bx - ax, by_ - ay, bz - az), 6) + 0.0 AS mx FROM atoms, b")
def model_space(s: SparkSession, d: str) -> DataFrame:
    from .views import normalised

    return normalised(atoms(s, d)).select("frame", "atom", r6(F.col("mx"), "mx"))
