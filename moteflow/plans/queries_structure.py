"""Registered queries on structure, conformations and interactions; those without SQL are iterative or fit matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import ATOMS_SQL, BOX, N_FRAMES, atoms, replicas
from ..operators import graph, interactions, neighbors, stats
from ..operators.bootstrap import bootstrap_interval
from . import conformation, structure
from .queries_points import PAIRS_SQL, RC, r6
from .registry_queries import query


ALL_TEMPLATES = tuple(structure.TEMPLATES)


@query("bond_order_l2", f"""WITH {PAIRS_SQL}, y AS (SELECT frame, i, count(*) AS n, avg(3*dz*dz/(d*d) - 1) AS a, avg(dx*dz/(d*d)) AS b, avg(dy*dz/(d*d)) AS c, avg((dx*dx - dy*dy)/(d*d)) AS e, avg(dx*dy/(d*d)) AS f FROM pairs GROUP BY frame, i),
o AS (SELECT t.frame, t.atom AS i, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(e, 0) AS e, coalesce(f, 0) AS f FROM atoms t LEFT JOIN y ON t.frame = y.frame AND t.atom = y.i),
s AS (SELECT frame, i AS centre, j AS i FROM pairs UNION ALL SELECT frame, atom, atom FROM atoms),
m AS (SELECT s.frame, s.centre AS atom, avg(a) AS a, avg(b) AS b, avg(c) AS c, avg(e) AS e, avg(f) AS f FROM s JOIN o ON s.frame = o.frame AND s.i = o.i GROUP BY s.frame, s.centre)
SELECT frame, atom, round(sqrt(0.25*a*a + 3*(b*b + c*c) + 0.75*e*e + 3*f*f), 6) + 0.0 AS q FROM m""")
def bond_order_l2(s: SparkSession, d: str) -> DataFrame:
    return structure.bond_order_within(atoms(s, d), RC, BOX, 2).select("frame", "atom", r6(F.col("q"), "q"))


@query("q6_bond_order")
def q6_bond_order(s: SparkSession, d: str) -> DataFrame:
    a = atoms(s, d)
    return structure.bond_order(structure.nearest_shells(a, 12, BOX), a, 6).select("frame", "atom", r6(F.col("q"), "q6"))


@query("acna")
def acna(s: SparkSession, d: str) -> DataFrame:
    a = atoms(s, d)
    return structure.common_neighbour_classes(a, structure.nearest_shells(a, 14, BOX))


@query("ptm")
def ptm(s: SparkSession, d: str) -> DataFrame:
    a = atoms(s, d)
    return structure.template_matches(a, structure.nearest_shells(a, 14, BOX), ALL_TEMPLATES, 0.3).select("frame", "atom", "class", r6(F.col("rmsd"), "rmsd"))


@query("grains")
def grains(s: SparkSession, d: str) -> DataFrame:
    a = atoms(s, d)
    near = structure.nearest_shells(a, 14, BOX)
    matches = graph.written(structure.template_matches(a, near, ALL_TEMPLATES, 0.3), "matches")
    pairs = graph.written(neighbors.neighbours(a, neighbors.shell_reach(near, a), BOX).select("frame", "i", "j"), "pairs")
    return structure.grains(a, matches, pairs, 15.0)


@query("superposition_rmsd")
def superposition_rmsd(s: SparkSession, d: str) -> DataFrame:
    return conformation.fits(atoms(s, d), 0).select("frame", r6(F.col("rmsd"), "rmsd"), r6(F.col("unfitted"), "unfitted"))


@query("rmsd_unfitted", f"WITH {ATOMS_SQL} SELECT a.frame, round(sqrt(avg((a.x-r.x)*(a.x-r.x) + (a.y-r.y)*(a.y-r.y) + (a.z-r.z)*(a.z-r.z))), 6) + 0.0 AS rmsd FROM atoms a JOIN atoms r ON r.frame = 0 AND a.atom = r.atom GROUP BY a.frame")
def rmsd_unfitted(s: SparkSession, d: str) -> DataFrame:
    return conformation.fits(atoms(s, d), 0).select("frame", r6(F.col("unfitted"), "rmsd"))


@query("kmedoids")
def kmedoids(s: SparkSession, d: str) -> DataFrame:
    return conformation.clusters(atoms(s, d), 4)


@query("gromos")
def gromos(s: SparkSession, d: str) -> DataFrame:
    return conformation.clusters(atoms(s, d), cutoff=0.21)


@query("pca")
def pca(s: SparkSession, d: str) -> DataFrame:
    table, _ = conformation.principal_components(atoms(s, d), 2)
    return table.select("frame", r6(F.abs("p1"), "p1"), r6(F.abs("p2"), "p2"))


@query("bootstrap_ci")
def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    runs = replicas(s, d).withColumn("ord", F.col("replica"))
    lo, hi = bootstrap_interval(runs, 2000)
    mean = stats.half_survival_time(runs, "t", "censored", ["seed"]).agg(F.avg("tau")).first()[0]
    return s.createDataFrame([(lo, hi, mean)], "low double, high double, tau double")


SCALED_SQL = f"{ATOMS_SQL}, sc AS (SELECT frame, atom, 14 * x AS x, 14 * y AS y, 14 * z AS z, label % 2 = 0 AS in_a, CASE atom % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'H' ELSE 'O' END AS el FROM atoms)"


@query("hbond_three_way", f"""WITH {SCALED_SQL}, dh AS (SELECT p.frame, p.atom AS donor, h.x - p.x AS hx, h.y - p.y AS hy, h.z - p.z AS hz FROM sc p JOIN sc h ON p.frame = h.frame AND h.el = 'H' AND p.el <> 'H' WHERE (h.x-p.x)*(h.x-p.x) + (h.y-p.y)*(h.y-p.y) + (h.z-p.z)*(h.z-p.z) <= 1.2 * 1.2),
da AS (SELECT p.frame, p.atom AS donor, q.atom AS acceptor, q.x - p.x AS ax, q.y - p.y AS ay, q.z - p.z AS az FROM sc p JOIN sc q ON p.frame = q.frame AND p.atom <> q.atom AND p.el <> 'H' AND q.el <> 'H' AND p.in_a <> q.in_a WHERE sqrt((q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z)) < 3.5),
b AS (SELECT frame, donor, acceptor, degrees(acos(greatest(-1.0, least(1.0, (-hx*(ax-hx) - hy*(ay-hy) - hz*(az-hz)) / (sqrt(hx*hx+hy*hy+hz*hz) * sqrt((ax-hx)*(ax-hx)+(ay-hy)*(ay-hy)+(az-hz)*(az-hz))))))) AS angle FROM dh JOIN da USING (frame, donor))
SELECT DISTINCT frame, donor, acceptor FROM b WHERE angle > 120""")
def hbond_three_way(s: SparkSession, d: str) -> DataFrame:
    a = atoms(s, d).withColumns({c: 14 * F.col(c) for c in "xyz"}).withColumn("in_a", F.col("label") % 2 == 0).withColumn("in_b", ~F.col("in_a"))
    a = a.withColumn("element", F.element_at(F.array(F.lit("N"), F.lit("H"), F.lit("O")), F.col("atom") % 3 + 1))
    return interactions.hydrogen_bonds(a, measured=False).select("frame", "donor", "acceptor")


@query("contact_frequency", f"""WITH {ATOMS_SQL} SELECT a.atom % 7 AS residue, round(count(DISTINCT a.frame) / 21.0, 6) AS frequency FROM atoms a JOIN atoms b ON a.frame = b.frame AND a.label = 0 AND b.label = 1 WHERE (b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) + (b.z-a.z)*(b.z-a.z) <= 0.04 * 0.04 GROUP BY 1""")
def contact_frequency(s: SparkSession, d: str) -> DataFrame:
    a = atoms(s, d)
    near = neighbors.range_join(a.where("label = 0"), a.where("label = 1"), 0.04)
    return near.groupBy((F.col("i") % 7).alias("residue")).agg(F.round(F.count_distinct("frame") / float(N_FRAMES), 6).alias("frequency"))


@query("relative_height", f"WITH {ATOMS_SQL} SELECT a.frame, a.atom, round(a.z - avg(a.z) OVER (PARTITION BY a.frame), 6) + 0.0 AS dz FROM atoms a")
def relative_height(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return atoms(s, d).select("frame", "atom", r6(F.col("z") - F.avg("z").over(Window.partitionBy("frame")), "dz"))
