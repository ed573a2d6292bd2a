"""Registered queries on the data behind pictures, on lists of runs and on the functions for SQL texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import ATOMS_SQL, BOX, SPECIES_SQL, atoms, species
from ..functions import sql
from . import jobs, views
from .queries_points import PAIRS_SQL, RC, r6
from .registry_queries import query

ENDS = ("x0", "y0", "z0", "x1", "y1", "z1")


def half_sql(end: str) -> str:
    cells = [f"round({end}.{c}, 6) + 0.0 AS {c}0" for c in "xyz"] + [f"round((a.{c} + b.{c}) / 2, 6) + 0.0 AS {c}1" for c in "xyz"]
    return f"SELECT p.frame, {end}.atom, {', '.join(cells)} FROM pairs p JOIN atoms a ON a.frame = p.frame AND a.atom = p.i JOIN atoms b ON b.frame = p.frame AND b.atom = p.j WHERE p.i < p.j"


@query("half_bonds", f"WITH {PAIRS_SQL} {half_sql('a')} UNION ALL {half_sql('b')}")
def half_bonds(s: SparkSession, d: str) -> DataFrame:
    return views.half_links(atoms(s, d), RC, BOX).select("frame", "atom", *[r6(F.col(c), c) for c in ENDS])


LO, HI = -0.2, 0.3
#: The map's control points as the SQL has them.
COOLWARM_SQL = """[[0.230, 0.299, 0.754], [0.406, 0.538, 0.934], [0.602, 0.731, 0.999], [0.788, 0.846, 0.939], [0.867, 0.867, 0.867], [0.941, 0.802, 0.732], [0.958, 0.648, 0.529], [0.887, 0.446, 0.361], [0.706, 0.016, 0.150]]"""
SHADE = "round(CASE WHEN k >= 8 THEN m[9][{0}] ELSE m[k + 1][{0}] * (1 - (t * 8 - k)) + m[k + 2][{0}] * (t * 8 - k) END, 6) + 0.0 AS {1}"


@query("field_colors", f"WITH {ATOMS_SQL}, v AS (SELECT frame, atom, least(1.0, greatest(0.0, (charge - {LO}) / ({HI} - {LO}))) AS t FROM atoms), k AS (SELECT *, CAST(floor(t * 8) AS INTEGER) AS k, CAST({COOLWARM_SQL} AS DOUBLE[][]) AS m FROM v) SELECT frame, atom, " + ", ".join(SHADE.format(i, c) for i, c in enumerate("rgb", 1)) + " FROM k")
def field_colors(s: SparkSession, d: str) -> DataFrame:
    rows = atoms(s, d).select("frame", "atom", views.color(F.col("charge"), LO, HI, "coolwarm").alias("c"))
    return rows.select("frame", "atom", *[r6(F.col(f"c.{c}"), c) for c in "rgb"])


@query("element_hues", f"WITH {SPECIES_SQL}, e AS (SELECT DISTINCT element FROM (SELECT element FROM atoms UNION ALL SELECT element FROM sp)) SELECT element, CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(element, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 360 AS INTEGER) AS hue FROM e")
def element_hues(s: SparkSession, d: str) -> DataFrame:
    names = atoms(s, d).select("element").unionByName(species(s, d).select("element")).distinct()
    return names.select("element", views.element_hue(F.col("element")).alias("hue"))


NOW = "1998-08-02 12:00:00"
STATES = {"F": "done", "O": "running", "P": "failed"}
JOBS_SQL = f"""j AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END AS state, CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate END AS created,
  CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 90) / 10000.0 ELSE (o_orderkey % 700) / 100.0 END AS cost, CASE WHEN o_custkey % 4 > 0 THEN o_custkey * 7 % 9000 END AS billed, CASE WHEN o_orderstatus = 'P' THEN 'wall_limit' END AS error FROM orders),
s AS (SELECT *, CASE WHEN billed > 0 THEN billed WHEN created IS NOT NULL THEN greatest(0, epoch(TIMESTAMP '{NOW}')::BIGINT - epoch(created)::BIGINT) END AS took FROM j)"""


@query("job_rows", f"""WITH {JOBS_SQL} SELECT id, CASE state WHEN 'done' THEN 'done' WHEN 'running' THEN 'running' ELSE 'failed' END AS tint, CASE WHEN cost <= 0 THEN '$0' WHEN cost < 0.01 THEN printf('$%.4f', cost) ELSE printf('$%.2f', cost) END AS cost,
  CASE WHEN took IS NULL THEN '—' WHEN took < 60 THEN took || 's' WHEN took < 3600 THEN (took // 60) || 'm ' || (took % 60) || 's' ELSE (took // 3600) || 'h ' || (took % 3600 // 60) || 'm' END AS elapsed,
  CASE WHEN error IS NOT NULL THEN 'hit its wall-clock cap' END AS detail,
  CASE WHEN created IS NULL THEN 'Undated' WHEN CAST(created AS DATE) = DATE '1998-08-02' THEN 'Today' WHEN CAST(created AS DATE) = DATE '1998-08-01' THEN 'Yesterday' WHEN year(created) = 1998 THEN strftime(created, '%b %-d') ELSE strftime(created, '%b %-d, %Y') END AS title,
  state <> 'running' AS terminal, id || ': ' || state || CASE WHEN cost > 0 THEN printf('  $%.4f', cost) ELSE '' END || CASE WHEN billed > 0 THEN ' (' || billed || ' s billed)' ELSE '' END || CASE WHEN error IS NOT NULL THEN '  error: ' || error ELSE '' END AS summary FROM s""")
def job_rows(s: SparkSession, d: str) -> DataFrame:
    """orders as runs: the status is the state, the date the creation, missing for a part of them."""
    o, k = s.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey")
    runs = o.select(
        k.alias("id"), jobs.lookup(F.col("o_orderstatus"), STATES, F.lit("failed")).alias("state"), F.when(k % 11 > 0, F.col("o_orderdate")).alias("created"),
        F.when(k % 3 == 0, (k % 90) / 10000.0).otherwise((k % 700) / 100.0).alias("cost_usd"), F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey") * 7 % 9000).alias("billed_s"), F.when(F.col("o_orderstatus") == "P", "wall_limit").alias("error"),
    )
    return jobs.job_rows(runs, F.lit(NOW).cast("timestamp")).select("id", "tint", "cost", "elapsed", "detail", "title", "terminal", "summary")


@query("sql_functions", f"WITH {ATOMS_SQL} SELECT frame, atom, round(x - 0.3 * round(x / 0.3), 6) + 0.0 AS mi, round(x - 0.3 * floor((x + 0.1) / 0.3), 6) + 0.0 AS wr, CAST(least(atom % 360 % 90, 90 - atom % 360 % 90) AS DOUBLE) AS dis FROM atoms")
def sql_functions(s: SparkSession, d: str) -> DataFrame:
    """The functions as a SQL text calls them; a turn about one axis of the cube is known in closed form."""
    sql.register(s)
    turned = "array(cos(radians(atom % 360) / 2), 0D, 0D, sin(radians(atom % 360) / 2))"
    return s.sql(f"SELECT frame, atom, round(min_image(x, 0.3D), 6) + 0D AS mi, round(wrap(x, -0.1D, 0.3D), 6) + 0D AS wr, round(disorientation(array(1D, 0D, 0D, 0D), {turned}, false), 4) + 0D AS dis FROM {{t}}", t=atoms(s, d))


STYLE_SQL = f"""u AS (SELECT frame, element FROM sp UNION ALL SELECT frame, CASE WHEN label % 4 = 1 THEN element ELSE 'C' END FROM atoms WHERE frame % 2 = 1),
n AS (SELECT frame, element, count(*) AS n FROM u GROUP BY ALL),
t AS (SELECT *, first_value(element) OVER (PARTITION BY frame ORDER BY n DESC, element) AS top FROM n),
e AS (SELECT DISTINCT element, CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(element, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 360 AS INTEGER) AS hue FROM u),
w AS (SELECT element, hue // 60 AS i, hue / 60.0 - hue // 60 AS f FROM e),
c AS (SELECT element, CASE element WHEN 'C' THEN [0.56, 0.56, 0.56] WHEN 'O' THEN [1.0, 0.2, 0.18] WHEN 'Al' THEN [0.75, 0.76, 0.8] WHEN 'Fe' THEN [0.88, 0.4, 0.2]
  ELSE [[0.88, 0.88 * (1 - 0.55 * (1 - f)), 0.396], [0.88 * (1 - 0.55 * f), 0.88, 0.396], [0.396, 0.88, 0.88 * (1 - 0.55 * (1 - f))], [0.396, 0.88 * (1 - 0.55 * f), 0.88], [0.88 * (1 - 0.55 * (1 - f)), 0.396, 0.88], [0.88, 0.396, 0.88 * (1 - 0.55 * f)]][i + 1] END::DOUBLE[] AS rgb FROM w),
d AS (SELECT t.frame, t.element, t.top, a.rgb AS own, CASE WHEN t.element <> t.top AND list_distance(a.rgb, b.rgb) < 0.45 THEN CASE WHEN list_distance(b.rgb, [1.0, 0.2, 0.18]::DOUBLE[]) < 0.6 THEN [0.2, 0.9, 1.0] ELSE [1.0, 0.2, 0.18] END::DOUBLE[] ELSE a.rgb END AS s
  FROM t JOIN c a ON a.element = t.element JOIN c b ON b.element = t.top)"""


@query("contrast_styles", f"WITH {SPECIES_SQL}, {STYLE_SQL} SELECT frame, element, CASE WHEN element = top THEN 1.0 ELSE 1.8 END::DOUBLE AS size, round(s[1], 6) AS r, round(s[2], 6) AS g, round(s[3], 6) AS b FROM d")
def contrast_styles(s: SparkSession, d: str) -> DataFrame:
    """Species of all frames; every other frame holds carbon too, and elements that have no colour of their own."""
    other = atoms(s, d).where(F.col("frame") % 2 == 1).withColumn("element", F.when(F.col("label") % 4 == 1, F.col("element")).otherwise("C"))
    both = species(s, d).select("frame", "element").unionByName(other.select("frame", "element"))
    return views.contrast_styles(both).select("frame", "element", "size", *[r6(F.col(c), c) for c in "rgb"])
