"""Registered queries on logs, force curves, replicas, energy networks, campaign matrices and job lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..adapters import ATOMS_SQL, FORCE_SQL, REPLICAS_SQL, THERMO_SQL, atoms, force_rows, replicas, thermo
from ..functions import text as T
from ..functions import units
from ..operators import joins, stats, windows
from ..operators.ranks import with_ranked
from ..operators.scan import numbered_rows
from ..sources import tables
from .registry_queries import query


def r6(c: F.Column, name: str) -> F.Column:
    return (F.round(c, 6) + 0.0).alias(name)


@query("thermo_common_columns", f"WITH {THERMO_SQL}, c AS (SELECT DISTINCT block, unnest(json_keys(props)) AS col FROM (SELECT event_type AS block, props FROM events)) SELECT col, count(*) AS blocks FROM c GROUP BY col HAVING count(*) = (SELECT count(DISTINCT block) FROM thermo)")
def thermo_common_columns(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    log = e.select(F.lit("events").alias("file"), F.col("event_type").alias("block"), F.posexplode(F.json_object_keys("props")).alias("ord", "col"))
    return log.where(F.col("col").isin(tables.common_columns(log))).groupBy("col").agg(F.count_distinct("block").alias("blocks"))


@query("thermo_concat", f"WITH {THERMO_SQL} SELECT block, row, step, row_number() OVER (ORDER BY block, row) - 1 AS global_row FROM thermo")
def thermo_concat(s: SparkSession, d: str) -> DataFrame:
    return numbered_rows(thermo(s, d), "global_row", [], ["block", "row"]).select("block", "row", "step", "global_row")


@query("json_props_extract", f"WITH {THERMO_SQL} SELECT block, count(k) AS n, round(avg(k), 6) + 0.0 AS mean_k, round(max(k), 6) + 0.0 AS max_k FROM thermo GROUP BY block")
def json_props_extract(s: SparkSession, d: str) -> DataFrame:
    return thermo(s, d).groupBy("block").agg(F.count("k").alias("n"), r6(F.avg("k"), "mean_k"), r6(F.max("k"), "max_k"))


@query("thermo_asof", f"""WITH {THERMO_SQL}, f AS (SELECT block, row AS frame, row * 37.5 AS timestep FROM thermo), c AS (SELECT f.block, f.frame, f.timestep, t.row, t.step, row_number() OVER (PARTITION BY f.block, f.frame ORDER BY abs(t.step - f.timestep), t.row) AS r FROM f JOIN thermo t ON f.block = t.block)
SELECT block, frame, row, step FROM c WHERE r = 1""")
def thermo_asof(s: SparkSession, d: str) -> DataFrame:
    t = thermo(s, d)
    frames = t.select("block", F.col("row").alias("frame"), (F.col("row") * 37.5).alias("timestep"))
    found = joins.nearest(frames, t.select("block", "step", "row"), "timestep", "step", "row", ["block"])
    return found.select("block", "frame", "row", "step")


@query("force_time_align", f"""WITH {FORCE_SQL}, f AS (SELECT seed, us + 1800000000 AS at FROM force WHERE row = 1), c AS (SELECT f.seed, q.row, abs(q.us - f.at) AS gap, row_number() OVER (PARTITION BY f.seed ORDER BY abs(q.us - f.at), q.row) AS r FROM f JOIN force q USING (seed))
SELECT seed, row FROM c WHERE r = 1 AND gap <= 86400000000""")
def force_time_align(s: SparkSession, d: str) -> DataFrame:
    rows = force_rows(s, d)
    at = rows.where("row = 1").select("seed", (F.col("us") + 1800000000).alias("at"))
    found = joins.nearest(at, rows.select("seed", "us", "row"), "at", "us", "row", ["seed"])
    return found.where(F.abs(F.col("us") - F.col("at")) <= 86400000000).select("seed", "row")


@query("rupture", f"WITH {FORCE_SQL} SELECT seed, CAST(min_by(row, -force * 1e9 + row) AS BIGINT) AS at, round(max(force), 6) AS force FROM force GROUP BY seed")
def rupture(s: SparkSession, d: str) -> DataFrame:
    return force_rows(s, d).groupBy("seed").agg(F.max_by("row", F.struct("force", -F.col("row"))).alias("at"), F.round(F.max("force"), 6).alias("force"))


@query("rupture_frame", f"WITH {FORCE_SQL}, l AS (SELECT seed, max(row) FILTER (contacts > 0) AS last, max(row) AS top FROM force GROUP BY seed) SELECT seed, CASE WHEN last < top THEN last + 1 END AS start FROM l")
def rupture_frame(s: SparkSession, d: str) -> DataFrame:
    return windows.zero_from(force_rows(s, d), "contacts", "row", ["seed"])


@query("pull_work", f"WITH {FORCE_SQL}, t AS (SELECT seed, 0.5 * (force + lag(force) OVER w) * (us - lag(us) OVER w) / 1e9 AS a FROM force WINDOW w AS (PARTITION BY seed ORDER BY row)) SELECT seed, round(coalesce(sum(a), 0), 4) + 0.0 AS work FROM t GROUP BY seed")
def pull_work(s: SparkSession, d: str) -> DataFrame:
    rows = force_rows(s, d).withColumn("x", F.col("us") / 1e9)
    return rows.select("seed", windows.trapezoid("x", "force", "row", ["seed"]).alias("a")).groupBy("seed").agg((F.round(F.sum("a"), 4) + 0.0).alias("work"))


@query("median_iqr", f"""WITH {FORCE_SQL}, r AS (SELECT seed, force, row_number() OVER (PARTITION BY seed ORDER BY force) AS r, count(*) OVER (PARTITION BY seed) AS n FROM force)
SELECT seed, max(n) AS n, round(median(force), 6) AS median, round(median(force) FILTER (r <= n // 2), 6) AS q1, round(median(force) FILTER (r > n - n // 2), 6) AS q3 FROM r GROUP BY seed""")
def median_iqr(s: SparkSession, d: str) -> DataFrame:
    t = stats.tukey_quartiles(force_rows(s, d), "force", ["seed"])
    return t.select("seed", "n", *[F.round(c, 6).alias(c) for c in ("median", "q1", "q3")])


KT = units.KB_PN_NM_K * 300


@query("bell_evans", f"""WITH {FORCE_SQL}, m AS (SELECT seed % 5 + 1 AS rate, median(100 + force) + 3 * (seed % 5 + 1) AS f0 FROM force GROUP BY seed), p AS (SELECT ln(rate) AS x, median(f0) AS f FROM m GROUP BY rate), q AS (SELECT count(*) AS n_rates, regr_slope(f, x) AS b, regr_intercept(f, x) AS a FROM p)
SELECT n_rates, round(CASE WHEN b > 0 THEN {KT} / b END, 6) AS distance FROM q""")
def bell_evans(s: SparkSession, d: str) -> DataFrame:
    per = stats.linear_ranks(force_rows(s, d).withColumn("f", 100 + F.col("force")), "f", {"m": 0.5}, ["seed"]).withColumn("rate", F.col("seed") % 5 + 1).withColumn("f0", F.col("m") + 3 * F.col("rate"))
    return stats.bell_evans(per, "rate", "f0", KT).select("n_rates", F.round("distance", 6).alias("distance"))


RT = units.R_KJ_MOL_K * 300


@query("jarzynski", f"""WITH {FORCE_SQL}, g AS (SELECT seed % 10 AS run, sum(force) / 100 AS w FROM force GROUP BY seed), l AS (SELECT run, min(w) AS low FROM g GROUP BY run)
SELECT run, count(*) AS n, CASE WHEN count(*) >= 10 THEN round(min(low) - {RT} * ln(avg(exp(-(w - low) / {RT}))), 6) END AS exponential, CASE WHEN count(*) >= 10 THEN round(avg(w) - var_pop(w) / (2 * {RT}), 6) END AS second_cumulant FROM g JOIN l USING (run) GROUP BY run""")
def jarzynski(s: SparkSession, d: str) -> DataFrame:
    work = force_rows(s, d).groupBy("seed").agg((F.sum("force") / 100).alias("w")).withColumn("run", F.col("seed") % 10)
    return stats.jarzynski("w", RT, ["run"], work).select("run", "n", F.round("exponential", 6).alias("exponential"), F.round("second_cumulant", 6).alias("second_cumulant"))


@query("kokh_tau", f"""WITH {REPLICAS_SQL}, u AS (SELECT seed, censored, CASE WHEN censored THEN (SELECT max(t) FROM replicas) ELSE t END AS t FROM replicas), n AS (SELECT *, count(*) OVER (PARTITION BY seed) AS n, sum(CASE WHEN censored THEN 0 ELSE 1 END) OVER (PARTITION BY seed) AS e, row_number() OVER (PARTITION BY seed ORDER BY t) AS r FROM u),
y AS (SELECT *, r / n AS y, coalesce(lag(t) OVER (PARTITION BY seed ORDER BY r), 0) AS t0, (r - 1) / n AS y0 FROM n) SELECT seed, round(t0 + (0.5 - y0) / (y - y0) * (t - t0), 4) AS tau FROM y WHERE y >= 0.5 AND y0 < 0.5 AND 2 * e >= n""")
def kokh_tau(s: SparkSession, d: str) -> DataFrame:
    return stats.half_survival_time(replicas(s, d), "t", "censored", ["seed"]).select("seed", F.round("tau", 4).alias("tau"))


@query("survival_curve", f"WITH {REPLICAS_SQL}, g AS (SELECT CAST(unnest(range(0, 11)) * 50000.0 AS DOUBLE) AS tt) SELECT seed, tt AS time_at, round(avg(CASE WHEN censored OR t > tt THEN 1.0 ELSE 0.0 END), 6) AS bound FROM replicas, g GROUP BY seed, tt")
def survival_curve(s: SparkSession, d: str) -> DataFrame:
    r = replicas(s, d).withColumn("time_at", F.explode(F.array(*[F.lit(50000.0 * k) for k in range(11)])))
    return r.groupBy("seed", "time_at").agg(F.round(F.avg((F.col("censored") | (F.col("t") > F.col("time_at"))).cast("int")), 6).alias("bound"))


@query("ols_slope", f"WITH {THERMO_SQL} SELECT block, round(regr_slope(press, step), 9) + 0.0 AS slope, round(regr_intercept(press, step), 6) + 0.0 AS intercept FROM thermo GROUP BY block")
def ols_slope(s: SparkSession, d: str) -> DataFrame:
    return thermo(s, d).groupBy("block").agg(*stats.ols("step", "press")).select("block", (F.round("slope", 9) + 0.0).alias("slope"), r6(F.col("intercept"), "intercept"))


@query("strain_curve", f"WITH {THERMO_SQL} SELECT block, row, round((10000.0 + step) / first_value(10000.0 + step) OVER (PARTITION BY block ORDER BY row) - 1, 9) + 0.0 AS strain, round(-press * 1e-4, 9) + 0.0 AS stress FROM thermo")
def strain_curve(s: SparkSession, d: str) -> DataFrame:
    rows = thermo(s, d).withColumn("lx", 10000.0 + F.col("step"))
    return windows.engineering_strain(rows, "lx", "row", ["block"]).select("block", "row", (F.round("strain", 9) + 0.0).alias("strain"), (F.round(-F.col("press") * units.BAR_TO_GPA, 9) + 0.0).alias("stress"))


@query("elastic_prefix", f"WITH {THERMO_SQL}, c AS (SELECT block, row, (10000.0 + step) / first_value(10000.0 + step) OVER (PARTITION BY block ORDER BY row) - 1 AS strain FROM thermo), v AS (SELECT *, max(CASE WHEN abs(strain) > 0.02 THEN 1 ELSE 0 END) OVER (PARTITION BY block ORDER BY row) AS over FROM c) SELECT block, count(*) AS points FROM v WHERE over = 0 GROUP BY block")
def elastic_prefix(s: SparkSession, d: str) -> DataFrame:
    rows = thermo(s, d).withColumn("lx", 10000.0 + F.col("step"))
    rows = windows.engineering_strain(rows, "lx", "row", ["block"])
    return windows.elastic_prefix(rows, "strain", "row", ["block"], 0.02).groupBy("block").agg(F.count("*").alias("points"))


@query("log_tail", f"WITH {THERMO_SQL}, r AS (SELECT block, row, step, row_number() OVER (PARTITION BY block ORDER BY row DESC) AS r FROM thermo) SELECT block, row, step FROM r WHERE r <= 10")
def log_tail(s: SparkSession, d: str) -> DataFrame:
    from ..streaming.follow import tail

    return tail(thermo(s, d), "row", ["block"]).select("block", "row", "step")


CELLS_SQL = "li AS (SELECT p_brand AS ligand, r_name AS receptor, l_extendedprice AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), cells AS (SELECT ligand, receptor, median(v) AS value, count(*) AS n FROM li GROUP BY ALL HAVING count(*) >= 100)"


def cells(s: SparkSession, d: str) -> DataFrame:
    """lineitem by brand and region as a campaign's cells; thin ones were not delivered."""
    t = {n: s.read.parquet(f"{d}/{n}.parquet") for n in ("lineitem", "part", "supplier", "nation", "region")}
    rows = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.col("p_brand").alias("ligand"), F.col("r_name").alias("receptor"), F.col("l_extendedprice").cast("double").alias("v"))
    sizes = rows.groupBy("ligand", "receptor").agg(F.count("*").alias("n")).where("n >= 100")
    middle = with_ranked(rows, "v", ["ligand", "receptor"], sizes, a=F.floor((F.col("n") - 1) / 2), b=F.floor(F.col("n") / 2))
    return middle.select("ligand", "receptor", ((F.col("a") + F.col("b")) / 2).alias("value"), "n")


@query("ligand_receptor_grid", f"WITH {CELLS_SQL}, g AS (SELECT DISTINCT p_brand AS ligand, r_name AS receptor FROM part, region) SELECT g.ligand, g.receptor, round(c.value, 4) AS value FROM g LEFT JOIN cells c USING (ligand, receptor)")
def ligand_receptor_grid(s: SparkSession, d: str) -> DataFrame:
    ligands = s.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("ligand")).distinct()
    receptors = s.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("receptor")).distinct()
    return joins.outer_grid(ligands, receptors, cells(s, d), ["ligand", "receptor"]).select("ligand", "receptor", F.round("value", 4).alias("value"))


@query("campaign_coverage", f"WITH {CELLS_SQL}, g AS (SELECT DISTINCT p_brand AS ligand, r_name AS receptor FROM part, region) SELECT g.receptor, count(*) AS n_cells, count(c.value) AS n_delivered, round(count(c.value) * 1.0 / count(*), 6) AS coverage FROM g LEFT JOIN cells c USING (ligand, receptor) GROUP BY g.receptor")
def campaign_coverage(s: SparkSession, d: str) -> DataFrame:
    g = ligand_receptor_grid(s, d)
    return g.groupBy("receptor").agg(F.count("*").alias("n_cells"), F.count("value").alias("n_delivered"), F.round(F.count("value") / F.count("*"), 6).alias("coverage"))


@query("matrix_sort", f"WITH {CELLS_SQL} SELECT ligand, receptor, CAST(row_number() OVER (PARTITION BY receptor ORDER BY value, ligand) AS INTEGER) AS rank FROM cells")
def matrix_sort(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("receptor").orderBy("value", "ligand")
    return cells(s, d).select("ligand", "receptor", F.row_number().over(w).alias("rank"))


EDGES_SQL = "edges AS (SELECT n_name AS lig_a, o_orderpriority AS lig_b, avg(o_totalprice) / 1000 - 150 AS ddg, stddev_samp(o_totalprice) / sqrt(count(*)) / 1000 AS err FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"


def edges(s: SparkSession, d: str) -> DataFrame:
    """orders by nation and priority as the edges of an energy network."""
    o, c, n = (s.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("lig_a"), F.col("o_orderpriority").alias("lig_b")).agg((F.avg("o_totalprice") / 1000 - 150).alias("ddg"), (F.stddev_samp("o_totalprice") / F.sqrt(F.count("*")) / 1000).alias("err"))


@query("edge_sort", f"WITH {EDGES_SQL} SELECT lig_a, lig_b, round(ddg, 6) + 0.0 AS ddg, CAST(row_number() OVER (ORDER BY ddg NULLS LAST, lig_a, lig_b) AS INTEGER) AS place FROM edges")
def edge_sort(s: SparkSession, d: str) -> DataFrame:
    rows = edges(s, d).select("lig_a", "lig_b", F.col("ddg").alias("ddG_kcal"), F.struct("lig_a", "lig_b").alias("ord"))
    return tables.sorted_edges(rows, "ddG").select("lig_a", "lig_b", r6(F.col("ddG_kcal"), "ddg"), (F.col("place") + 1).alias("place"))


@query("rank_lookup", f"WITH {EDGES_SQL}, k AS (SELECT lig_a AS name, row_number() OVER (ORDER BY min(ddg), lig_a) AS rank FROM edges GROUP BY lig_a), q AS (SELECT lig_b AS name, row_number() OVER (ORDER BY min(ddg), lig_b) AS rank FROM edges GROUP BY lig_b) SELECT lig_a, lig_b, CAST(least(k.rank, q.rank) AS INTEGER) AS best FROM edges JOIN k ON lig_a = k.name JOIN q ON lig_b = q.name")
def rank_lookup(s: SparkSession, d: str) -> DataFrame:
    e = edges(s, d)
    rank = lambda c: e.groupBy(F.col(c)).agg(F.min("ddg").alias("m")).select(c, F.row_number().over(Window.orderBy("m", c)).alias("r_" + c))
    return e.join(rank("lig_a"), "lig_a").join(rank("lig_b"), "lig_b").select("lig_a", "lig_b", F.least("r_lig_a", "r_lig_b").alias("best"))


@query("jobs_by_day", "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderstatus AS state, count(*) AS jobs, max(o_orderkey) AS newest FROM orders GROUP BY ALL")
def jobs_by_day(s: SparkSession, d: str) -> DataFrame:
    o = s.read.parquet(f"{d}/orders.parquet")
    return o.groupBy(F.to_date("o_orderdate").cast("string").alias("day"), F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("jobs"), F.max("o_orderkey").alias("newest"))


@query("pooled_runs", f"WITH {FORCE_SQL}, p AS (SELECT 'even' AS run, * FROM force WHERE seed % 2 = 0 UNION ALL SELECT 'odd', * FROM force WHERE seed % 2 = 1) SELECT run, count(*) AS n, round(avg(force), 6) AS mean FROM p GROUP BY run")
def pooled_runs(s: SparkSession, d: str) -> DataFrame:
    f = force_rows(s, d)
    both = f.where("seed % 2 = 0").withColumn("run", F.lit("even")).unionByName(f.where("seed % 2 = 1").withColumn("run", F.lit("odd")))
    return both.groupBy("run").agg(F.count("*").alias("n"), F.round(F.avg("force"), 6).alias("mean"))


@query("duration_text", "SELECT o_orderkey, CASE WHEN o_custkey * 7 >= 3600 THEN (o_custkey * 7 // 3600) || 'h ' || (o_custkey * 7 % 3600 // 60) || 'm' ELSE (o_custkey * 7 // 60) || 'm ' || (o_custkey * 7 % 60) || 's' END AS took FROM orders")
def duration_text(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", T.duration_text(F.col("o_custkey") * 7).alias("took"))


@query("energy_nearest_frame", f"WITH {THERMO_SQL}, e AS (SELECT block, row AS frame, press FROM thermo WHERE row % 5 = 0), f AS (SELECT block, row AS want FROM thermo), c AS (SELECT f.block, f.want, e.frame, row_number() OVER (PARTITION BY f.block, f.want ORDER BY abs(e.frame - f.want), e.frame) AS r FROM f JOIN e USING (block)) SELECT block, want, frame FROM c WHERE r = 1")
def energy_nearest_frame(s: SparkSession, d: str) -> DataFrame:
    t = thermo(s, d)
    table = t.where("row % 5 = 0").select("block", F.col("row").alias("at"), F.col("row").alias("frame"))
    return joins.nearest(t.select("block", F.col("row").alias("want")), table, "want", "at", "frame", ["block"]).select("block", "want", "frame")


@query("xyz_text_lines", f"WITH {ATOMS_SQL} SELECT frame, count(*) + 2 AS lines, CAST(sum(length(element)) AS BIGINT) AS symbols FROM atoms GROUP BY frame")
def xyz_text_lines(s: SparkSession, d: str) -> DataFrame:
    from ..sources.sinks import xyz_frames

    a = atoms(s, d)
    text = xyz_frames(a).select("frame", F.size(F.split("text", "\n")).cast("long").alias("lines"))
    return text.join(a.groupBy("frame").agg(F.sum(F.length("element")).alias("symbols")), "frame").select("frame", "lines", "symbols")


@query("xyz_roundtrip", f"WITH {ATOMS_SQL} SELECT frame, atom, element, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM atoms")
def xyz_roundtrip(s: SparkSession, d: str) -> DataFrame:
    from ..operators.graph import shared_folder
    from ..sources import sinks, trajectories

    path = shared_folder(s, "xyz")
    sinks.write_xyz(atoms(s, d), path)
    back = trajectories.read_xyz(s, path)
    return back.select("frame", "atom", "element", r6(F.col("x"), "x"), r6(F.col("y"), "y"), r6(F.col("z"), "z"))


@query("dump_roundtrip", f"WITH {ATOMS_SQL} SELECT frame, id, element, round(x, 6) + 0.0 AS x, round(charge, 6) + 0.0 AS charge FROM atoms")
def dump_roundtrip(s: SparkSession, d: str) -> DataFrame:
    from ..adapters import BOX
    from ..operators.graph import shared_folder
    from ..sources import sinks, trajectories

    path = shared_folder(s, "dump")
    sinks.write_dump(atoms(s, d), path, BOX)
    back = trajectories.read_dump(s, path)
    return back.select("frame", "id", "element", r6(F.col("x"), "x"), r6(F.col("charge"), "charge"))


@query("tar_roundtrip", f"WITH {ATOMS_SQL} SELECT frame, id, element, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, round(charge, 6) + 0.0 AS charge FROM atoms")
def tar_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Dumps, packed into gzipped archives and read back out of them."""
    from ..adapters import BOX
    from ..operators.graph import shared_folder
    from ..sources import archives, sinks

    path, packed = shared_folder(s, "dump"), shared_folder(s, "tar")
    sinks.write_dump(atoms(s, d), path, BOX)
    archives.pack(s, path, packed, archive_bytes=1 << 26)
    back, _ = archives.read_archived(s, packed)
    return back.select("frame", "id", "element", *[r6(F.col(c), c) for c in ("x", "y", "z", "charge")])


@query("excluded_pages", """WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), q AS (SELECT *, string_split(path, '/') AS parts FROM p)
SELECT page_id, path FROM q WHERE NOT (path GLOB '*.html' OR path GLOB '*example.net*page=[13-5]*' OR list_contains(parts, 'fr') OR len(list_filter(parts, lambda x: x GLOB 'blog.*')) > 0 OR len(list_filter(parts, lambda x: x GLOB '8?')) > 0)""")
def excluded_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages whose addresses no exclude fits, neither whole nor in a part of their path."""
    pages = s.read.parquet(f"{d}/pages.parquet").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return pages.where(~T.excluded(F.col("path"), ("*.html", "*example.net*page=[13-5]*", "fr", "blog.*", "8?")))
