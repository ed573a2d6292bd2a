"""Superposition, fluctuation, clustering, principal components and secondary structure of chains."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import units
from ..functions.geometry import angle_degrees
from ..operators.graph import greedy_cover, k_medoids, written
from ..operators.neighbors import range_join
from ..operators.scan import numbered_rows

MATRIX_FRAMES = 400  # frames of the distance matrix; the others join their nearest medoid


def gyration(atoms: DataFrame) -> DataFrame:
    """frame, rg: root of the mass-weighted mean squared distance from the centre of mass."""
    m = units.mass(F.col("element"))
    total = F.sum(m)
    square = F.sum(m * (F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))) / total
    centre = [F.sum(m * F.col(c)) / total for c in "xyz"]
    return atoms.groupBy("frame").agg(F.sqrt(F.greatest(F.lit(0.0), square - sum((c * c for c in centre[1:]), centre[0] * centre[0]))).alias("rg"))


def fluctuation(atoms: DataFrame) -> DataFrame:
    """atom, rmsf over frames, of positions as they are (superpose first for the fitted value)."""
    square = F.avg(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    mean = [F.avg(c) for c in "xyz"]
    return atoms.groupBy("atom").agg(F.sqrt(F.greatest(F.lit(0.0), square - sum((c * c for c in mean[1:]), mean[0] * mean[0]))).alias("rmsf"))


def cross_sums(x: tuple[str, str, str], y: tuple[str, str, str]) -> list[Column]:
    """The 18 sums over atoms that a best fit of positions x onto positions y needs."""
    sums = [F.count("*").cast("double").alias("n"), *[F.sum(c).alias(f"a{k}") for k, c in enumerate(x)], *[F.sum(c).alias(f"b{k}") for k, c in enumerate(y)]]
    sums += [F.sum(F.col(x[i]) * F.col(y[j])).alias(f"h{3 * i + j}") for i in range(3) for j in range(3)]
    square = lambda v: F.sum(sum((F.col(c) * F.col(c) for c in v), F.lit(0.0)))
    return [*sums, square(x).alias("aa"), square(y).alias("bb")]


SUMS = ["n", *[f"a{k}" for k in range(3)], *[f"b{k}" for k in range(3)], *[f"h{k}" for k in range(9)], "aa", "bb"]


def moments(atoms: DataFrame, references: DataFrame) -> DataFrame:
    """frame, ref and the sums of each frame with each of a few reference conformations (ref, atom, x, y, z), from one join and one aggregation."""
    ref = references.select("ref", "atom", *[F.col(c).alias("r" + c) for c in "xyz"])
    return atoms.select("frame", "atom", "x", "y", "z").join(ref, "atom").groupBy("frame", "ref").agg(*cross_sums(("x", "y", "z"), ("rx", "ry", "rz")))


def solved(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fitted and plain deviation, rotation and translation of each row of SUMS, all rows at once."""
    n, ca, cb = m[:, 0], m[:, 1:4] / m[:, :1], m[:, 4:7] / m[:, :1]
    h = m[:, 7:16].reshape(-1, 3, 3) - n[:, None, None] * ca[:, :, None] * cb[:, None, :]
    u, s, vt = np.linalg.svd(h)
    s[:, 2] *= (sign := np.where(np.linalg.det(u @ vt) > 0, 1.0, -1.0))
    u[:, :, 2] *= sign[:, None]
    rot = (u @ vt).transpose(0, 2, 1)
    spread = m[:, 16] - n * np.square(ca).sum(1) + m[:, 17] - n * np.square(cb).sum(1)
    fitted = np.sqrt(np.maximum(0.0, spread - 2 * s.sum(1)) / n)
    plain = np.sqrt(np.maximum(0.0, m[:, 16] + m[:, 17] - 2 * (m[:, 7] + m[:, 11] + m[:, 15])) / n)
    return fitted, plain, rot, cb - np.einsum("sij,sj->si", rot, ca)


def fits_to(atoms: DataFrame, references: DataFrame) -> DataFrame:
    """frame, ref, rmsd (fitted), unfitted, r0..r8 (rotation onto the reference, row by row), t0..t2 (translation)."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fitted, plain, rot, shift = solved(batch[SUMS].to_numpy(float))
            out = pd.DataFrame({"frame": batch["frame"], "ref": batch["ref"], "rmsd": fitted, "unfitted": plain})
            yield out.assign(**{f"r{k}": rot.reshape(-1, 9)[:, k] for k in range(9)}, **{f"t{k}": shift[:, k] for k in range(3)})

    schema = "frame int, ref int, rmsd double, unfitted double, " + ", ".join(f"r{k} double" for k in range(9)) + ", " + ", ".join(f"t{k} double" for k in range(3))
    return moments(atoms, references).mapInPandas(solve, schema)


def fits(atoms: DataFrame, reference: int) -> DataFrame:
    """fits_to() one frame of the same atoms."""
    return fits_to(atoms, atoms.where(F.col("frame") == reference).withColumn("ref", F.lit(0))).drop("ref")


def superposed(atoms: DataFrame, reference: int) -> DataFrame:
    """atoms with x, y, z turned and moved onto the reference frame."""
    x = [F.col(c) for c in "xyz"]
    turned = {c: F.col(f"r{3 * k}") * x[0] + F.col(f"r{3 * k + 1}") * x[1] + F.col(f"r{3 * k + 2}") * x[2] + F.col(f"t{k}") for k, c in enumerate("xyz")}
    return atoms.join(fits(atoms, reference), "frame").withColumns(turned).select(*atoms.columns)


CHUNK = 256


def frame_matrix(atoms: DataFrame, frames: list[int]) -> np.ndarray:
    """Fitted deviation of every pair of at most MATRIX_FRAMES frames.

    Atoms are dealt out in chunks; of each chunk all pairs of frames get their sums by matrix products, a task adds up its
    chunks, and what tasks hand on is a row a pair. Only the matrix itself meets on the driver.
    """
    at = {f: k for k, f in enumerate(frames)}
    rows = atoms.where(F.col("frame").isin(frames)).select("frame", "atom", *[F.col(c).cast("double").alias(c) for c in "xyz"]).withColumn("chunk", F.floor(F.col("atom") / CHUNK))

    def tiles(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, held, f = np.zeros((18, len(frames), len(frames))), [], len(frames)

        def add(t: pa.Table) -> None:
            place = np.array([at[v] for v in t.column(0).to_pylist()])
            known, col = np.unique(t.column(1).to_numpy(), return_inverse=True)
            p, there = np.zeros((3, f, len(known))), np.zeros((f, len(known)))
            for k in range(3):
                p[k, place, col] = t.column(2 + k).to_numpy()
            there[place, col] = 1.0
            square = np.square(p).sum(0)
            total[0] += there @ there.T
            for k in range(3):
                total[1 + k] += p[k] @ there.T
                for m in range(3):
                    total[7 + 3 * k + m] += p[k] @ p[m].T
            total[16] += square @ there.T

        last = None
        for batch in batches:
            marks = batch.column(5).to_numpy()
            for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(marks)) + 1):
                if len(part):
                    if held and marks[part[0]] != last:
                        add(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(int(part[0]), len(part)))
                    last = marks[part[0]]
        if held:
            add(pa.Table.from_batches(held))
        a, b = np.triu_indices(f, 1)
        total[4:7], total[17] = total[1:4].transpose(0, 2, 1), total[16].T
        got = np.flatnonzero(total[0][a, b] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(v[got].astype(np.int32)) for v in (a, b)] + [pa.array(total[k][a, b][got]) for k in range(18)], ["p", "q", *SUMS])

    summed = rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(tiles, "p int, q int, " + ", ".join(f"{c} double" for c in SUMS))
    table = summed.groupBy("p", "q").agg(*[F.sum(c).alias(c) for c in SUMS]).toPandas()  # MATRIX_FRAMES squared, halved
    out = np.zeros((len(frames), len(frames)))
    if len(table):
        p, q = table["p"].to_numpy(), table["q"].to_numpy()
        out[p, q] = out[q, p] = solved(table[SUMS].to_numpy(float))[0]
    return out


def clusters(atoms: DataFrame, count: int = 4, cutoff: float | None = None) -> DataFrame:
    """frame, cluster (1 is the most populous): k-medoids, or with a cutoff greedy covers, on fitted deviations.

    Above MATRIX_FRAMES frames every stride-th is clustered and the rest join the nearest medoid, by one fit onto all medoids.
    """
    spark = atoms.sparkSession
    frames = numbered_rows(atoms.select("frame").distinct(), "k", [], ["frame"])
    stride = math.ceil(frames.count() / MATRIX_FRAMES) or 1
    chosen = sorted(r[0] for r in frames.where(F.col("k") % stride == 0).select("frame").collect())  # MATRIX_FRAMES at most
    d = frame_matrix(atoms, chosen)
    if cutoff is None:
        medoids, own = k_medoids(d.tolist(), count)
    else:
        own = greedy_cover(d.tolist(), cutoff)
        medoids = [int(np.flatnonzero(np.array(own) == c)[d[np.ix_(np.flatnonzero(np.array(own) == c), np.flatnonzero(np.array(own) == c))].sum(1).argmin()]) for c in range(max(own) + 1)]
    table = spark.createDataFrame([(f, int(c)) for f, c in zip(chosen, own, strict=True)], "frame int, raw int")
    if stride > 1:
        middle = spark.createDataFrame([(chosen[m], c) for c, m in enumerate(medoids)], "frame int, ref int")
        rest = atoms.join(table.select("frame"), "frame", "left_anti")
        each = fits_to(rest, atoms.join(middle, "frame").select("ref", "atom", "x", "y", "z"))
        table = table.unionByName(each.groupBy("frame").agg(F.min(F.struct("rmsd", "ref")).alias("m")).select("frame", F.col("m.ref").alias("raw")))
    table = written(table, "clusters")
    rank = table.groupBy("raw").agg(F.count("*").alias("n")).withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("n"), "raw")))  # MATRIX_FRAMES rows at most
    return table.join(rank, "raw").select("frame", "cluster", F.col("n").alias("population"))


WIDTH, ROUNDS = 24, 80


def block_of(batch: object, names: list[str], axes: str) -> np.ndarray:
    """An Arrow batch's columns, direction by direction, as (rows, directions, axes)."""
    table = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], 1) if names else np.zeros((batch.num_rows, 0))  # type: ignore[attr-defined]
    return table.reshape(batch.num_rows, -1, len(axes))  # type: ignore[attr-defined]


def products(df: DataFrame, axes: str, count: int) -> np.ndarray:
    """The sums of products of every two of count directions over all rows: a task hands on count times count numbers."""
    import pyarrow as pa

    names = [f"{c}{k}" for k in range(count) for c in axes]

    def add(batches: Iterator) -> Iterator:
        total = np.zeros((count, count))
        for batch in batches:
            v = block_of(batch, names, axes)
            total += np.einsum("ric,rjc->ij", v, v, optimize=True)
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])

    out = np.zeros((count, count))
    for i, j, v in df.select(*names).mapInArrow(add, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = v
    return (out + out.T) / 2


def turned(df: DataFrame, key: str, axes: str, by: np.ndarray) -> DataFrame:
    """key and the mixtures of the directions that the matrix's columns name."""
    import pyarrow as pa

    names, new = [f"{c}{k}" for k in range(len(by)) for c in axes], [f"{c}{k}" for k in range(by.shape[1]) for c in axes]

    def mix(batches: Iterator) -> Iterator:
        for batch in batches:
            v = np.einsum("ric,ij->rjc", block_of(batch, names, axes), by, optimize=True).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array(v[:, k]) for k in range(v.shape[1])]], [key, *new])

    return df.select(key, *names).mapInArrow(mix, ", ".join([f"{key} int", *[f"{n} double" for n in new]]))


def principal_components(atoms: DataFrame, count: int = 2, tolerance: float = 1e-10) -> tuple[DataFrame, list[float]]:
    """frame, p1.. (projection on each component), and the share of variance of each, by block power iteration.

    A block of WIDTH directions is keyed by atom. A round projects the frames on them and adds the frames up again by atom:
    two joins and two aggregations, whose results are stored. Only the products of directions with each other, WIDTH by WIDTH
    numbers, come to the driver. It ends when the wanted variances stand still; with at most WIDTH frames the first round is
    exact. A component's sign is arbitrary; atoms must be in every frame to take part.
    """
    n = atoms.agg(F.count_distinct("frame")).first()[0]
    full = atoms.groupBy("atom").agg(F.count("*").alias("_n"), *[F.avg(c).alias("m" + c) for c in "xyz"]).where(F.col("_n") == n)
    rows = written(atoms.join(full, "atom").select("atom", "frame", *[(F.col(c) - F.col("m" + c)).alias(c) for c in "xyz"]), "centred")
    total = rows.agg(F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).first()[0] or 0.0
    q = min(WIDTH, n)
    start = lambda k: F.xxhash64("frame", F.lit(k)) / 2.0**63  # noqa: E731  # mixtures of frames: with as many as frames they span all of them
    basis = written(rows.groupBy("atom").agg(*[F.sum(F.col(c) * start(k)).alias(f"{c}{k}") for k in range(q) for c in "xyz"]), "directions")

    before = None
    for _ in range(ROUNDS):
        values, vectors = np.linalg.eigh(products(basis, "xyz", q))
        good = values > max(values.max(), 1e-300) * 1e-13
        basis = turned(basis, "atom", "xyz", vectors[:, good] / np.sqrt(values[good]))
        q = int(good.sum())
        shadow = rows.join(basis, "atom").groupBy("frame").agg(*[F.sum(F.col("x") * F.col(f"x{k}") + F.col("y") * F.col(f"y{k}") + F.col("z") * F.col(f"z{k}")).alias(f"p{k}") for k in range(q)])
        shadow = written(shadow, "projections")
        values, vectors = np.linalg.eigh(products(shadow, "p", q))
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        k = min(count, n)
        if n <= WIDTH or before is not None and np.all(np.abs(values[:k] - before[:k]) <= tolerance * max(values[0], 1e-300)):
            break
        before = values
        basis = written(rows.join(turned(shadow, "frame", "p", vectors), "frame").groupBy("atom").agg(*[F.sum(F.col(c) * F.col(f"p{k}")).alias(f"{c}{k}") for k in range(q) for c in "xyz"]), "directions")
    padded = np.pad(vectors, ((0, 0), (0, max(0, k - vectors.shape[1]))))
    table = turned(shadow, "frame", "p", padded[:, :k]).withColumnsRenamed({f"p{i}": f"_p{i}" for i in range(k)}).withColumnsRenamed({f"_p{i}": f"p{i + 1}" for i in range(k)})
    return table, [float(v / (total or 1.0)) for v in np.pad(values, (0, max(0, k - len(values))))[:k]]


def residues(atoms: DataFrame) -> DataFrame:
    """frame, r (order in the chain file), chain, resname, and the backbone's positions as structs n, ca, c, o.

    Residues begin where chain or number changes in the order of atoms.
    """
    lab = lambda k: F.trim(F.col("labels")[k])
    w = Window.partitionBy("frame").orderBy("atom")
    rows = atoms.select("frame", "atom", F.upper(lab("name")).alias("name"), F.coalesce(lab("chain"), F.lit("")).alias("chain"), lab("resid").alias("resid"), F.upper(lab("resname")).alias("resname"), F.struct("x", "y", "z").alias("p"))
    new = (F.lag("resid").over(w).isNull() | (F.lag("resid").over(w) != F.col("resid")) | (F.lag("chain").over(w) != F.col("chain"))).cast("int")
    rows = rows.withColumn("new", new).withColumn("r", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    at = lambda *names: F.min_by(F.when(F.col("name").isin(*names), F.col("p")), F.when(F.col("name").isin(*names), F.col("atom")))
    return rows.groupBy("frame", "r").agg(F.min("chain").alias("chain"), F.max("resname").alias("resname"), at("N").alias("n"), at("CA").alias("ca"), at("C").alias("c"), at("O", "OXT").alias("o"))


def secondary_structure(atoms: DataFrame) -> DataFrame:
    """frame, r, letter (H, E, B, G, I, T, S or -), after Kabsch and Sander, as joins of residues with their hydrogen bonds.

    The amide hydrogen lies against the carbonyl before it; a bond has less than -0.5 kcal/mol and two alpha carbons within 9 A.
    """
    v = lambda a, b: [F.col(f"{b}.{x}") - F.col(f"{a}.{x}") for x in "xyz"]
    size = lambda d: F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    w = Window.partitionBy("frame").orderBy("r")
    res = residues(atoms)
    res = res.withColumn("pc", F.lag("c").over(w)).withColumn("po", F.lag("o").over(w)).withColumn("pch", F.lag("chain").over(w))
    linked = F.coalesce((F.col("pch") == F.col("chain")) & (size(v("pc", "n")) < 2.5), F.lit(False))
    res = res.withColumn("linked", linked).withColumn("seg", F.sum(F.when(F.col("linked"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    co = v("po", "pc")
    amide = F.col("linked") & (F.coalesce("resname", F.lit("")) != "PRO") & (size(co) > 1e-6)
    res = res.withColumn("h", F.when(amide, F.struct(*[(F.col(f"n.{x}") + d / size(co)).alias(x) for x, d in zip("xyz", co, strict=True)]))).drop("pc", "po", "pch")
    ca = res.where("ca IS NOT NULL").select("frame", F.col("r").cast("int").alias("atom"), "ca.x", "ca.y", "ca.z")
    near = range_join(ca, ca, 9.0, None, same=True).where((F.col("d") < 9.0) & (F.abs(F.col("i") - F.col("j")) >= 2)).select("frame", "i", "j")
    donor = res.where("h IS NOT NULL AND n IS NOT NULL").select("frame", F.col("r").cast("int").alias("i"), "n", "h")
    taker = res.where("c IS NOT NULL AND o IS NOT NULL").select("frame", F.col("r").cast("int").alias("j"), "c", "o")
    energy = 27.888 * (1 / size(v("n", "o")) + 1 / size(v("h", "c")) - 1 / size(v("h", "o")) - 1 / size(v("n", "c")))
    hb = written(near.join(donor, ["frame", "i"]).join(taker, ["frame", "j"]).where(energy < -0.5).select("frame", F.col("i").alias("d"), F.col("j").alias("a")), "backbone-bonds")
    seg = res.select("frame", F.col("r").cast("int").alias("r"), "seg")
    same = lambda df, a, b: df.join(seg.select("frame", F.col("r").alias(a), F.col("seg").alias("_s1")), ["frame", a]).join(seg.select("frame", F.col("r").alias(b), F.col("seg").alias("_s2")), ["frame", b]).where("_s1 = _s2").drop("_s1", "_s2")
    turns = same(hb.where((F.col("d") - F.col("a")).isin(3, 4, 5)), "d", "a").select("frame", F.col("a").alias("i"), (F.col("d") - F.col("a")).alias("n"))
    in_turn = turns.select("frame", F.explode(F.sequence(F.col("i") + 1, F.col("i") + F.col("n") - 1)).alias("r")).distinct().withColumn("turn", F.lit(True))
    twice = turns.join(turns.select("frame", (F.col("i") - 1).alias("i"), "n"), ["frame", "i", "n"])
    helix = twice.select("frame", F.explode(F.sequence(F.col("i") + 1, F.col("i") + F.col("n"))).alias("r"), "n").groupBy("frame", "r").agg(F.max(F.when(F.col("n") == 4, 3).when(F.col("n") == 3, 2).otherwise(1)).alias("k"))
    bond = lambda di, ai, dj, aj: hb.select("frame", (F.col("d") - di).alias("i"), (F.col("a") - ai).alias("j")).join(hb.select("frame", (F.col("a") - aj).alias("i"), (F.col("d") - dj).alias("j")), ["frame", "i", "j"])
    # parallel: i gives to j-1 and j+1 gives to i, or the mirror; antiparallel: i and j give to each other, or their outer neighbours do
    one = bond(0, -1, 1, 0)
    two = one.select("frame", F.col("j").alias("i"), F.col("i").alias("j"))
    par = one.unionByName(two).distinct().withColumn("way", F.lit(1))
    anti = bond(0, 0, 0, 0).unionByName(bond(-1, 1, -1, 1)).unionByName(bond(1, -1, 1, -1).select("frame", F.col("i"), F.col("j"))).distinct().withColumn("way", F.lit(-1))
    last = res.groupBy("frame").agg(F.max("r").alias("last"))
    bridges = par.unionByName(anti).where("i > 0 AND j >= i + 3").join(last, "frame").where("j < last").drop("last").withColumns({"i0": F.col("i") - 1, "i2": F.col("i") + 1, "j0": F.col("j") - 1, "j2": F.col("j") + 1})
    bridges = written(same(same(bridges, "i0", "i2"), "j0", "j2").select("frame", "i", "j", "way").distinct(), "bridges")
    beside = bridges.select("frame", (F.col("i") - 1).alias("i"), (F.col("j") - F.col("way")).alias("j"), "way").unionByName(bridges.select("frame", (F.col("i") + 1).alias("i"), (F.col("j") + F.col("way")).alias("j"), "way")).distinct().withColumn("ladder", F.lit(True))
    laddered = bridges.join(beside, ["frame", "i", "j", "way"], "left").withColumn("ladder", F.coalesce("ladder", F.lit(False)))
    sheet = laddered.select("frame", F.col("i").alias("r"), "ladder").unionByName(laddered.select("frame", F.col("j").alias("r"), "ladder")).groupBy("frame", "r").agg(F.max("ladder").alias("ladder"))
    back, ahead = F.lag("ca", 2).over(w), F.lead("ca", 2).over(w)
    bent = res.withColumn("p2", back).withColumn("n2", ahead).withColumn("whole", (F.lag("seg", 2).over(w) == F.col("seg")) & (F.lead("seg", 2).over(w) == F.col("seg")))
    bent = bent.select("frame", F.col("r").cast("int").alias("r"), F.coalesce(F.col("whole") & (angle_degrees(v("p2", "ca"), v("ca", "n2")) > 70), F.lit(False)).alias("bend"))
    all_ = bent.join(helix, ["frame", "r"], "left").join(sheet, ["frame", "r"], "left").join(in_turn, ["frame", "r"], "left")
    letter = F.when(F.col("k") == 3, "H").when(F.col("ladder"), "E").when(F.col("ladder").isNotNull(), "B").when(F.col("k") == 2, "G").when(F.col("k") == 1, "I").when(F.col("turn"), "T").when(F.col("bend"), "S").otherwise("-")
    return all_.select("frame", "r", letter.alias("letter"))
