"""Boxes and neighbour searches of each frame, against brute force."""

import numpy as np
import pytest
from lattices import FCC, crystal, table
from pyspark.sql import functions as F

from moteflow import cli
from moteflow.operators import boxes, neighbors, windows
from moteflow.plans import mechanics, structure
from moteflow.plans.result import Context, run_tool
from moteflow.schema import FRAMES, Box


def frames_of(spark, cells):
    """frames table: (lo, hi, periodic, tilt) of each frame, None for an open one."""
    rows = [(f, f * 10, 0, c is not None, *(c[0] if c else [None] * 3), *(c[1] if c else [None] * 3), *(c[2] if c else [None] * 3), *(c[3] if c and c[3] else [None] * 3)) for f, c in enumerate(cells)]
    return spark.createDataFrame(rows, FRAMES)


def image(d, cell):
    for k in range(3):
        size = cell[1][k] - cell[0][k] if cell else 0
        if cell and cell[2][k] and size > 0:
            d[..., k] -= size * np.sign(d[..., k]) * np.floor(np.abs(d[..., k]) / size + 0.5)
    return d


def cubic(n, a):
    return [(i * a, j * a, k * a) for i in range(n) for j in range(n) for k in range(n)]


P = (True, True, True)


def test_stretched_lattice_keeps_its_neighbours(spark):
    pts = [cubic(10, 1.0), cubic(10, 1.2)]
    cells = [((0.0,) * 3, (10.0,) * 3, P, None), ((0.0,) * 3, (12.0,) * 3, P, None)]
    box = boxes.boxes_of(frames_of(spark, cells))
    assert isinstance(box, boxes.FrameBoxes)
    n = structure.coordination_numbers(table(spark, pts), table(spark, pts), 1.3, box).groupBy("frame").agg(F.min("n"), F.max("n")).collect()
    assert {tuple(r) for r in n} == {(0, 6, 6), (1, 6, 6)}
    r = run_tool("rdf", table(spark, pts), Context(box=box), {"rMax": 2.0, "bins": 40, "coordinationCutoff": 1.3})
    assert r.numbers(0)["Mean coordination"] == r.numbers(1)["Mean coordination"] == 6 and not r.notes
    assert abs(r.numbers(0)["First peak"] - 1.025) < 1e-9 and abs(r.numbers(1)["First peak"] - 1.225) < 0.051


def test_one_box_stays_one_box(spark):
    same = [((0.0, 0.0, 0.0), (4.0, 5.0, 6.0), (True, False, True), (0.5, 0.0, 0.0))] * 3
    box = boxes.boxes_of(frames_of(spark, same))
    assert box == Box((0.0, 0.0, 0.0), (4.0, 5.0, 6.0), (True, False, True), (0.5, 0.0, 0.0)) and box.tilted
    assert boxes.boxes_of(frames_of(spark, [None, None])) is None
    mixed = boxes.boxes_of(frames_of(spark, [None, same[0]]))
    assert isinstance(mixed, boxes.FrameBoxes) and mixed.tilted and mixed.shortest() == 4.0
    assert any("tilted" in n for n in run_tool("rdf", table(spark, [cubic(4, 1.0)]), Context(box=box), {"rMax": 1.5, "bins": 10}).notes)


def clouds(seed, sizes):
    rng = np.random.default_rng(seed)
    out = []
    for n in sizes:
        clump = rng.normal(0, 0.01, (n // 3, 3)) + 2.0
        gas = rng.uniform(0, 10, (n - n // 3, 3)) * rng.uniform(0.3, 1.0)
        out.append(np.concatenate([clump, gas, gas[:2], clump[:1]]) - 1.0)  # some lie outside of the box, some on each other
    return out


CELLS = [((0.0,) * 3, (9.0,) * 3, P, None), None, ((-1.0, 0.0, 0.0), (5.0, 7.0, 0.0), (True, False, True), None), ((0.0,) * 3, (2.0,) * 3, P, None)]


@pytest.mark.parametrize("rc", [0.05, 1.1, 4.0])
def test_range_join_with_a_box_for_each_frame(spark, rc):
    pts = clouds(1, [60, 60, 60, 60])
    t = table(spark, [p.tolist() for p in pts])
    got = {}
    for r in neighbors.neighbours(t, rc, boxes.boxes_of(frames_of(spark, CELLS))).collect():
        assert (r["frame"], r["i"], r["j"]) not in got
        got[r["frame"], r["i"], r["j"]] = r["d"]
    want = {}
    for f, p in enumerate(pts):
        d = np.sqrt((image(p[None] - p[:, None], CELLS[f]) ** 2).sum(2))
        want |= {(f, i, j): d[i, j] for i, j in np.argwhere(d <= rc).tolist() if i != j}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_range_join_with_a_cutoff_for_each_frame(spark):
    pts = clouds(2, [40, 40])
    t = table(spark, [p.tolist() for p in pts])
    cut = spark.createDataFrame([(0, 0.5)], "frame int, cutoff double")
    got = {(r["frame"], r["i"], r["j"]) for r in neighbors.neighbours(t, cut).collect()}
    d = np.sqrt(((pts[0][None] - pts[0][:, None]) ** 2).sum(2))
    assert got == {(0, i, j) for i, j in np.argwhere(d <= 0.5).tolist() if i != j}


@pytest.mark.parametrize("k", [1, 5, 14])
def test_k_nearest_in_clump_and_gas(spark, k):
    pts = [*clouds(3, [300, 120, 90, 90]), np.zeros((3, 3)), np.array([[1e6, 2.0, 3.0]] * 30), np.array([[0.5, 0.5, 0.5]])]
    cells = [*CELLS, None, None, CELLS[0]]
    t = table(spark, [p.tolist() for p in pts])
    got = {}
    for r in neighbors.k_nearest(t, k, boxes.boxes_of(frames_of(spark, cells))).collect():
        got[r["frame"], r["i"], r["rn"]] = (r["j"], r["d"])
    want = {}
    for f, p in enumerate(pts):
        d = np.sqrt((image(p[None] - p[:, None], cells[f]) ** 2).sum(2))
        for i in range(len(p)):
            order = sorted((d[i, j], j) for j in range(len(p)) if j != i)[:k]
            want |= {(f, i, n): x for n, x in enumerate(order, 1)}
    assert got.keys() == want.keys()
    for key, (d, j) in want.items():
        assert abs(got[key][1] - d) < 1e-9 and (got[key][0] == j or any(abs(d - x[0]) < 1e-9 for q, x in want.items() if q[:2] == key[:2] and q != key) or key[2] == k), key
    assert neighbors.k_nearest(t.limit(0), k).count() == 0


def test_hot_cell_is_split(spark):
    keys = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k"}
    before = {c: spark.conf.get(c) for c in keys}
    try:
        for c, v in keys.items():
            spark.conf.set(c, v)
        rows = spark.range(0, 1500, 1, 6).selectExpr("0 as frame", "cast(id as int) as atom", "if(id % 3 = 0, id, 0.001D * id) as x", "if(id % 3 = 0, id, 0D) as y", "0D as z")
        pairs = neighbors.neighbours(rows, 1.01)
        pairs.write.format("noop").mode("overwrite").save()
        n = pairs.count()
        assert "skew=true" in (plan := pairs._jdf.queryExecution().executedPlan().toString()) or pairs.collect() and "skew=true" in pairs._jdf.queryExecution().executedPlan().toString(), plan
        assert n == pairs.distinct().count()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_perfect_lattices_of_two_sizes(spark):
    small, big = crystal(FCC, 4.05, 3), crystal(FCC, 5.0, 3)
    cells = [(tuple(b.lo), tuple(b.hi), P, None) for _, b in (small, big)]
    t, box = table(spark, [small[0], big[0]]), boxes.boxes_of(frames_of(spark, cells))
    r = run_tool("crystallinity", t, Context(box=box))
    assert r.numbers(0)["FCC"] == r.numbers(1)["FCC"] == 100
    assert abs(r.numbers(1)["Cutoff"] / r.numbers(0)["Cutoff"] - 5.0 / 4.05) < 1e-9
    g = run_tool("grains", t, Context(box=box), {"structure": "fcc"})
    assert g.numbers(0)["Grains"] == g.numbers(1)["Grains"] == 1
    assert abs(g.numbers(1)["Mean diameter"] / g.numbers(0)["Mean diameter"] - 5.0 / 4.05) < 1e-9


def test_affine_stretch_of_box_and_atoms(spark):
    pts, box = crystal(FCC, 4.0, 3)
    stretched = [(x * 1.02, y, z) for x, y, z in pts]
    cells = [(box.lo, box.hi, P, None), (box.lo, (box.hi[0] * 1.02, *box.hi[1:]), P, None)]
    t = table(spark, [pts, stretched])
    d = mechanics.deformation(t, 0, 3.0, boxes.boxes_of(frames_of(spark, cells))).where("frame = 1").agg(F.min("dilation"), F.max("dilation"), F.max("d2min"), F.count_if("valid")).first()
    assert abs(d[0] - 0.02) < 1e-9 and abs(d[1] - 0.02) < 1e-9 and d[2] < 1e-9 and d[3] == len(pts)


def test_unwrapping_takes_each_frames_box(spark):
    # an atom that moves by 1 a frame through a box that grows by 1 a frame
    sizes = [4.0, 5.0, 6.0, 7.0]
    path = [3.5, 4.5, 5.5, 6.5]
    pts = [[(x % s, 0.0, 0.0)] for x, s in zip(path, sizes, strict=True)]
    cells = [((0.0,) * 3, (s,) * 3, P, None) for s in sizes]
    got = {}
    for ref in (0, 2):
        rows = windows.unwrapped(table(spark, pts), boxes.boxes_of(frames_of(spark, cells)), ref).orderBy("frame").collect()
        at, want = [p[0][0] for p in pts], {ref: 0.0}
        for order in (range(ref + 1, 4), range(ref - 1, -1, -1)):
            u = 0.0
            for f in order:
                d = at[f] - at[f - 1 if f > ref else f + 1]
                u += d - sizes[f] * round(d / sizes[f])
                want[f] = u
        got[ref] = [r["ux"] for r in rows]
        assert np.allclose(got[ref], [want[f] for f in range(4)])


def test_analyze_takes_the_boxes_of_a_dump(spark, tmp_path, capsys):
    text = ""
    for f, a in enumerate((1.0, 1.2)):
        size = 10 * a
        text += f"ITEM: TIMESTEP\n{f}\nITEM: NUMBER OF ATOMS\n1000\nITEM: BOX BOUNDS pp pp pp\n" + f"0 {size}\n" * 3 + "ITEM: ATOMS id type x y z\n" + "".join(f"{i + 1} 1 {x} {y} {z}\n" for i, (x, y, z) in enumerate(cubic(10, a)))
    (tmp_path / "run.dump").write_text(text)
    assert cli.main(["analyze", "rdf", str(tmp_path / "run.dump"), "--frames", "all", "--param", "rMax=2.0", "--param", "coordinationCutoff=1.3", "--csv"]) == 0
    lines = [x for x in capsys.readouterr().out.splitlines() if "Mean coordination" in x]
    assert len(lines) == 2 and all(x.split(",")[2] in ("6", "6.0") for x in lines), lines


@pytest.mark.parametrize("rc", [0.05, 1.1, 4.0])
def test_counts_and_nearest_make_no_row_of_a_pair(spark, monkeypatch, rc):
    pts = clouds(5, [90, 60, 60, 60])
    t, box = table(spark, [p.tolist() for p in pts]), boxes.boxes_of(frames_of(spark, CELLS))
    monkeypatch.setattr(neighbors, "joined_cells", None)  # pairs as rows
    near = [np.sqrt((image(p[None] - p[:, None], CELLS[f]) ** 2).sum(2)) <= rc for f, p in enumerate(pts)]
    got = {(r["frame"], r["atom"]): r["n"] for r in structure.coordination_numbers(t, t, rc, box).collect()}
    assert got == {(f, i): int(n) - 1 for f, m in enumerate(near) for i, n in enumerate(m.sum(1))}
    bins = structure.pair_distribution(t, box, rc + 1e-9, 5).groupBy("frame").agg(F.sum("n").alias("n")).collect()
    assert {r["frame"]: r["n"] for r in bins} == {f: int(m.sum()) - len(m) for f, m in enumerate(near)}
    first = neighbors.nearest_within(t, 3, rc, box).groupBy("frame").count().collect()
    assert {r["frame"]: r["count"] for r in first} == {f: int(np.minimum(m.sum(1) - 1, 3).sum()) for f, m in enumerate(near) if (m.sum(1) > 1).any()}
