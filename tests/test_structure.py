import math

import numpy as np
import pytest
from lattices import BCC, FCC, crystal, hcp, shaken, table, turned
from pyspark.sql import functions as F

from moteflow.operators import neighbors
from moteflow.plans import structure as S
from moteflow.plans import tools  # noqa: F401
from moteflow.plans.result import Context, run_tool
from moteflow.schema import Box


def brute(pts, rc, box):
    p = np.array(pts)
    d = p[None, :, :] - p[:, None, :]
    if box:
        for k in range(3):
            if box.periodic[k]:
                q = d[:, :, k] / box.lengths[k]
                d[:, :, k] -= box.lengths[k] * np.sign(q) * np.floor(np.abs(q) + 0.5)
    r = np.sqrt((d**2).sum(2))
    return {(i, j) for i, j in np.argwhere(r <= rc).tolist() if i != j}


@pytest.mark.parametrize("box,rc", [(None, 1.5), (Box((0, 0, 0), (6, 6, 6)), 1.5), (Box((0, 0, 0), (6, 6, 6), (True, False, True)), 1.0), (Box((0, 0, 0), (6, 6, 6)), 2.9), (Box((0, 0, 0), (6, 6, 6)), 7.0)])
def test_range_join_equals_brute_force(spark, box, rc):
    rng = np.random.default_rng(3)
    pts = (rng.random((150, 3)) * 6).tolist()
    got = [(r["i"], r["j"]) for r in neighbors.neighbours(table(spark, [pts]), rc, box).select("i", "j").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(pts, rc, box)


def test_no_cross_join_in_range_join(spark):
    plan = neighbors.neighbours(table(spark, [[(0, 0, 0)]]), 1.0)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("pts_box,code", [(crystal(FCC, 4.05, 4), S.FCC), (crystal(BCC, 2.87, 4), S.BCC), (hcp(3.21, 5, 3, 3), S.HCP)])
def test_perfect_lattices(spark, pts_box, code):
    pts, box = pts_box
    r = run_tool("crystallinity", table(spark, [pts]), Context(box=box))
    n = r.numbers()
    assert n[S.CLASS_NAMES[code]] == 100 and n["Crystalline"] == 100
    if code == S.FCC:
        assert abs(n["Mean q6"] - 0.5745) < 0.01 and abs(n["Mean q4"] - 0.1909) < 0.01


def test_liquid_is_not_crystalline(spark):
    pts, box = crystal(FCC, 4.05, 4)
    r = run_tool("crystallinity", table(spark, [shaken(pts, 0.6)]), Context(box=box))
    assert r.numbers()["Crystalline"] < 10


def plain_signatures(v, rc):
    """Common neighbours, bonds among them and the largest cluster of bonds, neighbour by neighbour."""
    bonded = [[i != j and math.dist(a, b) <= rc for j, b in enumerate(v)] for i, a in enumerate(v)]
    out = []
    for row in bonded:
        common = [k for k, yes in enumerate(row) if yes]
        left, largest = {(a, b) for a in common for b in common if a < b and bonded[a][b]}, 0
        n = len(left)
        while left:
            grown = {left.pop()}
            while more := {e for e in left if {k for g in grown for k in g} & set(e)}:
                grown |= more
                left -= more
            largest = max(largest, len(grown))
        out.append((len(common), n, largest == n))
    return out


def test_signatures_equal_the_plain_ones():
    rng = np.random.default_rng(4)
    v = np.stack([S.TEMPLATES["fcc"] + rng.normal(0, s, (12, 3)) for s in (0, 0.05, 0.2, 0.5) for _ in range(6)])
    rc = np.full(len(v), 1.2)
    n, bonds, one = S.signatures(v, rc)
    for k in range(len(v)):
        assert list(zip(n[k].tolist(), bonds[k].tolist(), one[k].tolist(), strict=True)) == plain_signatures(v[k].tolist(), 1.2)


def test_templates_recover_lattices_and_turns():
    for name in S.TEMPLATES:
        (rms,), _, (f,) = S.match_template(S.TEMPLATES[name][None] * 2.7, name)
        assert rms < 1e-6 and np.allclose(f @ f.T, np.eye(3) * 2.7**2, atol=1e-6)
    q = np.array([math.cos(0.3), 0.0, 0.0, math.sin(0.3)])
    v = S.TEMPLATES["fcc"] @ S.matrices(q[None])[0].T
    (rms,), (got,), _ = S.match_template(v[None], "fcc")
    assert rms < 1e-6
    from moteflow.functions.geometry import rotation_group

    assert len(rotation_group(4)) == 24 and len(rotation_group(6)) == 12


def test_ptm_on_bcc_and_hcp(spark):
    for (pts, box), name in ((crystal(BCC, 2.87, 3), "BCC"), (hcp(3.21, 4, 3, 2), "HCP")):
        n = run_tool("ptm", table(spark, [pts]), Context(box=box)).numbers()
        assert n[name] == 100 and n["Grains"] == 1


def test_bicrystal_has_two_grains(spark):
    pts, _ = crystal(FCC, 4.05, 5)
    left = [p for p in turned(pts, 0) if p[0] < 9.5]
    right = [(x + 9.5 + 6.0, y - 4, z) for x, y, z in turned(pts, 30) if x > -6.0]
    r = run_tool("grains", table(spark, [left + right]), Context(box=Box((-200, -200, 0), (200, 200, 20.25), (False, False, True))), {"structure": "fcc"})
    assert r.numbers()["Grains"] == 2


def test_a_defect_layer_cuts_no_grain(spark):
    """One crystal, with a layer of atoms that match no template, is one grain; the same layer between turned crystals bridges two."""
    rng = np.random.default_rng(8)
    pts, _ = crystal(FCC, 4.05, 6)
    loose = [tuple(np.array(p) + rng.normal(0, 0.9, 3)) if 11.9 < p[0] < 12.4 else p for p in pts]
    box = Box((-200, -200, 0), (200, 200, 24.3), (False, False, True))
    r = run_tool("grains", table(spark, [loose]), Context(box=box), {"structure": "fcc"})
    n = r.numbers()
    assert n["Grains"] == 1 and n["Boundary pairs"] == 0
    big = [(x - 18, y - 18, z) for x, y, z in crystal(FCC, 4.05, 9)[0] if z < 12.0]
    inside = lambda p: abs(p[0]) < 11 and abs(p[1]) < 11
    atoms = table(spark, [[p for p in big if inside(p) and p[0] < -0.4] + [p for p in turned(big, 30) if inside(p) and p[0] > 0.4]])
    n = run_tool("grains", atoms, Context(box=Box((-200, -200, 0), (200, 200, 12.15), (False, False, True))), {"structure": "fcc"}).numbers()
    assert n["Grains"] == 2 and n["Boundary pairs"] > 10 and abs(n["Mean misorientation"] - 30) < 2 and n["GB atoms"] > 1


def test_rdf_peak_and_coordination(spark):
    pts, box = crystal(FCC, 4.05, 5)
    r = run_tool("rdf", table(spark, [pts]), Context(box=box), {"rMax": 6.0, "bins": 60})
    n = r.numbers()
    assert abs(n["First peak"] - 4.05 / math.sqrt(2)) < 0.1 and n["Mean coordination"] == 12
    assert r.field.agg(F.max("value")).first()[0] == 12
