import json
import math
import random

import numpy as np
import pytest
from lattices import FCC, crystal, table
from pyspark.sql import functions as F

from moteflow.operators import binning, stats
from moteflow.plans import tools
from moteflow.plans.result import Context, InvalidParameter, MissingRequirement, NotApplicable, catalogue, run_tool
from moteflow.schema import Box


def test_catalogue_has_fifteen_tools_in_order():
    names = catalogue()
    assert len(names) == 15 and names == sorted(names, key=lambda t: (t["category"], t["title"]))


def test_depth_profile_golden(spark):
    pts = [(0, 0, k / 10) for k in range(100)] + [(0, 0, z) for z in (7.7, 10.0, 11.0, 13.0)]
    atoms = table(spark, [pts], element=["Al"] * 100 + ["O"] * 4, charge=[0.0] * 100 + [-1.5] * 4)
    n = run_tool("z_profile", atoms).numbers()
    assert abs(n["Surface z"] - 9.7) < 1e-9 and abs(n["Max penetration"] - 2.0) < 1e-9
    assert (n["Penetrated"], n["At surface"], n["Above"]) == (1, 2, 1) and n["Bound charge"] == -1.5
    with pytest.raises(NotApplicable):
        run_tool("z_profile", table(spark, [[(0, 0, 0)]]))


def test_column_field_and_parameters(spark):
    atoms = table(spark, [[(0, 0, float(k)) for k in range(10)]], columns=[{"pe": float(k)} for k in range(10)])
    assert run_tool("column_field", atoms).numbers()["Mean"] == 4.5
    assert run_tool("column_field", atoms, params={"column": "pe"}).numbers()["Max"] == 9
    with pytest.raises(InvalidParameter):
        run_tool("column_field", atoms, params={"bins": "many"})
    assert run_tool("column_field", atoms, params={"bins": "many"}, strict=False).numbers()["Mean"] == 4.5
    with pytest.raises(NotApplicable):
        run_tool("column_field", atoms, params={"column": "none"})
    r = run_tool("column_field", atoms)
    assert "Mean" in r.text() and "summary,Mean" in r.csv() and json.loads(r.json())["series"] == [[0, 4.5]]


def test_profile_counts_are_conserved(spark):
    atoms = table(spark, [[(0, 0, random.Random(k).random() * 7) for k in range(300)], [(0, 0, 1.0)] * 5])
    r = run_tool("column_field", atoms, params={"bins": 9})
    assert {x["frame"]: x["n"] for x in r.profile.groupBy("frame").agg(F.sum("count").alias("n")).collect()} == {0: 300, 1: 5}
    assert len(binning.bin_edges(0.0, 7.0, 9)) == 9


def test_random_walk_diffusion(spark):
    rng, length, sigma = np.random.default_rng(5), 12.0, 0.4
    p = rng.random((1500, 3)) * length
    frames = []
    for _ in range(12):
        frames.append((p % length).tolist())
        p = p + rng.normal(0, sigma, p.shape)
    r = run_tool("diffusion", table(spark, frames), Context(box=Box((0, 0, 0), (length,) * 3), reference=0))
    assert abs(r.numbers(11)["D"] / (sigma**2 / 2) - 1) < 0.07
    with pytest.raises(MissingRequirement):
        run_tool("diffusion", table(spark, frames))


def test_affine_deformation_is_exact(spark):
    pts, box = crystal(FCC, 4.05, 3)
    f = np.array([[1.02, 0.01, 0.0], [0.0, 0.99, 0.0], [0.0, 0.0, 1.0]])
    moved = (np.array(pts) @ f.T).tolist()
    r = run_tool("deformation", table(spark, [pts, moved]), Context(reference=0))
    e = 0.5 * (f.T @ f - np.eye(3))
    shear = math.sqrt(e[0, 1] ** 2 + e[0, 2] ** 2 + e[1, 2] ** 2 + ((e[0, 0] - e[1, 1]) ** 2 + (e[1, 1] - e[2, 2]) ** 2 + (e[2, 2] - e[0, 0]) ** 2) / 6)
    n = r.numbers(1)
    assert abs(n["Mean shear"] - shear) < 1e-9 and abs(n["Mean J - 1"] - (np.linalg.det(f) - 1)) < 1e-9 and n["Mean D2min"] < 1e-9
    pts2 = [list(p) for p in pts]
    pts2[20][0] += 1.0
    r = run_tool("deformation", table(spark, [pts, pts2]), Context(reference=0, box=box))
    assert r.field.where("frame = 1").agg(F.count("*")).first()[0] == len(pts) and r.numbers(1)["Fraction rearranged"] > 0


def test_stress_columns(spark):
    cols = [{f"c_stress[{k}]": float(v) for k, v in zip(range(1, 7), s, strict=True)} for s in ((100, 0, 0, 0, 0, 0), (0, 0, 0, 50, 0, 0))]
    atoms = table(spark, [[(0, 0, 0), (9, 9, 9)]] * 2, columns=cols)
    from moteflow.plans import mechanics

    names = mechanics.stress_components(tools.available_columns(atoms))
    got = [r["stress"] for r in mechanics.atom_stress(atoms, names).where("frame = 0").orderBy("atom").collect()]
    assert abs(got[0] - 100) < 1e-9 and abs(got[1] - 50 * math.sqrt(3)) < 1e-9


LOG = "a run\nStep Temp PotEng Press Lx Pxx\n" + "".join(f"{k} 300 -{k} 1 {100 + k * 0.01} {-7000 * k * 0.01}\n" for k in range(0, 500, 10)) + "WARNING: x\nLoop time of 3.5 on 1 procs\nprose here\nStep Temp PotEng Press Lx Pxx\n500 300 -1 1 105 -1\nLoop time of 1.0\n"


def test_thermo_log(spark, tmp_path):
    p = tmp_path / "log.lammps"
    p.write_text(LOG.replace("\n", "\r\n"))
    from moteflow.sources import tables

    log = tables.read_log(spark, str(p))
    assert log.select("block").distinct().count() == 2 and tables.common_columns(log)[0] == "Step"
    assert log.agg(F.max("loop_time")).first()[0] == 3.5
    r = run_tool("thermo", None, Context(side_file=str(p)))
    n = r.numbers(0)
    assert abs(n["E"] - 70.0) < 1e-6 and n["Temp"] == 300


def test_adhesion_counts(spark):
    pts = [(0, 0, 0), (0, 0, 10), (0, 0, 3), (0, 3, 0), (30, 0, 0)]
    atoms = table(spark, [pts], element=["C", "C", "N", "O", "C"], labels=[{"chain": c} for c in "AABBB"])
    r = run_tool("adhesion", atoms, Context(), {"groupA": {"kind": "label", "name": "chain", "values": ["A"]}, "groupB": {"kind": "label", "name": "chain", "values": ["B"]}})
    n = r.numbers()
    assert n["Contacts"] == 2 and abs(n["Min distance"] - 3) < 1e-9
    assert [x["value"] for x in r.field.orderBy("atom").collect()] == [1, 0, 2, 2, 0]  # of A, of B


def test_hydrogen_bond_and_classes(spark):
    pts = [(0, 0, 0), (0, 0, 1.0), (0, 0, 3.0), (8, 0, 0), (8, 3.5, 0)]
    lab = [{"chain": c, "resname": r, "resid": i, "name": n} for c, r, i, n in (("A", "SER", "1", "N"), ("A", "SER", "1", "H"), ("B", "GLY", "2", "O"), ("A", "LYS", "3", "NZ"), ("B", "ASP", "4", "OD1"))]
    atoms = table(spark, [pts, pts], element=["N", "H", "O", "N", "O"], labels=lab)
    g = {"groupA": {"kind": "label", "name": "chain", "values": ["A"]}, "groupB": {"kind": "label", "name": "chain", "values": ["B"]}}
    r = run_tool("adhesion", atoms, Context(), {**g, "quantity": "interactions"})
    n = r.numbers(1)
    assert n["H-bonds"] == 1 and n["Salt bridges"] == 1
    assert [x["value"] for x in r.field.where("frame = 1").orderBy("atom").collect()] == [3, 0, 3, 4, 4]  # the hydrogen takes no part
    rows = dict(r.rows(1))
    assert rows["A:LYS 3 (interactions)"] == "contacts 1 · H-bonds 0 · salt 1 · π 0 · φ 0" and rows["A:SER 1 (interactions)"] == "contacts 1 · H-bonds 1 · salt 0 · π 0 · φ 0"
    assert n["A:LYS 3 (contact frequency)"] == 1.0 and n["A:SER 1 (contact frequency)"] == 1.0
    with pytest.raises(ValueError):
        run_tool("adhesion", atoms, Context(), {"groupA": {"kind": "odd"}, "groupB": {"kind": "all"}})


def test_adhesion_energies_and_frequency(spark, tmp_path):
    near, far = [(0, 0, 0), (0, 0, 3)], [(0, 0, 0), (0, 0, 9)]
    lab = [{"chain": c, "resname": r, "resid": i} for c, r, i in (("A", "ALA", "1"), ("B", "GLY", "2"))]
    atoms = table(spark, [near, far, near, near], element=["C", "C"], labels=lab)
    (tmp_path / "interaction_energy.csv").write_text("frame,resname,resid,chain,e_vdw_kJ_mol,e_elec_kJ_mol\n0,ALA,1,A,-1,-2\n0,SER,4,A,-9,1\n3,ALA,1,A,-5,0\n")
    (tmp_path / "mmgbsa.csv").write_text("frame,time_ps,dG_bind_kJ_mol,e_vdw,e_elec,g_solv_complex,g_solv_receptor,g_solv_ligand\n0,0,-10,-20,-5,9,3,1\n2,20,-14,-21,-6,8,3,1\n")
    g = {"groupA": {"kind": "label", "name": "chain", "values": ["A"]}, "groupB": {"kind": "label", "name": "chain", "values": ["B"]}}
    r = run_tool("adhesion", atoms, Context(path=str(tmp_path / "t.xyz")), g)
    n0, n1, n2 = r.numbers(0), r.numbers(1), r.numbers(2)
    assert n0["A:ALA 1 (contact frequency)"] == 0.75
    assert (n0["A:SER 4 (ΔE)"], n0["A:ALA 1 (ΔE)"]) == (-8, -3) and n2["A:ALA 1 (ΔE)"] == -5 and "A:SER 4 (ΔE)" not in n2
    assert list(dict(r.rows(0)))[-8:-6] == ["A:SER 4 (ΔE)", "A:ALA 1 (ΔE)"]
    assert (n0["MM/GBSA ΔG_bind"], n1["MM/GBSA ΔG_bind"], n2["MM/GBSA ΔG_bind"], n0["MM/GBSA solv"], n0["MM/GBSA mean"]) == (-10, -10, -14, 5, -12)
    assert abs(n0["MM/GBSA deviation"] - math.sqrt(8)) < 1e-12


def test_conformation_of_a_rigid_body(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(0, 3, (20, 3))
    c, s = math.cos(0.7), math.sin(0.7)
    b = a @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T + 5
    far = a + rng.normal(0, 2, a.shape)
    atoms = table(spark, [a.tolist(), b.tolist(), far.tolist(), (far + 1).tolist()], element="C")
    r = run_tool("conformation", atoms, Context(reference=0), {"selection": "all", "clusterCount": 2})
    assert r.numbers(1)["RMSD (fitted)"] < 1e-6 and r.numbers(2)["RMSD (fitted)"] > 0.5
    assert r.numbers(0)["Population"] == 2 and r.numbers(0)["Cluster"] == r.numbers(1)["Cluster"]


def test_pulloff_kinetics(spark, tmp_path):
    rows = "seed,time_ps,ref_disp_nm,com_disp_nm,force_pN,work_kJ_mol,n_contacts_total\n"
    rows += "".join(f"1,{k},{k * .1},{k * .05},{100 - abs(k - 6) * 10},{k},{max(0, 8 - k)}\n" for k in range(12))
    (tmp_path / "force_curve.csv").write_text("# made\n" + rows)
    (tmp_path / "config.json").write_text(json.dumps({"pull_velocity_A_per_ns": 0.5, "spring_k_kJ_mol_nm2": 100, "seeds": [1]}))
    n = run_tool("pulloff_energetics", None, Context(path=str(tmp_path / "x.xyz")))
    got = n.numbers(3)
    assert got["F*"] == 100 and got["F* row"] == 6 and got["Rupture frame"] == 8 and got["Force"] == 70 and got["Velocity"] == 0.5
    timed = run_tool("pulloff_energetics", None, Context(path=str(tmp_path / "x.xyz")), {"frameAlignment": "time", "frameInterval_ps": 2.5})
    assert {r["frame"]: r["scalar"] for r in timed.series.collect()} == {0: 40, 1: 60, 2: 90, 3: 90, 4: 60}  # times 0, 2.5 (row 2), 5, 7.5 (row 7), 10
    with pytest.raises(NotApplicable):
        run_tool("pulloff_energetics", None, Context(path=str(tmp_path / "x.xyz"), frame=9), {"frameAlignment": "time", "frameInterval_ps": 2.5})
    (tmp_path / "tramd_times.csv").write_text("seed,replica,t_diss_ps,censored\n" + "".join(f"1,{k},{t},{c}\n" for k, (t, c) in enumerate(((100, 0), (200, "false"), (300, "no"), (400, "yes")))))
    r = run_tool("kinetics_tramd", None, Context(path=str(tmp_path / "x.xyz")), {"resamples": 50})
    assert r.numbers(0)["τ"] == 200 and r.numbers(0)["Censored"] == 1 and r.numbers(1)["Bound"] == 0.75 and r.numbers(4)["Bound"] == 0.25  # a frame for 0 and for each time


def test_fep_and_campaign(spark, tmp_path):
    doc = {"edges": [{"ligA": "a", "ligB": "b", "ddG_kcal": 0.95, "overlap_min": 0.01}, {"ligA": "b", "ligB": "c", "ddG_kcal": -0.83, "overlap_min": 0.2}], "ligands": [{"name": "c", "rank": 1}, {"name": "a", "dG_abs_kcal": -3.0}, {"name": "b", "rank": 2}], "cycles": [{"ligands": ["a", "b", "c"], "closure_kcal": 1.5}]}
    p = tmp_path / "results.json"
    p.write_text(json.dumps(doc))
    r = run_tool("fep_results", None, Context(side_file=str(p)))
    assert [x["scalar"] for x in r.series.collect()] == [-0.83, 0.95] and len(r.notes) == 2
    with pytest.raises(NotApplicable):
        run_tool("fep_results", None, Context(side_file=str(p), frame=7))
    cell = lambda lig, v: {"ligand": lig, "receptor": "r1", "state": "done" if v is not None else "failed", **({"value": v} if v is not None else {}), "tier": 1}
    m = {"ligands": ["x", "y"], "receptors": ["r1", "r2"], "primary_receptor": "r1", "direction": "lower_is_better", "unit": "kJ", "label": "Score", "cells": {"x__r1": cell("x", -2.0), "y__r1": cell("y", None)}, "columns": {"r1": ["x__r1", "y__r1"], "r2": []}}
    q = tmp_path / "matrix.json"
    q.write_text(json.dumps(m))
    r = run_tool("campaign_matrix", None, Context(side_file=str(q)))
    assert r.scalar.collect()[0]["scalar"] == -2.0 and dict(r.rows())["Coverage"] == "1 of 4 (25%)"
    assert run_tool("campaign_matrix", None, Context(side_file=str(q)), {"receptor": "r2"}).scalar.collect()[0]["scalar"] is None


def test_secondary_structure_of_a_helix(spark):
    pts, names = [], []
    for k in range(14):  # ideal alpha helix from cylindrical coordinates (radius, turn, rise) of each backbone atom
        for name, r, t, z in (("N", 1.55, -27.5, -0.87), ("CA", 2.29, 0.0, 0.0), ("C", 1.65, 26.3, 1.1), ("O", 1.99, 23.6, 2.31)):
            w = math.radians(100 * k + t)
            pts.append((r * math.cos(w), r * math.sin(w), 1.5 * k + z))
            names.append({"name": name, "resid": str(k + 1), "resname": "ALA", "chain": "A"})
    from moteflow.plans.conformation import secondary_structure

    got = "".join(r["letter"] for r in secondary_structure(table(spark, [pts], element="C", labels=names)).orderBy("r").collect())
    assert got.count("H") >= 9


def test_splitmix_is_reproducible():
    assert stats.SplitMix64(0).next() == 0xE220A8397B1DCDAF
