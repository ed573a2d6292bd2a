"""The registered queries that cover all frames or rows, against brute force on a small table."""

import math
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from moteflow.adapters import N_FRAMES

L, RC = 1.2, 0.15


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rng = np.random.default_rng(5)
    v = rng.uniform(-0.3, 0.3, (60, 64)).astype("float32")
    spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    events = [(i, f"t{i % 3}", float(i), '{"k": 1}') for i in range(600)]
    spark.createDataFrame(events, "event_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    return d, v.astype(float)[:, :63].reshape(60, N_FRAMES, 3).transpose(1, 0, 2)


def rows(spark, name, d):
    return entry.queries()[name](spark, d).collect()


def near(p, rc, box=None):
    delta = p[None] - p[:, None]
    if box:
        delta -= box * np.round(delta / box)
    r = np.sqrt((delta**2).sum(2))
    return {(i, j): r[i, j] for i, j in np.argwhere(r <= rc).tolist() if i != j}


def test_pairs_of_all_frames(spark, small):
    d, x = small
    opened, periodic = [near(p, RC) for p in x], [near(p, RC, L) for p in x]
    assert {(r["frame"], r["i"], r["j"]) for r in rows(spark, "neighbours_open", d)} == {(f, *k) for f, n in enumerate(opened) for k in n}
    assert {(r["frame"], r["i"], r["j"]) for r in rows(spark, "neighbours_periodic", d)} == {(f, *k) for f, n in enumerate(periodic) for k in n}
    want = {}
    for f, n in enumerate(periodic):
        by = defaultdict(list)
        for (i, j), r in n.items():
            by[i].append((r, j))
        want |= {(f, i, k + 1): j for i, v in by.items() for k, (_, j) in enumerate(sorted(v)[:12])}
    assert {(r["frame"], r["i"], r["rn"]): r["j"] for r in rows(spark, "knn12", d)} == want
    got = {r["frame"]: r for r in rows(spark, "coordination", d)}
    assert len(got) == N_FRAMES and all(math.isclose(got[f]["mean_coordination"], len(n) / 60, abs_tol=1e-6) for f, n in enumerate(periodic))
    count = defaultdict(int)
    for r in rows(spark, "rdf", d):
        count[r["frame"]] += r["n"]
    assert dict(count) == {f: len(n) for f, n in enumerate(periodic)}
    ab = [[r for (i, j), r in n.items() if i % 2 == 0 and j % 2 == 1] for n in opened]
    assert {r["frame"]: r["contacts"] for r in rows(spark, "contacts_ab", d)} == {f: len(n) for f, n in enumerate(ab) if n}
    least = [np.sqrt(((p[::2, None] - p[None, 1::2]) ** 2).sum(2)).min() for p in x]
    assert np.allclose([r["nearest"] for r in sorted(rows(spark, "min_interface_distance", d))], least, atol=1e-6)


def test_components_bonds_and_strain_of_all_frames(spark, small):
    d, x = small
    want = {}
    for f, p in enumerate(x):
        label = list(range(60))
        for _ in range(60):
            for i, j in near(p, RC):
                label[i] = label[j] = min(label[i], label[j])
        want |= {(f, i): k for i, k in enumerate(label)}
    assert {(r["frame"], r["node"]): r["label"] for r in rows(spark, "connected_components", d)} == want
    assert {r["frame"] for r in rows(spark, "bonds", d)} == set(range(N_FRAMES))
    first, got = near(x[0], 0.2, L), {(r["frame"], r["atom"]): r for r in rows(spark, "deformation_gradient", d)}
    degree = defaultdict(float)
    for f in range(1, N_FRAMES):
        for i, j in first:
            q = x[f][j] - x[f][i]
            degree[f, i] += ((q - L * np.round(q / L)) ** 2).sum()
    assert set(got) == set(degree) and all(math.isclose(got[k]["dd"], v, abs_tol=2e-6) for k, v in degree.items())


def test_structure_of_all_frames(spark, small):
    d, x = small
    every = {(f, i) for f in range(N_FRAMES) for i in range(60)}
    for name in ("bond_order_l2", "q6_bond_order", "acna", "ptm", "grains"):
        assert {(r["frame"], r["atom"]) for r in rows(spark, name, d)} <= every and len({r["frame"] for r in rows(spark, name, d)}) == N_FRAMES, name
    want = defaultdict(set)
    for f, p in enumerate(x):
        for i, j in near(p, 0.04):
            if i % 2 == 0 and j % 2 == 1:
                want[i % 7].add(f)
    assert {r["residue"]: r["frequency"] for r in rows(spark, "contact_frequency", d)} == {k: round(len(v) / N_FRAMES, 6) for k, v in want.items()}
    assert len({r["frame"] for r in rows(spark, "hbond_three_way", d)}) == N_FRAMES


def test_tables_of_all_frames_and_rows(spark, small):
    d, x = small
    for name, key in (("xyz_roundtrip", "atom"), ("dump_roundtrip", "id")):
        got = {(r["frame"], r[key]): r["x"] for r in rows(spark, name, d)}
        assert len(got) == N_FRAMES * 60 and all(math.isclose(v, x[f][i][0], abs_tol=1e-6) for (f, i), v in got.items())
    assert sorted((r["global_row"], r["block"], r["row"], r["step"]) for r in rows(spark, "thermo_concat", d)) == [(200 * b + k, f"t{b}", k, 3 * k + b) for b in range(3) for k in range(200)]
    found = {(r["block"], r["frame"]): r["row"] for r in rows(spark, "thermo_asof", d)}
    assert found == {(f"t{b}", k): min(range(200), key=lambda r: (abs(3 * r + b - 37.5 * k), r)) for b in range(3) for k in range(200)}
    found = {(r["block"], r["want"]): r["frame"] for r in rows(spark, "energy_nearest_frame", d)}
    assert found == {(f"t{b}", k): min(range(0, 200, 5), key=lambda r: (abs(r - k), r)) for b in range(3) for k in range(200)}
