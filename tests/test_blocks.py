"""Components by blocks of edges, principal components by power iteration and frames by tiled moments, against plain algebra."""

import random

import numpy as np
import pytest
from lattices import table
from pyspark.sql import functions as F

from moteflow.operators import graph
from moteflow.plans import conformation


def plain_labels(nodes, edges):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def components(spark, nodes, edges, kind, block):
    e = spark.createDataFrame(edges, f"a {kind}, b {kind}").repartition(5)
    return {r["node"]: r["label"] for r in graph.connected_components(spark.createDataFrame([(n,) for n in nodes], f"node {kind}"), e, block).collect()}


@pytest.mark.parametrize("block", [1, 7, 1 << 18])
def test_components_equal_plain_union(spark, block):
    rng = random.Random(block)
    nodes = list(range(120))
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(80)] + [(5, 5), (7, 9), (9, 7), (7, 9)]
    assert components(spark, nodes, edges, "long", block) == plain_labels(nodes, edges)
    names = [f"n{k:03d}" for k in nodes]
    assert components(spark, names, [(names[a], names[b]) for a, b in edges], "string", block) == plain_labels(names, [(names[a], names[b]) for a, b in edges])
    assert components(spark, nodes[:3], [], "long", block) == {0: 0, 1: 1, 2: 2}


def test_a_chain_through_many_blocks_needs_few_rounds(spark, monkeypatch):
    n, tables = 3000, []
    kept = graph.written

    def counted(df, what):
        out = kept(df, what)
        tables.append((what, out.count()))
        return out

    monkeypatch.setattr(graph, "written", counted)
    nodes = spark.range(n).select(F.col("id").alias("node"))
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.connected_components(nodes, edges, 100).select("label").distinct().count() == 1
    rounds = [rows for what, rows in tables if what == "labels"]
    assert len(rounds) <= 10 and max(rounds) < 200  # only nodes that blocks share go through rounds
    assert sum(rows for what, rows in tables if what != "roots") < n


def shapes(frames, atoms, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 3, (atoms, 3))
    return [base + 0.3 * rng.normal(0, 1, (atoms, 3)) + np.sin(f) * base[::-1] * 0.2 for f in range(frames)]


@pytest.mark.parametrize("frames,width", [(6, 24), (12, 8)])
def test_principal_components_equal_svd(spark, monkeypatch, frames, width):
    monkeypatch.setattr(conformation, "WIDTH", width)
    x = shapes(frames, 20)
    table_, shares = conformation.principal_components(table(spark, [p.tolist() for p in x]), 2, 1e-8)
    flat = np.stack([p.ravel() for p in x])
    u, s, _ = np.linalg.svd(flat - flat.mean(0), full_matrices=False)
    got = np.array([[r[f"p{k}"] for k in (1, 2)] for r in table_.orderBy("frame").collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-2) and np.allclose(shares, (s**2 / (s**2).sum())[:2], atol=1e-6)


def fitted(a, b):
    a, b = a - a.mean(0), b - b.mean(0)
    u, s, vt = np.linalg.svd(a.T @ b)
    s[2] *= np.sign(np.linalg.det(u @ vt))
    return np.sqrt(max(0.0, (a**2).sum() + (b**2).sum() - 2 * s.sum()) / len(a))


def test_frame_matrix_equals_fits_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(conformation, "CHUNK", 7)
    x = shapes(9, 30, 2)
    got = conformation.frame_matrix(table(spark, [p.tolist() for p in x]), list(range(9)))
    assert np.allclose(got, [[fitted(a, b) for b in x] for a in x], atol=1e-6)


def test_frames_beyond_the_matrix_join_their_nearest_medoid(spark, monkeypatch):
    monkeypatch.setattr(conformation, "MATRIX_FRAMES", 4)
    rng = np.random.default_rng(3)
    bases = [rng.normal(0, 3, (15, 3)) for _ in range(2)]
    x = [bases[f // 2 % 2] + 0.01 * rng.normal(0, 1, (15, 3)) for f in range(12)]
    got = {r["frame"]: (r["cluster"], r["population"]) for r in conformation.clusters(table(spark, [p.tolist() for p in x]), 2).collect()}
    assert len(got) == 12 and len({got[f] for f in range(12) if f // 2 % 2 == 0}) == 1 and len({got[f] for f in range(12) if f // 2 % 2}) == 1 and all(p == 6 for _, p in got.values())
