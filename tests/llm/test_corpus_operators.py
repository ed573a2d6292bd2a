import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from moteflow.llm import ann, linededup, mixing, ngramjoin, sharding, toxicity

DOCS = "doc_id long, text string, source string, line_row string, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", "x", "y") for i, t in rows], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(0, 1, (150, 8)).astype("float32")
    v[40:60] = v[40]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(3, v[3].tolist()), (900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] * 8), (None, [1.0] * 8), (904, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 10 = 0"), 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    w = v.astype(float)
    for q in range(0, 150, 10):
        d = np.sqrt(((w - w[q]) ** 2).sum(1))
        want = sorted((d[i], i) for i in range(150) if i != q)[:5]
        assert [got[q][k + 1][0] for k in range(5)] == [i for _, i in want] and np.allclose([got[q][k + 1][1] for k in range(5)], [s for s, _ in want], atol=1e-12)
    assert set(got) == set(range(0, 150, 10))
    twice = spark.createDataFrame([(0, [0.0, 1.0]), (0, [5.0, 0.0]), (1, [5.0, 0.5]), (2, [0.0, 3.0]), (3, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.nearest(twice, twice.where("vec_id = 0"), 2).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 2.0)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    small = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(small, small, 10).orderBy("query_id").collect()] == [(0, 1, 1, 1.0), (1, 1, 0, 1.0)]


def test_tile_bounds_lose_nothing():
    rng = np.random.default_rng(2)
    q, c = rng.normal(0, 1, (20, 16)), rng.normal(0, 1, (5000, 16)) * rng.lognormal(0, 1, (5000, 1))
    c[:30] = q[3] + 1e-9 * rng.normal(0, 1, (30, 16))
    packed = lambda x: (ann.quantise(x)[0].astype(np.int8), *ann.quantise(x)[1:])
    row, col, lower, upper = ann.tile_survivors(np.arange(20), packed(q), np.arange(100, 5100), packed(c), 10)
    assert len(row) < 20 * 600
    for i in range(20):
        d = np.sqrt(((c - q[i]) ** 2).sum(1))
        at = col[row == i]
        assert set(np.argsort(d, kind="stable")[:10].tolist()) <= set(at.tolist()) and (lower[row == i] <= d[at]).all() and (upper[row == i] >= d[at]).all()


def test_toxicity_learns_and_generalises(spark):
    rng = random.Random(3)
    bad = ["horridword", "vileperson", "stinker"]
    rows, labels = [], []
    for i in range(360):
        t = words(rng, rng.randint(20, 200)).split()
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(bad))
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, words(rng, 30) + " horidword " + words(rng, 30)), (1003, words(rng, 60_000)), (None, "x y"), (5, rows[5][1])]
    docs = table(spark, rows)
    lab = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.scored(docs, lab).collect()
    truth = dict(labels)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 360 and r["held_out"]]
    assert len(held) > 60 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and by[1002]["score"] > 0.5 > by[1001]["score"] == by[1000]["score"] and by[None]["held_out"]
    clash = docs.withColumn("Score", F.lit("mine")).withColumn("toxicity_score", F.lit(1))
    assert toxicity.clean(clash, lab).columns == clash.columns and toxicity.scored(clash, lab).count() == len(got)
    kept = toxicity.clean(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    assert toxicity.scored(docs, lab.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.scored(docs.limit(0), lab).count() == 0


def plain_grams(word):
    """Buckets of a word's n-grams and of its pieces, one by one."""
    b, out, mask = b"<" + word.encode() + b">", [], 2**64 - 1
    for at in range(0, max(1, len(b) - toxicity.OVERLAP), toxicity.PIECE - toxicity.OVERLAP):
        piece = b[at : at + toxicity.PIECE]
        h = 0
        for i in range(toxicity.PIECE):
            h = (((h ^ (piece[i] if i < len(piece) else 0)) * 1099511628211) + i) & mask
        out.append((h * 0x9E3779B97F4A7C15 & mask) >> 40)
        for n in toxicity.GRAMS:
            for i in range(len(piece) - n + 1):
                h = n
                for c in piece[i : i + n]:
                    h = ((h ^ c) * 1099511628211) & mask
                out.append((h * 0x9E3779B97F4A7C15 & mask) >> 40)
    return [x % toxicity.BUCKETS for x in out]


def test_toxicity_scores_equal_a_plain_sum():
    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(0, 3, toxicity.BUCKETS), -0.4)
    texts = ["", None, "one", "Zwei drei-vier", "a b c d e f g", "x" * 90 + " tail " + "ß" * 70, "the " * 5000 + "end of it all now"]
    for t, got in zip(texts, model.score(texts), strict=True):
        means = [np.mean([model.bucket_score[b] for b in plain_grams(w)]) for w in re.findall(r"\w+", (t or "").lower())]
        windows = [np.mean(means[i : i + 4]) for i in range(max(1, len(means) - 3))] if means else [0.0]
        assert abs(got - 1 / (1 + np.exp(-(max(windows) + model.bias)))) < 1e-9


def test_toxicity_training_equals_plain_steps():
    texts, toxic, rate, decay = ["good fine day", "bad awful word here now and then", "fine", "awful", ""], [0, 1, 0, 1, 0], 0.2, 1e-4
    got = toxicity.fit(texts, toxic, rounds=3, trusted_rounds=2)
    rng = np.random.default_rng(7)
    v, w, b = rng.normal(0, 0.1, (toxicity.BUCKETS, toxicity.DIM)), rng.normal(0, 0.1, (2, toxicity.DIM)), np.zeros(2)
    sv, sw, sb = np.full(toxicity.BUCKETS, 1e-8), np.full((2, toxicity.DIM), 1e-8), np.full(2, 1e-8)
    for step in range(3):
        gv, gw, gb, used = {}, np.zeros_like(w), np.zeros(2), set()
        for t, y in zip(texts, toxic, strict=True):
            bags = [plain_grams(x) for x in t.split()]
            starts = range(max(1, len(bags) - 3)) if bags else []
            at = max(starts, key=lambda i: np.mean([np.mean(v[g] @ (w[1] - w[0])) for g in bags[i : i + 4]]), default=0)
            bags = bags[at : at + 4]
            pooled = np.mean([v[g].mean(0) for g in bags], 0) if bags else np.zeros(toxicity.DIM)
            p = np.exp(w @ pooled + b)
            p /= p.sum()
            used |= {x for g in bags for x in g}
            if step >= 2 and abs(p[1] - y) > 0.6:
                continue
            delta = (p - np.array([1 - y, y])) * (0.5 / 2 if y else 0.5 / 3)
            gw += np.outer(delta, pooled)
            gb += delta
            for g in bags:
                for x in g:
                    gv[x] = gv.get(x, 0) + (delta @ w) / len(bags) / len(g)
        for x in used:
            g = gv.get(x, 0) + decay * v[x]
            sv[x] += np.square(g).mean()
            v[x] = v[x] - rate * g / np.sqrt(sv[x])
        sw += np.square(gw)
        sb += np.square(gb)
        w, b = w - rate * gw / np.sqrt(sw), b - rate * gb / np.sqrt(sb)
    assert np.allclose(got.bucket_score, v @ (w[1] - w[0]), atol=1e-9) and abs(got.bias - (b[1] - b[0])) < 1e-9


def repeated_runs(docs, least):
    """Every run of lines that an earlier place has too: all diagonals of all pairs."""
    cut = {k: re.split(r"(?<=\n)|(?<=[.!?] )", t) for k, t in docs}
    n = lambda u: len(u.strip(" \n\r\t").split(" ")) if u.strip(" \n\r\t") else 0
    gone = {k: set() for k, _ in docs}
    for (a, _), (b, _) in itertools.combinations_with_replacement(docs, 2):
        u, v = ([x.strip(" \n\r\t") for x in cut[k]] for k in (a, b))
        for shift in range(1 if a == b else -len(u) + 1, len(v)):
            run = []
            for j in range(max(0, shift), len(v) + 1):
                if j < len(v) and j - shift < len(u) and v[j] == u[j - shift]:
                    run.append(j)
                    continue
                if sum(n(cut[b][x]) for x in run) >= least:
                    gone[b] |= set(run)
                run = []
    return {k: "".join(x for j, x in enumerate(cut[k]) if j not in gone[k]) for k, _ in docs}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(6)
    line = lambda n: words(rng, n).capitalize() + "."
    passage, long_line, block = " ".join(line(9) for _ in range(6)), line(55), "\n".join(line(12) for _ in range(5))
    docs = [(1, line(20) + "\n" + passage + "\n" + line(10)), (2, line(8) + " " + passage + " " + line(7)), (3, long_line + "\n" + line(9)), (4, line(5) + "\n" + long_line + "\n\n" + block), (5, block), (6, "Short one.\n" * 40), (7, line(30)), (8, "a\x01b. Why? No! " + passage), (9, ""), (13, "And so " + passage.replace(". ", "! ", 1) + " went on. " + line(9)), (14, line(6) + " Then " + passage.replace(". ", "! ", 1) + " it said."), (10, line(9) + "\n  " + block + "  \n" + line(8))]
    got = linededup.dedup_lines(table(spark, [*docs, (None, block), (11, None), (12, line(40)), (12, "")]), removed="n")
    rows = got.collect()
    want = repeated_runs(docs, linededup.MIN_WORDS)
    for r in rows:
        if r["doc_id"] in want:
            assert r["text"] == want[r["doc_id"]], r["doc_id"]
    assert {r["text"] for r in rows if r["doc_id"] is None} == {""} and {r["text"] for r in rows if r["doc_id"] == 11} == {None}
    assert got.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "n"] and len(rows) == 16
    assert linededup.dedup_lines(table(spark, docs).limit(0)).count() == 0


def test_line_dedup_finds_a_run_whose_lines_stood_alone_before(spark):
    rng = random.Random(61)
    x, y, z = (words(rng, 14).capitalize() + "." for _ in range(3))
    run, lone = "\n".join([x, y, z]), lambda k: words(rng, 6) + ".\n" + k + "\n" + words(rng, 5) + "."
    docs = [(1, lone(x)), (2, lone(y)), (3, lone(z))]
    for i in range(4, 24, 4):  # and again between the copies, and a heading before the run in its own document
        docs += [(i, words(rng, 7) + ".\n" + run + "\n" + words(rng, 8) + "."), (i + 1, lone(x)), (i + 2, lone(y)), (i + 3, x + "\n" + words(rng, 3) + ".\n\n" + run)]
    for _ in range(12):  # short lines, long ones and blanks from few, so that runs of all lengths meet
        pool = [words(random.Random(k), 1 + 3 * k) + "." for k in range(5)] + ["", ""]
        docs.append((100 + len(docs), "\n".join(rng.choice(pool) for _ in range(30))))
    want = repeated_runs(docs, linededup.MIN_WORDS)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(table(spark, docs)).collect()}
    assert got == want and sum(y in t and z in t for t in got.values()) == 1


def test_line_dedup_of_very_many_lines(spark):
    block = [f"line {i} of a block that comes twice." for i in range(5)]
    long = [f"number {i}" for i in range(100_000)] + block + [f"other {i}" for i in range(100_000)] + block + ["end"]
    got = linededup.dedup_lines(table(spark, [(1, "\n".join(block)), (2, "\n".join(long)), (3, "one. two. three.")]), removed="n").collect()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n"] == 10 and by[2]["text"] == "\n".join(x for x in long if "block" not in x) and by[1]["n"] == by[3]["n"] == 0
    counts = [[], [3], list(range(511)), list(range(512)), list(range(513)), [1] * 1537]
    ends = spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "i int, w array<int>").select("i", linededup.word_ends(F.col("w")).alias("e"))
    assert {r["i"]: list(itertools.accumulate(counts[r["i"]])) == r["e"] for r in ends.collect()} == dict.fromkeys(range(len(counts)), True)


def test_line_dedup_windows_select_the_least_hash(spark):
    rng = random.Random(62)
    text = "\n".join(words(rng, rng.randrange(0, 9)) for _ in range(60))
    found = linededup.windows(spark.createDataFrame([(1, 2, text)], "d long, id long, text string"), 20).collect()
    h = spark.createDataFrame([(k, x) for k, x in enumerate(text.split("\n"))], "k int, x string").select("k", F.xxhash64("x").alias("h")).collect()
    h = {r["k"]: r["h"] for r in h}
    for r in found:
        a, b = r["place"] >> 32, r["place"] & 0xFFFFFFFF
        assert r["mark"] == min(h[k] for k in range(a, b + 1)) == h[r["line"]] and a <= r["line"] <= b
    # the guarantee: every run of 20 words holds a window
    n = [len(x.split()) for x in text.split("\n")]
    spans = {(r["place"] >> 32, r["place"] & 0xFFFFFFFF) for r in found}
    for a in range(60):
        b = next((b for b in range(a, 60) if sum(n[a : b + 1]) >= 20), None)
        assert b is None or any(a <= x and y <= b for x, y in spans)


def test_line_dedup_runs_no_python(spark):
    plan = linededup.dedup_lines(table(spark, [(1, "a.\nb.")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_mixing_meets_targets_and_equals_numpy(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, 40 + i % 50) if i % 4 else "### %%% " * (20 + i % 30)) for i in range(200)] + [(300, None), (301, ""), (None, words(rng, 10)), (5, words(rng, 44)), (302, words(rng, 3000))]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 200, 2)] + [(None, 1), (9, None), (11, 7)], "doc_id long, quality int")
    docs = table(spark, rows)
    got = mixing.document_rates(docs, labels, {1: 0.6, 0: 0.4}).collect()
    n, p, r = np.array([g["n_tokens"] for g in got], float), np.array([list(g["p"]) for g in got]), np.array([g["rate"] for g in got])
    assert len(got) == len(rows) and np.allclose(p.sum(1), 1) and r.min() >= 0
    share = (n * r) @ p
    assert np.allclose(share / share.sum(), [0.6, 0.4], atol=1e-6)
    rate = np.ones(len(n))
    target, gram = np.array([0.6, 0.4]) * n.sum(), (p * n[:, None]).T @ p
    for _ in range(500):  # plain projected gradient with short steps
        rate = np.maximum(0, rate + 0.5 * p @ np.linalg.solve(gram, target - (n * rate) @ p))
    assert np.allclose(rate, r, atol=1e-5)
    soft = n @ p
    low = 1.02 * float((n[p[:, 0] < 0.5] @ p[p[:, 0] < 0.5])[0] / soft.sum())  # hardly more than the other domain's documents bring by themselves
    harsh = np.array([g["rate"] for g in mixing.document_rates(docs, labels, {1: low, 0: 1 - low}, rounds=60).collect()])
    rate, target = np.ones(len(n)), np.array([low, 1 - low]) * n.sum()
    for _ in range(3000):
        rate = np.maximum(0, rate + 0.5 * p @ np.linalg.solve(gram, target - (n * rate) @ p))
    assert np.allclose(np.sort(harsh), np.sort(rate), atol=1e-3) and harsh.min() >= 0
    mixed = mixing.mix(docs, labels, {1: 0.6, 0: 0.4})
    posterior = {(g["doc_id"], g["n_tokens"]): (g["n_tokens"], g["p"][0]) for g in got}
    share = [posterior[(r["doc_id"], len((r["text"] or "").split()))] for r in mixed.select("doc_id", "text").collect()]
    assert abs(sum(t * q for t, q in share) / sum(t for t, _ in share) - 0.6) < 0.01  # rates are rounded to copies
    assert mixed.columns == docs.columns and mixed.count() >= len(rows) and mixed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert {g["rate"] for g in mixing.document_rates(docs, labels.limit(0), {1: 0.5, 0: 0.5}).collect()} == {1.0}
    assert mixing.document_rates(docs.limit(0), labels, {1: 0.5, 0: 0.5}).count() == 0


def test_sharding_fits_and_splits_only_what_is_too_large(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randint(1, 60))) for i in range(300)] + [(7, "hot key " * 10)] * 120 + [(400, "x" * 9000), (None, None), (None, "n"), (401, "")]
    got = sharding.with_shards(table(spark, rows), 4000).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert len(got) == len(rows)
    for s, rs in by.items():
        size = sum(r["n_bytes"] for r in rs)
        assert all((r["shard_bytes"], r["shard_rows"], r["depth"]) == (size, len(rs), len(s)) for r in rs) and (size <= 4000 or len(rs) == 1)
    shards = sorted(by)
    assert all(not b.startswith(a) for a, b in itertools.combinations(shards, 2))
    for s in shards:  # a bucket was split only because it was too large
        if s:
            assert sum(r["n_bytes"] for r in got if r["shard"].startswith(s[:-1])) > 4000
    assert {r["shard"] for r in sharding.with_shards(table(spark, rows), 10**9).collect()} == {""}
    assert sharding.with_shards(table(spark, rows).limit(0), 10).count() == 0


def test_written_shards(spark, tmp_path):
    rows = [(i, "text " * 10) for i in range(50)]
    sharding.write_shards(table(spark, rows), str(tmp_path / "s"), 700)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 50 and back.groupBy("bits").agg(F.sum(F.length("text")).alias("n")).agg(F.max("n")).first()[0] <= 700


def similarity(a, b):
    return len(a & b) / len(a | b)


def shingles(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_ngram_join_equals_brute_force(spark):
    rng = random.Random(10)
    rows, base = [], words(rng, 120).split()
    for i in range(70):
        t = list(base)
        for _ in range(rng.choice((1, 1, 2, 3, 5))):
            t[rng.randrange(len(t))] = words(rng, 1)
        rows.append((i, " ".join(t)))
    rows += [(100 + i, words(rng, 60)) for i in range(40)]
    rows += [(200, rows[3][1]), (201, rows[3][1].upper()), (202, "one two"), (203, "one  two"), (204, ""), (205, None), (206, rows[70][1] + " tail"), (None, rows[71][1]), (7, rows[7][1])]
    ngramjoin.BLOCK, block = 16, ngramjoin.BLOCK
    try:
        got = ngramjoin.ngram_join(table(spark, rows)).collect()
    finally:
        ngramjoin.BLOCK = block
    classes = {}
    for i, t in rows:
        classes.setdefault(shingles(t), []).append(i)
    sets = list(classes)
    near = {s: [o for o in sets if o is not s and s and o and similarity(s, o) >= 0.8 - 1e-12] for s in sets}
    group = {}
    for s in sets:
        if s not in group:
            todo, seen = [s], set()
            while todo:
                if (x := todo.pop()) not in seen:
                    seen.add(x)
                    todo += near[x]
            ids = [i for x in seen for i in classes[x] if i is not None]
            for x in seen:
                group[x] = min(ids, default=None)
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        s = shingles(t)
        want.setdefault(i, []).append((min([j for j in classes[s] if j is not None], default=None), group[s], len(near[s])))
    for r in got:
        assert (r["class_id"], r["group_id"], r["n_links"]) in want[r["doc_id"]], r
    assert sum(r["first"] for r in got) == len({frozenset(map(str, [group[s], s if group[s] is None else ""])) for s in sets})
    docs = table(spark, rows)
    kept = ngramjoin.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["first"] for r in got)
    assert ngramjoin.ngram_join(docs.limit(0)).count() == 0


def test_prefixes_shorten_until_the_recall_is_met(spark, monkeypatch):
    k = ngramjoin.shortest_prefix(0.8)
    assert ngramjoin.found_at(0.8, k) >= ngramjoin.RECALL > ngramjoin.found_at(0.8, k + 1)
    depths, tiles = [], ngramjoin.tiles
    monkeypatch.setattr(ngramjoin, "tiles", lambda near, k: depths.append(k) or tiles(near, k))
    rng = random.Random(12)
    far = [words(rng, 300).split() for _ in range(12)]
    changed = lambda t, n: [words(rng, 1) if i % (len(t) // n) == 0 else w for i, w in enumerate(t)]
    for edits, last in ((1, ngramjoin.DEPTH), (6, k)):  # links far above the threshold are all found at once, those near it not
        rows = [(i, " ".join(t)) for i, t in enumerate(far)] + [(100 + i, " ".join(changed(t, edits))) for i, t in enumerate(far)]
        got = {r["doc_id"]: r for r in ngramjoin.ngram_join(table(spark, rows)).collect()}
        sets = {i: shingles(t) for i, t in rows}
        assert all(got[100 + i]["n_links"] == int(similarity(sets[i], sets[100 + i]) >= 0.8) for i in range(12))
        assert depths == list(range(ngramjoin.DEPTH, last - 1, -1))
        depths.clear()
