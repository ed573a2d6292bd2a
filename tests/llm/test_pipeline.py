import math
import os
import re
import struct

from pyspark.sql import functions as F


def test_stages_compose(spark, tmp_path):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "near copies", "mixing", "encoding"] and P.ORACLE_SQL is None
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, docs
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, seen, sf)
        out.write.parquet(str(tmp_path / str(k)))
        before, seen = seen, spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert seen.columns == columns
        if k == 1:
            assert seen.count() == before.count() and seen.where(F.length("text") != F.col("n_chars")).count() == 0
        if k == 2:
            assert 0 < seen.count() < before.count()
        if k == 3:
            assert seen.select("doc_id").distinct().count() == before.count()
    assert seen.count() == spark.read.parquet(str(tmp_path / "3")).count() and "token_ids" in seen.columns


def test_entry_guards_missing_operators():
    src = open(os.path.join(os.path.dirname(__file__), "..", "..", "__spark_entry__.py")).read()
    assert "moteflow.llm" in src and not re.search(r"^(from|import) (moteflow\.llm|corpus_pipeline)", src, re.M)


def plain_score(model, text):
    """The worst window's mean of the words' means of their n-grams' numbers, word by word."""
    from moteflow.llm import toxicity

    scores = [model.bucket_score[toxicity.grams([w])[0]].mean() for w in toxicity.words_of(text)]
    spans = [scores[i : i + toxicity.WINDOW] for i in range(max(1, len(scores) - toxicity.WINDOW + 1))] if scores else []
    return 1 / (1 + math.exp(-(model.bias + max((sum(s) / len(s) for s in spans), default=0.0))))


def first_of_groups(rows):
    """(id, text) of the smallest id of each group that similarities of 0.8 and more of five-word shingles join."""
    shingles = []
    for _, text in rows:
        w = (text or "").lower().split()
        shingles.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = shingles[a], shingles[b]
            if x == y or (x and y and len(x & y) >= 0.8 * len(x | y) - 1e-12):
                group = [group[b] if g == group[a] else g for g in group]
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    return {rows[min((i for i, g in enumerate(group) if g == k), key=order)] for k in set(group)}


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline as P
    from test_corpus_operators import repeated_runs
    from tokenizers import Tokenizer

    from moteflow.llm import linededup, toxicity
    from moteflow.llm.common import tokenizer_path

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    short = docs.where(F.length("text") < 1500).orderBy("doc_id").limit(70)
    some = short.limit(3)
    odd = [
        some.withColumn("doc_id", F.col("doc_id") + 1_000_000),  # copies
        some.limit(1),  # a repeated row
        some.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat(F.lit("Another text of a row without an id it is. "), "text")),
        some.limit(1).withColumn("doc_id", F.lit(2_000_000).cast("long")).withColumn("text", F.lit(None).cast("string")),
        some.limit(1).withColumn("doc_id", F.lit(2_000_001).cast("long")).withColumn("text", F.lit("")),
    ]
    for extra in odd:
        short = short.unionByName(extra)
    short.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = P.run(spark, str(tmp_path)).collect()

    model = toxicity.train(docs, labels)
    kept = {(r["doc_id"], r["text"]) for r in docs.collect() if plain_score(model, r["text"]) < 0.7}
    named = sorted((r for r in kept if r[0] is not None and r[1]), key=lambda r: r[0])
    assert len({k for k, _ in named}) == len(named)
    nameless = [t for k, t in kept if k is None]
    lined = repeated_runs([*named, *((10**9, t) for t in nameless)], linededup.MIN_WORDS)
    after = [(k, lined[k] if k is not None and t else lined[10**9] if t else t) for k, t in kept]
    want = first_of_groups(after)
    encoder = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = {k: encoder.encode(t or "", add_special_tokens=False).ids for k, t in want}
    seen = {r["doc_id"]: list(struct.unpack(f"<{len(r['token_ids']) // 4}I", r["token_ids"])) for r in got}
    assert seen == ids and len(got) >= len(want) < len(kept) and all(r["n_tokens"] == len(seen[r["doc_id"]]) for r in got)


def test_stages_take_empty_tables(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, sf).count() == 0
