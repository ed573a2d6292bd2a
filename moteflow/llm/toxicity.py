"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its hashed character n-grams and of itself, so an unseen misspelling shares most of a
known word's vectors. What is averaged is a window of WINDOW words, and a text scores as its worst window does: in the mean of a
whole long text a toxic sentence vanishes. The gradient of each text flows through that window into the softmax and the n-gram
vectors alike. Because all of it is linear up to the softmax, a trained word is one number: scoring a text looks its words up
and takes the best sliding mean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ending, own_columns, slices

BUCKETS, DIM, GRAMS, WINDOW = 1 << 16, 16, (3, 4, 5), 4
PIECE, OVERLAP = 28, 4  # bytes: longer words are cut into pieces that overlap
WORDS = re.compile(r"\w+")
CACHE_WORDS = 300_000
THRESHOLD = 0.7


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every word, and the word it belongs to; words are marked at both ends."""
    pieces, owner = [], []
    for i, w in enumerate(words):
        b = b"<" + w.encode() + b">"
        for at in range(0, max(1, len(b) - OVERLAP), PIECE - OVERLAP):
            pieces.append(b[at : at + PIECE])
            owner.append(i)
    lengths, owner = np.fromiter(map(len, pieces), np.int64, len(pieces)), np.array(owner, np.int64)
    width = PIECE
    flat = np.zeros((len(pieces), width), np.uint64)
    flat[np.arange(width)[None, :] < lengths[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
    mix, buckets, owners = np.uint64(0x9E3779B97F4A7C15), [], []
    with np.errstate(over="ignore"):
        whole = np.zeros(len(pieces), np.uint64)
        for i in range(width):
            whole = (whole ^ flat[:, i]) * np.uint64(1099511628211) + np.uint64(i)
        buckets.append((whole * mix >> np.uint64(40)) % np.uint64(BUCKETS))
        owners.append(owner)
        for n in GRAMS:
            for i in range(width - n + 1):
                fits = lengths >= i + n
                if not fits.any():
                    break
                h = np.full(int(fits.sum()), n, np.uint64)
                for j in range(n):
                    h = (h ^ flat[fits, i + j]) * np.uint64(1099511628211)
                buckets.append((h * mix >> np.uint64(40)) % np.uint64(BUCKETS))
                owners.append(owner[fits])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def window_means(scores: np.ndarray) -> np.ndarray:
    """Mean of each run of WINDOW words; of all words, if fewer."""
    if len(scores) <= WINDOW:
        return np.array([scores.mean()])
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    return (sums[WINDOW:] - sums[:-WINDOW]) / WINDOW


@dataclass
class Model:
    """Per bucket, the n-gram vector's product with the softmax's weight difference; bias of the difference."""

    bucket_score: np.ndarray
    bias: float
    known: dict[str, float] = field(default_factory=dict)

    def forget(self) -> None:
        self.known = {}

    def __getstate__(self) -> dict:
        return {"bucket_score": self.bucket_score, "bias": self.bias, "known": {}}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        for at in range(0, len(new), 8192):
            part = new[at : at + 8192]
            buckets, owner = grams(part)
            mean = np.bincount(owner, self.bucket_score[buckets], len(part)) / np.bincount(owner, minlength=len(part))
            self.known.update(zip(part, mean.tolist(), strict=True))

    def score(self, texts: list[str | None]) -> list[float]:
        """Probability of the toxic class; of an empty text, what the bias alone gives."""
        lists = [words_of(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        self.learn({w for ws in lists for w in ws})
        get, out = self.known.__getitem__, []
        for ws in lists:
            logit = self.bias + (float(window_means(np.fromiter(map(get, ws), np.float64, len(ws))).max()) if ws else 0.0)
            out.append(1.0 / (1.0 + np.exp(-np.clip(logit, -40, 40))))
        return out


def fit(texts: list[str | None], toxic: list[int], rounds: int = 40, rate: float = 0.2, decay: float = 1e-4, seed: int = 7, distrust: float = 0.6, trusted_rounds: int = 13) -> Model:
    """Adagrad on the mean log loss, both classes weighing the same. Without examples of both, a model that scores 0.5 or less.

    Labels may be wrong: after trusted_rounds rounds, an example whose probability is further than distrust from its label has
    no weight in that round; it may come back in a later one. distrust=1 trusts every label.
    """
    y = np.array(toxic, float)
    lists = [words_of(t) for t in texts]
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), -4.0)
    vocabulary: dict[str, int] = {}
    coded = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], np.int64) for ws in lists]
    parts = [grams(list(vocabulary)[at : at + 16384]) for at in range(0, len(vocabulary), 16384)]
    bucket = np.concatenate([b for b, _ in parts])
    owner = np.concatenate([o + 16384 * i for i, (_, o) in enumerate(parts)])
    n_grams = np.bincount(owner, minlength=len(vocabulary))
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if (np.diff(owner) >= 0).all() else None
    if starts is None:
        order = np.argsort(owner, kind="stable")
        bucket, owner = bucket[order], owner[order]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    rng = np.random.default_rng(seed)
    vectors, weights, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (2, DIM)), np.array([0.0, 0.0])
    seen_v, seen_w, seen_b = np.full(BUCKETS, 1e-8), np.full((2, DIM), 1e-8), np.full(2, 1e-8)
    weight = base = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for round_no in range(rounds):
        direction = weights[1] - weights[0]
        word = np.add.reduceat((vectors @ direction)[bucket], starts) / n_grams
        chosen = []
        for c in coded:
            if len(c) <= WINDOW:
                chosen.append(c)
            else:
                at = int(window_means(word[c]).argmax())
                chosen.append(c[at : at + WINDOW])
        sizes = np.array([len(c) for c in chosen])
        doc = np.repeat(np.arange(len(chosen)), sizes)
        used = np.concatenate(chosen) if len(doc) else np.zeros(0, np.int64)
        own, local = np.unique(used, return_inverse=True)
        counts = n_grams[own]
        ends = np.cumsum(counts)
        gram_at = np.arange(ends[-1] if len(own) else 0) + np.repeat(starts[own] - (ends - counts), counts)
        used_bucket = bucket[gram_at]
        embedded = (np.add.reduceat(vectors[used_bucket], ends - counts) if len(own) else np.zeros((0, DIM))) / counts[:, None]
        pooled = np.zeros((len(chosen), DIM))
        np.add.at(pooled, doc, embedded[local])
        pooled /= np.maximum(sizes, 1)[:, None]
        logits = pooled @ weights.T + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        if round_no >= trusted_rounds:
            weight = np.where(np.abs(p[:, 1] - y) > distrust, 0.0, base)
        delta = (p - np.stack([1 - y, y], 1)) * weight[:, None]
        g_w, g_b, g_pooled = delta.T @ pooled, delta.sum(0), delta @ weights
        g_word = np.zeros((len(own), DIM))
        np.add.at(g_word, local, (g_pooled / np.maximum(sizes, 1)[:, None])[doc])
        order = np.argsort(used_bucket, kind="stable")
        touched, first = np.unique(used_bucket[order], return_index=True)
        g_bucket = np.add.reduceat(np.repeat(g_word / counts[:, None], counts, axis=0)[order], first) + decay * vectors[touched]
        seen_v[touched] += np.square(g_bucket).mean(1)
        vectors[touched] -= rate * g_bucket / np.sqrt(seen_v[touched])[:, None]
        seen_w += np.square(g_w)
        seen_b += np.square(g_b)
        weights -= rate * g_w / np.sqrt(seen_w)
        bias -= rate * g_b / np.sqrt(seen_b)
    return Model(vectors @ (weights[1] - weights[0]), float(bias[1] - bias[0]))


def held_out(key: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, modulo 3, is 1; a null id counts as held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_chars: int = 20_000, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits on a bounded sample of labelled rows that are not held out: at most per_class of each class, in the order of a hash
    of their ids, from whole texts of at most max_chars characters. Null labels and null ids are left out; of several labels of
    one id the largest counts, of several texts of one id the smallest.
    """
    known = own_columns(labels, key, label).where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).alias("y"))
    sizes = own_columns(docs, key, text).select(key, F.length(text).alias("n")).where((F.col("n") <= max_chars) & ~held_out(F.col(key)))
    labelled = sizes.join(known, key).groupBy(key).agg(F.max("y").alias("y"))
    chosen = [(r[key], r["y"]) for y in (0, 1) for r in labelled.where(F.col("y") == y).orderBy(F.xxhash64(key), key).limit(per_class).collect()]
    if not chosen:
        return fit([], [])
    sample = docs.sparkSession.createDataFrame(chosen, f"{key} long, y int")  # 2 * per_class rows
    rows = own_columns(docs, key, text).where(F.length(text) <= max_chars).join(F.broadcast(sample), key)
    texts, toxic = [], []
    for r in rows.groupBy(key).agg(F.min(text).alias(text), F.max("y").alias("y")).orderBy("y", F.xxhash64(key), key).collect():  # at most 2 * per_class * max_chars
        texts.append(r[text])
        toxic.append(r["y"])
    return fit(texts, toxic)


def with_score(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """docs with one more column, the probability that the whole text is toxic. Null and empty texts score by the bias.

    All other columns, nulls and repeated rows pass unchanged; a column of that name is replaced.
    """
    from pyspark.sql.functions import arrow_udf

    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS doubles

    def run(texts: Iterator) -> Iterator:
        import pyarrow as pa

        def scores() -> Iterator:
            for batch in texts:
                rows = pa.record_batch([batch], ["text"])
                yield pa.array([x for part in slices(rows, 0, 256, 1 << 20) for x in shared.value.score(part.column(0).to_pylist())], pa.float64())

        yield from ending(scores(), shared.value.forget)

    # Arrow's types as annotations choose the form of the function; only texts go to Python and only scores come back
    run.__annotations__ = {"texts": Iterator[_arrow()], "return": Iterator[_arrow()]}
    return docs.drop(score).withColumn(score, arrow_udf(run, "double")(F.col(f"`{text}`")))


def _arrow():  # noqa: ANN202
    import pyarrow as pa

    return pa.Array


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; the model is trained on the labelled rows first."""
    rows = with_score(own_columns(docs, "doc_id", "text"), train(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text does not score as toxic."""
    model = train(docs, labels)
    name = "toxicity_score"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return with_score(docs, model, score=name).where(F.col(name) < THRESHOLD).drop(name)
