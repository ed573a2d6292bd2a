"""Mixing to target weights by soft membership; DataFrame functions only.

A Gaussian naive Bayes classifier over style features, fitted on the labelled table by one aggregation, gives each document a
posterior over domains. Nonnegative rates are then fitted by projected-gradient least squares so that the expected tokens of
each domain, summed over documents of rate * tokens * posterior, meet the targets. The metric weighs a document by its tokens
and the residual is whitened by the domains' Gram matrix, so a step of length one is exact while no rate meets zero; a step is
one distributed sum, and the driver holds only a few numbers a domain.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

FEATURES = ("f_length", "f_blank", "f_line", "f_symbol", "f_digit", "f_upper", "f_varied")
SMOOTH = 1e-3  # added to each variance
SYMBOLS, DIGITS, UPPER = "|%$#&*!<>{}=_^~", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def features(text: Column) -> list[Column]:
    """n_tokens (pieces between blanks and newlines) and the features; of an empty text all are 0."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda c: (F.length(text) - F.length(c)) / n
    pieces = F.array_remove(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "), "")
    return [
        F.size(pieces).cast("long").alias("n_tokens"),
        F.ln(F.length(text) + 1.0).alias("f_length"),
        share(F.replace(text, F.lit(" "), F.lit(""))).alias("f_blank"),
        (share(F.replace(text, F.lit("\n"), F.lit(""))) * 10).alias("f_line"),
        share(F.translate(text, SYMBOLS, "")).alias("f_symbol"),
        share(F.translate(text, DIGITS, "")).alias("f_digit"),
        share(F.translate(text, UPPER, "")).alias("f_upper"),
        (F.size(F.array_distinct(pieces)) / F.greatest(F.size(pieces), F.lit(1))).alias("f_varied"),
    ]


def posteriors(rows: DataFrame, labels: DataFrame, domains: list, label: str) -> DataFrame:
    """rows (key k and features) with p, the posterior of each domain in the order given.

    Rows of labels with another value, a null value or a null key are left out; of several labels of one key the largest counts.
    A domain without examples gets 0; without any example all domains get the same.
    """
    known = labels.where(F.col("k").isNotNull() & F.col(label).isin(domains)).groupBy("k").agg(F.max(label).alias("y"))
    stats = rows.join(known, "k").groupBy("y").agg(F.count("*").alias("n"), *[F.avg(f).alias(f"m_{f}") for f in FEATURES], *[(F.var_pop(f) + SMOOTH).alias(f"v_{f}") for f in FEATURES])
    found = {r["y"]: r for r in stats.collect()}  # a row for each domain
    if not found:
        return rows.withColumn("p", F.array(*[F.lit(1.0 / len(domains))] * len(domains)))
    total = sum(r["n"] for r in found.values())

    def score(d: object) -> Column:
        if d not in found:
            return F.lit(float("-inf"))
        r = found[d]
        terms = [-0.5 * math.log(2 * math.pi * r[f"v_{f}"]) - (F.col(f) - r[f"m_{f}"]) * (F.col(f) - r[f"m_{f}"]) / (2 * r[f"v_{f}"]) for f in FEATURES]
        return reduce(lambda a, b: a + b, terms, F.lit(math.log(r["n"] / total)))

    scored = rows.withColumn("s", F.array(*[score(d) for d in domains])).withColumn("s", F.transform("s", lambda x: F.exp(x - F.array_max("s"))))
    total_s = reduce(lambda a, b: a + b, [F.get("s", F.lit(i)) for i in range(len(domains))])
    return scored.withColumn("p", F.transform("s", lambda x: x / total_s)).drop("s")


def fit_rates(members: DataFrame, weights: list[float], total_tokens: float | None, upsample: bool, rounds: int, tolerance: float) -> Column:
    """A column of members (n_tokens, p) that is the rate of each row: 1 if there is nothing to fit."""
    import numpy as np

    k = len(weights)
    p = [F.get("p", F.lit(i)) for i in range(k)]
    n = F.col("n_tokens").cast("double")
    gram = members.agg(*[F.sum(n * p[i]).alias(f"t{i}") for i in range(k)], *[F.sum(n * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]).first()
    now = np.array([gram[f"t{i}"] or 0.0 for i in range(k)])
    share = np.array(weights, float) / sum(weights)
    if now.sum() <= 0:
        return F.lit(1.0)
    total, least = total_tokens or now.sum(), 1.0 if upsample else 0.0
    if upsample:
        total = max((now[i] / share[i] for i in range(k) if share[i] > 0), default=total)
    g = np.array([[gram[f"g{i}_{j}"] for j in range(k)] for i in range(k)])
    while True:
        target, rate, got = share * total, F.lit(1.0), now
        for _ in range(rounds):
            residual = target - got
            if np.abs(residual).max() <= tolerance * target.sum():
                return rate
            step = np.linalg.lstsq(g, residual, rcond=1e-12)[0]
            rate = F.greatest(F.lit(least), reduce(lambda a, b: a + b, [p[i] * float(step[i]) for i in range(k)], rate))
            sums = members.select(n.alias("n"), rate.alias("r"), "p").agg(*[F.sum(F.col("n") * F.col("r") * F.get("p", F.lit(i))).alias(f"t{i}") for i in range(k)]).first()
            got = np.array([sums[f"t{i}"] for i in range(k)])
        if not upsample or total > 1e3 * now.sum():
            return rate  # the nearest that rates in reach come
        total *= 1.1  # rates that may not fall under one need more tokens in all


def document_rates(docs: DataFrame, labels: DataFrame, targets: dict, label: str = "quality", key: str = "doc_id", text: str = "text", total_tokens: float | None = None, upsample: bool = False, rounds: int = 20, tolerance: float = 1e-9) -> DataFrame:
    """One row for each row of docs: key, id (hash of key and text), n_tokens, p (posteriors in the order of targets), rate.

    targets gives each domain's weight. The tokens to reach are total_tokens, or as many as docs has; with upsample no rate is
    under 1, and the tokens to reach are the fewest for which no domain must shrink, or more in steps of a tenth until the
    targets are met. Null and empty texts have no tokens and the rate of their features. Null keys have no
    label. Repeated rows have equal rates, as have ties. Without tokens all rates are 1. An empty table gives no rows. Extra
    columns are not read.
    """
    domains = list(targets)
    base = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(key), F.col(text)).alias("id"), *features(F.coalesce(F.col(text), F.lit(""))))
    rows = stored(base, "mix-features")
    members = stored(posteriors(rows, labels.select(F.col(key).alias("k"), F.col(label)), domains, label).select("k", "id", "n_tokens", "p"), "mix-members")
    rate = fit_rates(members, [float(targets[d]) for d in domains], total_tokens, upsample, rounds, tolerance)
    return members.select(F.col("k").alias(key), "id", "n_tokens", "p", rate.alias("rate"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict, label: str = "quality", key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each row as often as its rate says: no rate is under 1, so every row stays, and rows of scarce domains repeat.

    The rate's fraction is rounded up for a share of rows that a hash of key and text picks, so the tokens meet the targets on
    the average. A row's copies are as many as its rate, which the targets bound and the table's size does not. Columns pass
    unchanged.
    """
    rates = document_rates(docs, labels, targets, label, key, text, upsample=True).groupBy(F.struct(F.col(key).alias("k"), "id").alias("id")).agg(F.max("rate").alias("rate"))
    name = lambda base: reduce(lambda n, c: n + "_" if n.lower() == c.lower() else n, sorted(docs.columns, key=str.lower), base)
    rid, times = name("mix_row"), name("mix_times")
    spin = F.pmod(F.xxhash64(F.col(rid), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    drawn = docs.withColumn(rid, F.struct(F.col(key).alias("k"), F.xxhash64(F.col(key), F.col(text)).alias("id"))).join(rates.select(F.col("id").alias(rid), F.col("rate").alias(times)), rid)
    copies = F.greatest(F.lit(1), F.floor(F.col(times) + spin).cast("int"))  # 1 where there is no rate
    return drawn.withColumn(times, F.explode(F.sequence(F.lit(1), copies))).select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB, for two domains 1 and 0 while no rate meets zero: the classifier and the one exact step.
ORACLE_SQL = """
WITH t AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
s AS (SELECT *, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS w, CAST(greatest(length(text), 1) AS DOUBLE) AS n FROM t),
f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, ln(length(text) + 1.0) AS f1, (length(text) - length(replace(text, ' ', ''))) / n AS f2,
    (length(text) - length(replace(text, chr(10), ''))) / n * 10 AS f3, (length(text) - length(translate(text, '|%$#&*!<>{{}}=_^~', ''))) / n AS f4,
    (length(text) - length(translate(text, '0123456789', ''))) / n AS f5, (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) / n AS f6,
    len(list_distinct(w)) / CAST(greatest(len(w), 1) AS DOUBLE) AS f7 FROM s),
l AS (SELECT doc_id, max(quality) AS y FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
c AS (SELECT y, CAST(count(*) AS DOUBLE) AS n, {means} FROM f JOIN l USING (doc_id) GROUP BY y),
k AS (SELECT doc_id, n_tokens, ln(c.n / (SELECT sum(n) FROM c)) {terms} AS s, y FROM f CROSS JOIN c),
q AS (SELECT doc_id, any_value(n_tokens) AS n_tokens, max(s) FILTER (y = 1) AS s1, max(s) FILTER (y = 0) AS s0 FROM k GROUP BY doc_id),
p AS (SELECT doc_id, n_tokens, 1 / (1 + exp(s0 - s1)) AS p1 FROM q),
g AS (
  SELECT sum(n_tokens * p1) AS t1, sum(n_tokens * (1 - p1)) AS t0, sum(n_tokens * p1 * p1) AS g11, sum(n_tokens * p1 * (1 - p1)) AS g10,
    sum(n_tokens * (1 - p1) * (1 - p1)) AS g00 FROM p),
r AS (SELECT *, {w1} * (t1 + t0) - t1 AS r1, {w0} * (t1 + t0) - t0 AS r0, g11 * g00 - g10 * g10 AS det FROM g)
SELECT doc_id, n_tokens, round(p1, 6) AS p_high, round(greatest(0, 1 + p1 * (g00 * r1 - g10 * r0) / det + (1 - p1) * (g11 * r0 - g10 * r1) / det), 6) AS rate
FROM p CROSS JOIN r
"""


def oracle_sql(targets: dict) -> str:
    names = [f"f{i}" for i in range(1, len(FEATURES) + 1)]
    means = ", ".join(f"avg({f}) AS m_{f}, var_pop({f}) + {SMOOTH} AS v_{f}" for f in names)
    terms = " ".join(f"+ (-0.5 * ln(2 * pi() * v_{f}) - ({f} - m_{f}) * ({f} - m_{f}) / (2 * v_{f}))" for f in names)
    total = sum(targets.values())
    return ORACLE_SQL.format(means=means, terms=terms, w1=targets[1] / total, w0=targets[0] / total)
