"""Repeated-run removal by winnowing over line hashes; DataFrame functions only.

A document is a sequence of lines; a long line is read sentence by sentence, so that a passage is found inside a line too. A
window is the shortest sequence of lines that has enough words, from each line on and back from each line; it selects its least
line hash as a fingerprint. The guarantee: a run of enough words holds a whole window, so copies of the run select the same
fingerprint, at the same place in it.

Positions of fingerprints are joined; one that stands in one place only rules out its windows. The others are extended both
ways, to the windows that selected them, whose lines are compared by one hash with the first place that has them all. Every
window is compared so, not only with the partner of the fingerprint's first position: with that, a run whose fingerprints had
stood alone in earlier documents, each in another one, would meet no partner that has the run. The union of the windows found
is the run at its full length, and no two texts are compared.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MIN_WORDS = 20
ENDS = ("\n", ". ", "! ", "? ")  # of lines and sentences
CUT = "\x01"
BLOCK = 512


def lines(text: Column) -> Column:
    """The text's lines and sentences with what separates them; they concatenate to the text."""
    cut = reduce(lambda c, end: F.replace(c, F.lit(end), F.lit(end + CUT)), ENDS, text)
    return F.when(F.contains(text, F.lit(CUT)), F.split(text, r"(?<=\n)|(?<=[.!?] )")).otherwise(F.split(cut, CUT))


SPACE = " \n\r\t"


def trimmed(parts: Column) -> Column:
    return F.transform(parts, lambda u: F.btrim(u, F.lit(SPACE)))


def word_counts(lines_: Column) -> Column:
    """Words of each trimmed line, as blanks separate them; a line of white space alone has none."""
    return F.transform(lines_, lambda u: F.when(u == "", 0).otherwise(F.octet_length(u) - F.octet_length(F.replace(u, F.lit(" "), F.lit(""))) + 1))


def word_ends(words: Column) -> Column:
    """The words up to the end of each line; sums grow block by block, so that long texts cost in proportion to their lines."""
    grown = lambda a: F.aggregate(a, F.array().cast("array<int>"), lambda s, w: F.array_append(s, F.coalesce(F.get(s, F.size(s) - 1), F.lit(0)) + w))
    inner = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(BLOCK)), lambda b: grown(F.slice(words, b, BLOCK)))
    starts = lambda blocks: F.concat(F.array(F.lit(0)), grown(grown_ends(blocks)))
    grown_ends = lambda blocks: F.transform(blocks, lambda b: F.coalesce(F.get(b, F.size(b) - 1), F.lit(0)))
    many = bound(inner, lambda blocks: bound(starts(blocks), lambda s: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda v: v + F.get(s, i))))))
    return F.when(F.size(words) <= BLOCK, grown(words)).otherwise(many)


def windows(docs: DataFrame, min_words: int) -> DataFrame:
    """key, d, id, place, mark, line of every window of docs.

    A window is the shortest sequence of lines with enough words from a line on, or back from a line; place is its first line
    << 32 and its last line, key the hash of its lines. mark, its fingerprint, is the least hash of its lines, and line is where
    that stands: the first of equals.
    """
    rows = docs.select("d", "id", trimmed(lines(F.col("text"))).alias("t")).select("d", "id", F.transform("t", lambda u: F.xxhash64(u)).alias("h"), word_counts(F.col("t")).alias("w"))
    # the line of each word, and the words before each line's end
    rows = rows.withColumns({"line_of": F.flatten(F.transform("w", lambda w, i: F.array_repeat(i, w))), "ends": word_ends(F.col("w"))})
    rows = rows.select("d", "id", "h", "ends", F.transform("ends", lambda e, i: F.get("line_of", e - F.get("w", i) + (min_words - 1))).alias("on"), F.transform("ends", lambda e: F.get("line_of", e - min_words)).alias("back"))
    place = lambda a, b: F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))
    ahead = F.transform("on", lambda b, i: F.when(b.isNotNull(), place(i, b)))
    behind = F.transform("back", lambda a, i: F.when(a.isNotNull() & ~F.get("on", a).eqNullSafe(i), place(a, i)))  # one that is shortest both ways is there once
    rows = rows.select("d", "id", "h", F.explode(F.array_compact(F.concat(ahead, behind))).alias("place"))
    # hashes are taken after the explode, in generated code
    a = F.shiftright("place", 32).cast("int")
    inside = F.slice("h", a + 1, F.col("place").bitwiseAND(F.lit(2**32 - 1)).cast("int") - a + 1)
    return rows.select(F.xxhash64(inside).alias("key"), "d", "id", "place", F.array_min(inside).alias("mark"), (a + F.array_position(inside, F.array_min(inside)) - 1).cast("int").alias("line"))


def repeats(found: DataFrame) -> DataFrame:
    """d, id and place of every window whose lines an earlier window has too, in the order of d, id and place.

    Fingerprints that stand in one place rule out their windows. Those that stand in several extend both ways to the windows
    that selected them; a window is a repeat if it isn't the first of those with its lines.
    """
    stand = F.xxhash64("d", "id", "line")  # one number, so that the sums of a mark stay in a hash table
    shared = stored(found.groupBy("mark").agg(F.min(stand).alias("a"), F.max(stand).alias("b")).where("a < b").select("mark"), "line-marks")  # read back, so that a hot mark's join can be split
    again = stored(found.join(shared, "mark", "left_semi").select("key", "d", "id", "place"), "line-windows-again")
    place = F.struct("d", "id", "place")
    firsts = stored(again.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("m")).where("m > 1").drop("m"), "line-firsts")
    return again.join(firsts, "key").where(place != F.col("first")).select("d", "id", "place")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row: a lambda's variable isn't inlined into what refers to it, as a column is."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """docs with every later occurrence of a repeated run of lines taken out of its text; the first one stays.

    Runs have at least min_words words, and all of them are found. Lines compare without white space at their ends. Earlier is the smaller key, then a hash of key and text; null keys come last. A text without repeated runs is
    unchanged to the byte; null stays null; an emptied text is empty. Rows that agree in key and text count as one document
    and are treated alike. removed names a further column: how many lines went. All other columns pass; an empty table stays
    empty.
    """
    name = lambda base: reduce(lambda n, c: n + "_" if n.lower() == c.lower() else n, sorted(docs.columns, key=str.lower), base)
    rid, found = name("line_row"), name("line_runs")
    body = F.col(f"`{text}`")
    row_id, order = F.xxhash64(F.col(f"`{key}`"), body), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(2**63 - 1))
    plain = docs.where(body.isNotNull()).select(order.alias("d"), row_id.alias("id"), body.alias("text"))
    again = repeats(stored(windows(plain, min_words), "line-windows"))
    sides = again.groupBy(F.struct("d", "id").alias(rid)).agg(F.collect_set("place").alias(found))  # places of one text, as many as its lines
    parts = name("line_parts")
    joined = docs.withColumn(rid, F.when(body.isNotNull(), F.struct(order.alias("d"), row_id.alias("id")))).join(sides, rid, "left")
    gone = F.flatten(F.transform(found, lambda p: F.sequence(F.shiftright(p, 32).cast("int"), p.bitwiseAND(F.lit(2**32 - 1)).cast("int"))))

    def keep_of(p: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(p) - 1), gone)
        return bound(kept, lambda k: F.struct(F.array_join(F.transform(k, lambda i: F.get(p, i)), "").alias("text"), (F.size(p) - F.size(k)).alias("n")))

    joined = joined.withColumn(parts, F.when(F.col(found).isNotNull(), bound(lines(body), keep_of)))
    out = [F.coalesce(F.col(parts)["text"], body).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if removed:
        out.append(F.coalesce(F.col(parts)["n"], F.lit(0)).alias(removed))
    return joined.select(*out)
