"""What holds two groups together: interaction classes of atoms, tallies of residues, contact frequencies and energies by frame.

Each *_rows function gives summary rows (frame, ord, label, num, text, unit) whose labels name residues.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import residue_key
from ..operators import groups
from ..operators.interactions import ANIONS, BACKBONE_CARBONS, CATIONS, PI_CATIONS, RINGS, TERMINAL, member_of
from ..operators.joins import nearest

#: Code and priority of each class of the field; contacts are 1 in A and 2 in B, of priority 1.
CODES = {"salt": (4, 5), "pi": (5, 4), "hbond": (3, 3), "oily": (6, 2)}
TOP = 8


def marked(slots: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """frame, atom, kind: the atoms that make the residues' interactions; cation-pi pairs count as pi."""
    ring = member_of({r: [n for names in lists for n in names] for r, lists in RINGS.items()})
    fits = {"salt": member_of(CATIONS) | member_of(ANIONS) | (F.col("name") == TERMINAL), "pi": ring, "cation_pi": ring | member_of(PI_CATIONS), "oily": (F.upper(F.trim("element")) == "C") & ~F.col("name").isin(*BACKBONE_CARBONS)}
    parts = [slots.where(fits[k]).join(t.select("frame", F.explode(F.array("a", "b")).alias("slot")).distinct(), ["frame", "slot"], "left_semi").select("frame", "atom", F.lit("pi" if k == "cation_pi" else k).alias("kind")) for k, t in found.items()]
    return reduce(DataFrame.unionByName, parts)


def strongest(marks: DataFrame | None, hb: DataFrame | None) -> DataFrame:
    """frame, atom, code: the class of the highest priority that an atom takes part in."""
    parts = [] if marks is None else [marks]
    if hb is not None:
        parts.append(hb.select("frame", F.explode(F.array("donor", "acceptor")).alias("atom"), F.lit("hbond").alias("kind")))
    pick = lambda k: reduce(lambda c, item: c.when(F.col("kind") == item[0], item[1][k]), CODES.items(), F)
    return reduce(DataFrame.unionByName, parts).groupBy("frame", "atom").agg(F.max_by(pick(0), pick(1)).alias("code"))


def tallies(keyed: DataFrame, slots: DataFrame, ends: DataFrame, hb: DataFrame | None, found: dict[str, DataFrame]) -> DataFrame:
    """frame, key, contacts, hbonds, salt, pi, oily of each residue of A (keyed: frame, atom, key) in frames with any interaction."""
    of_slot = slots.join(keyed, ["frame", "atom"]).select("frame", "slot", "key").distinct()
    by_slot = lambda t, k: t.select("frame", F.explode(F.array("a", "b")).alias("slot")).join(of_slot, ["frame", "slot"]).select("frame", "key", F.lit(k).alias("kind"), F.lit(1).alias("n"))
    parts = [by_slot(t, "pi" if k == "cation_pi" else k) for k, t in found.items()]
    parts.append(ends.join(keyed, ["frame", "atom"]).select("frame", "key", F.lit("contacts").alias("kind"), F.col("n").cast("int")))
    if hb is not None:
        parts.append(hb.select("frame", F.explode(F.array("donor", "acceptor")).alias("atom")).join(keyed, ["frame", "atom"]).select("frame", "key", F.lit("hbonds").alias("kind"), F.lit(1).alias("n")))
    kinds = ["contacts", "hbonds", "salt", "pi", "oily"]
    wide = reduce(DataFrame.unionByName, parts).groupBy("frame", "key").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in kinds])
    some = reduce(DataFrame.unionByName, [t.select("frame") for t in found.values()]).distinct()
    return wide.join(some, "frame", "left_semi")


def rows_of(df: DataFrame, ord_: Column, label: Column, num: Column | None, text: Column | None, unit: str) -> DataFrame:
    return df.select("frame", ord_.cast("int").alias("ord"), label.alias("label"), (num if num is not None else F.lit(None)).cast("double").alias("num"), (text if text is not None else F.lit(None)).cast("string").alias("text"), F.lit(unit).alias("unit"))


def interaction_rows(tally: DataFrame) -> DataFrame:
    """The residues of A with the most interactions of all kinds, frame by frame."""
    total = F.col("contacts") + F.col("hbonds") + F.col("salt") + F.col("pi") + F.col("oily")
    top = groups.ranked(tally.withColumn("total", total), ["frame"], TOP, F.desc("total"), F.col("key"))
    text = F.format_string("contacts %d · H-bonds %d · salt %d · π %d · φ %d", "contacts", "hbonds", "salt", "pi", "oily")
    return rows_of(top, 100 + F.col("rank"), F.concat("key", F.lit(" (interactions)")), F.col("total"), text, "")


def contact_frequency(keyed: DataFrame, ends: DataFrame) -> DataFrame:
    """key, frequency: the share of all frames in which a residue of A is touched, for those that ever are."""
    n = keyed.agg(F.count_distinct("frame").alias("frames"))  # one row
    hits = keyed.join(ends, ["frame", "atom"], "left_semi").groupBy("key").agg(F.count_distinct("frame").alias("hits"))
    return hits.crossJoin(F.broadcast(n)).select("key", (F.col("hits") / F.col("frames")).alias("frequency"))


def frequency_rows(frequency: DataFrame, frames: DataFrame) -> DataFrame:
    """The residues touched in most frames, beside every frame."""
    top = frequency.orderBy(F.desc("frequency"), "key").limit(TOP).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("frequency"), "key")))
    return rows_of(frames.crossJoin(F.broadcast(top)), 200 + F.col("rank"), F.concat("key", F.lit(" (contact frequency)")), F.col("frequency"), None, "of frames")


def energy_rows(energies: DataFrame, frames: DataFrame) -> DataFrame:
    """The residues of the strongest interaction energy in the table's frame nearest to each frame."""
    at = energies.select(F.col("frame").alias("at")).distinct().withColumn("tie", F.col("at"))
    near = nearest(frames.select("frame", F.col("frame").alias("want")), at, "want", "at", "tie").select("frame", F.col("at").cast("int").alias("at"))  # a row a frame
    key = residue_key(F.col("chain"), F.col("resname"), F.col("resid"))
    rows = near.join(energies.withColumnRenamed("frame", "at").select("at", key.alias("key"), "vdw", "elec", (F.col("vdw") + F.col("elec")).alias("total")), "at")
    top = groups.ranked(rows, ["frame"], TOP, F.desc(F.abs("total")), F.col("key"))
    return rows_of(top, 300 + F.col("rank"), F.concat("key", F.lit(" (ΔE)")), F.col("total"), F.format_string("vdW %.4g · elec %.4g · total %.4g", "vdw", "elec", "total"), "kJ/mol")


def mmgbsa_rows(bound: DataFrame, frames: DataFrame) -> DataFrame:
    """Binding energy and its terms in the table's frame nearest to each frame, and mean and deviation over all of them."""
    at = bound.select(F.col("frame").alias("at"), F.col("frame").alias("tie"), "dg", "vdw", "elec", "solv")
    near = nearest(frames.select("frame", F.col("frame").alias("want")), at, "want", "at", "tie")
    all_ = near.crossJoin(F.broadcast(bound.agg(F.avg("dg").alias("mean"), F.stddev_samp("dg").alias("sd"))))  # one row
    parts = [rows_of(all_, F.lit(400 + i), F.lit(label), F.col(c), None, "kJ/mol") for i, (label, c) in enumerate((("MM/GBSA ΔG_bind", "dg"), ("MM/GBSA mean", "mean"), ("MM/GBSA deviation", "sd"), ("MM/GBSA vdW", "vdw"), ("MM/GBSA elec", "elec"), ("MM/GBSA solv", "solv")))]
    return reduce(DataFrame.unionByName, parts)
