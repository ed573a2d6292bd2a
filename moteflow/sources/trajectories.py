"""Frames of dump and XYZ files: the text of one frame to its rows, and readers that take frames from an index of their bytes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice, zip_longest

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ATOMS

MARK, BATCH = "ITEM: TIMESTEP", 1 << 15
BOX_FIELDS = [*[f"{e}_{a}" for e in ("lo", "hi") for a in "xyz"], *[f"per_{a}" for a in "xyz"], "tilt_xy", "tilt_xz", "tilt_yz"]
ROW_SCHEMA = "file string, start long, block long, pos int, timestep bigint, n_atoms int, has_box boolean, " + ", ".join(f"{b} {'boolean' if b.startswith('per') else 'double'}" for b in BOX_FIELDS) + ", id bigint, element string, x double, y double, z double, charge double, columns map<string,float>, labels map<string,string>"
NAMES = [c.split()[0] for c in ROW_SCHEMA.split(", ")]
PREFIX = re.compile(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|\s*[+-]?(?:nan|inf(?:inity)?)", re.I)


def number(token: str | None) -> float:
    """The number that a token begins with; NaN for none."""
    m = PREFIX.match(token) if token is not None else None
    return float(m[0]) if m else math.nan


def dump_head(lines: list[str]) -> tuple | None:
    """step, n, number of columns, box, x y z (column, origin, scale), element, type, charge, id and extra columns, and where the atoms begin."""
    items: dict[str, int] = {}
    for k, line in enumerate(lines):
        if line.startswith("ITEM: ") and (word := line[6:].split(" ")[0] + (" OF" if line.startswith("ITEM: NUMBER OF") else "")) not in items:
            items[word] = k
    try:
        step = int(lines[1].strip())
        n = int(lines[items["NUMBER OF"] + 1].strip())
        head = lines[items["ATOMS"]].split()[2:]
    except (KeyError, ValueError, IndexError):
        return None
    box: dict = {"has_box": "BOX" in items}
    if box["has_box"]:
        flags, tilted = lines[items["BOX"]].split()[3:], False
        if flags[:3] == ["xy", "xz", "yz"]:
            flags, tilted = flags[3:], True
        rows = [[number(t) for t in lines[items["BOX"] + 1 + k].split()] for k in range(3)]
        for k, a in enumerate("xyz"):
            box["lo_" + a] = rows[k][0] if rows[k] else 0.0
            box["hi_" + a] = rows[k][1] if len(rows[k]) > 1 else 1.0
            box["per_" + a] = flags[k].startswith("p") if k < len(flags) else True
            if tilted and len(rows[k]) > 2:
                box[("tilt_xy", "tilt_xz", "tilt_yz")[k]] = rows[k][2]
    at = {c: k for k, c in reversed(list(enumerate(head)))}
    first = lambda *names: next((at[m] for m in names if m in at), None)
    places = []
    for a in "xyz":
        direct, scaled = first(a, a + "u"), first(a + "s", a + "su")
        if direct is None and scaled is None:
            return None
        lo, hi = box.get("lo_" + a, 0.0), box.get("hi_" + a, 1.0)
        places.append((direct, 0.0, 1.0) if direct is not None else (scaled, lo, hi - lo))
    el, ty, q, ident = first("element"), first("type"), first("q", "charge"), first("id")
    taken = {el, ty, ident, *[p[0] for p in places]}
    extra = [(c, k) for c, k in at.items() if k not in taken]
    return step, n, len(head), box, places, el, ty, q, ident, extra, items["ATOMS"] + 1


def numbers(tokens: tuple) -> np.ndarray:
    """number() of each token; whole numbers of them at once where every token is one."""
    try:
        if not any(t is not None and "_" in t for t in tokens):  # Python takes 1_0 for 10
            return np.array(tokens, dtype=float)
    except (TypeError, ValueError):
        pass
    return np.array([number(t) for t in tokens], dtype=float)


def dump_frame(block: str) -> Iterator[pd.DataFrame]:
    """The atoms of one frame (the text after its TIMESTEP line), sorted by id, in tables of at most BATCH rows; nothing if it is malformed or cut off.

    Lines are split a batch at a time; of the whole frame only numbers and elements are held.
    """
    lines = re.sub(r"\r\n?", "\n", block).split("\n") if "\r" in block else block.split("\n")
    if (found := dump_head(lines)) is None:
        return
    step, n, width, box, places, el, ty, q, ident, extra, start = found
    body = (t for i in range(start, len(lines)) if (t := lines[i].split()))
    parts, seen, last = [], 0, []
    while seen < n and (tokens := list(islice(body, min(BATCH, n - seen)))):
        cols, m, last = list(zip_longest(*tokens)), len(tokens), tokens[-1]
        get = lambda c: cols[c] if c is not None and c < len(cols) else (None,) * m  # noqa: B023, E731
        xyz = [o + s * numbers(get(c)) for c, o, s in places]
        raw, k = numbers(get(ident)), np.arange(seen + 1, seen + m + 1)
        whole = np.isfinite(raw)
        ids = np.where(whole, np.trunc(np.where(whole, raw, 0)), k).astype("int64")
        element = np.array([e or t or "?" for e, t in zip(get(el), get(ty), strict=True)], dtype=object)
        keep = np.isfinite(xyz[0]) & np.isfinite(xyz[1]) & np.isfinite(xyz[2])
        parts.append([c[keep] for c in (ids, element, *xyz, numbers(get(q)), *[numbers(get(i)) for _, i in extra])])
        seen += m
    if n <= 0 or seen < n or len(last) < width:
        return
    ids, element, x, y, z, charge, *others = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(ids, kind="stable")
    for at in range(0, len(order), BATCH):
        o = order[at : at + BATCH]
        columns = [dict(zip([c for c, _ in extra], v, strict=True)) for v in zip(*[c[o].tolist() for c in others], strict=True)] if extra else [{} for _ in o]
        table = {"pos": np.arange(at, at + len(o)), "timestep": step, "n_atoms": len(order), **box, "id": ids[o], "element": element[o], "x": x[o], "y": y[o], "z": z[o], "charge": pd.Series([None if math.isnan(v) else v for v in charge[o].tolist()], dtype=object), "columns": columns, "labels": [{} for _ in o]}
        yield pd.DataFrame(table)


def dump_rows(block: str) -> Iterator[dict]:
    """dump_frame, a row at a time."""
    for t in dump_frame(block):
        yield from t.astype(object).to_dict("records")


def xyz_frames_of(text: str, only_first: bool = False) -> Iterator[list[dict]]:
    """Frames of an XYZ file: a count, a comment, that many rows. A cut last frame is left out; other lines are skipped."""
    lines = re.sub(r"\r\n?", "\n", text).split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    k = 0
    while k < len(lines):
        head = lines[k].strip()
        if not head.isdigit() or int(head) < 1:
            k += 1
            continue
        n = int(head)
        if k + 2 + n > len(lines):
            return
        comment, rows = lines[k + 1], lines[k + 2 : k + 2 + n]
        box, names = lattice(comment), properties(comment)
        out = []
        for row in rows:
            t = row.split()
            xyz = [number(v) for v in t[1:4]]
            if len(t) < 4 or not all(map(math.isfinite, xyz)):
                continue
            columns = {c: number(t[i]) if i < len(t) else math.nan for c, i, numeric in names if numeric}
            labels = {c: t[i] if i < len(t) else "" for c, i, numeric in names if not numeric}
            out.append({**box, "timestep": None, "id": None, "element": t[0], "x": xyz[0], "y": xyz[1], "z": xyz[2], "charge": columns.get("charge"), "columns": columns, "labels": labels})
        yield [{**r, "pos": i, "n_atoms": len(out)} for i, r in enumerate(out)]
        if only_first:
            return
        k += 2 + n


def attribute(comment: str, key: str) -> str | None:
    m = re.search(rf'(?:^|\s){key}\s*=\s*(?:"([^"]*)"|(\S+))', comment, re.I)
    return (m[1] if m[1] is not None else m[2]) if m else None


def lattice(comment: str) -> dict:
    """Box of an extended comment: nine lattice numbers, periodic unless pbc says otherwise."""
    v = [number(t) for t in (attribute(comment, "lattice") or "").split()]
    if len(v) != 9 or not all(map(math.isfinite, v)):
        return {"has_box": False}
    pbc = (attribute(comment, "pbc") or "T T T").split()
    out: dict = {"has_box": True, **{"lo_" + a: 0.0 for a in "xyz"}, "hi_x": v[0], "hi_y": v[4], "hi_z": v[8]}
    out |= {"per_" + a: pbc[k].lower().startswith("t") if k < len(pbc) else True for k, a in enumerate("xyz")}
    if v[3] or v[6] or v[7]:
        out |= {"tilt_xy": v[3], "tilt_xz": v[6], "tilt_yz": v[7]}
    return out


def properties(comment: str) -> list[tuple[str, int, bool]]:
    """Extra columns: name, index of the token, whether it is a number; three-vectors get _x, _y and _z, others _1 and on."""
    parts = (attribute(comment, "properties") or "").split(":")
    out, at = [], 0
    for name, kind, n in zip(parts[0::3], parts[1::3], parts[2::3], strict=False):
        if not n.isdigit():
            break
        if name not in ("species", "pos"):
            ends = [""] if int(n) == 1 else ["_x", "_y", "_z"] if int(n) == 3 else [f"_{k + 1}" for k in range(int(n))]
            out += [(name + e, at + k, kind.upper() in "RI") for k, e in enumerate(ends)]
        at += int(n)
    return out


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([[r.get(c) for c in NAMES] for r in rows], columns=NAMES)


def read_trajectory(spark: SparkSession, path: str, frames: str = "all") -> tuple[DataFrame, DataFrame]:
    """atoms and frames of dump or XYZ files, each file as its first lines say; frames: all, first, last, or numbers as the command line takes them.

    Only the bytes of the frames asked for are parsed; numbers stay those of the whole trajectory.
    """
    from ..cli import frame_filter
    from .frame_index import atoms_of, frame_index, frames_of

    index = frame_index(spark, path)
    if frames != "all":
        last = index.agg(F.max("frame")).first()[0]
        index = index.where(frame_filter(frames, -1 if last is None else last))
    return atoms_of(index), frames_of(index)


def read_dump(spark: SparkSession, path: str, frames: str = "all") -> DataFrame:
    return read_trajectory(spark, path, frames)[0]


def read_xyz(spark: SparkSession, path: str, frames: str = "all") -> DataFrame:
    return read_trajectory(spark, path, frames)[0]


def dump_fields(spark: SparkSession, path: str) -> list[str] | None:
    """Column names of the first ATOMS header within 64 lines; None for other files."""
    for r in spark.read.text(path).limit(64).collect():
        if r["value"].startswith("ITEM: ATOMS"):
            return r["value"].split()[2:]
    return None


def decimated(atoms: DataFrame, every: int) -> DataFrame:
    """Every so many frames from the first on, and the last in any case."""
    if every < 2:
        raise ValueError(f"every {every}: it must be 2 or more")
    last = atoms.agg(F.max("frame")).first()[0]
    return atoms.where((F.col("frame") % every == 0) | (F.col("frame") == F.lit(last)))


def append_new_frames(spark: SparkSession, path: str, table: str) -> int:
    """Follows a trajectory that grows: appends the complete frames that the table lacks to it, and tells how many they are.

    Frames keep their numbers as a file grows, so a refresh that is run again adds nothing; a cut last frame waits.
    """
    from .frame_index import atoms_of, frame_index

    index = frame_index(spark, path)
    names = [c.split()[0] for c in ATOMS.split(", ")]
    try:
        known = spark.read.parquet(table).agg(F.max("frame")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    new = index.where(F.col("frame") > (-1 if known is None else known))
    atoms_of(new).select(*names).write.mode("append").parquet(table)
    return new.count()


def map_elements(atoms: DataFrame, symbols: list[str]) -> DataFrame:
    """Numeric types as symbols, counted from 1; other tokens pass."""
    names = F.array(*[F.lit(s) for s in symbols])
    k = F.col("element").try_cast("int")
    return atoms.withColumn("element", F.when(F.col("element").rlike("^[0-9]+$") & k.between(1, len(symbols)), F.get(names, k - 1)).otherwise(F.col("element")))
