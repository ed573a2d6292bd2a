"""The typed result of a tool, its requirements and the registry of tools."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_number
from ..operators.boxes import Cell
from ..sources.sinks import csv_text, write_xlsx


class AnalysisError(Exception):
    """An analysis that can't be answered."""


class NotApplicable(AnalysisError):
    """The data has nothing for this tool."""


class MissingRequirement(AnalysisError):
    """A box, a reference frame, groups or a side file is missing."""


class InvalidParameter(AnalysisError):
    """A parameter's name or type is wrong."""


@dataclass
class Context:
    """What a tool may need besides atoms: the box of all frames or a table of boxes, the frames' times, the reference frame and where the data came from."""

    box: Cell = None
    frames: DataFrame | None = None
    reference: int | None = None
    path: str | None = None
    side_file: str | None = None
    frame: int | None = None


@dataclass
class ToolResult:
    """summary (frame, ord, label, num, text, unit), field (frame, atom, value), profile (frame, bin, lo, hi, centre, value, count), scalar (frame, scalar)."""

    summary: DataFrame
    scalar: DataFrame
    field: DataFrame | None = None
    profile: DataFrame | None = None
    notes: list[str] = dataclasses.field(default_factory=list)
    series_label: str = ""
    palette: dict = dataclasses.field(default_factory=dict)

    @property
    def series(self) -> DataFrame:
        """The scalar of every frame, in order."""
        return self.scalar.orderBy("frame")

    def rows(self, frame: int | None = None) -> list[tuple[str, str]]:
        """Label and C-formatted text of a frame's summary (of the only one, if there is one)."""
        s = self.summary if frame is None else self.summary.where(F.col("frame") == frame)
        out = []
        for r in s.orderBy("frame", "ord").collect():
            out.append((r["label"], r["text"] if r["text"] is not None else (format_number(r["num"]) + (f" {r['unit']}" if r["unit"] and r["num"] is not None else ""))))
        return out

    def numbers(self, frame: int = 0) -> dict[str, float]:
        return {r["label"]: r["num"] for r in self.summary.where(F.col("frame") == frame).collect()}

    def text(self, frame: int | None = None) -> str:
        """Aligned label and value, then notes."""
        rows = self.rows(frame)
        width = max((len(a) for a, _ in rows), default=0)
        return "\n".join([*(f"{a:<{width}}  {b}" for a, b in rows), *(f"note: {n}" for n in self.notes)])

    def tables(self, frame: int | None = None, field_rows: int = 100_000) -> dict[str, list[list[object]]]:
        """Small tables for export; the field only up to so many atoms."""
        pick = lambda d: d if frame is None or d is None else d.where(F.col("frame") == frame)
        out: dict[str, list[list[object]]] = {"Summary": [["frame", "label", "value", "unit"]] + [[r["frame"], r["label"], r["text"] if r["text"] is not None else r["num"], r["unit"]] for r in pick(self.summary).orderBy("frame", "ord").collect()]}
        if self.profile is not None:
            out["Profile"] = [["frame", "centre", "value", "count"]] + [[r["frame"], r["centre"], r["value"], r["count"]] for r in pick(self.profile).orderBy("frame", "bin").collect()]
        out["Series"] = [["frame", self.series_label or "value"]] + [[r["frame"], r["scalar"]] for r in self.series.collect()]
        if self.field is not None and pick(self.field).limit(field_rows + 1).count() <= field_rows:
            out["Field"] = [["frame", "atom", "value"]] + [list(r) for r in pick(self.field).select("frame", "atom", "value").orderBy("frame", "atom").collect()]
        return out

    def csv(self, provenance: list[str] = (), frame: int | None = None) -> str:  # type: ignore[assignment]
        rows: list[list[object]] = [["section", "label", "value", "unit"]]
        for name, table in self.tables(frame, 0).items():
            for r in table[1:]:
                rows.append([name.lower(), r[1], r[2] if len(r) > 2 else r[1], r[3] if name == "Summary" else ""] if name != "Series" else ["series", r[0], r[1], ""])
        rows += [["note", "", n, ""] for n in self.notes]
        return csv_text(rows, list(provenance))

    def json(self, frame: int | None = None) -> str:
        import math

        t = self.tables(frame, 0)
        return json.dumps({"summary": [dict(zip(t["Summary"][0], r, strict=True)) for r in t["Summary"][1:]], "series": [r for r in t["Series"][1:] if r[1] is not None and math.isfinite(r[1])], "notes": self.notes})

    def xlsx(self, path: str, frame: int | None = None) -> None:
        write_xlsx(path, self.tables(frame))


def summary_of(wide: DataFrame, rows: list[tuple[str, Column | str, str]]) -> DataFrame:
    """A row for each label of each frame of wide; a string column gives text, a number num."""
    kinds = dict(wide.select(*[(F.col(c) if isinstance(c, str) else c).alias(f"c{i}") for i, (_, c, _) in enumerate(rows)]).dtypes)
    cells = []
    for i, (label, c, unit) in enumerate(rows):
        col = F.col(c) if isinstance(c, str) else c
        text = kinds[f"c{i}"] == "string"
        cells.append(F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label"), (F.lit(None) if text else col).cast("double").alias("num"), (col if text else F.lit(None)).cast("string").alias("text"), F.lit(unit).alias("unit")))
    return wide.select("frame", F.explode(F.array(*cells)).alias("r")).select("frame", "r.*")


def frame_profile(rows: DataFrame, position: Column, value: Column | None, bins: int, min_width: float = 0.5) -> DataFrame:
    """frame, bin, lo, hi, centre, value, count over each frame's own range; the value is the mean, or the count without one."""
    r = rows.select("frame", position.cast("double").alias("p"), (value if value is not None else F.lit(0.0)).cast("double").alias("v")).where(F.col("p").isNotNull())
    ext = r.groupBy("frame").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).withColumn("w", F.greatest(F.lit(min_width), (F.col("hi") - F.col("lo")) / bins))
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(bins + 1)), F.array(F.col("lo")), lambda s, i: F.when(F.element_at(s, -1) + F.col("w") < F.col("hi"), F.concat(s, F.array(F.element_at(s, -1) + F.col("w")))).otherwise(s))
    ext = ext.withColumn("starts", grown)
    n = F.size("starts")
    guess = F.least(n - 1, F.greatest(F.lit(0), F.floor((F.col("p") - F.col("lo")) / F.col("w")).cast("int")))
    bin_ = F.when(F.col("p") < F.get("starts", guess), guess - 1).when((guess + 1 < n) & (F.col("p") >= F.get("starts", guess + 1)), guess + 1).otherwise(guess)
    got = r.join(ext, "frame").groupBy("frame", bin_.alias("bin")).agg(F.count("*").alias("count"), F.avg("v").alias("mean"))
    grid = ext.select("frame", "w", F.posexplode("starts").alias("bin", "lo"))
    out = grid.join(got, ["frame", "bin"], "left")
    count = F.coalesce("count", F.lit(0)).cast("long")
    return out.select("frame", "bin", "lo", (F.col("lo") + F.col("w")).alias("hi"), (F.col("lo") + F.col("w") / 2).alias("centre"), (F.coalesce("mean", F.lit(0.0)) if value is not None else count.cast("double")).alias("value"), count.alias("count"))


def joined(*tables: DataFrame) -> DataFrame:
    """Per-frame tables side by side."""
    return reduce(lambda a, b: a.join(b, "frame", "full"), tables)


@dataclass
class Tool:
    id: str
    title: str
    category: str
    run: Callable[..., ToolResult]
    parameters: dict[str, Any]
    requires: tuple[str, ...] = ()
    functions: tuple[str, ...] = ("scalar", "series")


TOOLS: dict[str, Tool] = {}


def tool(id: str, title: str, category: str, requires: tuple[str, ...] = (), functions: tuple[str, ...] = ("scalar", "series"), **parameters: Any) -> Callable:  # noqa: A002
    def add(f: Callable[..., ToolResult]) -> Callable[..., ToolResult]:
        TOOLS[id] = Tool(id, title, category, f, parameters, requires, functions)
        return f

    return add


def catalogue() -> list[dict]:
    """All tools by category, then title."""
    return [{"id": t.id, "title": t.title, "category": t.category, "requires": list(t.requires), "functions": list(t.functions), "parameters": t.parameters} for t in sorted(TOOLS.values(), key=lambda t: (t.category, t.title))]


def merged(t: Tool, given: dict[str, Any], strict: bool) -> dict[str, Any]:
    """Defaults with what is given; a wrong name or type is an error, or without strict makes all parameters the defaults."""
    out = dict(t.parameters)
    for k, v in given.items():
        want = t.parameters.get(k)
        ok = k in t.parameters and (want is None or v is None or isinstance(v, type(want)) or (isinstance(want, float) and isinstance(v, int) and not isinstance(v, bool)))
        if not ok:
            if strict:
                raise InvalidParameter(f"{t.id}: {k}={v!r}")
            return dict(t.parameters)
        out[k] = float(v) if isinstance(want, float) and v is not None else v
    return out


def run_tool(name: str, atoms: DataFrame | None, context: Context | None = None, params: dict | None = None, strict: bool = True) -> ToolResult:
    if name not in TOOLS:
        raise InvalidParameter(f"unknown tool {name!r}")
    t, c = TOOLS[name], context or Context()
    if "referenceFrame" in t.requires and c.reference is None:
        raise MissingRequirement(f"{name} needs a reference frame")
    if "sideFile" in t.requires and not c.side_file and not c.path:
        raise MissingRequirement(f"{name} needs a side file")
    return t.run(atoms, c, **merged(t, params or {}, strict))


def save_settings(path: str, enabled: list[str], params: dict[str, dict]) -> None:
    Path(path).write_text(json.dumps({"enabled": enabled, "params": params}))


def load_settings(path: str) -> dict:
    p = Path(path)
    return json.loads(p.read_text()) if p.exists() else {"enabled": list(TOOLS), "params": {}}
