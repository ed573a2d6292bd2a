"""Command line: python -m moteflow.cli analyze TOOL FILE [--frame N | --frames A-B:S] [--param k=v] [--csv | --json],
export FILE -o OUT [--frame first|last|N] [--charges], decimate FILE EVERY -o OUT, or tools. OUT is a folder of XYZ text."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def typed(text: str) -> object:
    """An integer, else a number, else a truth value, else the text; JSON lists and objects pass."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def frame_filter(spec: str, last: int) -> Column:
    """first, last (or nothing), N, all, a-b or a-b:stride; outside of the trajectory is an error."""
    spec = spec.strip()
    if spec == "all":
        return F.lit(True)
    if spec in ("", "last", "first"):
        return F.col("frame") == (0 if spec == "first" else last)
    body, _, stride = spec.partition(":")
    lo, dash, hi = body.partition("-")
    a, b, step = int(lo), int(hi if dash else lo), int(stride or 1)
    if not 0 <= a <= b <= last or step < 1:
        raise ValueError(f"frames {spec} are outside of 0 to {last}")
    return F.col("frame").between(a, b) & ((F.col("frame") - a) % step == 0)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from .operators.boxes import boxes_of
    from .plans import tools  # noqa: F401
    from .plans.result import Context, catalogue, run_tool
    from .sources.sinks import write_xyz
    from .sources.frame_index import atoms_of, frame_index, frames_of
    from .sources.trajectories import decimated

    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("tools")
    a = sub.add_parser("analyze")
    a.add_argument("tool")
    a.add_argument("file")
    a.add_argument("--frames", default="last")
    a.add_argument("--reference", type=int, default=0)
    a.add_argument("--param", action="append", default=[])
    a.add_argument("--csv", action="store_true")
    a.add_argument("--json", action="store_true")
    a.add_argument("--frame", default=None)
    x, d = sub.add_parser("export"), sub.add_parser("decimate")
    x.add_argument("file")
    d.add_argument("file")
    d.add_argument("every", type=int)
    x.add_argument("--frame", default="last")
    for q in (x, d):
        q.add_argument("-o", "--out", required=True)
        q.add_argument("--charges", action="store_true")
    n = p.parse_args(argv)
    if n.what == "tools":
        print(json.dumps(catalogue(), indent=1))
        return 0
    spark = SparkSession.builder.appName("moteflow").getOrCreate()
    if n.what in ("export", "decimate"):
        index = frame_index(spark, n.file)
        last = index.agg(F.max("frame")).first()[0]
        if last is None:
            raise ValueError(f"{n.file} holds no complete frame")
        write_xyz(atoms_of(decimated(index, n.every) if n.what == "decimate" else index.where(frame_filter(n.frame, last))), n.out, charges=n.charges)
        return 0
    only = None
    params = {k: typed(v) for k, _, v in (s.partition("=") for s in n.param)}
    if n.file.endswith((".json", ".csv", ".log", ".lammps")):
        r = run_tool(n.tool, None, Context(side_file=n.file), params)
        only = int(n.frame) if n.frame and n.frame.isdigit() else None  # a row of the side file
    else:
        index = frame_index(spark, n.file)
        frames, last = frames_of(index), index.agg(F.max("frame")).first()[0]
        keep = frame_filter(n.frame or n.frames, last)
        ref = F.col("frame") == n.reference
        needs = n.tool in ("diffusion", "deformation", "conformation")
        r = run_tool(n.tool, atoms_of(index.where(F.lit(True) if n.tool == "diffusion" else keep | ref if needs else keep)), Context(box=boxes_of(frames), frames=frames, reference=n.reference, path=n.file), params)
    print(r.csv([f"tool {n.tool}", f"file {n.file}"], only) if n.csv else r.json(only) if n.json else r.text(only))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
