"""Writers: XYZ and dump text, comma-separated reports and workbooks."""

from __future__ import annotations

import math
import re
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.boxes import Cell, celled


def xyz_frames(atoms: DataFrame, comment: str = "", charges: bool = False) -> DataFrame:
    """frame, text: count, comment and rows of each frame, without a newline at the end."""
    cells = [F.col("element"), *[F.col(c).cast("string") for c in "xyz"]]
    if charges:
        cells.append(F.coalesce("charge", F.lit(0.0)).cast("string"))
        comment = ("Properties=species:S:1:pos:R:3:charge:R:1 " + comment).strip()
    rows = F.array_sort(F.collect_list(F.struct("atom", F.concat_ws(" ", *cells).alias("row"))))
    body = F.transform(rows, lambda r: r["row"])
    return atoms.groupBy("frame").agg(F.concat_ws("\n", F.count("*").cast("string"), F.lit(comment), F.array_join(body, "\n")).alias("text"))


def write_xyz(atoms: DataFrame, path: str, comment: str = "", charges: bool = False) -> None:
    """One file a range of frames, in order."""
    xyz_frames(atoms, comment, charges).repartitionByRange("frame").sortWithinPartitions("frame").select("text").write.text(path)


def write_dump(atoms: DataFrame, path: str, box: Cell) -> None:
    """Dump text, a file a range of frames in order; each frame has its own box, an open frame none. Lines are sorted, no frame is one row."""
    row = F.concat_ws(" ", F.col("id").cast("string"), "element", *[F.col(c).cast("string") for c in "xyz"], F.coalesce("charge", F.lit(0.0)).cast("string"))
    heads = celled(atoms.groupBy("frame").agg(F.count("*").alias("n")), box)
    flags = F.concat_ws(" ", *[F.when(F.col(f"cell_per_{a}"), "pp").otherwise("ff") for a in "xyz"])
    bounds = [F.concat(F.col(f"cell_lo_{a}").cast("string"), F.lit(" "), (F.col(f"cell_lo_{a}") + F.col(f"cell_size_{a}")).cast("string"), F.lit("\n")) for a in "xyz"]
    boxed = F.col("cell_size_x") + F.col("cell_size_y") + F.col("cell_size_z") > 0
    cell = F.when(boxed, F.concat(F.lit("ITEM: BOX BOUNDS "), flags, F.lit("\n"), *bounds)).otherwise("")
    head = F.concat(F.lit("ITEM: TIMESTEP\n"), F.col("frame").cast("string"), F.lit("\nITEM: NUMBER OF ATOMS\n"), F.col("n").cast("string"), F.lit("\n"), cell, F.lit("ITEM: ATOMS id element x y z q"))
    lines = heads.select("frame", F.lit(0).alias("kind"), F.lit(None).cast(atoms.schema["atom"].dataType).alias("atom"), head.alias("text"))
    lines = lines.unionByName(atoms.select("frame", F.lit(1).alias("kind"), "atom", row.alias("text")))
    lines.repartitionByRange("frame").sortWithinPartitions("frame", "kind", "atom", "text").select("text").write.text(path)


def quoted(cell: object) -> str:
    """A cell of a comma-separated file, quoted where it must be."""
    s = "" if cell is None else str(cell)
    return '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n\r') else s


def csv_text(rows: list[list[object]], provenance: list[str] = ()) -> str:  # type: ignore[assignment]
    return "".join(f"# {p}\n" for p in provenance) + "".join(",".join(map(quoted, r)) + "\n" for r in rows)


def sheet_name(name: str) -> str:
    return "".join(c for c in name if c not in ':\\/?*[]')[:31] or "Sheet"


NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def write_xlsx(path: str, sheets: dict[str, list[list[object]]]) -> None:
    """A workbook of small tables; text that looks like a finite number becomes one."""
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")

    def cell(v: object) -> str:
        if v is not None and not isinstance(v, bool) and NUMBER.fullmatch(str(v)) and math.isfinite(float(str(v))):
            return f"<c><v>{float(str(v))!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{esc("" if v is None else str(v))}</t></is></c>'

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = [sheet_name(n) for n in sheets]
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{esc(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>' + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>")
