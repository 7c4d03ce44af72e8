"""Spreadsheet files as a data source that writes: sheets are made by tasks, and joined to one file once all are done.

A sheet has at most ROWS rows by its format, so one task makes one sheet, row by row. Parts lie beside the file, in a folder
that driver and executors share; the file appears whole by a rename, and if a task fails nothing is left.
"""

from __future__ import annotations

import os
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.text import spreadsheet_safe

#: Most rows of a sheet.
ROWS = 1_048_576

# Names of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml."


def column(n: int) -> str:
    """Letters of the n-th column, from 0."""
    out = ""
    n += 1
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def row_xml(number: int, cells: list) -> str:
    """A row of cells (text, number), one of which is null; both null: an empty cell."""
    made = []
    for k, (text, value) in enumerate(cells):
        at = f"{column(k)}{number}"
        if value is not None:
            made.append(f'<c r="{at}"><v>{value}</v></c>')
        elif text is not None:
            # Characters that the format forbids go.
            kept = "".join(c for c in text if c >= " " or c in "\t\n")
            made.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(kept)}</t></is></c>')
    return f'<row r="{number}">{"".join(made)}</row>'


@dataclass
class Sheets(WriterCommitMessage):
    parts: list[tuple[int, str, str]]


class WorkbookWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.folder = path, f"{path}.parts-{uuid.uuid4().hex}"
        os.makedirs(self.folder)

    def write(self, iterator: Iterator) -> Sheets:
        """Rows (place, sheet, row, cells) by place and row."""
        parts, out, count, last = [], None, 0, None
        for place, sheet, _, cells in iterator:
            if place != last:
                if out:
                    out.write("</sheetData></worksheet>")
                    out.close()
                name = f"{self.folder}/{place}-{uuid.uuid4().hex}.xml"
                parts.append((place, sheet, name))
                out = open(name, "w", encoding="utf-8")  # noqa: SIM115
                out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>')
                last, count = place, 0
            count += 1
            if count > ROWS:
                raise ValueError(f"a sheet has at most {ROWS} rows")
            out.write(row_xml(count, cells))
        if out:
            out.write("</sheetData></worksheet>")
            out.close()
        return Sheets(parts)

    def commit(self, messages: list[Sheets | None]) -> None:
        sheets = sorted(p for m in messages if m for p in m.parts)
        whole = f"{self.folder}/whole"
        relation = lambda k, kind, target: f'<Relationship Id="r{k}" Type="{OFFICE}/{kind}" Target="{target}"/>'
        override = lambda name, kind: f'<Override PartName="{name}" ContentType="{KIND}{kind}+xml"/>'
        numbers = range(1, len(sheets) + 1)
        with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{override("/xl/workbook.xml", "sheet.main")}{"".join(override(f"/xl/worksheets/sheet{k}.xml", "worksheet") for k in numbers)}</Types>')
            z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}">{relation(1, "officeDocument", "xl/workbook.xml")}</Relationships>')
            named = "".join(f"<sheet name={quoteattr(s[1])} sheetId=\"{k}\" r:id=\"r{k}\"/>" for k, s in zip(numbers, sheets))
            z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{named}</sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}">{"".join(relation(k, "worksheet", f"worksheets/sheet{k}.xml") for k in numbers)}</Relationships>')
            for k, (_, _, part) in zip(numbers, sheets):
                z.write(part, f"xl/worksheets/sheet{k}.xml")
        os.replace(whole, self.path)
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages: list[Sheets | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class Workbook(DataSource):
    """df.write.format("workbook").mode("append").save(path); df as write_workbook makes it."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "place int, sheet string, row long, cells array<struct<text:string,number:string>>"

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"])


def write_workbook(sheets: dict[str, DataFrame], path: str, order: dict[str, list] | None = None) -> None:
    """One file with a sheet for each table: the columns' names, then the rows, sorted by `order`'s columns where given.

    Numbers are numbers, all else is text that can't act as a formula; nulls are empty cells. An existing file is replaced.
    Tables of more than ROWS - 1 rows are refused, as the format has no room for them.
    """
    every = None
    for place, (sheet, df) in enumerate(sheets.items()):
        numeric = lambda f: f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")
        quoted = [(f, F.col("`" + f.name.replace("`", "``") + "`")) for f in df.schema]
        none = F.lit(None).cast("string")
        cell = lambda text, number: F.struct(text.alias("text"), number.alias("number"))
        cells = F.array(*(cell(none, c.cast("string")) if numeric(f) else cell(spreadsheet_safe(c.cast("string")), none) for f, c in quoted))
        # Nothing says which row of an unsorted table is first, so they come as they are read.
        keys = (order or {}).get(sheet)
        rows = (df.orderBy(*keys) if keys else df).select(cells.alias("cells")).withColumn("row", F.monotonically_increasing_id() + 1)
        head = df.sparkSession.range(1).select(F.array(*(cell(F.lit(f.name), none) for f, _ in quoted)).alias("cells"), F.lit(0).cast("long").alias("row"))
        part = head.unionByName(rows).select(F.lit(place).alias("place"), F.lit(sheet).alias("sheet"), "row", "cells")
        every = part if every is None else every.unionByName(part)
    spark = every.sparkSession
    spark.dataSource.register(Workbook)
    every.repartition(len(sheets), "place").sortWithinPartitions("place", "row").write.format("workbook").mode("append").save(path)
