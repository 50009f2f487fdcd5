"""Workbooks as tables of text: the sheets of .xlsx and .xlsm files, by the zip and XML they are made of.

A workbook is a zip, so a file is one task's, but no part of it is held whole: a sheet is parsed
as a stream, a few thousand rows a batch, and so are its shared strings, which are a table of
their own. Cells name strings by number and meet them by a join, in which a small table is sent
to all tasks. Dates and the text of numbers are column expressions. Old binary workbooks (.xls,
.xlsb) and encrypted ones are refused: nothing installed reads them. A workbook that expands to
more than ``most`` bytes is refused too.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coordspark.operators.columns import named_array
from coordspark.operators.tables import fitted, written
from coordspark.sources.texts import MOST_BYTES, FileTooLarge, files

SHEETS = "source_id string, sheet_no int, sheet string"
ROWS = "source_id string, pos long, cells array<struct<i:int,t:string,v:string,s:int>>"
STRINGS = "source_id string, n int, string string"
BOOKS = "source_id string, dated array<boolean>, base int"
CELL = pa.list_(pa.struct([("i", pa.int32()), ("t", pa.string()), ("v", pa.string()), ("s", pa.int32())]))
BATCH_ROWS = 4096
#: The days from the two epochs of workbooks to 1970, and the built-in formats of dates and times.
EPOCH, EPOCH_1904 = 25569, 24107
DATES = frozenset((*range(14, 23), *range(45, 48)))


class WorkbookProtected(ValueError):
    """A workbook that is encrypted."""


def kind(content: Column) -> Column:
    """xlsx, ole (an old or encrypted workbook) or other, by the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("504B0304"), "xlsx").when(head == "D0CF11E0A1B11AE1", "ole").otherwise("other")


def _opened(most: int, made: Callable) -> Callable:
    """A function over batches (source_id, content) that opens each workbook for ``made``."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if content[:4] == b"\xd0\xcf\x11\xe0":
                    raise WorkbookProtected(f"{source}: encrypted, or of an old kind") if b"E\0n\0c\0r\0y\0p\0t" in content else ValueError(f"{source}: old workbooks aren't read")
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    size = sum(i.file_size for i in z.infolist())
                    if size > most:
                        raise FileTooLarge(f"{source}: {size} bytes expanded")
                    yield from made(source, z)

    return opened


def _local(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _elements(z: zipfile.ZipFile, name: str, wanted: str) -> Iterator[ElementTree.Element]:
    """The elements of a part by name, each gone once it is passed."""
    if name not in z.namelist():
        return
    with z.open(name) as part:
        path: list[ElementTree.Element] = []
        for event, element in ElementTree.iterparse(part, ("start", "end")):
            if event == "start":
                path.append(element)
                continue
            path.pop()
            if _local(element) == wanted:
                yield element
                element.clear()
                if path:
                    path[-1].clear()


def _texts(element: ElementTree.Element) -> str:
    """The text of an element's t parts, without readings of them."""
    return "".join((t.text or "") if _local(t) == "t" else _texts(t) if _local(t) != "rPh" else "" for t in element)


def _book(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and part of each sheet, in the book's order."""
    targets = {r.get("Id"): r.get("Target", "").lstrip("/").removeprefix("xl/") for r in _elements(z, "xl/_rels/workbook.xml.rels", "Relationship")}
    of = lambda e: next(v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == "id")
    return [(e.get("name", ""), "xl/" + targets[of(e)]) for e in _elements(z, "xl/workbook.xml", "sheet")]


def _column(ref: str | None, otherwise: int) -> int:
    """A to 0, B to 1, AA to 26."""
    n = 0
    for c in re.match("[A-Z]*", ref or "")[0]:
        n = n * 26 + ord(c) - 64
    return n - 1 if n else otherwise


def _listed(source: str, z: zipfile.ZipFile) -> Iterator[pa.RecordBatch]:
    names = [n for n, _ in _book(z)]
    yield pa.RecordBatch.from_arrays([pa.array([source] * len(names), pa.string()), pa.array(range(len(names)), pa.int32()), pa.array(names, pa.string())], ["source_id", "sheet_no", "sheet"])


def _rows(sheet: int | str) -> Callable:
    def rows(source: str, z: zipfile.ZipFile) -> Iterator[pa.RecordBatch]:
        book = _book(z)
        part = next((p for k, (n, p) in enumerate(book) if sheet in (k, n)), None)
        held: list[list[dict]] = []
        pos = 0

        def batch() -> pa.RecordBatch:
            nonlocal pos
            n = len(held)
            out = pa.RecordBatch.from_arrays([pa.array([source] * n, pa.string()), pa.array(range(pos, pos + n), pa.int64()), pa.array(held, CELL)], ["source_id", "pos", "cells"])
            held.clear()
            pos += n
            return out

        for row in _elements(z, part or "", "row"):
            cells = []
            for k, c in enumerate(x for x in row if _local(x) == "c"):
                value = {_local(x): x for x in c}
                text = _texts(value["is"]) if "is" in value else (value["v"].text or "") if "v" in value else ""
                cells.append({"i": _column(c.get("r"), k), "t": c.get("t", "n"), "v": text, "s": int(c.get("s", 0))})
            held.append(cells)
            if len(held) >= BATCH_ROWS:
                yield batch()
        if held:
            yield batch()

    return rows


def _strings(source: str, z: zipfile.ZipFile) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array([source] * len(held), pa.string()), pa.array(range(n, n + len(held)), pa.int32()), pa.array(held, pa.string())], ["source_id", "n", "string"])
    for si in _elements(z, "xl/sharedStrings.xml", "si"):
        held.append(_texts(si))
        if len(held) >= BATCH_ROWS:
            yield batch()
            n, held = n + len(held), []
    if held:
        yield batch()


def _dates(source: str, z: zipfile.ZipFile) -> Iterator[pa.RecordBatch]:
    """Which styles are of dates, and the days to 1970."""
    custom = {e.get("numFmtId") for e in _elements(z, "xl/styles.xml", "numFmt") if re.search(r'^[^"\[]*[dmyhs]', e.get("formatCode", ""))}
    dated = [[x.get("numFmtId") in custom or int(x.get("numFmtId", 0)) in DATES for x in e] for e in _elements(z, "xl/styles.xml", "cellXfs")]
    late = any(e.get("date1904") in ("1", "true") for e in _elements(z, "xl/workbook.xml", "workbookPr"))
    yield pa.RecordBatch.from_arrays([pa.array([source]), pa.array(dated[:1] or [[]], pa.list_(pa.bool_())), pa.array([EPOCH_1904 if late else EPOCH], pa.int32())], ["source_id", "dated", "base"])


def sheets(spark: SparkSession, path: str | list[str], most: int = MOST_BYTES) -> DataFrame:
    """The sheets in the book's order: source_id, sheet_no, sheet."""
    return files(spark, path).mapInArrow(_opened(most, _listed), SHEETS)


def _cell_text() -> Column:
    """A cell's stored value as text: columns t, v, s, string, dated, base."""
    value, number = F.col("v"), F.col("v").try_cast("double")
    seconds = F.rint(number * 86400).cast("long")
    since = seconds - F.col("base").cast("long") * 86400
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(since / 86400).cast("int"))
    clock = F.format_string("%02d:%02d:%02d", F.floor(F.pmod(seconds, F.lit(86400)) / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60)))
    date = F.when(number < 1, clock).when(F.pmod(seconds, F.lit(86400)) == 0, day.cast("string")).otherwise(F.concat(day.cast("string"), F.lit(" "), clock))
    plain = F.when(number == F.floor(number), F.when(F.abs(number) < 1e15, number.cast("long").cast("string"))).otherwise(value)
    dated = number.between(0, 2958466) & F.coalesce(F.get("dated", F.col("s")), F.lit(False))
    kind_ = F.col("t")
    return F.when(kind_ == "s", F.col("string")).when(kind_.isin("inlineStr", "str", "e", "d"), value).when(kind_ == "b", F.when(value == "1", "TRUE").otherwise("FALSE")).when(dated, date).otherwise(F.coalesce(plain, value))


def read(spark: SparkSession, path: str | list[str], sheet: int | str = 0, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """The rows and headers of one sheet of each workbook; cells are their stored values as text, dates in the ISO way."""
    books = files(spark, path)
    rows = written(books.mapInArrow(_opened(most, _rows(sheet)), ROWS), "workbook-rows")
    strings = fitted(written(books.mapInArrow(_opened(most, _strings), STRINGS), "workbook-strings"))
    dates = fitted(written(books.mapInArrow(_opened(most, _dates), BOOKS), "workbook-dates"))
    cells = rows.select("source_id", "pos", F.explode("cells").alias("c")).select("source_id", "pos", "c.*")
    named = cells.withColumn("n", F.when(F.col("t") == "s", F.col("v").try_cast("int"))).join(strings, ["source_id", "n"], "left").join(dates, "source_id")
    texts = named.select("source_id", "pos", F.struct("i", F.coalesce(_cell_text(), F.lit("")).alias("v")).alias("cell"))
    each = texts.groupBy("source_id", "pos").agg(F.map_from_entries(F.collect_list("cell")).alias("cells"))  # a sheet's columns
    each = written(rows.select("source_id", "pos").join(each, ["source_id", "pos"], "left"), "workbook-cells")
    width = fitted(each.groupBy("source_id").agg(F.max(F.array_max(F.map_keys("cells"))).alias("most"), F.min("pos").alias("at")))
    cell = lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(""))
    full = each.join(width, "source_id").select("source_id", "pos", "at", F.transform(F.sequence(F.lit(0), F.coalesce("most", F.lit(0))), cell).alias("cells"))
    data = full.where("pos > at").select("source_id", (F.col("pos") - F.col("at") - 1).cast("long").alias("row_id"), "cells")
    return data, full.where("pos = at").select("source_id", named_array(F.col("cells")).alias("names"))
