"""Shapefiles and workbooks: zip files, one for each source, written by the task that has its rows in order."""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordspark.functions import crs, formatting, names

#: The width of a text field and the codes of the formats.
WIDTH, SHAPE, POINT = 254, 9994, 1
MADE = "source_id string, path string"


def _each_source(rows: DataFrame, columns: list[str], folder: str, ending: str, made: Callable) -> DataFrame:
    """One file for each source; the paths of complete ones. A file is written under a name of its own and then renamed."""
    ordered = rows.repartition("source_id").sortWithinPartitions("source_id", "row_id").select("source_id", *(F.col(f"`{c}`") for c in columns))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None
        fs, base = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        fs.create_dir(base, recursive=True)

        def done() -> pa.RecordBatch:
            path = f"{base}/{names.file_name(current)}-{uuid.uuid4().hex[:8]}"
            with fs.open_output_stream(path + ".open", compression=None) as out:
                out.write(held.finished())
            fs.move(path + ".open", path + ending)
            return pa.RecordBatch.from_arrays([pa.array([current]), pa.array([path + ending])], ["source_id", "path"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != current or held is None:
                    if held is not None:
                        yield done()
                    current, held = row[0], made(row[0])
                held.add(row[1:])
        if held is not None:
            yield done()

    return ordered.mapInArrow(files, MADE)


class _Shapes:
    """The members of a shapefile of points with text fields."""

    def __init__(self, base: str, fields: list[str], prj: str, note: str):
        self.base, self.fields, self.prj, self.note = base, fields, prj, note
        self.shp, self.shx, self.dbf, self.n = io.BytesIO(), io.BytesIO(), io.BytesIO(), 0
        self.box = [float("inf"), float("inf"), float("-inf"), float("-inf")]

    def add(self, row: tuple) -> None:
        lon, lat, *values = row
        at = 50 + self.n * 14
        self.n += 1
        self.shp.write(struct.pack(">2i", self.n, 10) + struct.pack("<i2d", POINT, lon, lat))
        self.shx.write(struct.pack(">2i", at, 10))
        self.dbf.write(b" " + b"".join(self._value(v) for v in values))
        self.box = [min(self.box[0], lon), min(self.box[1], lat), max(self.box[2], lon), max(self.box[3], lat)]

    @staticmethod
    def _value(value) -> bytes:
        text = ("" if value is None else str(value)).encode()[:WIDTH].decode("utf-8", "ignore").encode()
        return text.ljust(WIDTH)

    def _head(self, words: int) -> bytes:
        return struct.pack(">7i", SHAPE, 0, 0, 0, 0, 0, words) + struct.pack("<2i", 1000, POINT) + struct.pack("<8d", *(self.box if self.n else [0.0] * 4), 0, 0, 0, 0)

    def finished(self) -> bytes:
        size = 1 + WIDTH * len(self.fields)
        top = struct.pack("<4BIHH20x", 3, 100, 1, 1, self.n, 33 + 32 * len(self.fields), size)
        top += b"".join(f.encode().ljust(11, b"\0") + struct.pack("<c4xBB14x", b"C", WIDTH, 0) for f in self.fields) + b"\r"
        members = {".shp": self._head(50 + self.n * 14) + self.shp.getvalue(), ".shx": self._head(50 + self.n * 4) + self.shx.getvalue(), ".dbf": top + self.dbf.getvalue() + b"\x1a", ".prj": self.prj.encode(), ".cpg": b"UTF-8"}
        if self.note:
            members[".txt"] = self.note.encode()
        return _zipped({self.base + e: d for e, d in members.items()})


def _zipped(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def shapefiles(rows: DataFrame, folder: str, metadata: list[tuple[str, str]] | None = None, lat: str = "Latitude_DD", lon: str = "Longitude_DD") -> DataFrame:
    """A zipped shapefile for each source of rows (source_id, row_id, ...); other columns are text fields."""
    columns = [c for c in rows.columns if c not in ("source_id", "row_id", lat, lon)]
    fields, prj, note = names.field_names(columns), crs.esri_wkt(4326), names.metadata_text(metadata or [])
    return _each_source(rows, [lon, lat, *columns], folder, ".zip", lambda source: _Shapes(names.file_name(source), fields, prj, note))


class _Sheet:
    """A workbook of one sheet with text in place, and one of metadata."""

    def __init__(self, columns: list[str], metadata: list[tuple[str, str]]):
        self.lines, self.metadata, self.n = io.StringIO(), metadata, 0
        self.add(tuple(columns))

    @staticmethod
    def _cell(value) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) != float("inf"):
            return f"<c><v>{value!r}</v></c>"
        text = str(value).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        return f'<c t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'

    def add(self, row: tuple) -> None:
        self.lines.write("<row>" + "".join(map(self._cell, row)) + "</row>")

    def finished(self) -> bytes:
        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        sheets = {"converted": self.lines.getvalue()}
        if self.metadata:
            sheets["metadata"] = "".join("<row>" + self._cell(a) + self._cell(b) + "</row>" for a, b in self.metadata)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        members = {
            "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
            "_rels/.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>",
        }
        members |= {f"xl/worksheets/sheet{k}.xml": f'{head}<worksheet xmlns="{main}"><sheetData>{data}</sheetData></worksheet>' for k, data in enumerate(sheets.values(), 1)}
        return _zipped({n: d.encode() for n, d in members.items()})


def workbooks(rows: DataFrame, folder: str, metadata: list[tuple[str, str]] | None = None) -> DataFrame:
    """A workbook for each source of rows (source_id, row_id, ...), in plain cells: text stays text, formulas too."""
    columns = [c for c in rows.columns if c not in ("source_id", "row_id")]
    kinds = dict(rows.dtypes)
    clean = rows.select("source_id", "row_id", *((formatting.without_controls(F.col(f"`{c}`")) if kinds[c] == "string" else F.col(f"`{c}`")).alias(c) for c in columns))
    return _each_source(clean, columns, folder, ".xlsx", lambda source: _Sheet(columns, metadata or []))
