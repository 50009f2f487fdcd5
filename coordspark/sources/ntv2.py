"""NTv2 grid files as a table of cells.

A file holds sub-grids: a head with bounds and steps in seconds of arc, longitudes counted to
the west, and nodes from the south-eastern corner westwards, row by row. Each cell becomes a
row with the shifts at its four corners, so that a point needs one equi-join to be moved
(``operators.grids``). Heads are few, and are what the driver knows of a grid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coordspark.operators.tables import written

#: The length of a record, records of a head, and the fields of a sub-grid's head in order.
RECORD, RECORDS = 16, 11
FIELDS = ("SUB_NAME", "PARENT", "CREATED", "UPDATED", "S_LAT", "N_LAT", "E_LONG", "W_LONG", "LAT_INC", "LONG_INC", "GS_COUNT")
FACTORS = {"SECONDS": 1.0, "MINUTES": 60.0, "DEGREES": 3600.0}
#: The most bytes of a file: a file is one row until it is cut into cells.
MOST_BYTES = 1 << 30
HEADS = "sub int, name string, parent string, south double, east double, lat_step double, lon_step double, rows int, columns int, first long, factor double, big boolean"
CELLS = "sub int, i int, j int, lat array<double>, lon array<double>"


@dataclass(frozen=True)
class SubGrid:
    """Bounds and steps in seconds, to the north and to the west; rows and columns of nodes; where its nodes begin in the file."""

    sub: int
    name: str
    parent: str
    south: float
    east: float
    lat_step: float
    lon_step: float
    rows: int
    columns: int
    first: int
    factor: float
    big: bool


@dataclass(frozen=True)
class Grid:
    """Sub-grids and their cells: sub, i (from the south), j (from the east), shifts in seconds at the corners (south-east, south-west, north-east, north-west)."""

    heads: tuple[SubGrid, ...]
    cells: DataFrame


def heads_of(data: bytes) -> list[SubGrid]:
    """The sub-grids of a file; one that isn't NTv2 is an error."""
    if data[:8] != b"NUM_OREC" or len(data) < RECORD * RECORDS:
        raise ValueError("not an NTv2 file")
    big = int.from_bytes(data[8:12], "little") != RECORDS
    order = "big" if big else "little"
    number = lambda at: int.from_bytes(data[at + 8 : at + 12], order)
    real = lambda at: float(np.frombuffer(data[at + 8 : at + 16], ">f8" if big else "<f8")[0])
    text = lambda at: data[at + 8 : at + 16].decode("latin-1").strip(" \0")
    factor = FACTORS.get(text(3 * RECORD), 1.0)
    out, at = [], RECORD * RECORDS
    for sub in range(number(2 * RECORD)):
        place = {name: at + k * RECORD for k, name in enumerate(FIELDS)}
        south, north, east, west, lat_step, lon_step = (real(place[n]) for n in FIELDS[4:10])
        count = number(place["GS_COUNT"])
        rows, columns = round((north - south) / lat_step) + 1, round((west - east) / lon_step) + 1
        first = at + RECORDS * RECORD
        if rows * columns != count or first + count * RECORD > len(data):
            raise ValueError(f"sub-grid {text(place['SUB_NAME'])} says {count} nodes, its bounds {rows} times {columns}")
        out.append(SubGrid(sub, text(place["SUB_NAME"]), text(place["PARENT"]), south * factor, east * factor, lat_step * factor, lon_step * factor, rows, columns, first, factor, big))
        at = first + count * RECORD
    return out


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("content").to_pylist():
            yield pa.RecordBatch.from_pylist([vars(h) for h in heads_of(data)], pa.schema([(n, {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (f.split() for f in HEADS.split(", "))]))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("content").to_pylist():
            for h in heads_of(data):
                nodes = np.frombuffer(data, ">f4" if h.big else "<f4", h.rows * h.columns * 4, h.first).reshape(h.rows, h.columns, 4)[:, :, :2].astype(np.float64) * h.factor
                corners = np.stack([nodes[:-1, :-1], nodes[:-1, 1:], nodes[1:, :-1], nodes[1:, 1:]], axis=2)
                j = np.arange(h.columns - 1, dtype=np.int32)
                for i, row in enumerate(corners):  # a row of cells a batch
                    lists = [pa.ListArray.from_arrays(pa.array(4 * np.arange(len(j) + 1), pa.int32()), pa.array(np.ascontiguousarray(row[:, :, k]).ravel())) for k in range(2)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), h.sub, np.int32)), pa.array(np.full(len(j), i, np.int32)), pa.array(j), *lists], [f.split()[0] for f in CELLS.split(", ")])


def read(spark: SparkSession, path: str, most: int = MOST_BYTES) -> Grid:
    """A grid file; one that is missing, or larger than ``most`` bytes, is an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    sizes = files.select("path", "length").collect()
    if len(sizes) != 1 or sizes[0].length > most:
        raise ValueError(f"one grid file of at most {most} bytes is asked for, found {[(r.path, r.length) for r in sizes]}")
    return parsed(files.select("content"))


def parsed(content: DataFrame) -> Grid:
    """The grid in a row with a file's bytes."""
    heads = tuple(SubGrid(**r.asDict()) for r in content.mapInArrow(_heads, HEADS).collect())
    return Grid(heads, written(content.mapInArrow(_cells, CELLS), "grid-cells"))


def encoded(heads: list[tuple[str, str, float, float, float, float, np.ndarray]], big: bool = False) -> bytes:
    """A file of sub-grids (name, parent, south, east, steps in seconds, shifts by row, column and axis), as tests and queries need one."""
    end, kind = ("big", ">") if big else ("little", "<")
    whole = lambda name, n: name.ljust(8).encode() + n.to_bytes(4, end) + bytes(4)
    text = lambda name, value: name.ljust(8).encode() + value.ljust(8).encode()
    real = lambda name, x: name.ljust(8).encode() + np.array([x], f"{kind}f8").tobytes()
    out = [whole("NUM_OREC", RECORDS), whole("NUM_SREC", RECORDS), whole("NUM_FILE", len(heads)), text("GS_TYPE", "SECONDS"), text("VERSION", "NTv2.0"), text("SYSTEM_F", "FROM"), text("SYSTEM_T", "TO")]
    out += [real(n, x) for n, x in (("MAJOR_F", 6378388.0), ("MINOR_F", 6356911.946), ("MAJOR_T", 6378137.0), ("MINOR_T", 6356752.314))]
    for name, parent, south, east, lat_step, lon_step, shifts in heads:
        rows, columns, _ = shifts.shape
        ends = (south, south + lat_step * (rows - 1), east, east + lon_step * (columns - 1), lat_step, lon_step)
        out += [text("SUB_NAME", name), text("PARENT", parent), text("CREATED", ""), text("UPDATED", ""), *(real(n, x) for n, x in zip(FIELDS[4:10], ends, strict=True)), whole("GS_COUNT", rows * columns)]
        nodes = np.zeros((rows, columns, 4), f"{kind}f4")
        nodes[:, :, :2] = shifts
        out.append(nodes.tobytes())
    return b"".join([*out, b"END".ljust(8) + bytes(8)])


def cell_count(grid: Grid) -> int:
    return sum((h.rows - 1) * (h.columns - 1) for h in grid.heads)


def finest_first(grid: Grid) -> list[SubGrid]:
    """Sub-grids in the order in which a point is looked for."""
    return sorted(grid.heads, key=lambda h: (h.lat_step * h.lon_step, h.sub))


def whole(x):
    """A column as a whole number."""
    return F.floor(x).cast("int")
