"""Moving points by a grid of shifts, with a seven-parameter shift where the grid doesn't reach.

A point's sub-grid, the finest that holds it, is a chain of conditions over the few heads; its
cell is arithmetic; the shifts at the cell's corners come by an equi-join on the cell, small
grids sent to all tasks and large ones shuffled; what is between the corners is bilinear. The
way back looks for the point that the grid moves to the one given: each step takes the shift
of the last guess, which errs by less than a thousandth of what it did before, as shifts
change that little over their own length. The first guess finds the cell, and the steps stay in
it: by then a guess is wrong by centimetres, and cells agree along their edges.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordspark.functions import crs
from coordspark.operators.tables import fitted, written
from coordspark.sources.ntv2 import Grid, SubGrid, finest_first, whole

STEPS = 4
WGS84 = 4326


def _name() -> str:
    return f"grid_{uuid.uuid4().hex[:8]}"


def _cell(h: SubGrid, north: Column, west: Column) -> Column:
    """A point's cell in a sub-grid, with its corner and steps in seconds, or null."""
    u, v = (north - h.south) / h.lat_step, (west - h.east) / h.lon_step
    here = u.between(0, h.rows - 1) & v.between(0, h.columns - 1)
    # a point on the far edge belongs to the last cell
    i, j = F.least(whole(u), F.lit(h.rows - 2)), F.least(whole(v), F.lit(h.columns - 2))
    place = {"sub": F.lit(h.sub), "i": i, "j": j, "south": h.south + i * h.lat_step, "east": h.east + j * h.lon_step, "up": F.lit(h.lat_step), "left": F.lit(h.lon_step)}
    return F.when(here, F.struct(*(x.alias(c) for c, x in place.items())))


def _located(df: DataFrame, lon: Column, lat: Column, grid: Grid, name: str) -> DataFrame:
    """The frame with the cell of a point and the shifts at its corners in a column; null outside of the grid, and for null or NaN."""
    cell = F.coalesce(*(_cell(h, lat * 3600, lon * -3600) for h in finest_first(grid)))
    cells = fitted(grid.cells.select(F.struct("sub", "i", "j").alias(f"{name}_of"), F.struct("lat", "lon").alias(f"{name}_by")))
    key = F.struct(*(F.col(f"{name}_at.{c}").alias(c) for c in ("sub", "i", "j")))
    found = df.withColumn(f"{name}_at", cell).join(cells, key == F.col(f"{name}_of"), "left")
    return found.select(*df.columns, F.when(F.col(f"{name}_by").isNotNull(), F.struct(f"{name}_at", f"{name}_by")).alias(name))


def _moved(name: str, lon: Column, lat: Column) -> tuple[Column, Column]:
    """The shift of a point in a cell, in degrees to the east and north."""
    at, by = F.col(f"{name}.{name}_at"), F.col(f"{name}.{name}_by")
    u, v = (lat * 3600 - at["south"]) / at["up"], (lon * -3600 - at["east"]) / at["left"]

    def mixed(c: str) -> Column:
        a, b, d, e = (F.get(by[c], F.lit(k)) for k in range(4))
        return (1 - u) * (a + v * (b - a)) + u * (d + v * (e - d))

    return mixed("lon") / -3600, mixed("lat") / 3600


def forward(df: DataFrame, lon: str, lat: str, grid: Grid, out: tuple[str, str]) -> DataFrame:
    """Points moved by the grid, null where it doesn't reach."""
    n = _name()
    keep = [c for c in df.columns if c not in out]
    east, north = _moved(n, F.col(lon), F.col(lat))
    return _located(df, F.col(lon), F.col(lat), grid, n).select(*keep, (F.col(lon) + east).alias(out[0]), (F.col(lat) + north).alias(out[1]))


def backward(df: DataFrame, lon: str, lat: str, grid: Grid, out: tuple[str, str], steps: int = STEPS) -> DataFrame:
    """The points that the grid moves to those given; null where the point or its first guess lies outside of the grid."""
    n, m = _name(), _name()
    keep = [c for c in df.columns if c not in out]
    east, north = _moved(n, F.col(lon), F.col(lat))
    first = _located(df, F.col(lon), F.col(lat), grid, n).select(*df.columns, F.struct((F.col(lon) - east).alias("lon"), (F.col(lat) - north).alias("lat")).alias(f"{m}_p"))
    at = _located(first, F.col(f"{m}_p.lon"), F.col(f"{m}_p.lat"), grid, m)

    def step(p: Column, _: Column) -> Column:
        by = _moved(m, p["lon"], p["lat"])
        return F.struct((F.col(lon) - by[0]).alias("lon"), (F.col(lat) - by[1]).alias("lat"))

    found = at.withColumn(f"{m}_p", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col(f"{m}_p"), step))
    return found.select(*keep, F.col(f"{m}_p.lon").alias(out[0]), F.col(f"{m}_p.lat").alias(out[1]))


def transform(df: DataFrame, x: str, y: str, source: int | crs.System, target: int | crs.System, grids: dict[int, Grid], out: tuple[str, str] = ("x_out", "y_out"), how: str | None = None) -> DataFrame:
    """The frame with x and y of the target system, through WGS84: grids by the code of the system they move to it.

    A point that its system's grid doesn't hold is moved by the system's seven parameters;
    ``how`` names a column that says which: grid, helmert, or null where neither was called for
    or nothing came out. Of two shifts on the way it names the seven parameters if either was
    theirs. A system that needs a grid and has none here is an error.
    """
    a, b = crs.get(source), crs.get(target)
    for s in (a, b):
        if s.needs_grid and a != b and s.code not in grids:
            raise ValueError(f"system {s.code} needs a grid file, and none is given")
    n = _name()
    keep = [c for c in df.columns if c not in (*out, how)]
    bare = lambda s: (replace(s, shift=None, needs_grid=False), crs.System(0, s.ellipsoid, False))
    told = []
    here = df.withColumns({f"{n}_lon": F.col(x), f"{n}_lat": F.col(y)})
    place = (f"{n}_lon", f"{n}_lat")
    if a != b:
        if a.code in grids and a.needs_grid:
            plain, own = bare(a)
            here = crs.transform(here, x, y, plain, own, (f"{n}_p", f"{n}_q"))
            here = forward(here, f"{n}_p", f"{n}_q", grids[a.code], (f"{n}_p", f"{n}_q"))
            here = crs.transform(here, x, y, a, WGS84, place, mode="helmert")
            here = here.withColumn(f"{n}_first", F.when(F.col(f"{n}_p").isNotNull(), "grid").when(F.col(place[0]).isNotNull(), "helmert"))
            here = here.withColumns({place[0]: F.coalesce(f"{n}_p", place[0]), place[1]: F.coalesce(f"{n}_q", place[1])})
            told.append(F.col(f"{n}_first"))
        else:
            here = crs.transform(here, x, y, a, WGS84, place)
        if b.code in grids and b.needs_grid:
            plain, own = bare(b)
            here = backward(here, *place, grids[b.code], (f"{n}_p", f"{n}_q"))
            here = crs.transform(here, f"{n}_p", f"{n}_q", own, plain, (f"{n}_p", f"{n}_q"))
            here = crs.transform(here, *place, WGS84, b, (f"{n}_r", f"{n}_s"), mode="helmert")
            here = here.withColumn(f"{n}_second", F.when(F.col(f"{n}_p").isNotNull(), "grid").when(F.col(f"{n}_r").isNotNull(), "helmert"))
            here = here.withColumns({place[0]: F.coalesce(f"{n}_p", f"{n}_r"), place[1]: F.coalesce(f"{n}_q", f"{n}_s")})
            told.append(F.col(f"{n}_second"))
        else:
            here = crs.transform(here, *place, WGS84, b, place)
    both = F.greatest(*told) if len(told) > 1 else told[0] if told else F.lit(None).cast("string")  # helmert sorts behind grid
    said = [] if how is None else [F.when(F.col(place[0]).isNotNull(), both).alias(how)]
    done = here.select(*keep, *(F.col(c).alias(o) for c, o in zip(place, out, strict=True)), *said)
    # two ways, each tried for every point, make a long plan: what follows reads their result
    return written(done, "grid-points") if told else done
