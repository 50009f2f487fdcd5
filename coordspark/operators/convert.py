"""The whole conversion of a table: cells to degrees, statuses, suggestions applied on request, derived columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coordspark.functions import crs, formatting, parse
from coordspark.operators import regions, swaps
from coordspark.operators.tables import written

#: The derived columns, and the like for a second system.
DERIVED = ("Latitude_DD", "Longitude_DD", "X_DD", "Y_DD", "WKT", "Latitude_GMS", "Longitude_GMS", "Folha_25k", "Folha_50k", "Nome_50k")
SECOND = r"^(?:X|Y|WKT)_[A-Za-z0-9]+$"
KILOMETRE = 1000.0
#: Where eastings and northings of the islands lie; boxes of the island groups with their older and newer systems.
ISLANDS_X, ISLANDS_Y = (1e5, 9e5), (4e6, 4.5e6)
GROUPS = {"west": (39.3, 39.8, -31.4, -30.9, 2188, 5014), "central": (38.3, 39.2, -28.9, -26.9, 2189, 5015), "east": (36.85, 37.95, -25.95, -24.9, 2190, 5015)}


class ReviewPending(RuntimeError):
    """Rows that look reversed haven't been answered yet."""


def read_pairs(table: DataFrame, first: str, second: str, system: crs.System | None = None, region: str | None = None, supply_sign: bool = False, scale: float = 1.0, fixes: DataFrame | None = None, mode: str = "grid") -> DataFrame:
    """The table with lat and lon, unrounded: degrees as written, or a grid's values brought to degrees.

    The first column is the latitude, or in a grid the easting. Fixes (row_id, x, y) replace the values of their rows.
    """
    if system is None or not system.projected:
        if supply_sign and region:
            read = regions.signed_for(table, region, first, second)
        else:
            read = parse.with_coordinates(table, {"lat": first, "lon": second})
        return read if system is None else crs.to_wgs84(read, "lon", "lat", system, ("lon", "lat"), mode)
    read = table.withColumns({"x": parse.parse_projected(F.col(first)) * scale, "y": parse.parse_projected(F.col(second)) * scale})
    if fixes is not None:
        new = fixes.select("row_id", F.col("x").alias("fx"), F.col("y").alias("fy"))
        read = read.join(new, "row_id", "left").withColumns({"x": F.coalesce("fx", "x"), "y": F.coalesce("fy", "y")}).drop("fx", "fy")
    return crs.to_wgs84(read, "x", "y", system, ("lon", "lat"), mode)


def without_derived(table: DataFrame) -> DataFrame:
    """Without what an earlier conversion added."""
    again = [c for c in table.columns if c in DERIVED]
    more = [c for c in table.columns if again and c not in DERIVED and re.match(SECOND, c)]
    return table.drop(*again, *more)


def derived(points: DataFrame, decimals: int = 6, dms: bool = False, target: int | str | crs.System | None = None, mode: str = "grid") -> DataFrame:
    """The points (lat, lon, unrounded) with rounded degrees, WKT, on request degrees-minutes-seconds and a second system's metres."""
    base = without_derived(points)
    lat, lon = (formatting.round_half_even(F.col(c), decimals) for c in ("lat", "lon"))
    out = base.withColumns({"Latitude_DD": lat, "Longitude_DD": lon})
    out = out.withColumns({"X_DD": F.col("Longitude_DD"), "Y_DD": F.col("Latitude_DD"), "WKT": formatting.wkt_point(F.col("Latitude_DD"), F.col("Longitude_DD"))})
    if dms:
        out = out.withColumns({"Latitude_GMS": formatting.format_dms(F.col("Latitude_DD"), "lat"), "Longitude_GMS": formatting.format_dms(F.col("Longitude_DD"), "lon")})
    if target is not None:
        system = crs.resolve(target)
        s = target if isinstance(target, str) and target.startswith("UTM") else str(abs(system.code))
        good = parse.valid_pair(F.col("lat"), F.col("lon"))
        held = out.withColumns({"lat_in": F.when(good, F.col("lat")), "lon_in": F.when(good, F.col("lon"))})
        there = crs.from_wgs84(held, "lon_in", "lat_in", system, (f"X_{s}", f"Y_{s}"), mode).drop("lat_in", "lon_in")
        places = 3 if system.projected else decimals
        there = there.withColumns({c: formatting.round_half_even(F.col(c), places) for c in (f"X_{s}", f"Y_{s}")})
        text = F.concat(F.lit("POINT ("), formatting.number_text(F.col(f"X_{s}")), F.lit(" "), formatting.number_text(F.col(f"Y_{s}")), F.lit(")"))
        out = there.withColumn(f"WKT_{s}", text)
    return out


def convert(table: DataFrame, first: str, second: str, *keys: str, system: int | str | crs.System | None = None, region: str | None = None, reference: tuple[float, float] | None = None, radius: float = 10.0, supply_sign: bool = False, scale: float = 1.0, fixes: DataFrame | None = None, decimals: int = 6, dms: bool = False, target: int | str | crs.System | None = None, mode: str = "grid") -> DataFrame:
    """The table (row_id, cells as text columns) with lat, lon, status and the derived columns; keys name a file's rows."""
    found = crs.resolve(system)
    points = read_pairs(table, first, second, found, region, supply_sign, scale, fixes, mode)
    mismatch = parse.axis_mismatch(F.col(first), F.col(second)) if found is None or not found.projected else None
    rounded = points.withColumns({"exact_lat": F.col("lat"), "exact_lon": F.col("lon"), "mismatch": mismatch if mismatch is not None else F.lit(False)})
    rounded = rounded.withColumns({c: formatting.round_half_even(F.col(c), decimals) for c in ("lat", "lon")})
    rounded = written(rounded, "converted")  # statuses name lat and lon many times: each cell is read once
    labelled = swaps.detect(rounded, *keys, region=region, reference=reference, radius=radius, mismatch=F.col("mismatch"))
    labelled = written(labelled, "labelled")
    exact = labelled.withColumns({"lat": F.col("exact_lat"), "lon": F.col("exact_lon")}).drop("exact_lat", "exact_lon", "mismatch")
    return derived(exact, decimals, dms, target, mode)


def apply_swaps(result: DataFrame, accepted: Column | DataFrame, decimals: int = 6, dms: bool = False, target: int | str | crs.System | None = None, mode: str = "grid") -> DataFrame:
    """The result with accepted rows exchanged and settled as ok, and derived again; accepted is a condition or a table of row_id."""
    if isinstance(accepted, DataFrame):
        marked = result.join(accepted.select("row_id").distinct().withColumn("taken", F.lit(True)), "row_id", "left")
        taken = F.coalesce("taken", F.lit(False))
    else:
        marked, taken = result.withColumn("taken", accepted), F.coalesce("taken", F.lit(False))
    turned = marked.withColumns({"lat": F.when(taken, F.col("lon")).otherwise(F.col("lat")), "lon": F.when(taken, F.col("lat")).otherwise(F.col("lon")), "status": F.when(taken, regions.classify(F.col("lon"), F.col("lat"))).otherwise(F.col("status"))})
    return derived(turned.drop("taken"), decimals, dms, target, mode)


def reviewed(result: DataFrame, review: str = "required") -> DataFrame:
    """What may be written: as it is when nothing is suspect or ``keep`` is said, exchanged when ``apply`` is; else ReviewPending."""
    suspect = F.col("status").startswith("swap_")
    if review == "apply":
        return apply_swaps(result, suspect)
    if review == "required" and not result.where(suspect).isEmpty():
        raise ReviewPending("rows look reversed; say keep or apply")
    return result


def plot_points(result: DataFrame) -> DataFrame:
    """The rows a map can show; those reversed out of range are shown where the other order puts them."""
    turned = F.col("status") == "swap_range"
    placed = result.withColumns({"plot_lat": F.when(turned, F.col("lon")).otherwise(F.col("lat")), "plot_lon": F.when(turned, F.col("lat")).otherwise(F.col("lon"))})
    return placed.where(parse.valid_pair(F.col("plot_lat"), F.col("plot_lon")))


def features(result: DataFrame) -> DataFrame:
    """What an export holds: rows in range, without the columns that repeat the place."""
    repeats = [c for c in result.columns if c in ("X_DD", "Y_DD", "WKT") or re.match(SECOND, c)]
    return result.where(parse.valid_pair(F.col("Latitude_DD"), F.col("Longitude_DD"))).drop(*repeats)


def search(result: DataFrame, text: str) -> DataFrame:
    """Rows whose number or any cell holds the text, whatever its case."""
    cells = F.concat_ws(" ", (F.col("row_id") + 1).cast("string"), *(F.col(f"`{c}`").cast("string") for c in result.columns if c != "row_id"))
    return result.where(F.contains(F.lower(cells), F.lit(text.lower())))


def preview(result: DataFrame, n: int = 20, start: int = 0) -> DataFrame:
    """The first rows in order, or those of a page."""
    return result.orderBy("row_id").offset(start).limit(n)


def azores_group(points: DataFrame, region: str, *keys: str) -> DataFrame:
    """For rows with metres of the islands but outside the region: the group whose box most of them fall in, read in its own system."""
    rows = points.where(F.col("x").between(*ISLANDS_X) & F.col("y").between(*ISLANDS_Y)).where(~regions.in_region(F.col("lat"), F.col("lon"), region))
    counts = []
    for name, (a, b, c, d, old, _) in GROUPS.items():
        rows = crs.to_wgs84(rows, "x", "y", old, (f"{name}_lon", f"{name}_lat"))
        counts.append(F.struct(F.lit(name).alias("name"), F.lit(old).alias("system"), F.count_if(F.col(f"{name}_lat").between(a, b) & F.col(f"{name}_lon").between(c, d)).alias("n")))
    best = F.reduce(F.array(*counts), F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("system"), F.lit(0).cast("long").alias("n")), lambda z, x: F.when(x["n"] > z["n"], x).otherwise(z))
    return rows.groupBy(*keys).agg(best.alias("b")).where("b.n > 0").select(*keys, "b.*")


def quick(spark: SparkSession, first: str, second: str, **options) -> DataFrame:
    """One pair."""
    return convert(spark.createDataFrame([(0, first, second)], "row_id long, a string, b string"), "a", "b", region=options.pop("region", "Portugal mainland"), dms=True, **options)
