"""Regions, statuses and suggestions over points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordspark.functions.parse import bare, parse_coordinate, sign_missing, unsigned_outside, valid_pair
from coordspark.operators.tables import written

#: Regions in their order, each with its boxes of least and most latitude and longitude.
REGIONS = {
    "Portugal mainland": ((36.8, 42.2, -9.6, -6.1),),
    "Azores": ((36.9, 39.8, -31.3, -24.9),),
    "Madeira": ((32.3, 33.2, -17.3, -16.2), (30.0, 30.25, -16.1, -15.7)),
    "Angola": ((-18.1, -4.3, 11.6, 24.2),),
    "Cabo Verde": ((14.7, 17.3, -25.5, -22.6),),
    "Guiné-Bissau": ((10.8, 12.8, -16.9, -13.5),),
    "Moçambique": ((-27.0, -10.4, 30.1, 41.0),),
    "São Tomé e Príncipe": ((-0.1, 1.8, 6.4, 7.6),),
}


def in_region(lat: Column, lon: Column, name: str) -> Column:
    """Whether a point is in one of the region's boxes, edges included."""
    boxes = [lat.between(a, b) & lon.between(c, d) for a, b, c, d in REGIONS[name]]
    return F.coalesce(reduce(Column.__or__, boxes), F.lit(False))


def identify_region(lat: Column, lon: Column) -> Column:
    """The first region in order that holds the point, or null."""
    return F.coalesce(*(F.when(in_region(lat, lon, name), name) for name in REGIONS))


def classify(lat: Column, lon: Column, region: str | None = None, mismatch: Column | None = None) -> Column:
    """ok, missing, out_of_range, swap_range, swap_cluster (reversed, the point is in the region) or swap_axis (a letter proves it, of points in range)."""
    ok, turned = valid_pair(lat, lon), valid_pair(lon, lat)
    out = F.when(lat.isNull() | lon.isNull() | F.isnan(lat) | F.isnan(lon), "missing")
    if mismatch is not None:
        out = out.when(mismatch & ok, "swap_axis")
    if region is not None:
        out = out.when(ok & ~in_region(lat, lon, region) & in_region(lon, lat, region), "swap_cluster")
    return out.when(ok, "ok").when(turned, "swap_range").otherwise("out_of_range")


def swapped(points: DataFrame, accepted: Column, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The points with latitude and longitude exchanged where accepted."""
    new = {lat: F.when(accepted, F.col(lon)).otherwise(F.col(lat)), lon: F.when(accepted, F.col(lat)).otherwise(F.col(lon))}
    return points.withColumns(new)


def extent(points: DataFrame, *keys: str) -> DataFrame:
    """Count, bounding box and mean of the points in range."""
    good = valid_pair(F.col("lat"), F.col("lon"))
    lat, lon = F.when(good, F.col("lat")), F.when(good, F.col("lon"))
    return points.groupBy(*keys).agg(
        F.count_if(good).alias("n"), F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"), F.min(lon).alias("lon_min"),
        F.max(lon).alias("lon_max"), F.avg(lat).alias("lat_mean"), F.avg(lon).alias("lon_mean"),
    )


def suggest_scale(points: DataFrame, region: str, *keys: str) -> DataFrame:
    """Whether values written in kilometres fit the region: lat, lon as written and lat_km, lon_km times 1000; rows unreadable as written don't count."""
    readable = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    here = F.count_if(readable & in_region(F.col("lat"), F.col("lon"), region))
    scaled = F.count_if(readable & in_region(F.col("lat_km"), F.col("lon_km"), region))
    found = points.groupBy(*keys).agg(F.count_if(readable).alias("readable"), here.alias("was"), scaled.alias("inside"))
    return found.where("readable >= 3 and inside > was and inside >= 0.8 * readable")


def signed_for(cells: DataFrame, region: str, lat: str = "lat_raw", lon: str = "lon_raw") -> DataFrame:
    """The cells read as lat and lon, with the region's sign where only that is missing."""
    made = {}
    for out, cell in (("lat", lat), ("lon", lon)):
        value = parse_coordinate(F.col(cell))
        made[out] = F.when(unsigned_outside(F.col(cell), out, REGIONS[region]), -F.abs(value)).otherwise(value)
    return cells.withColumns(made)


def signable(cells: DataFrame, region: str, *keys: str, lat: str = "lat_raw", lon: str = "lon_raw") -> DataFrame:
    """How many values of both axes the region's sign would complete."""
    flags = [unsigned_outside(F.col(c), axis, REGIONS[region]).cast("long") for axis, c in (("lat", lat), ("lon", lon))]
    return cells.groupBy(*keys).agg(F.sum(flags[0] + flags[1]).alias("signable"))


def suggest_region(cells: DataFrame, *keys: str, chosen: str | None = None, lat: str = "lat_raw", lon: str = "lon_raw", least: int = 3, share: float = 0.8) -> DataFrame:
    """The region whose sign alone would put the points inside it: region, inside, readable, flips; no row where none does or two do equally well.

    One aggregate over all regions: of each, the points inside once its sign is supplied and the signs that takes.
    """
    read = cells.select(*keys, parse_coordinate(F.col(lat)).alias("a"), parse_coordinate(F.col(lon)).alias("o"), bare(F.col(lat)).alias("bare_a"), bare(F.col(lon)).alias("bare_o"))
    read = written(read, "signs").where("a is not null and o is not null")  # each cell is read once for all regions
    sums = []
    for name, boxes in REGIONS.items():
        a, o = sign_missing(F.col("a"), F.col("bare_a"), "lat", boxes), sign_missing(F.col("o"), F.col("bare_o"), "lon", boxes)
        inside = in_region(F.when(a, -F.abs("a")).otherwise(F.col("a")), F.when(o, -F.abs("o")).otherwise(F.col("o")), name)
        sums.append(F.struct(F.lit(name).alias("region"), F.count_if(inside).alias("inside"), F.sum(a.cast("long") + o.cast("long")).alias("flips")))
    found = read.groupBy(*keys).agg(F.count("*").alias("readable"), F.array(*sums).alias("tried")).where(F.col("readable") >= least)
    bar = F.coalesce(F.get(F.filter("tried", lambda x: x["region"] == chosen), F.lit(0))["inside"], F.lit(0)) if chosen in REGIONS else F.lit(0)
    fit = F.filter("tried", lambda x: (x["region"] != (chosen or "")) & (x["flips"] > 0) & (x["inside"] > bar) & (x["inside"] >= share * F.col("readable")))
    # in order: a better one takes the lead, an equal one ends it
    none = "cast(null as struct<region:string,inside:bigint,flips:bigint>)"
    walk = f"aggregate(fit, named_struct('best', {none}, 'tied', false), (z, x) -> if(z.tied, z, if(z.best is not null and x.inside = z.best.inside, named_struct('best', {none}, 'tied', true), if(z.best is null or x.inside > z.best.inside, named_struct('best', x, 'tied', false), z))))"
    led = found.withColumn("fit", fit).withColumn("best", F.expr(f"{walk}.best")).where("best is not null")
    return led.select(*keys, "best.region", "best.inside", "readable", "best.flips")


def outside_declared(labelled: DataFrame, region: str | None = None, reference: tuple[float, float] | None = None, radius: float = 10.0) -> DataFrame:
    """Points that are ok but lie outside the declared region, with the region they are in (null: none that is known)."""
    lat, lon = F.col("lat"), F.col("lon")
    if region is None and reference is None:
        return labelled.where("false").withColumn("found", F.lit(None).cast("string"))
    inside = in_region(lat, lon, region) if region is not None else F.hypot(lat - reference[0], lon - reference[1]) <= radius
    return labelled.where((F.col("status") == "ok") & ~inside).withColumn("found", identify_region(lat, lon))


def region_check(labelled: DataFrame, *keys: str, region: str | None = None, reference: tuple[float, float] | None = None, radius: float = 10.0) -> DataFrame:
    """Counts of the points outside by the region they are in, and the first row of each; in order of that row."""
    out = outside_declared(labelled, region, reference, radius)
    return out.groupBy(*keys, "found").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


def best_switch(checked: DataFrame, *keys: str) -> DataFrame:
    """The known region that most of the outside points are in; of equals the first met."""
    best = F.max_by(F.struct(F.col("found").alias("region"), "n"), F.struct("n", -F.col("first_row")))
    return checked.where("found is not null").groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def metrics(labelled: DataFrame, *keys: str, region: str | None = None) -> DataFrame:
    """Rows, those in range and in the region, outside of it, likely reversed, and unusable."""
    ok = F.col("status") == "ok"
    inside = ok & in_region(F.col("lat"), F.col("lon"), region) if region else ok
    return labelled.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(inside).alias("inside"), F.count_if(ok & ~inside).alias("outside"),
        F.count_if(F.col("status").startswith("swap_")).alias("swaps"), F.count_if(F.col("status").isin("missing", "out_of_range")).alias("invalid"),
    )
