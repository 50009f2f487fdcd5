"""Which two columns of a table hold the coordinates: by their names, else by what their values look like.

Tables are rows (source_id, row_id, cells) with a header (source_id, names); all sources are
one job. Scores are aggregates by source and column; each source's decision is array
functions over its columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordspark.functions.parse import blank, looks_angular, parse_coordinate
from coordspark.operators.quantiles import at_ranks, upper_median
from coordspark.operators.regions import REGIONS
from coordspark.operators.tables import written

#: Names of latitudes and longitudes in the order tried, and of a grid's northings and eastings.
LAT_NAMES = ("latitude", "lat", "coordenadas x", "latitude x", "coord_lat", "lat_dms", "lat_gms", "y", "y_dd", "lat_y")
LON_NAMES = ("longitude", "lon", "long", "coordenadas y", "longitude y", "coord_lon", "lon_dms", "lon_gms", "x", "x_dd", "lon_x")
GRID_LAT_NAMES, GRID_LON_NAMES = ("northing", "y", "p"), ("easting", "x", "m")
#: Fixed value: a unit that may follow a name.
UNIT = r"""(?i)\s*[(\[]\s*(?:m|km|metros|metres|meters|graus|deg|degrees|gms|dms|dd|[°º'"′″\s]+)\s*[)\]]\s*$"""
#: The least values of a column and the share that must parse; no angle is larger.
LEAST_VALUES, LEAST_RATE, MOST_DEGREES = 3, 0.6, 180.0


def header_names(cells: DataFrame) -> DataFrame:
    """The names of header cells (source_id, pos, cell), by position from 0: empty ones are numbered, repeats get .1, .2, ..."""
    named = cells.withColumn("name", F.when(F.coalesce("cell", F.lit("")) == "", F.concat(F.lit("Unnamed: "), F.col("pos"))).otherwise(F.col("cell")))
    again = F.row_number().over(Window.partitionBy("source_id", "name").orderBy("pos")) - 1
    return named.select("source_id", "pos", F.when(again > 0, F.concat("name", F.lit("."), again)).otherwise(F.col("name")).alias("name"))


def numbered_repeats(names: Column) -> Column:
    """Names with .1, .2, ... after those met before."""
    before = lambda x, i: F.size(F.filter(F.slice(names, F.lit(1), i), lambda y: y == x))
    return F.transform(names, lambda x, i: F.when(before(x, i) > 0, F.concat(x, F.lit("."), before(x, i))).otherwise(x))


def named_array(cells: Column) -> Column:
    """The names of one header's cells as an array."""
    return numbered_repeats(F.transform(cells, lambda x, i: F.when(F.coalesce(x, F.lit("")) == "", F.concat(F.lit("Unnamed: "), i)).otherwise(x)))


def column_key(name: Column) -> Column:
    """A name in lower case without its unit."""
    return F.lower(F.trim(F.regexp_replace(name, UNIT, "")))


def named_column(names: Column, candidates: tuple[str, ...]) -> Column:
    """Place from 0 of the first column that the first possible candidate names, or null."""
    keys = F.transform(names, column_key)
    return F.coalesce(*(F.nullif(F.array_position(keys, c), F.lit(0).cast("long")) for c in candidates)) - 1


def scores(tables: DataFrame) -> DataFrame:
    """How much each column looks like coordinates: source_id, i, score, median (of magnitudes, the upper of the middle two)."""
    cells = tables.select("source_id", F.posexplode("cells").alias("i", "cell")).where(~blank(F.col("cell")))
    # each cell is read once for all that follows
    read = written(cells.select("source_id", "i", looks_angular(F.col("cell")).alias("angular"), parse_coordinate(F.col("cell")).alias("p")), "column-cells")
    size = F.abs("p")
    found = read.groupBy("source_id", "i").agg(
        F.count("*").alias("seen"), F.count("p").alias("good"), F.count_if("angular").alias("angular"),
        F.count_if(F.col("p") == F.floor("p")).alias("whole"), F.max(size).alias("most"),
    ).where((F.col("seen") >= LEAST_VALUES) & (F.col("good") > 0) & (F.col("good") >= LEAST_RATE * F.col("seen")))
    rate = F.col("good") / F.col("seen")
    kind = F.when(F.col("angular") / F.col("seen") > 0.5, 1.0).when(F.col("whole") == F.col("good"), -0.5).otherwise(0.0)
    score = rate + kind - F.when(F.col("most") > MOST_DEGREES, 1.0).otherwise(0.0)
    middle = at_ranks(read.select("source_id", "i", size.alias("v")), ["source_id", "i"], upper_median)
    return found.select("source_id", "i", score.alias("score")).join(middle.select("source_id", "i", F.get("at", F.lit(0)).alias("median")), ["source_id", "i"])


def _span(region: str, axis: str) -> tuple[float, float]:
    """The magnitudes a region's boxes admit on an axis."""
    sides = [(b[0], b[1]) if axis == "lat" else (b[2], b[3]) for b in REGIONS[region]]
    return min(0.0 if a <= 0 <= b else min(abs(a), abs(b)) for a, b in sides), max(max(abs(a), abs(b)) for a, b in sides)


def guess_coordinate_columns(tables: DataFrame, headers: DataFrame, region: str | None = None, projected: bool = False) -> DataFrame:
    """Each source's two columns: source_id, lat_col, lon_col, from 0. In a grid the northing and the easting take those places."""
    lat_names, lon_names = (GRID_LAT_NAMES + LAT_NAMES, GRID_LON_NAMES + LON_NAMES) if projected else (LAT_NAMES, LON_NAMES)
    measured = scores(tables).where("score > 0").groupBy("source_id").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "i", "median")).alias("m"))  # a row for each column
    found = headers.join(measured, "source_id", "left").withColumn("m", F.array_sort(F.coalesce("m", F.expr("cast(array() as array<struct<s:double,i:int,median:double>>)"))))
    spans = {axis: _span(region, axis) for axis in ("lat", "lon")} if region else {}
    within = lambda x, axis: x.between(*spans[axis])
    found = found.withColumn("fit", F.filter("m", lambda x: within(x["median"], "lat") | within(x["median"], "lon")) if region else F.col("m"))
    found = found.withColumn("told", (F.size("fit") >= 2) & F.lit(region is not None)).withColumn("top", F.slice(F.when(F.size("fit") >= 2, F.col("fit")).otherwise(F.col("m")), 1, 2))
    pair = F.array_sort(F.transform("top", lambda x: F.struct(x["i"].alias("i"), x["median"].alias("median"))))
    found = found.withColumn("pair", pair).withColumns({"a": F.get("pair", F.lit(0)), "b": F.get("pair", F.lit(1))})
    med = lambda c: F.col(f"{c}.median")
    straight, turned = F.lit(False), (med("a") > 90) & (med("b") <= 90)
    if region:
        one = within(med("a"), "lat") & within(med("b"), "lon")
        other = within(med("b"), "lat") & within(med("a"), "lon")
        straight, turned = F.col("told") & one & ~other, F.when(F.col("told") & (one != other), other).otherwise(turned)
    by_lat, by_lon = named_column(F.col("names"), lat_names), named_column(F.col("names"), lon_names)
    found = found.withColumns({"by_lat": by_lat, "by_lon": by_lon})
    named = F.col("by_lat").isNotNull() & F.col("by_lon").isNotNull() & (F.col("by_lat") != F.col("by_lon"))
    two = F.size("top") == 2
    turned = turned & ~straight
    lat = F.when(named, F.col("by_lat")).when(two, F.when(turned, F.col("b.i")).otherwise(F.col("a.i"))).otherwise(F.coalesce("by_lat", F.lit(0)))
    lon = F.when(named, F.col("by_lon")).when(two, F.when(turned, F.col("a.i")).otherwise(F.col("b.i"))).otherwise(F.coalesce("by_lon", F.when(F.size("names") > 1, 1).otherwise(0)))
    return found.select("source_id", lat.cast("int").alias("lat_col"), lon.cast("int").alias("lon_col"))


#: Words in the names of columns that label a point.
LABELS = ("nome", "name", "local", "lugar", "sitio", "amostra", "sample", "referencia", "ref", "ponto", "point", "estacao", "station", "id", "codigo", "obra")


def label_column(tables: DataFrame, headers: DataFrame) -> DataFrame:
    """Each source's first column of texts that is named like a place or a sample, else its first column of texts: source_id, label_col.

    A column is of texts if at least seven in ten of its values are neither numbers nor dates and they aren't all the same.
    """
    cells = tables.select("source_id", F.posexplode("cells").alias("i", "cell")).where(~blank(F.col("cell")))
    plain = F.col("cell").rlike(r"^\s*[-+]?[0-9][0-9.,\s]*$|^\s*[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}")
    texty = cells.groupBy("source_id", "i").agg(F.count("*").alias("n"), F.count_if(~plain).alias("t"), F.min("cell").alias("lo"), F.max("cell").alias("hi"))
    texty = texty.where("t >= 0.7 * n and lo <> hi").groupBy("source_id").agg(F.sort_array(F.collect_list("i")).alias("at"))
    key = lambda x: F.translate(F.lower(x), "áàâãéêíóôõúç", "aaaaeeiooouc")
    like = lambda x: reduce(Column.__or__, (F.split(key(x), "[^a-z]+")[0] == w for w in LABELS))
    found = headers.join(texty, "source_id").withColumn("named", F.filter("at", lambda i: like(F.get(F.col("names"), i))))
    return found.select("source_id", F.coalesce(F.get("named", F.lit(0)), F.get("at", F.lit(0))).alias("label_col"))


def cell(place: str) -> Column:
    """The cell of a row at the place that another column holds."""
    return F.get(F.col("cells"), F.col(place))
