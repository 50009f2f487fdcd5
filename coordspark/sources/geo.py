"""Points of GeoJSON, KML, KMZ and GPX documents as tables of text, in column expressions.

Every reader takes sources (source_id, text) and gives points (source_id, row_id, name, lat,
lon, alt, keys, values, projected) and notes (source_id, code, n). ``tables`` makes rows and
headers of them: the properties in the order in which they are first met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coordspark.functions.formatting import number_text
from coordspark.operators.columns import numbered_repeats
from coordspark.operators.tables import discard, fitted, written
from coordspark.sources import geojson_splits
from coordspark.sources.texts import texts

#: Names of the plain geographic system in the way of 2008, and how another is named.
WGS84_NAMES = ("urn:ogc:def:crs:ogc:1.3:crs84", "urn:ogc:def:crs:ogc::crs84", "urn:ogc:def:crs:epsg::4326", "epsg:4326", "crs84", "ogc:crs84")
EPSG = r"(?i)epsg:*([0-9]{4,6})\s*$"
#: Fixed value: the fields of a GPX point that are read, in order.
GPX_FIELDS = ("name", "cmt", "desc", "sym", "type", "time", "src")
EMPTY = "cast(array() as array<string>)"


def _tag(name: str) -> str:
    """An element in any namespace, its content in a group."""
    return rf"(?s)<(?:[\w.-]+:)?{name}(?:\s[^>]*)?(?<!/)>(.*?)</(?:[\w.-]+:)?{name}\s*>"


def _elements(text: Column, name: str) -> Column:
    return F.regexp_extract_all(text, F.lit(_tag(name)), F.lit(1))


def _whole(text: Column, name: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)(<(?:[\w.-]+:)?{name}(?:\s[^>]*)?(?:/>|>.*?</(?:[\w.-]+:)?{name}\s*>))"), F.lit(1))


def _first(text: Column, name: str) -> Column:
    return F.when(text.rlike(_tag(name)), _plain(F.regexp_extract(text, _tag(name), 1)))


def _attribute(text: Column, name: str) -> Column:
    """An attribute of the first element."""
    return _entities(F.regexp_extract(text, rf"""^[^>]*?\s{name}\s*=\s*["']([^"']*)["']""", 1))


#: The five named references of XML.
NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def _entities(text: Column) -> Column:
    """References replaced, each once; one that means nothing stays."""
    code = lambda t, pattern, base: F.conv(F.regexp_extract(t, pattern, 1), base, 10).cast("int")
    sign = lambda n: F.when(n.between(1, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def one(t: Column) -> Column:
        out = F.when(t.rlike("^&#[xX]"), F.coalesce(sign(code(t, "([0-9A-Fa-f]+);", 16)), t)).when(t.rlike("^&#[0-9]"), F.coalesce(sign(code(t, "([0-9]+);", 10)), t))
        for name, meant in NAMED.items():
            out = out.when(t == name, meant)
        return out.otherwise(t)

    parts = F.regexp_extract_all(text, F.lit("(&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};|&[a-z]+;|[^&]+|&)"), F.lit(1))
    return F.when(text.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def _plain(text: Column) -> Column:
    """An element's text: markup taken out, references replaced, white space single."""
    return F.trim(F.regexp_replace(_entities(F.regexp_replace(text, "<[^>]*>", "")), r"(?U)\s+", " "))


def _simple(text: Column) -> Column:
    """The document as markup and text alone: comments and instructions left out, character data written with references.

    One expression reads them all, so that what looks like one inside another is not taken for it.
    """
    token = r"""(?s)(<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++|<)"""
    raw = lambda t: F.substring(t, F.lit(10), F.length(t) - 12)
    escaped = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    one = lambda t: F.when(t.startswith("<!--") | t.startswith("<?"), "").when(t.startswith("<![CDATA["), escaped(raw(t))).otherwise(t)
    whole = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(token), F.lit(1)), one), "")
    return F.when(text.contains("<!") | text.contains("<?"), whole).otherwise(text)


def kml(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Placemarks with a point, and how many have none."""
    marks = sources.select("source_id", F.posexplode(_elements(_simple(F.col("text")), "Placemark")).alias("pos", "x"))
    at = F.split(F.trim(F.regexp_extract("x", rf"{_tag('Point')}", 1)), "zzz")[0]
    place = F.regexp_extract(F.trim(F.regexp_extract(at, _tag("coordinates"), 1)), r"^\s*(\S+)", 1)
    parts = F.split(place, ",")
    data = F.transform(_whole(F.col("x"), "Data"), lambda d: F.struct(_attribute(d, "name").alias("k"), F.coalesce(_first(d, "value"), F.lit("")).alias("v")))
    simple = F.transform(_whole(F.col("x"), "SimpleData"), lambda d: F.struct(_attribute(d, "name").alias("k"), F.coalesce(_first(d, "SimpleData"), F.lit("")).alias("v")))
    props = F.concat(data, simple)
    text = _first(F.col("x"), "description")
    named = F.exists(props, lambda p: p["k"] == "description")
    props = F.when(text.isNotNull() & ~named, F.concat(props, F.array(F.struct(F.lit("description").alias("k"), text.alias("v"))))).otherwise(props)
    name = _first(F.regexp_replace("x", r"(?s)<(?:[\w.-]+:)?(?:ExtendedData|Point|MultiGeometry)\b.*", ""), "name")
    read = marks.select("source_id", "pos", name.alias("name"), F.get(parts, F.lit(1)).alias("lat"), F.get(parts, F.lit(0)).alias("lon"), F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("alt"), props.alias("props"), F.coalesce((F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != ""), F.lit(False)).alias("point"))
    return _points(read), _notes(read, "geo_skipped_non_points")


def gpx(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Way points; where a file has none its route points, and else its track points."""
    sources = sources.select("source_id", _simple(F.col("text")).alias("text"))
    text = F.col("text")
    kinds = {k: _whole(text, k) for k in ("wpt", "rtept", "trkpt")}
    size = sources.select("source_id", *(v.alias(k) for k, v in kinds.items()))
    chosen = F.when(F.size("wpt") > 0, F.col("wpt")).when(F.size("rtept") > 0, F.col("rtept")).otherwise(F.col("trkpt"))
    each = size.select("source_id", F.posexplode(chosen).alias("pos", "x"))
    leaves = F.regexp_extract_all(F.regexp_extract("x", _tag("extensions"), 1), F.lit(r"(?s)(<(?:[\w.-]+:)?[\w.-]+(?:\s[^>]*)?>[^<]*</)"), F.lit(1))
    more = F.transform(leaves, lambda e: F.struct(F.regexp_extract(e, r"^<(?:[\w.-]+:)?([\w.-]+)", 1).alias("k"), _entities(F.trim(F.regexp_extract(e, r"(?s)>([^<]*)</$", 1))).alias("v")))
    body = F.regexp_replace("x", r"(?s)<(?:[\w.-]+:)?extensions.*?</(?:[\w.-]+:)?extensions\s*>", "")
    own = F.filter(F.array(*(F.struct(F.lit(f).alias("k"), _first(body, f).alias("v")) for f in GPX_FIELDS[1:])), lambda p: p["v"].isNotNull())
    read = each.select("source_id", "pos", _first(body, "name").alias("name"), _attribute(F.col("x"), "lat").alias("lat"), _attribute(F.col("x"), "lon").alias("lon"), F.coalesce(_first(body, "ele"), F.lit("")).alias("alt"), F.concat(own, more).alias("props"))
    read = read.withColumn("point", (F.col("lat") != "") & (F.col("lon") != ""))
    note = F.when((F.size("wpt") > 0) & (F.size("trkpt") > 0), F.struct(F.lit("gpx_ignored_tracks").alias("code"), F.size("trkpt").cast("long").alias("n"))).when((F.size("wpt") == 0) & (F.size("rtept") > 0), F.struct(F.lit("gpx_from_route").alias("code"), F.size("rtept").cast("long").alias("n"))).when((F.size("wpt") == 0) & (F.size("trkpt") > 0), F.struct(F.lit("gpx_from_track").alias("code"), F.size("trkpt").cast("long").alias("n")))
    kinds_ = size.select("source_id", note.alias("note")).where("note is not null").select("source_id", "note.code", "note.n")
    return _points(read), kinds_.unionAll(_notes(read, "geo_skipped_without_place"))


def _number(value: Column) -> Column:
    """A JSON number as text: whole ones below 1e16 without a point, others as short as they read back."""
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e16), value.cast("long").cast("string")).otherwise(number_text(value))


def _json_text(text: Column, value: Column) -> Column:
    """A JSON value as text, by its kind: strings as they are, null as empty, objects and arrays as compact JSON."""
    return F.when(F.schema_of_variant(value) == "VOID", "").when(_numeric(value), _number(text.try_cast("double"))).otherwise(F.coalesce(text, F.lit("")))


def _numeric(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _place(coordinates: Column, k: int) -> Column:
    """A number of a position; null for anything else."""
    value = F.get(coordinates, F.lit(k))
    return F.when(_numeric(value), F.variant_get(value, "$", "double"))


def _collection(text: Column) -> Column:
    return F.from_json(text, "type string, features array<string>, crs string")


def geojson(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The points of a collection, a feature or a bare geometry; of several points the first; the rest is counted. A declared system is a note."""
    text = F.regexp_replace("text", "^﻿", "")
    doc = sources.select("source_id", text.alias("text"), _collection(text).alias("d"))
    whole = F.when(F.col("d.type") == "FeatureCollection", F.coalesce("d.features", F.expr(EMPTY))).otherwise(F.array("text"))
    read = _features(doc.select("source_id", F.col("d.crs").alias("crs"), F.posexplode(whole).alias("pos", "x")))
    declared = read.where("code <> ''").select("source_id", "code").distinct()
    return _points(read), _notes(read, "geo_skipped_non_points").unionAll(_declared(declared))


def _declared(codes: DataFrame) -> DataFrame:
    return codes.select("source_id", F.concat(F.lit("geojson_crs:EPSG:"), "code").alias("code"), F.lit(1).cast("long").alias("n"))


def _features(each: DataFrame) -> DataFrame:
    """Features (crs, x and others) read: name, lat, lon, alt, props, whether it is a point, and the code of another system than the plain one."""
    others = [c for c in each.columns if c not in ("crs", "x")]
    each = each.withColumn("f", F.from_json("x", "type string, id string, geometry string, properties string"))
    geometry = F.when(F.col("f.type") == "Feature", F.col("f.geometry")).otherwise(F.col("x"))
    each = each.withColumn("g", F.from_json(geometry, "type string, coordinates string"))
    place = F.when(F.col("g.type") == "Point", F.from_json("g.coordinates", "array<variant>")).when(F.col("g.type") == "MultiPoint", F.get(F.from_json("g.coordinates", "array<array<variant>>"), F.lit(0)))
    crs_name = F.get_json_object("crs", "$.properties.name")
    code = F.when(F.lower(crs_name).isin(*WGS84_NAMES), "").otherwise(F.regexp_extract(crs_name, EPSG, 1))
    keys = F.coalesce(F.json_object_keys("f.properties"), F.expr(EMPTY))
    values, typed = F.from_json("f.properties", "map<string,string>"), F.from_json("f.properties", "map<string,variant>")
    # columns of their own on the way: what follows names each many times, and the plan reads it once
    each = each.withColumns({"keys": keys, "values": values, "typed": typed, "code": F.coalesce(code, F.lit("")), "place": place})
    each = each.withColumns({f"at{k}": _place(F.col("place"), k) for k in range(3)})
    each = each.withColumns({n: _number(F.col(f"at{k}")) for k, n in enumerate(("lon", "lat", "alt"))})
    props = F.transform("keys", lambda k: F.struct(k.alias("k"), _json_text(F.element_at("values", k), F.element_at("typed", k)).alias("v")))
    own = F.when(F.col("f.id").isNotNull() & (F.col("f.type") == "Feature"), F.array(F.struct(F.lit("id").alias("k"), F.col("f.id").alias("v")))).otherwise(F.expr("cast(array() as array<struct<k:string,v:string>>)"))
    read = each.select(*others, F.lit(None).cast("string").alias("name"), "lat", "lon", F.coalesce("alt", F.lit("")).alias("alt"), F.concat(own, props).alias("props"), (F.col("lon").isNotNull() & F.col("lat").isNotNull()).alias("point"), "code")
    return read.withColumn("projected", F.col("code") != "")


def geojson_files(spark: SparkSession, path: str | list[str], parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Points and notes as of ``geojson``, of files that are read in splits; with ``parts`` a folder's files are one document.

    Points are numbered by the counts of the splits before theirs, so no file is ordered as a
    whole. Files that can't be read (see ``geojson_splits.features``) are notes.
    """
    found, frames, problems = geojson_splits.features(spark, path, parts=parts)
    frames = written(frames.withColumn("d", _collection(F.col("text"))).select("source_id", "d.crs", F.col("d.type").eqNullSafe("FeatureCollection").alias("many"), F.col("text").alias("x")), "geojson-frames")
    tops = frames.where("many").select("source_id", "crs")
    alone = frames.where("not many").select("source_id", "crs", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("nth"), "x")
    each = found.join(fitted(tops), "source_id").select("source_id", "crs", "at", "nth", "x").unionAll(alone)
    read, problems = written(_features(each), "geojson-read"), written(problems, "geojson-problems")
    discard(found, frames)
    split, file = ["source_id", "at"], Window.partitionBy("source_id").orderBy("at")
    counts = read.where("point").groupBy(*split).agg(F.count("*").alias("n"))
    starts = counts.select(*split, (F.sum("n").over(file) - F.col("n")).alias("start"))  # a row for each split
    nth = F.row_number().over(Window.partitionBy(*split).orderBy("nth")).cast("long") - 1
    good = read.where("point").withColumn("row", nth).join(fitted(starts), split)
    points = good.select("source_id", (F.col("start") + F.col("row")).alias("row_id"), "name", "lat", "lon", "alt", "props", "projected")
    declared = read.where("code <> ''").select("source_id", "code").distinct()
    return points, _notes(read, "geo_skipped_non_points").unionAll(_declared(declared)).unionAll(problems)


def _points(read: DataFrame) -> DataFrame:
    """The rows that are points, numbered in order within their source."""
    order = F.row_number().over(Window.partitionBy("source_id").orderBy("pos")).cast("long") - 1
    projected = F.col("projected") if "projected" in read.columns else F.lit(False)
    return read.where("point").select("source_id", order.alias("row_id"), "name", "lat", "lon", "alt", "props", projected.alias("projected"))


def _notes(read: DataFrame, code: str) -> DataFrame:
    return read.where("not point").groupBy("source_id").agg(F.count("*").alias("n")).select("source_id", F.lit(code).alias("code"), "n")


def tables(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and headers: a name if any point has one, the place, a height if any is worth keeping, then the properties as first met."""
    high = (F.col("alt") != "") & F.coalesce(F.col("alt").try_cast("double") != 0, F.lit(True))
    kinds = points.groupBy("source_id").agg(F.max(F.coalesce(F.col("name"), F.lit("")) != "").alias("named"), F.max(high).alias("high"), F.max("projected").alias("projected"))
    met = points.select("source_id", "row_id", F.posexplode("props").alias("k", "p")).groupBy("source_id", F.col("p.k").alias("key")).agg(F.min(F.struct("row_id", "k")).alias("first"))
    keys = met.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "key"))), lambda x: x["key"]).alias("keys"))  # a row for each column
    # written: rows and headers both read it, and its size is asked
    head = written(kinds.join(keys, "source_id", "left").withColumn("keys", F.coalesce("keys", F.expr(EMPTY))), "geo-heads")
    only = lambda flag, *names: F.when(F.col(flag), F.array(*names)).otherwise(F.expr(EMPTY))
    place = F.when(F.col("projected"), F.array(F.lit("Y"), F.lit("X"))).otherwise(F.array(F.lit("Latitude"), F.lit("Longitude")))
    names = F.concat(only("named", F.lit("Nome")), place, only("high", F.lit("Altitude")), F.col("keys"))
    value = lambda k: F.coalesce(F.get(F.filter("props", lambda p: p["k"] == k), F.lit(0))["v"], F.lit(""))
    cells = F.concat(only("named", F.coalesce("name", F.lit(""))), F.array("lat", "lon"), only("high", F.col("alt")), F.transform("keys", value))
    rows = points.drop("projected").join(fitted(head), "source_id").select("source_id", "row_id", cells.alias("cells"))
    return rows, head.select("source_id", numbered_repeats(names).alias("names"))


READERS = {".kml": kml, ".kmz": kml, ".gpx": gpx, ".geojson": geojson, ".json": geojson}


def is_geospatial(name: str) -> bool:
    return any(name.lower().endswith(e) for e in READERS)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, headers and notes of files of one kind, told by the end of their name."""
    kind = next((e for e in READERS if path.lower().endswith(e)), None)
    if kind is None:
        raise ValueError(f"not a geospatial file: {path}")
    points, notes = READERS[kind](texts(spark, path))
    return *tables(points), notes
