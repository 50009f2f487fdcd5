"""CSV, GeoJSON, KML and GPX as tables of lines: source_id, pos, line.

Each feature is one line, made by column expressions; a document's head and foot are lines too.
``write`` puts a source's lines in order into one file; ``write_parts`` puts them into files that
are the document when they are joined in the order of their names, so that a large source is many
tasks' work; ``write_lines`` keeps features alone, as lines of as many files as there are tasks.
All write by Spark's own commit: what a failed task or job wrote is never seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordspark.functions import formatting
from coordspark.operators.tables import compiled, fitted

HEAD, FOOT = -1, 1 << 62
METADATA = list[tuple[str, str]]


def _framed(rows: DataFrame, line: Column, head: str, foot: str) -> DataFrame:
    """Lines of rows (source_id, row_id) between each source's head and foot."""
    lines = rows.select("source_id", F.col("row_id").alias("pos"), line.alias("line"))
    sources = rows.select("source_id").distinct()
    ends = sources.select("source_id", F.explode(F.array(F.struct(F.lit(HEAD).cast("long").alias("pos"), F.lit(head).alias("line")), F.struct(F.lit(FOOT).alias("pos"), F.lit(foot).alias("line")))).alias("e"))
    return lines.unionAll(ends.select("source_id", "e.pos", "e.line"))


def _attributes(rows: DataFrame, lat: str, lon: str) -> list[str]:
    return [c for c in rows.columns if c not in ("source_id", "row_id", lat, lon)]


def _text(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def _json(name: str, kind: str) -> Column:
    """A value as JSON; numbers that aren't finite are null."""
    value = F.col(f"`{name}`")
    if kind in ("double", "float"):
        return F.coalesce(formatting.number_text(value.cast("double")), F.lit("null"))
    if kind in ("int", "bigint", "smallint", "tinyint", "boolean"):
        return F.coalesce(value.cast("string"), F.lit("null"))
    return F.coalesce(_json_string(_text(name)), F.lit("null"))


def _json_string(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1) if text is not None else text


def geojson(rows: DataFrame, metadata: METADATA | None = None, lat: str = "Latitude_DD", lon: str = "Longitude_DD") -> DataFrame:
    """A compact collection; properties in the order of the columns."""
    kinds = dict(rows.dtypes)
    pairs = []
    for k, c in enumerate(_attributes(rows, lat, lon)):
        value = F.when(F.col(f"`{c}`").isNull(), "null").otherwise(_json(c, kinds[c]))
        pairs.append(F.concat(F.lit(("," if k else "") + _literal(c) + ":"), value))
    props = F.concat(F.lit("{"), *pairs, F.lit("}"))
    place = F.concat(F.lit('"geometry":{"type":"Point","coordinates":['), formatting.number_text(F.col(lon)), F.lit(","), formatting.number_text(F.col(lat)), F.lit("]}"))
    # a row for each source, met by its rows: no source is ordered for its first row
    firsts = fitted(rows.groupBy("source_id").agg(F.min("row_id").alias("first_row")))
    rows = rows.join(firsts, "source_id")
    line = F.concat(F.when(F.col("row_id") == F.col("first_row"), "").otherwise(","), F.lit('{"type":"Feature",'), place, F.lit(',"properties":'), props, F.lit("}"))
    told = "" if not metadata else '"metadata":{' + ",".join(f"{_literal(a)}:{_literal(b)}" for a, b in metadata) + "},"
    return _framed(rows, line, '{"type":"FeatureCollection",' + told + '"features":[', "]}")


def _literal(text: str) -> str:
    import json

    return json.dumps(text, ensure_ascii=False)


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def kml(rows: DataFrame, name: str | None = None, metadata: METADATA | None = None, lat: str = "Latitude_DD", lon: str = "Longitude_DD") -> DataFrame:
    """Placemarks with their data; null properties are left out."""
    data = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f'<Data name="{_escaped(c)}"><value>'), formatting.xml_text(_text(c)), F.lit("</value></Data>"))) for c in _attributes(rows, lat, lon)]
    title = F.concat(F.lit("<name>"), formatting.xml_text(_text(name)), F.lit("</name>")) if name else F.lit(None).cast("string")
    place = F.concat(F.lit("<Point><coordinates>"), formatting.number_text(F.col(lon)), F.lit(","), formatting.number_text(F.col(lat)), F.lit(",0</coordinates></Point>"))
    line = F.concat(F.lit("<Placemark>"), F.coalesce(title, F.lit("")), F.lit("<ExtendedData>"), F.concat_ws("", *data), F.lit("</ExtendedData>"), place, F.lit("</Placemark>"))
    told = "".join(f'<Data name="{_escaped(a)}"><value>{_escaped(b)}</value></Data>' for a, b in metadata or ())
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>' + (f"<ExtendedData>{told}</ExtendedData>" if told else "")
    return _framed(rows, line, head, "</Document></kml>")


def gpx(rows: DataFrame, name: str | None = None, metadata: METADATA | None = None, lat: str = "Latitude_DD", lon: str = "Longitude_DD") -> DataFrame:
    """Way points with plain decimals and a name."""
    title = F.coalesce(F.concat(F.lit("<name>"), formatting.xml_text(_text(name)), F.lit("</name>")), F.lit("")) if name else F.lit("")
    line = F.concat(F.lit('<wpt lat="'), formatting.gpx_number(F.col(lat)), F.lit('" lon="'), formatting.gpx_number(F.col(lon)), F.lit('">'), title, F.lit("</wpt>"))
    told = "" if not metadata else "<metadata><desc>" + _escaped("\n".join(f"{a}: {b}" for a, b in metadata)) + "</desc></metadata>"
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="coordspark" xmlns="http://www.topografix.com/GPX/1/1">' + told
    return _framed(rows, line, head, "</gpx>")


def csv(rows: DataFrame, separator: str = ",") -> DataFrame:
    """All rows under a header that begins with a byte order mark; cells that a spreadsheet would run are guarded."""
    columns = [c for c in rows.columns if c not in ("source_id", "row_id")]
    kinds = dict(rows.dtypes)

    def cell(c: str) -> Column:
        text = formatting.number_text(F.col(f"`{c}`")) if kinds[c] == "double" else _text(c)
        guarded = formatting.csv_safe(text) if kinds[c] == "string" else text
        quoted = F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(F.when(guarded.rlike(f'[{separator}"\r\n]'), quoted).otherwise(guarded), F.lit(""))

    line = F.concat_ws(separator, *map(cell, columns))
    quote = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in (separator, '"', "\n", "\r")) else c
    framed = _framed(rows, line, "﻿" + separator.join(map(quote, columns)), "")
    return framed.where(F.col("pos") != FOOT)


def write(lines: DataFrame, folder: str) -> None:
    """A folder for each source with one text file: a document has one root, so one task writes it."""
    lines.repartition("source_id").sortWithinPartitions("source_id", "pos").select("source_id", F.col("line").alias("value")).write.partitionBy("source_id").text(folder)


def write_parts(lines: DataFrame, folder: str, parts: int | None = None) -> None:
    """A folder for each source, whose files in the order of their names are the document.

    Lines are dealt out by ranges of source and position that sampling makes even, so a source
    that holds most rows has most of the files; a small one has one file, or two where a range
    ends in it. Names number the files up to a hundred thousand tasks.
    """
    by = ("source_id", "pos")
    ranged = lines.repartitionByRange(parts, *by) if parts else lines.repartitionByRange(*by)
    with compiled(lines.sparkSession):
        ranged.sortWithinPartitions(*by).select("source_id", F.col("line").alias("value")).write.partitionBy("source_id").text(folder)


def write_lines(lines: DataFrame, folder: str) -> None:
    """Features as lines in as many files as there are tasks, without heads and feet."""
    features = lines.where((F.col("pos") != HEAD) & (F.col("pos") != FOOT))
    features.select("source_id", F.regexp_replace("line", "^,", "").alias("value")).write.partitionBy("source_id").text(folder)
