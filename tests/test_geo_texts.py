import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from coordspark.functions import formatting
from coordspark.sources import geo


def read(spark, reader, text):
    points, notes = reader(spark.createDataFrame([("s", text)], "source_id string, text string"))
    rows, heads = geo.tables(points)
    return heads.first().names if heads.count() else [], [r.cells for r in rows.orderBy("row_id").collect()], {(r.code, r.n) for r in notes.collect()}


TEXTS = ["caf&#233; &#x1F30B; &amp;lt; &quot;", "x <![CDATA[ y & <b>z</b> ]]> tail", "<![CDATA[a]]><![CDATA[b]]>", "one<!-- <name>no</name> -->two", "a\n   b <i>c</i>", "<![CDATA[<!-- kept -->]]>", "&unknown; &#0;"]


@pytest.mark.parametrize("text", TEXTS)
def test_texts_of_elements(spark, text):
    doc = f'<?xml version="1.0"?><k:kml xmlns:k="u"><!-- <Placemark> --><k:Placemark a="&gt;"><k:name>{text}</k:name><ExtendedData><Data name="d&#233;"><value>{text}</value></Data></ExtendedData><k:Point><k:coordinates>\n 1,2 3,4</k:coordinates></k:Point></k:Placemark></k:kml>'
    head, rows, notes = read(spark, geo.kml, doc)
    # what an XML parser gives; references that mean nothing stay here, where a parser refuses
    want = text if text.startswith("&unknown") else " ".join("".join(ET.fromstring(f"<r>{text}</r>").itertext()).split())
    assert (head, rows, notes) == (["Nome", "Latitude", "Longitude", "dé"], [[want, "2", "1", want]], set())


def test_comments_hide_points(spark):
    doc = '<gpx><!-- <wpt lat="9" lon="9"/> --><wpt lat="1" lon="2"><name>A &amp; B</name><extensions><x>1 &lt; 2</x></extensions></wpt></gpx>'
    assert read(spark, geo.gpx, doc) == (["Nome", "Latitude", "Longitude", "x"], [["A & B", "1", "2", "1 < 2"]], set())


VALUES = {"small": 1e-7, "whole": 7.0, "big": 12345678901234567890, "long": 12345678.25, "zero": -0.0, "true": True, "none": None, "text": "007.0", "number": "1e-7", "nested": {"z": [1, 2], "a": "é"}, "least": 5e-324, "huge": 1e300, "third": 1 / 3}


def flat(v):
    if v is None or isinstance(v, str):
        return v or ""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return str(int(v)) if float(v).is_integer() and abs(v) < 1e16 else repr(float(v))
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def test_values_of_geojson(spark):
    feature = lambda g, p: {"type": "Feature", "geometry": g, "properties": p}
    doc = {"type": "FeatureCollection", "features": [feature({"type": "Point", "coordinates": [1e-7, 38.0, 5]}, VALUES), feature({"type": "MultiPoint", "coordinates": [[-9.5, 2], [3, 4]]}, None)]}
    doc["features"] += [feature({"type": "Point", "coordinates": c}, {}) for c in ([], [1], ["1", "2"], [None, 2], [True, 1])] + [feature({"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, {}), feature(None, {})]
    head, rows, notes = read(spark, geo.geojson, "﻿" + json.dumps(doc))
    assert head == ["Latitude", "Longitude", "Altitude", *VALUES]
    assert rows == [["38", "1e-07", "5", *map(flat, VALUES.values())], ["2", "-9.5", "", *[""] * len(VALUES)]]
    assert notes == {("geo_skipped_non_points", 7)}


@pytest.mark.parametrize("value", [0.0, -0.0, 5e-324, 1.7976931348623157e308, 1e-5, 1.5e-5, 9999999999999998.0, 1e16, 0.0001, -1e22, 0.1, 123456.789, 2.2250738585072014e-308])
def test_numbers_read_back(spark, value):
    assert spark.range(1).select(formatting.number_text(F.lit(value)).alias("x")).first().x == repr(value)
