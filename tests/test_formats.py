import zipfile

import pytest
from pyspark.sql import functions as F

from coordspark.functions import crs, names, parse
from coordspark.operators import columns, convert, regions, sheets, swaps, tidy
from coordspark.sinks import binary, documents
from coordspark.sources import csv, excel, geo


def source(spark, *texts):
    return spark.createDataFrame([(f"s{k}", t) for k, t in enumerate(texts)], "source_id string, text string")


def cells(rows):
    return [r.cells for r in rows.orderBy("source_id", "row_id").collect()]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('nome;lat;lon;lat;\n"A ""x"";\ny";38,5;-9,1;z\nB;38,6\n\nC;1;2;3;4;5\n;;;\n'.encode("cp1252"))
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbfn,\xc3\xa9\n1,2\n")
    (tmp_path / "c.csv").write_bytes("é\tb\n€\t2\n".encode("cp1252"))
    (tmp_path / "d.csv").write_bytes("x|y\n1|2\n".encode("utf-16"))
    rows, heads = csv.read(spark, str(tmp_path))
    assert cells(rows) == [['A "x";\ny', "38,5", "-9,1", "z", ""], ["B", "38,6", "", "", ""], ["C", "1", "2", "3", "4"], ["1", "2"], ["€", "2"], ["1", "2"]]
    assert [r.names for r in heads.orderBy("source_id").collect()] == [["nome", "lat", "lon", "lat.1", "Unnamed: 4"], ["n", "é"], ["é", "b"], ["x", "y"]]
    assert csv.read_texts(source(spark))[0].count() == 0


KML = """<kml xmlns="x"><Document><Folder><Placemark><name>P &amp; Q</name><description><![CDATA[d<b>]]></description><ExtendedData><Data name="a"><value>1</value></Data></ExtendedData>
<Point><coordinates> -9.1,38.5,10 </coordinates></Point></Placemark></Folder><Placemark><LineString><coordinates>1,2</coordinates></LineString></Placemark>
<Placemark><MultiGeometry><Point><coordinates>1,2</coordinates></Point></MultiGeometry></Placemark></Document></kml>"""
GPX = '<gpx><wpt lat="1" lon="2"><ele>0</ele><name>w</name><extensions><o:z>9</o:z></extensions></wpt><trk><trkseg><trkpt lat="5" lon="6"/></trkseg></trk></gpx>'
JSON = '{"type":"FeatureCollection","crs":{"properties":{"name":"urn:ogc:def:crs:EPSG::3763"}},"features":[{"type":"Feature","id":7,"geometry":{"type":"Point","coordinates":[1.5,2.0]},"properties":{"z":1.0,"a":"x","b":true}},{"type":"Feature","geometry":null,"properties":{}}]}'


@pytest.mark.parametrize(
    "reader, text, head, rows, notes",
    [
        (geo.kml, KML, ["Nome", "Latitude", "Longitude", "Altitude", "a", "description"], [["P & Q", "38.5", "-9.1", "10", "1", "d<b>"], ["", "2", "1", "", "", ""]], {("geo_skipped_non_points", 1)}),
        (geo.gpx, GPX, ["Nome", "Latitude", "Longitude", "z"], [["w", "1", "2", "9"]], {("gpx_ignored_tracks", 1)}),
        (geo.gpx, GPX.replace("wpt", "x"), ["Latitude", "Longitude"], [["5", "6"]], {("gpx_from_track", 1)}),
        (geo.geojson, JSON, ["Y", "X", "id", "z", "a", "b"], [["2", "1.5", "7", "1", "x", "true"]], {("geo_skipped_non_points", 1), ("geojson_crs:EPSG:3763", 1)}),
    ],
)
def test_geo(spark, reader, text, head, rows, notes):
    found, told = reader(source(spark, text))
    data, tops = geo.tables(found)
    assert tops.first().names == head and cells(data) == rows
    assert {(r.code, r.n) for r in told.collect()} == notes


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", 0, "a<b", 1, 38.5, -9.0), ("s", 1, None, None, 1e-5, -9.25), ("t", 0, '=q"', 3, 1.0, 2.0)], "source_id string, row_id long, nome string, n int, Latitude_DD double, Longitude_DD double")
    text = lambda d, s: "".join(r.line for r in d.where(F.col("source_id") == s).orderBy("pos").collect())
    assert text(documents.geojson(df, [("a", "b")]), "s") == '{"type":"FeatureCollection","metadata":{"a":"b"},"features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[-9.0,38.5]},"properties":{"nome":"a<b","n":1}},{"type":"Feature","geometry":{"type":"Point","coordinates":[-9.25,1e-05]},"properties":{"nome":null,"n":null}}]}'
    assert text(documents.gpx(df, "nome"), "s").endswith('<wpt lat="38.5" lon="-9"><name>a&lt;b</name></wpt><wpt lat="0.00001" lon="-9.25"></wpt></gpx>')
    assert '<Data name="n"><value>3</value></Data>' in text(documents.kml(df, "nome"), "t")
    assert text(documents.csv(df), "t").endswith('''"'=q""",3,1.0,2.0''')
    again, _ = geo.kml(df.sparkSession.createDataFrame([("k", text(documents.kml(df, "nome"), "s"))], "source_id string, text string"))
    assert [(r.lat, r.lon) for r in again.orderBy("row_id").collect()] == [("38.5", "-9.0"), ("1e-05", "-9.25")]
    binary.workbooks(df, f"file://{tmp_path}/x", [("k", "v")]).collect()
    rows, heads = excel.read(spark, str(tmp_path / "x"))
    assert cells(rows) == [["a<b", "1", "38.5", "-9"], ["", "", "1e-05", "-9.25"], ['=q"', "3", "1", "2"]]
    assert heads.first().names == ["nome", "n", "Latitude_DD", "Longitude_DD"]
    path = binary.shapefiles(df, str(tmp_path / "shp"), [("a", "b")]).where("source_id = 's'").first().path
    with zipfile.ZipFile(path) as z:
        shp, dbf = z.read("s.shp"), z.read("s.dbf")
        assert len(shp) == 100 + 2 * 28 and int.from_bytes(shp[24:28], "big") * 2 == len(shp) and dbf[4] == 2 and b"a<b" in dbf
        assert sorted(z.namelist()) == ["s.cpg", "s.dbf", "s.prj", "s.shp", "s.shx", "s.txt"]


def test_tidy_and_guess(spark):
    t = [("a", 1, [None, "Aldeia", "38° 1' 2\"", "-8,5", "3"]), ("a", 2, [None, "Vila", "38° 2' 2\"", "-8,6", "4"]), ("a", 3, ["", "Z", "39° 1'", "-8,7", "5"])]
    t += [("b", 1, ["Ilha", None, None, None]), ("b", 2, ["Nome", "Latitude", "", ""]), ("b", 3, ["x", "32", "47", "35.3"]), ("b", 4, ["y", "32", "48", "36.3"])]
    t += [("c", 1, [None, "M", "P"]), ("c", 2, ["7", "1.5", "2.5"]), ("c", 3, ["8", "1.6", "2.6"])]
    heads = [("a", ["Unnamed: 0", "Local", "A", "B", "N"]), ("b", [f"Unnamed: {k}" for k in range(4)]), ("c", ["Data", "COORDENADAS", "Unnamed: 2"])]
    rows, names_ = tidy.tidy(spark.createDataFrame(t, "source_id string, row_id long, cells array<string>"), spark.createDataFrame(heads, "source_id string, names array<string>"))
    assert {r.source_id: r.names for r in names_.collect()} == {"a": ["Local", "A", "B", "N"], "b": ["Nome", "Latitude"], "c": ["Data", "M", "P"]}
    assert cells(rows.where("source_id = 'b'")) == [["x", "32° 47' 35.3\""], ["y", "32° 48' 36.3\""]]
    found = {r.source_id: (r.lat_col, r.lon_col) for r in columns.guess_coordinate_columns(rows, names_, projected=True).collect()}
    assert found["a"] == (1, 2) and found["c"] == (2, 1)


def test_convert_and_review(spark):
    data = [(k, "f", f"{38 + k % 7 * 0.1:.1f}", f"{-9 + k % 5 * 0.1:.1f}") for k in range(30)] + [(30, "f", "-9.1", "38.7"), (31, "f", "x", "1")]
    out = convert.convert(spark.createDataFrame(data, "row_id long, source_id string, lat_raw string, lon_raw string"), "lat_raw", "lon_raw", "source_id", target="UTM29N")
    assert {r.row_id: r.status for r in out.where("status <> 'ok'").collect()} == {30: "swap_cluster", 31: "missing"}
    with pytest.raises(convert.ReviewPending):
        convert.reviewed(out)
    assert convert.reviewed(out, "apply").where("row_id = 30").select("status", "WKT").first() == ("ok", "POINT (-9.1 38.7)")
    assert {"X_UTM29N", "WKT_UTM29N"} <= set(out.columns) and swaps.suspects(out).count() == 1


def test_signs_and_projected(spark):
    cells_ = spark.createDataFrame([("s", f"{18 + k * 0.1:.1f}", f"{34 + k * 0.1:.1f}") for k in range(5)], "source_id string, lat_raw string, lon_raw string")
    assert regions.suggest_region(cells_, "source_id", chosen="Portugal mainland").first()[1:] == ("Moçambique", 5, 5, 5)
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(parse.parse_coordinate(F.lit("\u2009-9.5\u3000"))) == -9.5 and one(parse.parse_projected(F.lit("1,234.567,8"))) == 1234567.8
    assert one(parse.parse_projected(F.lit("\ufeff532725,16"))) == 532725.16
    assert one(regions.classify(F.lit(100.0), F.lit(40.0), None, F.lit(True))) == "swap_range"


def test_sheets(spark):
    p = sheets.military_km(spark.createDataFrame([(1, 38.7, -9.1, "431", None), (2, 41.1, -8.6, "431", None), (3, None, 1.0, "1", None)], "row_id long, lat double, lon double, d25 string, d50 string"))
    found = sheets.check_sheets(p.withColumns({"x": F.col("m") * 1000, "y": F.col("p") * 1000}), "d25", "d50")
    got = {r.row_id: (r.at25, r.sheet_status, r.confidence) for r in found.collect()}
    assert got[1][0] == "431" and got[1][1] == "ok" and got[2][1:] == ("off", "verificar") and got[3][1] == "none"


def test_names_and_systems():
    assert names.file_name("C:/a/Pontos São João (1).csv") == "Pontos_Sao_Joao_1" and names.file_name("") == "coordinates"
    assert names.field_names(["Latitude_DD", "latitude_dd2", "", "ção"]) == ["Latitude_D", "latitude_1", "field", "ção"]
    assert crs.from_proj4("+proj=utm +zone=29 +datum=WGS84 +units=m") == crs.System(0, "WGS84", True, 0.0, -9.0, 0.9996, 500000.0)
    assert crs.resolve("UTM33S").y_0 == 1e7 and "Transverse_Mercator" in crs.esri_wkt(3763)
    with pytest.raises(ValueError):
        crs.from_proj4("+proj=lcc")
    told = dict(names.provenance(date="d", file="f", source=crs.get(2188), scale=1000.0))
    assert told["source system"] == "EPSG:2188" and "scale" in told
