import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from coordspark.sinks import documents


def points(spark, n=2400):
    """Two sources, of which one holds all rows but twelve, in no order."""
    source = F.when(F.col("id") % (n // 12) == 0, "small").otherwise("large")
    rows = spark.range(n).select(source.alias("source_id"), F.col("id").alias("row_id"), (F.col("id") / 64).alias("Latitude_DD"), (-F.col("id") / 32).alias("Longitude_DD"), F.concat(F.lit("a <b>\n"), "id").alias("name"))
    return rows.orderBy(F.xxhash64("row_id"))


def joined(folder, source):
    files = sorted((folder / f"source_id={source}").glob("part-*"))
    return len(files), "".join(f.read_text() for f in files)


def test_parts_joined_are_the_document(spark, tmp_path):
    rows, folder = points(spark), tmp_path / "out"
    documents.write_parts(documents.geojson(rows, [("from", "here")]), str(folder), 6)
    large, text = joined(folder, "large")
    doc = json.loads(text)
    ids = [i for i in range(2400) if i % 200]
    assert large >= 5 and doc["metadata"] == {"from": "here"}
    assert [f["properties"]["name"] for f in doc["features"]] == [f"a <b>\n{i}" for i in ids]
    small, text = joined(folder, "small")
    assert small <= 2 and len(json.loads(text)["features"]) == 12


def test_parts_of_kml(spark, tmp_path):
    documents.write_parts(documents.kml(points(spark, 240), "name"), str(tmp_path / "out"), 5)
    marks = ET.fromstring(joined(tmp_path / "out", "large")[1].split("\n", 1)[1]).iter("{http://www.opengis.net/kml/2.2}Placemark")
    assert [m.findtext("{*}name").split("\n")[1] for m in marks] == [str(i) for i in range(240) if i % 20]


def test_parts_as_written_in_one_file(spark, tmp_path):
    lines = documents.csv(points(spark, 240))
    documents.write(lines, str(tmp_path / "one"))
    documents.write_parts(lines, str(tmp_path / "many"), 5)
    for source in ("large", "small"):
        assert joined(tmp_path / "one", source)[1] == joined(tmp_path / "many", source)[1]
    assert joined(tmp_path / "one", "large")[0] == 1 < joined(tmp_path / "many", "large")[0]


@pytest.mark.parametrize("write", [documents.write, documents.write_parts, documents.write_lines])
def test_a_failed_task_leaves_nothing(spark, tmp_path, write):
    lines = documents.geojson(points(spark, 240))
    broken = F.when(F.col("pos") == 200, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("line"))
    with pytest.raises(Exception, match="lost"):
        write(lines.withColumn("line", broken), str(tmp_path / "out"))
    assert not [f for f in tmp_path.rglob("*") if f.is_file() and not f.name.startswith(".")]


def test_no_rows(spark, tmp_path):
    documents.write_parts(documents.geojson(points(spark, 240).where("false")), str(tmp_path / "out"))
    assert not list((tmp_path / "out").rglob("part-*"))
