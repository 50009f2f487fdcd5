import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coordspark.functions.formatting import number_text
from coordspark.operators.tables import COMPILED, compiled
from coordspark.sinks import documents as sinks
from coordspark.sources import geo, geojson_splits


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(n) for n in names]
    yield lambda n, rows=3: [spark.conf.set(name, str(v)) for name, v in zip(names, (n, n, rows))]
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def feature(rng, k):
    """A feature with braces, quotes and backslashes in strings and keys that look like the list's."""
    text = "".join(rng.choice(["{", "}", "[", "]", '"', "\\", "é", "a", ",", '"features":[', "\n"]) for _ in range(rng.randrange(12)))
    props = {"n": k, "t": text, "features": [{"x": [1, {"y": "}"}]}], 'q"{': {"z": text}} if rng.random() < 0.7 else rng.choice([None, {}])
    place = rng.choice([{"type": "Point", "coordinates": [k / 8, -k / 16, k]}, {"type": "MultiPoint", "coordinates": [[k, 1], [2, 3]]}, {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, None])
    return {"type": "Feature", "id": k, "geometry": place, "properties": props}


def documents(rng):
    crs = {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3763", "features": []}}
    many = lambda n: [feature(rng, k) for k in range(n)]
    dumped = lambda d, **kw: json.dumps(d, ensure_ascii=rng.random() < 0.5, **kw)
    return {
        "plain": dumped({"type": "FeatureCollection", "features": many(14)}, separators=(",", ":")),
        "indented": dumped({"metadata": {"a": [{"features": [{}]}], "b": '"features":['}, "type": "FeatureCollection", "features": many(8), "crs": crs}, indent=2) + "\n",
        "first": "﻿" + dumped({"crs": crs, "features": many(4), "type": "FeatureCollection", "bbox": [1, 2, 3, 4]}) + " \n\n",
        "none": dumped({"type": "FeatureCollection", "features": []}),
        "missing": dumped({"type": "FeatureCollection"}),
        "single": dumped(feature(rng, 3)),
        "bare": dumped({"type": "Point", "coordinates": [1.5, 2]}) + "\r\n",
        "blank": " \n",
    }


def rows(points):
    return sorted((r.source_id.rsplit("/", 1)[-1], r.row_id, r.lat, r.lon, r.alt, tuple(map(tuple, r.props)), r.projected) for r in points.collect())


def notes(found):
    return sorted((r.source_id.rsplit("/", 1)[-1], r.code, r.n) for r in found.collect())


@pytest.mark.parametrize("size", [600, 1 << 20])
def test_splits_give_the_features_of_the_whole(spark, tmp_path, small_splits, size):
    texts = documents(random.Random(size))
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    small_splits(size)
    found, told = geo.geojson_files(spark, str(tmp_path))
    got = rows(found), notes(told)
    small_splits(1 << 20, 10000)
    points, skipped = geo.geojson(spark.createDataFrame(list(texts.items()), "source_id string, text string"))
    assert got == (rows(points), notes(skipped))
    assert {r[0] for r in got[0]} == {"plain", "indented", "first", "bare", *({"single"} & {r[0] for r in got[0]})}


def test_features_are_those_of_a_parser(spark, tmp_path, small_splits):
    rng = random.Random(5)
    doc = {"type": "FeatureCollection", "features": [feature(rng, k) for k in range(20)] + [[1, {"a": 2}], {}], "after": [{"b": 1}]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    small_splits(600)
    found, frames, problems = geojson_splits.features(spark, str(tmp_path))
    assert [json.loads(r.x) for r in found.orderBy("at", "nth").collect()] == doc["features"]
    assert [json.loads(r.text) for r in frames.collect()] == [doc | {"features": []}] and problems.count() == 0
    assert found.select("at").distinct().count() > 3


def test_charsets_and_documents_that_do_not_close(spark, tmp_path, small_splits):
    doc = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": "É"}, "geometry": {"type": "Point", "coordinates": [k, 2]}} for k in range(9)]}, ensure_ascii=False)
    for name, data in {"old": doc.encode("cp1252"), "wide": doc.encode("utf-16"), "cut": doc[:-40].encode(), "open": (doc[:-2] + ',"a":"').encode(), "empty": b"", "more": (doc + "]").encode()}.items():
        (tmp_path / name).write_bytes(data)
    small_splits(300)
    found, told = geo.geojson_files(spark, str(tmp_path))
    assert [r[:2] + r[5] for r in rows(found)] == [("old", k, ("n", "É")) for k in range(9)]
    assert notes(told) == [("cut", "geojson_unclosed", 1), ("more", "geojson_unclosed", 1), ("open", "geojson_unclosed", 1), ("wide", "geojson_wide_charset", 1)]


def cut_by_hand(text, size, rows, rng):
    """The two passes over pieces dealt to splits of some size, in batches of some rows, without Spark."""
    pieces, at, splits = [p + "}" for p in text.split("}")], 0, {}
    if not text.endswith("}"):
        extra = 1
    else:
        pieces, extra = pieces[:-1], 0
    for p in pieces:
        splits.setdefault(at // size * size, []).append(p.encode())
        at += len(p.encode())
    def batches(more):
        flat = [(a, p) for a, ps in splits.items() for p in ps]
        for k in range(0, len(flat), rows):
            part = flat[k : k + rows]
            base = {"source_id": ["s"] * len(part), "at": [a for a, _ in part], "raw": pa.array([p for _, p in part], pa.binary())}
            yield pa.RecordBatch.from_pydict(base | {n: pa.array([f(a) for a, _ in part]) for n, f in more.items()})
    whole = len(text.encode())
    made = pa.Table.from_batches(geojson_splits._summaries(batches({"size": lambda a: whole, "utf8": lambda a: True}))).to_pandas()
    known = geojson_splits._entries(made.sample(frac=1, random_state=rng.randrange(99))).set_index("at")
    assert known["problem"].isna().all() and known["extra"].sum() == extra
    told = {n: (lambda a, n=n: known.loc[a, n].item()) for n in ("inside", "depth", "listed", "seen", "extra")}
    out = pa.Table.from_batches(geojson_splits._cutting(1 << 20)(batches(told))).to_pandas().sort_values(["at", "nth"])
    found = []
    for r in out[out["nth"] > -2].itertuples():
        if r.nth >= 0:
            found.append(r.raw)
        else:
            found[-1] += r.raw
    return [f.decode() for f in found], b"".join(out[out["nth"] == -2]["raw"]).decode()


@pytest.mark.parametrize("seed", range(12))
def test_any_split_of_pieces(seed):
    rng = random.Random(seed)
    for text in documents(rng).values():
        text = text.removeprefix("\ufeff")
        doc = json.loads(text) if text.strip() else None
        many = isinstance(doc, dict) and "features" in doc
        for size in (1, rng.randint(2, 40), rng.randint(40, 900), 1 << 20):
            found, frame = cut_by_hand(text, size, rng.randint(1, 9), rng)
            assert [json.loads(f) for f in found] == (doc["features"] if many else [])
            assert (json.loads(frame) if doc is not None else None) == (doc | {"features": []} if many else doc)


def test_a_large_feature_is_refused(spark, tmp_path, small_splits):
    (tmp_path / "a").write_text(json.dumps({"type": "FeatureCollection", "features": [{"p": [{"n": k} for k in range(100)]}]}))
    for size in (400, 1 << 20):
        small_splits(size)
        with pytest.raises(Exception, match="too large"):
            geojson_splits.features(spark, str(tmp_path), most=300)[0].collect()


def test_many_splits_are_ordered_after_a_shuffle(spark, tmp_path, small_splits, monkeypatch):
    doc = json.dumps({"type": "FeatureCollection", "features": [{"k": k, "t": "}{" * (k % 5)} for k in range(80)]})
    (tmp_path / "a").write_text(doc)
    small_splits(250)
    for module in ("coordspark.sources.geojson_splits", "coordspark.operators.tables"):
        monkeypatch.setattr(f"{module}.SMALL", 3)
    found, _, _ = geojson_splits.features(spark, str(tmp_path))
    assert [json.loads(r.x)["k"] for r in found.orderBy("at", "nth").select(F.col("x"), "at", "nth").collect()] == list(range(80))


@pytest.mark.parametrize("size", [500, 1 << 20])
def test_files_of_a_folder_are_one_document(spark, tmp_path, small_splits, size):
    rng = random.Random(size)
    texts = documents(rng)
    for name, text in texts.items():
        folder, cuts = tmp_path / f"a={name} x", [k for k in range(1, len(text)) if text[k - 1] in ",}"]
        folder.mkdir()
        ends = sorted({0, *rng.sample(cuts, min(5, len(cuts))), len(text)})
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            (folder / f"part-{k:05}.txt").write_bytes(text[a:b].encode())
    small_splits(size)
    found, told = geo.geojson_files(spark, f"{tmp_path}/*/*", parts=True)
    name = lambda s: s.split("=")[-1].removesuffix("%20x")
    got = [(name(r[0]), *r[1:]) for r in rows(found)], [(name(n[0]), *n[1:]) for n in notes(told)]
    points, skipped = geo.geojson(spark.createDataFrame(list(texts.items()), "source_id string, text string"))
    assert got == (rows(points), notes(skipped))


def test_written_in_parts_and_read_again(spark, tmp_path, small_splits):
    rows_ = spark.range(900).select(F.lit("a }b").alias("source_id"), (F.col("id") * 2).alias("row_id"), (F.col("id") / 64).alias("Latitude_DD"), (-F.col("id") / 32).alias("Longitude_DD"), F.concat(F.lit('"features":[{\\'), "id").alias("name"))
    sinks.write_parts(sinks.geojson(rows_, [("by", "}]")]), str(tmp_path / "out"), 6)
    assert len(list(tmp_path.glob("out/*/part-*"))) >= 5
    small_splits(9000, 100)
    found, told = geo.geojson_files(spark, f"{tmp_path}/out/*/*", parts=True)
    got = [(r.row_id, r.lat, r.props[0].v) for r in found.orderBy("row_id").collect()]
    text = lambda x: str(int(x)) if x == int(x) else repr(x)
    assert got == [(k, text(k / 64), '"features":[{\\' + str(k)) for k in range(900)]
    assert found.select("source_id").distinct().count() == 1 and told.count() == 0


def test_large_methods_are_not_left_uncompiled(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    with pytest.raises(ValueError), compiled(spark):
        assert int(spark.conf.get(name)) <= COMPILED
        raise ValueError
    assert spark.conf.get(name) == before


def test_number_text_is_as_short_as_a_double_reads_back(spark):
    values = [0.0, -0.0, 0.001, 0.0009, -38.123456, 9999999.0, 9999999.5, 1e7, 123456789.25, 1 / 3, 1e-5, 1e16, 0.1 + 0.2]
    got = [r.t for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", number_text(F.col("v")).alias("t")).orderBy("k").collect()]
    assert got == [repr(v) for v in values]
