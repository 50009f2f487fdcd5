from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from coordspark.functions import crs
from coordspark.operators import grids
from coordspark.sources import ntv2


def shifts(rows, columns, size):
    i, j = np.mgrid[:rows, :columns]
    return np.stack([size * np.sin(i / 3 + j / 7), size * np.cos(i / 5 - j / 4)], axis=2).astype(np.float32)


def made(big=False):
    coarse, fine = shifts(9, 11, 4.0), shifts(13, 9, 2.0)
    # 2 degrees by 2.5 from 37 N, 7 W; a finer one inside it
    return [("COARSE", "NONE", 37 * 3600.0, 7 * 3600.0, 900.0, 900.0, coarse), ("FINE", "COARSE", 38 * 3600.0, 8 * 3600.0, 180.0, 225.0, fine)]


@pytest.fixture(scope="module")
def grid(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("grid") / "g.gsb"
    path.write_bytes(ntv2.encoded(made()))
    return ntv2.read(spark, str(path))


def brute(lat, lon):
    """Bilinear by hand, the finest sub-grid first."""
    for _, _, south, east, up, left, nodes in sorted(made(), key=lambda h: h[4]):
        nodes = nodes.astype(float)
        u, v = (lat * 3600 - south) / up, (-lon * 3600 - east) / left
        if 0 <= u <= nodes.shape[0] - 1 and 0 <= v <= nodes.shape[1] - 1:
            i, j = min(int(u), nodes.shape[0] - 2), min(int(v), nodes.shape[1] - 2)
            du, dv = u - i, v - j
            s = (1 - du) * (1 - dv) * nodes[i, j] + (1 - du) * dv * nodes[i, j + 1] + du * (1 - dv) * nodes[i + 1, j] + du * dv * nodes[i + 1, j + 1]
            return lat + float(s[0]) / 3600, lon - float(s[1]) / 3600
    return None


POINTS = [(37.3, -7.1), (38.31, -8.2), (38.0, -8.0), (39.0, -9.5), (37.0, -7.0), (38.6, -8.5), (36.9, -8.0), (39.1, -8.0), (38.0, -9.6), (None, -8.0), (float("nan"), -8.0)]


@pytest.mark.parametrize("big", [False, True])
def test_both_ends_are_read(big):
    heads = ntv2.heads_of(ntv2.encoded(made(), big))
    assert [(h.name, h.parent, h.rows, h.columns, h.big) for h in heads] == [("COARSE", "NONE", 9, 11, big), ("FINE", "COARSE", 13, 9, big)]
    with pytest.raises(ValueError):
        ntv2.heads_of(b"something else" * 20)


def test_forward_and_back(spark, grid):
    assert grid.cells.count() == ntv2.cell_count(grid) == 8 * 10 + 12 * 8
    df = spark.createDataFrame([(k, *p, "x") for k, p in enumerate(POINTS)], "k int, lat double, lon double, sub string")
    there = grids.forward(df, "lon", "lat", grid, ("lon2", "lat2"))
    assert there.columns == ["k", "lat", "lon", "sub", "lon2", "lat2"]
    for r in there.collect():
        want = brute(r.lat, r.lon) if r.lat is not None and r.lat == r.lat else None
        assert (r.lat2 is None) == (want is None), r
        if want:
            assert abs(r.lat2 - want[0]) < 1e-11 and abs(r.lon2 - want[1]) < 1e-11
    # not on the finer grid's edge, where these two grids don't agree
    inner = there.where("lat between 37.1 and 38.9 and lon between -9.4 and -7.1 and k not in (2, 5)")
    back = grids.backward(inner, "lon2", "lat2", grid, ("lon3", "lat3")).collect()
    assert len(back) == 2 and all(abs(r.lon3 - r.lon) < 1e-9 and abs(r.lat3 - r.lat) < 1e-9 for r in back)
    plan = there._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "NestedLoop" not in plan


def test_fallback_says_which(spark, grid):
    code = 20790
    inside, outside = (38.4, -8.3), (41.0, -8.3)
    df = spark.createDataFrame([("in", *inside), ("out", *outside), ("none", None, -8.0)], "k string, lat double, lon double")
    metres = grids.transform(df, "lon", "lat", 4326, code, {code: grid}, ("x", "y"), how="way")
    rows = {r.k: r for r in metres.collect()}
    assert {k: r.way for k, r in rows.items()} == {"in": "grid", "out": "helmert", "none": None} and rows["none"].x is None
    helmert = {r.k: r for r in crs.transform(df, "lon", "lat", 4326, code, ("x", "y"), mode="helmert").collect()}
    assert (rows["out"].x, rows["out"].y) == (helmert["out"].x, helmert["out"].y)
    # by hand: what the grid leaves of the point, then the system's own projection
    again = grids.transform(metres, "x", "y", code, 4326, {code: grid}, ("lon2", "lat2"), how="way2").where("k = 'in'").first()
    assert again.way2 == "grid" and abs(again.lon2 - inside[1]) < 1e-9 and abs(again.lat2 - inside[0]) < 1e-9
    s = crs.get(code)
    own = crs.transform(spark.createDataFrame([(rows["in"].x, rows["in"].y)], "x double, y double"), "x", "y", replace(s, shift=None, needs_grid=False), crs.System(0, s.ellipsoid, False), ("lon", "lat")).first()
    moved = brute(own.lat, own.lon)
    assert abs(moved[0] - inside[0]) < 1e-9 and abs(moved[1] - inside[1]) < 1e-9
    # two systems with grids: through WGS84, the seven parameters named if either was theirs
    two = grids.transform(metres, "x", "y", code, 27493, {code: grid, 27493: grid}, ("a", "b"), how="both")
    assert {r.k: r.both for r in two.collect()} == {"in": "grid", "out": "helmert", "none": None}
    with pytest.raises(ValueError, match="needs a grid"):
        grids.transform(df, "lon", "lat", 4326, code, {})


def test_a_large_grid_is_joined_by_a_shuffle(spark, grid, monkeypatch):
    monkeypatch.setattr("coordspark.operators.tables.SMALL", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(k, *p) for k, p in enumerate(POINTS)], "k int, lat double, lon double")
        there = grids.forward(df, "lon", "lat", grid, ("lon2", "lat2"))
        assert "SortMergeJoin" in there._jdf.queryExecution().executedPlan().toString()
        assert there.where(F.col("lat2").isNotNull()).count() == 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
