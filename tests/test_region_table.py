import random

import pytest
from pyspark.sql import functions as F

from coordspark.operators import region_table, regions

BOXES = "ord int, name string, lat_min double, lat_max double, lon_min double, lon_max double"


def brute(lat, lon, boxes):
    if lat is None or lon is None or lat != lat or lon != lon:
        return None
    return min(((o, n) for o, n, a, b, c, d in boxes if None not in (a, b, c, d) and a <= lat <= b and c <= lon <= d), default=(0, None))[1]


@pytest.mark.parametrize("part", [1_000_000, 7])
def test_first_of_many_boxes(spark, part):
    rng = random.Random(part)
    boxes = []
    for k in range(400):
        lat, lon, size = rng.uniform(30, 42), rng.uniform(-12, -5), rng.choice([0.0, 0.01, 0.3, 2.0, 9.0])
        boxes.append((rng.randrange(300), f"r{k}", lat, lat + size, lon, lon + size * rng.random()))
    boxes += [(500, "all", -90.0, 90.0, -180.0, 180.0), (0, "turned", 41.0, 40.0, -9.0, -8.0), (0, "null", None, 40.0, -9.0, -8.0)]
    points = [(k % 40, rng.uniform(29, 43), rng.uniform(-13, -4)) for k in range(200)]
    points += [(900, b[2], b[4]) for b in boxes[:40]] + [(901, b[3], b[5]) for b in boxes[:40]]  # corners count
    points += [(None, 38.0, -9.0), (None, 38.0, -9.0), (5, None, 1.0), (6, float("nan"), 1.0), (7, 91.0, 200.0)] + [(8, 38.5, -8.5)] * 30
    df = spark.createDataFrame([(*p, "x") for p in points], "row_id int, lat double, lon double, region_of string")
    found = region_table.first_region(df, spark.createDataFrame(boxes, BOXES), "row_id", part=part)
    got = sorted(((r.row_id, r.lat, r.lon, r.region) for r in found.collect()), key=repr)
    assert list(map(repr, got)) == sorted(repr((i, a, o, brute(a, o, boxes))) for i, a, o in points)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()


def test_known_regions_and_none(spark):
    df = spark.createDataFrame([(k, a, o) for k, (a, o) in enumerate([(38.7, -9.1), (32.7, -16.9), (30.1, -15.9), (37.8, -25.5), (0.3, 6.7), (10.0, 10.0)])], "row_id int, lat double, lon double")
    found = region_table.first_region(df, region_table.known_regions(spark), "row_id").withColumn("want", regions.identify_region(F.col("lat"), F.col("lon")))
    assert [r.region for r in found.orderBy("row_id").collect()] == [r.want for r in found.orderBy("row_id").collect()] != []
    none = region_table.first_region(df, region_table.known_regions(spark).where("false"), "row_id")
    assert none.count() == 6 and none.where("region is not null").count() == 0


def test_boxes_over_one_another_leave_few(spark):
    """A point meets the boxes that can be its first, not all that hold it: ten times as many boxes aren't ten times as many candidates."""
    rng = random.Random(3)
    boxes = [(rng.randrange(50), f"r{k}", lat, lat + rng.uniform(0.5, 2), lon, lon + rng.uniform(0.5, 2)) for k in range(6000) for lat, lon in [(rng.uniform(36, 40), rng.uniform(-10, -6))]]
    points = [(k, rng.uniform(36.5, 41), rng.uniform(-9.5, -5)) for k in range(300)]
    met = []
    for n in (600, 6000):
        cells = region_table._cells(spark.createDataFrame(boxes[:n], BOXES)).collect()
        met.append(sum(c.i == lat // 2.0**c.level and c.j == lon // 2.0**c.level for c in cells for _, lat, lon in points))
    assert met[1] < 2 * met[0] and met[1] < 40 * len(points), met
    found = region_table.first_region(spark.createDataFrame(points, "row_id int, lat double, lon double"), spark.createDataFrame(boxes, BOXES), "row_id")
    assert {r.row_id: r.region for r in found.collect()} == {k: brute(a, o, boxes) for k, a, o in points}


def test_equal_edges_end_the_cutting(spark):
    boxes = [(k, f"r{k}", 41.0 - k / 1000, 42.0, -9.0, -8.0 + k / 1000) for k in range(500)]  # one upper edge, one western edge
    points = [(0, 42.0, -9.0), (1, 42.0, -8.2), (2, 42.0 + 1e-12, -9.0), (3, 40.6, -8.0), (4, 41.5, -9.0 - 1e-12), (5, 41.0, -7.7)]
    found = region_table.first_region(spark.createDataFrame(points, "row_id int, lat double, lon double"), spark.createDataFrame(boxes, BOXES), "row_id")
    assert {r.row_id: r.region for r in found.collect()} == {k: brute(a, o, boxes) for k, a, o in points}
