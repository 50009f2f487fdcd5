"""Points in the first of many regions that holds them, regions being a table of boxes.

A region is a name, its place in an order, and one box or several. Boxes are dealt to the cells
of a grid that fits the largest; of those that cover a cell wholly only the first in the order
counts there, and none behind it does. A cell that still has more than ``FEW`` boxes is cut into
smaller ones, which the boxes that are left are dealt to, until cutting helps no more. So of boxes
over one another only those that can be a point's first are left, and points meet few. Cells don't
overlap: a point has one in each of the few sizes that are used, an equi-join, after which the box
is tested exactly. A cell with many points is dealt out in parts, and its boxes with it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coordspark.operators.regions import REGIONS
from coordspark.operators.tables import discard, fitted, written

#: The largest box has at most this many steps on its longer side; points of a cell that are one part.
STEPS, PART = 4, 1_000_000
#: Boxes of a cell that isn't cut further, the share of them that a cut must leave out, and the halvings of a cut.
FEW, HELP, HALVINGS = 32, 0.25, 2
#: Exponents of two of the steps, in degrees: from far under a metre to the whole globe.
LEAST, MOST = -24, 9


def known_regions(spark: SparkSession) -> DataFrame:
    """The eight regions as a table: ord, name and a row for each box."""
    rows = [(k, name, *map(float, box)) for k, (name, boxes) in enumerate(REGIONS.items()) for box in boxes]
    return spark.createDataFrame(rows, "ord int, name string, lat_min double, lat_max double, lon_min double, lon_max double")


CELL = ["level", "i", "j"]


def _dealt(boxes: DataFrame, level: int, within: bool) -> DataFrame:
    """Boxes by the cells of a level that they touch, within the cell they were in: i, j, and whether they cover it."""
    step, sides = 2.0**level, {}
    for at, low, high in (("i", "lat_min", "lat_max"), ("j", "lon_min", "lon_max")):
        first, last = F.floor(F.col(low) / step), F.floor(F.col(high) / step)
        if within:
            first, last = F.greatest(first, F.col(at) * 2**HALVINGS), F.least(last, (F.col(at) + 1) * 2**HALVINGS - 1)
        sides[at] = F.sequence(first, last)
    boxes = boxes.withColumns({f"{at}s": s for at, s in sides.items()}).withColumn("i", F.explode("is")).withColumn("j", F.explode("js")).drop("is", "js")
    covers = (F.col("lat_min") <= F.col("i") * step) & (F.col("lat_max") >= (F.col("i") + 1) * step) & (F.col("lon_min") <= F.col("j") * step) & (F.col("lon_max") >= (F.col("j") + 1) * step)
    return boxes.withColumns({"level": F.lit(level), "covers": covers})


def _cells(regions: DataFrame) -> DataFrame:
    """Boxes by cell: level, i, j, without those that a box before them covers there. Boxes that are null or turned round are none."""
    good = regions.where("lat_min <= lat_max and lon_min <= lon_max and abs(lat_min) < 1e9 and abs(lat_max) < 1e9 and abs(lon_min) < 1e9 and abs(lon_max) < 1e9")
    corners = ["lat_min", "lat_max", "lon_min", "lon_max"]
    good = good.groupBy(*corners).agg(F.min(F.struct("ord", "name")).alias("rank"))  # of equal boxes the first counts
    side = good.agg(F.max(F.greatest(F.col("lat_max") - F.col("lat_min"), F.col("lon_max") - F.col("lon_min")))).first()[0]
    level = MOST if side is None else min(max(math.ceil(math.log2(max(side / STEPS, 2.0**LEAST))), LEAST), MOST)
    # few bytes of boxes make many rows of cells
    open_, done = good.repartition(4 * regions.sparkSession.sparkContext.defaultParallelism).withColumn("parent", F.lit(None).cast("long")), []
    while True:
        dealt = written(_dealt(open_, level, bool(done)), "region-cells")
        first = dealt.where("covers").groupBy(*CELL).agg(F.min("rank").alias("first"))
        kept = dealt.join(first, CELL, "left").where("first is null or rank <= first").drop("first")
        sizes = kept.groupBy(*CELL).agg(F.count("*").alias("n"), F.max("parent").alias("had"))
        cut = sizes.withColumn("cut", (F.col("n") > FEW) & (F.col("had").isNull() | (F.col("n") <= F.col("had") * (1 - HELP))) & F.lit(level - HALVINGS >= LEAST))
        now = written(kept.drop("parent").join(cut.drop("had"), CELL), "region-cells")
        discard(dealt)
        done.append(now.where("not cut"))
        open_ = now.where("cut").withColumnRenamed("n", "parent").drop("cut")
        if open_.isEmpty():
            break
        level -= HALVINGS
    return reduce(DataFrame.unionAll, [d.select(*CELL, "rank.ord", "rank.name", *corners) for d in done])


def first_region(points: DataFrame, regions: DataFrame, *keys: str, lat: str = "lat", lon: str = "lon", part: int = PART) -> DataFrame:
    """The points with ``region``, the name of the first region in order with a box that holds them, edges included; null if none does.

    ``keys`` tell the points apart; of rows that share them each gets its own region. The
    regions have ord, name, lat_min, lat_max, lon_min, lon_max; of equal places in the order the
    smaller name counts. A point that is null or NaN has none.
    """
    cells = _cells(regions.select("ord", "name", *(F.col(c).cast("double").alias(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max"))))
    cells = fitted(written(cells, "region-cells"))
    levels = [r.level for r in cells.select("level").distinct().orderBy("level").collect()]  # at most MOST - LEAST + 1
    place = points.select(*(F.col(k).alias(f"key_{n}") for n, k in enumerate(keys)), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    place = place.where(~F.isnan("lat") & ~F.isnan("lon") & (F.abs("lat") < 1e9) & (F.abs("lon") < 1e9))
    at = lambda level: F.struct(F.lit(level).alias("level"), F.floor(F.col("lat") / 2.0**level).alias("i"), F.floor(F.col("lon") / 2.0**level).alias("j"))
    none = F.filter(F.array(at(0)), lambda _: F.lit(False))
    each = place.withColumn("cell", F.explode(F.array(*map(at, levels)) if levels else none))
    each = each.select("*", "cell.level", "cell.i", "cell.j").drop("cell")
    crowded = each.groupBy(*CELL).agg(F.count("*").alias("n")).where(F.col("n") > part).select(*CELL, F.ceil(F.col("n") / part).cast("int").alias("parts"))
    crowded = fitted(written(crowded, "region-crowded"))
    parted = each.join(crowded, CELL, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("lat", "lon", *(c for c in place.columns if c.startswith("key_"))), F.col("parts")).cast("int"), F.lit(0)))
    boxes = cells.join(crowded, CELL, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    met = parted.drop("parts").join(boxes.drop("parts"), [*CELL, "part"])
    inside = met.where(F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lon").between(F.col("lon_min"), F.col("lon_max")))
    own = [c for c in place.columns if c.startswith("key_")]
    best = inside.groupBy(*own, F.col("lat").alias("at_lat"), F.col("lon").alias("at_lon")).agg(F.min(F.struct("ord", "name"))["name"].alias("found"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"b.key_{n}")) for n, k in enumerate(keys)]
    same += [F.col(f"p.{lat}").cast("double") == F.col("b.at_lat"), F.col(f"p.{lon}").cast("double") == F.col("b.at_lon")]
    joined = points.alias("p").join(best.alias("b"), [*same] if same else None, "left")
    return joined.select("p.*", F.col("b.found").alias("region"))
