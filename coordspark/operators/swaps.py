"""Reversed pairs: statuses of points by key, against a region, a reference or their own densest cluster.

Everything a file decides as a whole is an aggregate by key that is joined back, so one file
or thousands are the same job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordspark.functions.parse import valid_pair
from coordspark.operators.quantiles import quantile
from coordspark.operators.regions import classify
from coordspark.operators.tables import discard, fitted, written

#: The least points in range, the size of cells, the least radius, and how far is away and back.
LEAST_POINTS, LEAST_CELL, CELLS, LEAST_RADIUS = 6, 0.5, 20.0, 1.0
AWAY, BACK, RATIO = 3.0, 1.5, 10.0


def _distance(lat: Column, lon: Column, at: Column, on: Column) -> Column:
    return F.hypot(lat - at, lon - on)


def by_reference(points: DataFrame, reference: tuple[float, float], radius: float = 10.0, mismatch: Column | None = None) -> DataFrame:
    """The points with ``status``: away from the reference as written, near it when reversed."""
    lat, lon = F.col("lat"), F.col("lon")
    at, on = F.lit(float(reference[0])), F.lit(float(reference[1]))
    plain = classify(lat, lon, None, mismatch)
    flagged = (plain == "ok") & (_distance(lat, lon, at, on) > radius) & (_distance(lon, lat, at, on) <= radius)
    return points.withColumn("status", F.when(flagged, "swap_cluster").otherwise(plain))


def dense_centre(points: DataFrame, *keys: str) -> DataFrame:
    """Each key's densest cluster of points in range: at, on, radius; the input has row_id, lat, lon and is read several times."""
    key = list(keys)
    good = points.select(*key, "row_id", "lat", "lon").where(valid_pair(F.col("lat"), F.col("lon")))
    span = F.greatest(F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon"))
    cells = good.groupBy(*key).agg(F.count("*").alias("n"), F.greatest(F.lit(LEAST_CELL), span / CELLS).alias("cell")).where(F.col("n") >= LEAST_POINTS)
    cells = fitted(written(cells.select(*key, "cell"), "cluster-cells"))
    at_cell = {"i": F.floor(F.col("lat") / F.col("cell")), "j": F.floor(F.col("lon") / F.col("cell"))}
    counts = good.join(cells, key).withColumns(at_cell).groupBy(*key, "cell", "i", "j").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))
    modal = counts.groupBy(*key, "cell").agg(F.max_by(F.struct("i", "j"), F.struct("n", -F.col("first_row"))).alias("best"))
    placed = good.join(fitted(written(modal, "cluster-modal")), key).withColumns(at_cell)
    members = placed.where((F.abs(F.col("i") - F.col("best.i")) <= 1) & (F.abs(F.col("j") - F.col("best.j")) <= 1)).select(*key, "lat", "lon")
    # both medians at once
    sides = members.select(*key, F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("v")) for c in ("lat", "lon")))).alias("x")).select(*key, "x.side", "x.v")
    middle = quantile(sides, [*key, "side"], 0.5, "m").groupBy(*key).agg(F.max(F.when(F.col("side") == "lat", F.col("m"))).alias("at"), F.max(F.when(F.col("side") == "lon", F.col("m"))).alias("on"))
    centre = fitted(written(middle, "cluster-middles"))
    away = members.join(centre, key).select(*key, _distance(F.col("lat"), F.col("lon"), F.col("at"), F.col("on")).alias("v"))
    return centre.join(quantile(away, key, 0.9, "p90"), key).select(*key, "at", "on", F.greatest(F.lit(LEAST_RADIUS), F.col("p90")).alias("radius"))


def by_cluster(points: DataFrame, *keys: str, mismatch: Column | None = None) -> DataFrame:
    """The points with ``status``: away from their key's cluster as written, back at it when reversed. Keys with few points in range have no cluster.

    What a key decides is taken from a written table of its points alone, and joined back as one row.
    """
    key, columns = list(keys), points.columns
    lat, lon = F.col("lat"), F.col("lon")
    light = written(points.select(*key, "row_id", "lat", "lon"), "cluster-points")
    centres = fitted(written(dense_centre(light, *keys), "cluster-centres"))
    d_as = _distance(lat, lon, F.col("at"), F.col("on"))
    extent = light.where(valid_pair(lat, lon)).join(centres, key).where(d_as <= AWAY * F.col("radius")).groupBy(*key).agg(F.max(d_as).alias("extent"))
    decided = centres.join(extent, key, "left").select(*key, F.struct("at", "on", "radius", F.coalesce("extent", F.lit(0.0)).alias("extent")).alias("cluster"))
    decided = fitted(written(decided, "cluster-decided"))
    discard(light)
    c = lambda name: F.col(f"cluster.{name}")
    d_as, d_sw = _distance(lat, lon, c("at"), c("on")), _distance(lon, lat, c("at"), c("on"))
    measured = points.join(decided, key, "left").withColumns({"cluster_as": d_as, "cluster_sw": d_sw, "cluster_plain": classify(lat, lon)})
    returns = (F.col("cluster_sw") <= F.greatest(BACK * c("radius"), c("extent") + c("radius"))) | ((F.col("cluster_sw") > 0) & (F.col("cluster_as") >= RATIO * F.col("cluster_sw")))
    flagged = (F.col("cluster_plain") == "ok") & (F.col("cluster_as") > AWAY * c("radius")) & returns
    status = F.when(flagged, "swap_cluster").otherwise(F.col("cluster_plain"))
    if mismatch is not None:
        status = F.when(mismatch & valid_pair(lat, lon), "swap_axis").otherwise(status)
    return measured.select(*columns, status.alias("status"))


def detect(points: DataFrame, *keys: str, region: str | None = None, reference: tuple[float, float] | None = None, radius: float = 10.0, mismatch: Column | None = None) -> DataFrame:
    """The points with ``status``, by region if one is given, else by reference, else by cluster."""
    if region is not None:
        return points.withColumn("status", classify(F.col("lat"), F.col("lon"), region, mismatch))
    if reference is not None:
        return by_reference(points, reference, radius, mismatch)
    return by_cluster(points, *keys, mismatch=mismatch)


def suspects(labelled: DataFrame) -> DataFrame:
    """Rows to review, proofs first, then those out of range, then clusters."""
    order = F.when(F.col("status") == "swap_axis", 0).when(F.col("status") == "swap_range", 1).otherwise(2)
    return labelled.where(F.col("status").startswith("swap_")).orderBy(order, "row_id")


def inverted(labelled: DataFrame) -> Column:
    """The other reading of a cluster: the rows called ok are the reversed ones."""
    return F.col("status") == "ok"


def review_token(labelled: DataFrame, *keys: str) -> DataFrame:
    """A number that stands for a key's exact set of suspects, so an answer is kept for that set only."""
    suspect = F.when(F.col("status").startswith("swap_"), F.xxhash64("row_id", "status"))
    return labelled.groupBy(*keys).agg(F.count(suspect).alias("suspects"), F.bit_xor(suspect).alias("token"))
