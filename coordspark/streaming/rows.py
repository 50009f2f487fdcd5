"""Conversion of an unbounded feed: what is decided row by row, counts by window, and what a source decides as a whole.

A source's decisions (its figures, the suspects a review is asked about, the region its points
outside are in) are sums, extremes and exclusive ors, so a feed keeps one small row a source as
its state, and tasks add up their rows before they meet. A source is a session: it ends when
nothing came for a while, is given out once, and its state goes with it. The same function over
a table gives the same rows, which is what a batch job does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordspark.functions import formatting, parse
from coordspark.operators.regions import REGIONS, classify, in_region


def labelled(feed: DataFrame, first: str, second: str, region: str, decimals: int = 6) -> DataFrame:
    """The feed with lat, lon and status; nothing is held, so any trigger and any output mode will do."""
    read = parse.with_coordinates(feed, {"lat": first, "lon": second})
    read = read.withColumns({c: formatting.round_half_even(F.col(c), decimals) for c in ("lat", "lon")})
    return read.withColumn("status", classify(F.col("lat"), F.col("lon"), region, parse.axis_mismatch(F.col(first), F.col(second))))


def status_counts(rows: DataFrame, at: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows by window of time and status; what comes later than the watermark allows is left out, and a window's state with it."""
    return rows.withWatermark(at, late).groupBy(F.window(at, window), "status").agg(F.count("*").alias("n"))


def decisions(rows: DataFrame, region: str, *keys) -> DataFrame:
    """Of each key of labelled rows: total, inside, outside, swaps, invalid, the token of its suspects, and the known region most points outside are in (switch, switch_n; of equals the first in order).

    Rows have row_id, lat, lon, status; a key is a column or an expression such as a session.
    """
    lat, lon, status = F.col("lat"), F.col("lon"), F.col("status")
    ok, suspect = status == "ok", status.startswith("swap_")
    away = ok & ~in_region(lat, lon, region)
    # a point is in the first region that holds it
    first = F.coalesce(*(F.when(in_region(lat, lon, name), F.lit(k)) for k, name in enumerate(REGIONS)))
    counts = F.array(*(F.struct(F.count_if(away & (first == k)).alias("n"), F.lit(-k).alias("order"), F.lit(name).alias("name")) for k, name in enumerate(REGIONS)))
    made = rows.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(ok & ~away).alias("inside"), F.count_if(away).alias("outside"), F.count_if(suspect).alias("swaps"),
        F.count_if(status.isin("missing", "out_of_range")).alias("invalid"), F.bit_xor(F.when(suspect, F.xxhash64("row_id", "status"))).alias("token"), F.array_max(counts).alias("best"),
    )
    known = F.col("best.n") > 0
    return made.withColumns({"switch": F.when(known, F.col("best.name")), "switch_n": F.when(known, F.col("best.n"))}).drop("best")


def source_decisions(rows: DataFrame, region: str, at: str, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The decisions of each source (source_id) of a feed, once nothing came for it for a while; rows that come later than the watermark allows are left out."""
    session = F.session_window(at, idle).alias("session")
    return decisions(rows.withWatermark(at, late), region, "source_id", session).select("source_id", F.col("session.start").alias("began"), F.col("session.end").alias("ended"), "total", "inside", "outside", "swaps", "invalid", "token", "switch", "switch_n")
