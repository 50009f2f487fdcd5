"""Exact order statistics by key without holding a group in one task.

A mergeable sketch, one aggregate for all keys, gives bounds between which the ranks asked for
surely lie: its quantiles err by less than a step of the grid they are taken at, and a step more
is taken on each side. A second aggregate counts what is below the bounds and the equal values
between them; of these few rows are left, and they are ordered. Where more than ``FEW`` are left
of a key, the sketch is taken again between its bounds, so neither outliers nor large keys bring
many values into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordspark.operators.tables import discard, fitted, written

#: Quantiles of the sketch, and its accuracy: ranks err by a share of one over it.
GRID, ACCURACY = 256, 10_000
FEW = 100_000


def _bounds(values: DataFrame, key: list[str], wanted, old: DataFrame | None) -> DataFrame:
    """Of each key: n, ranks, and bounds lo and hi that hold them; between the old bounds if there are any."""
    inside = F.col("v").between(F.col("lo"), F.col("hi")) if old is not None else F.lit(True)
    v = F.when(inside, F.col("v"))
    rows = values if old is None else values.join(old, key)
    below = F.count_if(F.col("v") < F.col("lo")) if old is not None else F.lit(0).cast("long")
    grid = F.percentile_approx(v, [k / GRID for k in range(GRID + 1)], ACCURACY)
    found = rows.groupBy(*key).agg(F.count("*").alias("n"), F.count(v).alias("m"), below.alias("below"), F.min(v).alias("least"), F.max(v).alias("most"), grid.alias("grid"))
    found = found.withColumn("ranks", wanted(F.col("n")))
    step = lambda rank: (rank - F.col("below")) / F.greatest(F.col("m") - 1, F.lit(1)) * GRID
    first, last = F.floor(step(F.array_min("ranks"))).cast("int") - 1, F.ceil(step(F.array_max("ranks"))).cast("int") + 1
    lo = F.when(first <= 0, F.col("least")).otherwise(F.get("grid", first))
    hi = F.when(last >= GRID, F.col("most")).otherwise(F.get("grid", last))
    return found.select(*key, "n", "ranks", lo.alias("lo"), hi.alias("hi"))


def at_ranks(values: DataFrame, key: list[str], wanted) -> DataFrame:
    """Of each key (key, v): n, and ``at``, the values at the ranks, counted from 0, that ``wanted`` makes of n as an array. Nulls don't count."""
    values = values.where("v is not null")
    bounds = None
    while True:
        last, bounds = bounds, written(_bounds(values, key, wanted, None if bounds is None else fitted(bounds.select(*key, "lo", "hi"))), "rank-bounds")
        if last is not None:
            discard(last)
        near = values.join(fitted(bounds.select(*key, "lo", "hi")), key).where("v <= hi")
        # what is below is one row, without a value
        near = written(near.groupBy(*key, F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("c")), "rank-values")
        if near.groupBy(*key).count().where(F.col("count") > FEW).isEmpty():
            break
        narrow = bounds.where("lo < hi").isEmpty()
        if narrow:
            break
        discard(near)
    upto = F.sum("c").over(Window.partitionBy(*key).orderBy(F.asc_nulls_first("v")))
    rows = near.withColumn("upto", upto).join(fitted(bounds.select(*key, "n", "ranks")), key)
    met = rows.select(*key, "n", "ranks", "v", F.explode(F.array_distinct("ranks")).alias("rank"), "upto", "c").where("v is not null and rank < upto and rank >= upto - c")
    found = met.groupBy(*key).agg(F.first("n").alias("n"), F.first("ranks").alias("ranks"), F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("by"))
    return found.select(*key, "n", F.transform("ranks", lambda r: F.element_at("by", r)).alias("at"))


def quantile(values: DataFrame, key: list[str], q: float, name: str) -> DataFrame:
    """Each key's quantile of v, interpolated between neighbours."""
    h = lambda n: (n - 1) * F.lit(q)
    found = at_ranks(values, key, lambda n: F.array(F.floor(h(n)), F.ceil(h(n))))
    a, b = F.get("at", F.lit(0)), F.get("at", F.lit(1))
    return found.select(*key, (a + (b - a) * (h(F.col("n")) - F.floor(h(F.col("n"))))).alias(name))


def upper_median(n: Column) -> Column:
    """The rank of the upper of the middle two."""
    return F.array(F.floor(n / 2))
