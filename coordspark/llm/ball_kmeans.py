"""Lloyd's rounds over balls: members near their centre keep it, the others meet near centres only.

A cluster is a ball: its centroid and a reach that no member lies beyond. Two balls are
neighbours if half the way between their centroids is within a reach; only those are kept for
the round. A task takes a cluster's members of a batch together. Those nearer to the centroid
than half the way to its nearest neighbour are the stable core and keep their cluster. The
others lie in annuli between half the ways to neighbours, nearest first: a member of the m-th
annulus is compared with the first m neighbours. By the triangle inequality no other centroid
can be as near, so the clusters are those of comparing all. A member on the bound itself is
compared, as the smaller number takes ties.

A round is one pass without a shuffle of vectors: each task writes its rows with their new
cluster and, beside them, sums, counts and farthest distances by cluster, which one aggregate
adds up. The driver sees k rows of components and nothing else, and moves the centroids; a
ball's next reach is its farthest member plus the way its centroid moved. Rounds read the last
round's table and delete it, so a lost executor costs a part of one round.

Arithmetic is exact: squared distances are whole doubles below 2**53 while components stay
below ``PLAIN``, and Python's whole numbers beyond. A component of 2**62 or more, and a distance
or sum beyond a long, are errors.

Vectors of another length, null, or with null or non-finite components are left out. Rows
without id take part and come last among the first centroids; rows that repeat an id are rows
of their own; of equal hashes the smaller vector comes first. With fewer than k vectors there
are as many clusters; an empty table gives no row. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordspark.llm.exact_topk import usable
from coordspark.llm.tables import discard, written

#: Components below this have exact squared distances in doubles, up to 128 of them.
PLAIN = 1 << 21
WIDEST = 1 << 62
STATE = "vec_id long, v array<long>, cluster int, distance long, n long, sums array<long>, reach long, inertia long"
NAMES = [f.split()[0] for f in STATE.split(", ")]


@dataclass(frozen=True)
class Ball:
    """A centroid, a squared reach that holds all members (None: not known), and its neighbours' numbers and squared ways, nearest first."""

    centre: tuple[int, ...]
    reach: int | None
    near: tuple[tuple[int, int], ...]


def _squared(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def balls(centres: list[tuple[int, ...]], reaches: list[int | None]) -> list[Ball]:
    """Each centroid with the neighbours its members may meet: half the way between is within the reach."""
    out = []
    for i, (c, reach) in enumerate(zip(centres, reaches, strict=True)):
        ways = sorted((_squared(c, d), j) for j, d in enumerate(centres) if j != i)
        out.append(Ball(c, reach, tuple((j, w) for w, j in ways if reach is None or w <= 4 * reach)))
    return out


def _moved(reach: int, way: int) -> int:
    """The square of two lengths' sum, rounded up, from their squares."""
    return (math.isqrt(reach) + 1 + math.isqrt(way) + 1) ** 2


def assign(vectors: np.ndarray, cluster: np.ndarray, at: list[Ball]) -> tuple[np.ndarray, np.ndarray]:
    """New clusters and squared distances of the members of a batch; the vectors are whole doubles or whole numbers."""
    new, best = cluster.copy(), np.zeros(len(vectors), vectors.dtype)
    for i in np.unique(cluster):
        members = np.flatnonzero(cluster == i)
        own = ((vectors[members] - np.array(at[i].centre, vectors.dtype)) ** 2).sum(1)
        best[members] = own
        open_, far = members, own  # beyond the core; each step leaves an annulus
        for j, way in at[i].near:
            rest = 4 * far >= way
            open_, far = open_[rest], far[rest]
            if not len(open_):
                break
            d = ((vectors[open_] - np.array(at[j].centre, vectors.dtype)) ** 2).sum(1)
            nearer = (d < best[open_]) | ((d == best[open_]) & (j < new[open_]))
            best[open_[nearer]], new[open_[nearer]] = d[nearer], j
    return new, best


def _longs(values: np.ndarray) -> np.ndarray:
    if len(values) and (values.max() >= 2**63 or values.min() < -(2**63)):
        raise ValueError("a distance or a sum doesn't fit in a long")
    return values.astype(np.int64)


def _round(at: list[Ball], dim: int):
    """A pass: rows with their new cluster, then a row of sums for each cluster the task has seen."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = [np.zeros(dim, object) for _ in at], [0] * len(at)
        reach, inertia = [0] * len(at), [0] * len(at)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("v")
            whole = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            small = max(abs(int(whole.min())), abs(int(whole.max())), *(max(map(abs, b.centre)) for b in at)) < PLAIN
            vectors = whole.astype(np.float64) if small else whole.astype(object)
            cluster, distance = assign(vectors, batch.column("cluster").to_numpy(zero_copy_only=False), at)
            distance = _longs(distance)
            for i in np.unique(cluster):
                mine = cluster == i
                sums[i] = sums[i] + (whole[mine] if small else whole[mine].astype(object)).sum(0)
                n[i] += int(mine.sum())
                reach[i], inertia[i] = max(reach[i], int(distance[mine].max())), inertia[i] + sum(map(int, distance[mine]))
            rows = [batch.column("vec_id"), column, pa.array(cluster, pa.int32()), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(rows + [pa.nulls(len(cluster), t) for t in (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64())], NAMES)
        seen = [i for i in range(len(at)) if n[i]]
        totals = [_longs(np.array([*sums[i], inertia[i]], object)).tolist() for i in seen]
        told = [pa.array(seen, pa.int32()), pa.nulls(len(seen), pa.int64()), pa.array([n[i] for i in seen], pa.int64()), pa.array([t[:-1] for t in totals], pa.list_(pa.int64())), pa.array([reach[i] for i in seen], pa.int64()), pa.array([t[-1] for t in totals], pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(seen), pa.int64()), pa.nulls(len(seen), pa.list_(pa.int64())), *told], NAMES)

    return passed


def _told(state: DataFrame, dim: int) -> dict[int, tuple[int, int, int, list[int]]]:
    """Of each cluster: members, farthest squared distance, inertia, sums of components. One row a cluster reaches the driver."""
    parts = state.where("n is not null")
    sums = parts.select("cluster", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    by = {(r.cluster, r.at): int(r.s) for r in sums.collect()}
    size = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("reach").alias("reach"), F.sum(F.col("inertia").cast("decimal(20,0)")).alias("inertia"))
    return {r.cluster: (r.n, r.reach, int(r.inertia), [by[r.cluster, j] for j in range(dim)]) for r in size.collect()}


def as_integers(embedding, scale: int):
    """Components as whole numbers, floor(scale * x); one that is too large to be told from its neighbours is an error."""
    whole = lambda x: F.floor(x.cast("double") * scale)
    return F.transform(embedding, lambda x: F.when(F.abs(x.cast("double") * scale) < float(WIDEST), whole(x)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long")))


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3") -> DataFrame:
    """Each kept vector's cluster: vec_id, cluster, distance, cluster_inertia, inertia, centroid (whole components)."""
    spark = vectors.sparkSession
    good = vectors.where(usable(F.col("embedding")) & (F.size("embedding") == dim))
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), as_integers(F.col("embedding"), scale).alias("v"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in STATE.split(", ")[4:])]
    # all begin in the first ball, whose reach isn't known
    state = written(good.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), *none), "ball-rows")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    centres = [tuple(r.v) for r in state.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()]
    if not centres:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<decimal(38,0)>")
    reaches: list[int | None] = [None] * len(centres)
    for again in range(rounds + 1):
        last, state = state, written(state.where("v is not null").mapInArrow(_round(balls(centres, reaches), dim), STATE), "ball-rows")
        discard(last)
        told = _told(state, dim)
        if again < rounds:
            old, centres = centres, [tuple(s // told[i][0] for s in told[i][3]) if i in told else c for i, c in enumerate(centres)]
            reaches = [_moved(told[i][1], _squared(old[i], c)) if i in told else 0 for i, c in enumerate(centres)]
    inertia = sum(t[2] for t in told.values())
    if inertia >= 2**63:
        raise ValueError("the inertia doesn't fit in a long")
    # k rows
    names = spark.createDataFrame([(i, told[i][2], inertia, ",".join(map(str, c))) for i, c in enumerate(centres) if i in told], "cluster int, cluster_inertia long, inertia long, centroid string")
    rows = state.where("v is not null").select("vec_id", "cluster", "distance").join(F.broadcast(names), "cluster")
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.split("centroid", ",").cast("array<decimal(38,0)>").alias("centroid"))


def digest(centroid) -> object:
    """The lowercase hex sha256 of components joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ",").cast("binary"), 256)


def brute_force(rows: list[tuple[int | None, list[int]]], k: int = 8, rounds: int = 10, seed: str = "3") -> list[tuple[int | None, int, int]]:
    """Lloyd's rounds that compare all with all: id, cluster, squared distance, in the order of the rows."""
    first = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in first[:k]]
    out = []
    for again in range(rounds + 1):
        found = [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in rows]
        out = [(i, j, d) for (i, _), (d, j) in zip(rows, found, strict=True)]
        if again < rounds:
            for j in range(len(centres)):
                mine = [v for (_, v), (_, of) in zip(rows, found, strict=True) if of == j]
                centres[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else centres[j]
    return out


def oracle_sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """The same by comparing all with all, for DuckDB."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS HUGEINT)) AS v
            FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT {k}))",
    ]
    way = "list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for t in range(rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(w).c AS c, min(w).d AS d FROM (SELECT v.r, v.vec_id, v.v, {{'d': {way}, 'c': c.c}} AS w FROM v, c{t} c) GROUP BY r)")
        if t < rounds:
            steps.append(f"""s{t} AS (SELECT c, i, (s - ((s % n) + n) % n) // n AS x FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{t}) GROUP BY ALL))""")
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.v, o.v) AS v FROM c{t} o LEFT JOIN (SELECT c, list(CAST(x AS HUGEINT) ORDER BY i) AS v FROM s{t} GROUP BY c) n USING (c))")
    return f"""WITH {', '.join(steps)} SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"""
