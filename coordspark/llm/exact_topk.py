"""Exact inner-product search by norm-sorted scans with rotated partial sums.

Components become floor(256 * x). The usable rows are written once as a table, range
partitioned and sorted by descending length, so each task meets its longest rows first.
An orthogonal rotation, the right singular vectors of a bounded sample, gathers a vector's
energy in its first ``HEAD`` coordinates.

Queries never pass through the driver: tasks write them to the shared folder in blocks of at
most ``QUERY_BYTES`` with each query's threshold, its k-th best score among the ``SEED_ROWS``
longest vectors, and the driver lists the files. Each task takes the candidates it scans in
batches and reads the blocks for each batch, so memory holds one of either and candidates are
not shuffled again. A block is passed over when the batch's longest row can't reach its least
threshold. In a batch, what the first coordinates give, plus the product of the residual
lengths (Cauchy-Schwarz), bounds the score, and pairs whose bound is below the query's
threshold or k-th best in the batch are never finished.

Survivors get exact integer products: doubles where the lengths' product is below 2**53,
whole numbers beyond. A score outside a long is an error.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do
rows without id; vectors of another length than the query's never meet it. Rows are told
apart by themselves: of a repeated id each row is a query and a candidate of its own, and a
query meets all rows but itself. Ties go to the smaller id. Other columns are ignored,
whatever their names. Empty tables give no row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.feather as feather
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordspark.llm.tables import opened, shared_dir, written

HEAD, SAMPLE_ROWS, SEED_ROWS = 24, 2000, 2000
QUERY_BYTES, BATCH_BYTES = 16 << 20, 16 << 20
QUERIES = 256
#: Sums of whole products are exact in doubles below this.
EXACT = 2.0**53
SCHEMA = "query_row long, query_id long, vec_id long, row long, score long"
FILES = "path string, longest double, least double"


def as_integers(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * 256).cast("double"))


def usable(embedding: Column) -> Column:
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if len(column) else np.zeros((0, dim))


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(1))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs of rows, as whole numbers."""
    out = np.einsum("ij,ij->i", a, b)
    wide = np.flatnonzero(~(_norms(a) * _norms(b) < EXACT))
    if not len(wide):
        return out.astype(np.int64)
    whole = [sum(int(x) * int(y) for x, y in zip(a[k], b[k], strict=True)) for k in wide]
    if any(not -(2**63) <= x < 2**63 for x in whole):
        raise ValueError("a score doesn't fit in a long")
    keep = np.delete(np.arange(len(out)), wide)
    found = np.empty(len(out), np.int64)
    found[keep], found[wide] = out[keep].astype(np.int64), whole
    return found


class Best:
    """The k best candidate rows of each query, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id, self.row = np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1, np.int64)

    def bar(self, part: slice) -> np.ndarray:
        return np.where(self.row[part, -1] >= 0, self.score[part, -1].astype(float), -np.inf)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Merge found pairs; work is done for the queries they touch only."""
        some, at = np.unique(q, return_inverse=True)
        owner = np.concatenate([np.repeat(np.arange(len(some)), self.k), at])
        s, i, r = (np.concatenate([old[some].ravel(), new]) for old, new in ((self.score, score), (self.id, ids), (self.row, rows)))
        _, level = np.unique(s, return_inverse=True)
        order = np.lexsort((r, i, -level, r < 0, owner))
        owner, s, i, r = owner[order], s[order], i[order], r[order]
        top = np.arange(len(owner)) - np.searchsorted(owner, owner) < self.k
        for old, new in ((self.score, s), (self.id, i), (self.row, r)):
            old[some] = new[top].reshape(-1, self.k)


def scan(best: Best, floor: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, rotation: np.ndarray, ids: np.ndarray, numbers: np.ndarray, rows: np.ndarray) -> None:
    """Meet one batch of candidates, longest first."""
    norm = _norms(rows)
    order = np.argsort(-norm, kind="stable")
    ids, numbers, rows, norm = ids[order], numbers[order], rows[order], norm[order]
    head = rows @ rotation
    rest = np.sqrt(np.maximum(norm**2 - (head * head).sum(1), 0))
    for a in range(0, len(queries), QUERIES):
        q = queries[a : a + QUERIES]
        q_norm = _norms(q)
        q_head = q @ rotation
        q_rest = np.sqrt(np.maximum(q_norm**2 - (q_head * q_head).sum(1), 0))
        for b in range(0, len(rows), 1024):
            bar = np.maximum(best.bar(slice(a, a + len(q))), floor[a : a + len(q)])
            slack = 1e-9 * q_norm * norm[b] + 1e-6  # of the rotation's rounding
            if not (q_norm * norm[b] + slack >= bar).any():
                break
            part = slice(b, b + 1024)
            bound = q_head @ head[part].T + np.outer(q_rest, rest[part])
            open_q, open_c = np.nonzero(bound + slack[:, None] >= bar[:, None])
            if not len(open_q):
                continue
            if 4 * len(open_q) > bound.size and q_norm.max() * norm[b] < EXACT:
                score = (q @ rows[part].T)[open_q, open_c].astype(np.int64)
            else:
                score = _products(q[open_q], rows[part][open_c])
            good = (score >= bar[open_q]) & (numbers[part][open_c] != query_rows[a + open_q])
            if good.any():
                best.add(a + open_q[good], score[good], ids[part][open_c[good]], numbers[part][open_c[good]])


def _query_blocks(folder: str, dim: int, k: int, block: int, rotation: np.ndarray, seeds: tuple[np.ndarray, ...]):
    """Write the queries of a task in blocks, each with its thresholds; one row a file."""
    fields = ("row", "vec_id", "v")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, block // (8 * dim))
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            queries, rows = _matrix(table.column("v").combine_chunks(), dim), table.column("row").to_numpy()
            best = Best(len(queries), k)
            scan(best, np.full(len(queries), -np.inf), rows, queries, rotation, *seeds)
            floor = best.bar(slice(None))
            fs, base = opened(folder)
            fs.create_dir(base, recursive=True)
            name = f"{uuid.uuid4().hex}.arrow"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                feather.write_feather(table.append_column("floor", pa.array(floor)), out)
            held.clear()
            path = f"{folder}/{name}"
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([float(_norms(queries).max())]), pa.array([float(floor.min())])], [f.split()[0] for f in FILES.split(", ")])

        for batch in batches:
            batch = batch.select(fields)
            for a in range(0, batch.num_rows, most):
                held.append(batch.slice(a, most))
                if sum(h.num_rows for h in held) >= most:
                    yield flush()
        if held:
            yield flush()

    return blocks


def _scanner(files: list[tuple[str, float, float]], dim: int, k: int, rotation: np.ndarray, size: int):
    def met(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, numbers, vectors = rows.column("vec_id").to_numpy(), rows.column("row").to_numpy(), _matrix(rows.column("v").combine_chunks(), dim)
        top = _norms(vectors).max()
        for path, longest, least in files:
            if longest * top * (1 + 1e-9) + 1e-6 < least:
                continue
            fs, name = opened(path)
            with fs.open_input_file(name) as f:
                block = feather.read_table(f, memory_map=False)
            query_rows, query_ids, queries = block.column("row").to_numpy(), block.column("vec_id").to_numpy(), _matrix(block.column("v").combine_chunks(), dim)
            best = Best(len(queries), k)
            scan(best, block.column("floor").to_numpy(), query_rows, queries, rotation, ids, numbers, vectors)
            q, j = np.nonzero(best.row >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (query_rows[q], query_ids[q], best.id[q, j], best.row[q, j], best.score[q, j])], [f.split()[0] for f in SCHEMA.split(", ")])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, held = max(1, size // (8 * dim)), []
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                held.append(batch.slice(a, most))
                if sum(h.num_rows for h in held) >= most:
                    yield from met(pa.Table.from_batches(held).combine_chunks())
                    held = []
        if held:
            yield from met(pa.Table.from_batches(held).combine_chunks())

    return scanned


def top_k(vectors: DataFrame, query: Column, k: int = 5, query_bytes: int = QUERY_BYTES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Each query row's k best other rows: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    good = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), as_integers(F.col("embedding")).alias("v"), F.coalesce(query, F.lit(False)).alias("asked"))
    good = good.withColumn("dim", F.size("v")).withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    ranged = good.repartitionByRange("dim", F.desc("norm")).sortWithinPartitions("dim", F.desc("norm"), "vec_id")
    rows = written(ranged.withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    folder = f"{shared_dir(spark).rstrip('/')}/topk-queries-{uuid.uuid4().hex}"
    found = []
    # one pass per vector length; a table normally has one
    for dim in [r.dim for r in rows.where("asked").select("dim").distinct().orderBy("dim").collect()]:
        same = rows.where(F.col("dim") == dim)
        sample = np.array([r.v for r in same.orderBy(F.xxhash64("vec_id"), "v").limit(SAMPLE_ROWS).collect()])
        rotation = np.ascontiguousarray(np.linalg.svd(sample, full_matrices=False)[2][: min(HEAD, dim)].T)
        longest = same.orderBy(F.desc("norm"), "row").limit(SEED_ROWS).collect()
        seeds = (np.array([r.vec_id for r in longest]), np.array([r.row for r in longest]), np.array([r.v for r in longest]))
        asked = same.where("asked").select("row", "vec_id", "v").mapInArrow(_query_blocks(folder, dim, k, query_bytes, rotation, seeds), FILES)
        files = [tuple(r) for r in written(asked, "topk-files").collect()]  # a name for each block of queries
        found.append(same.select("row", "vec_id", "v").mapInArrow(_scanner(files, dim, k, rotation, batch_bytes), SCHEMA))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # each batch gives k rows a query at most
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    best = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(w))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
