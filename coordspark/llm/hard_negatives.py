"""Hard negatives by one-dimensional distance keys.

Vectors of whole components get one more, sqrt(M**2 - |x|**2) for the longest length M, and
anchors a zero: then D**2 = |q|**2 + M**2 - 2 * score, so the highest scores are the nearest
vectors and a range of scores is an annulus around the anchor. Each vector's key is its
nearest pivot, out of a bounded sample, and its distance to it. The index is a table sorted by
(pivot, distance) and cut into blocks; a pivot's sorted distances are cut into strips of about
``STRIP`` rows, at most ``STRIPS`` a pivot, so what the driver knows of the index is a list of
bounded length at any size of the table.

A search goes in steps. Anchors lie in packs, near ones together. For each anchor and strip the
triangle inequality bounds the scores in it from above and below: a strip that lies in the
annulus or nearer than it is not passed over until its bound falls below what the anchor has
found. Each step lets packs meet the blocks of the next strips, the most promising first, and
twice as many strips each time; an anchor is done once no strip left could hold a row as good
as its last one, which certifies its rows. No step leaves out what a bound allows, so rows are
those of comparing all.

A pack is never sent along with each block it meets: that is as many copies as there are strips,
which grow with the table. Tasks write the packs of a step to the shared folder, a file each, and
the driver knows their names and strips, one for ``PACK_ROWS`` anchors. A task that reads blocks
takes ``BATCH_BYTES`` of them and reads the packs that ask for their strips.

The positives are one search (same label, k rows). The negatives are a second one: a window of
scores for each positive, whose outer end is where the expansion begins. Blocks are read as they
were written, in files of about ``PART`` blocks, so neither a strip that a third of the rows fall
into nor a strip that all anchors need is one task's. Files stay small as their readers take
thousands of rows at once, and a row that is a block or a pack is up to a megabyte or so.

Scores are exact: doubles where the lengths' product is below 2**53, Python's whole numbers
beyond; one outside a long is an error. Rows with a null label, null or empty vectors, null or
non-finite components, or no id take no part; vectors of another length never meet. Rows are
told apart by themselves: of a repeated id each row is an anchor and a candidate of its own.
Ties go to the smaller id. Anchors without positives, and positives without negatives, give no
row; so does an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.feather as feather
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordspark.llm.exact_topk import EXACT, Best, as_integers, usable
from coordspark.llm.tables import discard, opened, shared_dir, written

PIVOTS, SAMPLE_ROWS = 16, 2000
STRIP, STRIPS = 2048, 64
BLOCK_ROWS, BLOCK_BYTES, PACK_ROWS, BATCH_BYTES = 1024, 1 << 20, 256, 16 << 20
#: Blocks and packs in a file.
PART, SHARE = 64, 256
FIRST = 8
KEYED = "row long, vec_id long, label int, v array<double>, asked boolean, pivot int, key double, near double"
BLOCK = "strip int, block long, dim int, least double, most double, longest double, n int, rows binary, ids binary, labels binary, m binary"
FOUND = "pack long, query_row long, slot int, vec_id long, row long, score long"
LONG = np.int64
NONE = np.iinfo(LONG).min


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def _fit(dim: int, most: int) -> int:
    """Vectors of a block or pack."""
    return max(1, min(most, BLOCK_BYTES // (8 * dim)))


def _packed(values: np.ndarray, kind=LONG) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _ways(v: np.ndarray, lift: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of lifted vectors to pivots, which have the lifted component last."""
    square = (v * v).sum(1) + lift * lift
    cross = v @ pivots[:, :-1].T + np.outer(lift, pivots[:, -1])
    return np.sqrt(np.maximum(square[:, None] + (pivots * pivots).sum(1) - 2 * cross, 0))


def choose_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Rows of a sample that lie far apart, then the mean of those nearest to each."""
    picked = [0]
    ways = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(most, len(sample)) and ways.max() > 0:
        picked.append(int(ways.argmax()))
        ways = np.minimum(ways, ((sample - sample[picked[-1]]) ** 2).sum(1))
    pivots = sample[picked]
    nearest = ((sample[:, None] - pivots) ** 2).sum(2).argmin(1)
    return np.array([sample[nearest == k].mean(0) if (nearest == k).any() else p for k, p in enumerate(pivots)])


def _keyed(pivots: dict[int, tuple[int, np.ndarray]], longest: dict[int, float]):
    """Rows with their key; anchors with the pivot they are near to, for packing."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                v, (first, at) = _matrix(part.column("v"), int(dim)), pivots[int(dim)]
                norm = (v * v).sum(1)
                ways = _ways(v, np.sqrt(np.maximum(longest[int(dim)] ** 2 - norm, 0)), at)
                own = ways.argmin(1)
                asked = _ways(v, np.zeros(len(v)), at).argmin(1)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "vec_id", "label", "v", "asked")), pa.array((first + own).astype(np.int32)), pa.array(ways[np.arange(len(v)), own]), pa.array((first + asked).astype(float))], _names(KEYED))

    return keys


def _blocks(bounds: dict[int, tuple[int, np.ndarray]]):
    """Consecutive rows of a strip as one row; bounds: of each pivot its first strip and the keys at which later ones begin."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number = 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            strip, dim = held[0][0], held[0][1]
            rows, ids, labels, keys, v = (np.concatenate([h[k] for h in held]) for k in range(2, 7))
            held.clear()
            number += 1
            norm = float(np.sqrt((v * v).sum(1)).max())
            block = hash((strip, int(rows[0]), number)) & (2**62 - 1)
            return pa.RecordBatch.from_pylist([{"strip": strip, "block": block, "dim": dim, "least": float(keys.min()), "most": float(keys.max()), "longest": norm, "n": len(rows), "rows": _packed(rows), "ids": _packed(ids), "labels": _packed(labels), "m": _packed(v, np.float64)}], _arrow(BLOCK))

        for batch in batches:
            if not batch.num_rows:
                continue
            pivot, key = batch.column("pivot").to_numpy(), batch.column("key").to_numpy()
            strip = np.array([bounds[p][0] + np.searchsorted(bounds[p][1], x, side="right") for p, x in zip(pivot.tolist(), key.tolist(), strict=True)])
            edges = np.flatnonzero(np.diff(strip)) + 1
            for a, b in zip([0, *edges], [*edges, len(strip)], strict=True):
                if held and held[0][0] != strip[a]:
                    yield flush()
                dim = len(batch.column("v")[int(a)])
                most = _fit(dim, BLOCK_ROWS)
                for s in range(a, b, most):
                    part = batch.slice(s, min(b, s + most) - s)
                    held.append((int(strip[a]), dim, *(part.column(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "label", "key")), _matrix(part.column("v"), dim)))
                    if sum(len(h[2]) for h in held) >= most:
                        yield flush()
        if held:
            yield flush()

    return cut


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors that lie near each other, several a row."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        rows, ids, labels, v = (np.concatenate([h[k] for h in held]) for k in range(1, 5))
        dim = held[0][0]
        held.clear()
        return pa.RecordBatch.from_pylist([{"pack": int(rows[0]), "dim": dim, "rows": _packed(rows), "ids": _packed(ids), "labels": _packed(labels), "m": _packed(v, np.float64)}], _arrow(PACK))

    for batch in batches:
        if not batch.num_rows:
            continue
        dims = batch.column("dim").to_numpy()
        edges = np.flatnonzero(np.diff(dims)) + 1
        for a, b in zip([0, *edges], [*edges, len(dims)], strict=True):
            if held and held[0][0] != dims[a]:
                yield flush()
            most = _fit(int(dims[a]), PACK_ROWS)
            for s in range(a, b, most):
                part = batch.slice(s, min(b, s + most) - s)
                held.append((int(dims[a]), *(part.column(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "label")), _matrix(part.column("v"), int(dims[a]))))
                if sum(len(h[1]) for h in held) >= most:
                    yield flush()
    if held:
        yield flush()


PACK = "pack long, dim int, rows binary, ids binary, labels binary, m binary"
#: What a search asks of a pack: lowest and highest scores and the least score still of use, a number for each slot of each anchor.
ASKED = "low binary, high binary, bar binary, done int"
TAKEN = f"{PACK}, {ASKED}, strips array<int>"
FILED = "name string, strips array<int>"


def _long(data: bytes, columns: int | None = None) -> np.ndarray:
    out = np.frombuffer(data, LONG)
    return out if columns is None else out.reshape(-1, columns)


def bounds_of(v: np.ndarray, pivots: np.ndarray, of: np.ndarray, least: np.ndarray, most: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """For anchors and strips, the lowest and highest score that a row of the strip can have."""
    ways = _ways(v, np.zeros(len(v)), pivots)[:, of]
    near, far = np.maximum(np.maximum(ways - most, least - ways), 0), ways + most
    whole = (v * v).sum(1)[:, None] + longest**2
    slack = 1e-9 * whole + 1e-6  # of the roots' rounding
    return (whole - far**2) / 2 - slack, (whole - near**2) / 2 + slack


def _chosen(strips: dict[int, tuple], width: int, slots: int):
    """The next strips of each pack, at most ``width`` of them; strips holds by length: pivots, longest, and of each strip its number, pivot and keys."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack in batch.to_pylist():
                pivots, longest, number, of, least, most = strips[pack["dim"]]
                v = np.frombuffer(pack["m"]).reshape(-1, pack["dim"])
                lower, upper = bounds_of(v, pivots, of, least, most, longest)
                low, high, bar = (_long(pack[c], slots) for c in ("low", "high", "bar"))
                need = np.maximum(low, bar)
                # of the anchors that could find something there, the best the strip could give: ranked by what is open most
                open_ = (upper[:, :, None] >= need[:, None, :]) & (lower[:, :, None] <= high[:, None, :]) & (low <= high)[:, None, :]
                promise = np.where(open_.any(2), upper, -np.inf).max(0)
                order = np.argsort(-promise, kind="stable")
                # strips taken before come again with the same promise or less: the ones done are kept by number
                taken = set(pack["strips"] or [])
                new = [int(number[k]) for k in order if np.isfinite(promise[k]) and int(number[k]) not in taken][:width]
                if new:
                    yield pa.RecordBatch.from_pylist([pack | {"strips": new}], _arrow(TAKEN))

    return choose


class Searched:
    """The rows found for a pack by a task, by slot, with the bars that rise as it goes."""

    def __init__(self, pack: dict, k: int, slots: int, same: bool):
        self.k, self.same, self.pack = k, same, pack["pack"]
        self.rows, self.ids, self.labels = (_long(pack[c]) for c in ("rows", "ids", "labels"))
        self.v = np.frombuffer(pack["m"]).reshape(-1, pack["dim"])
        self.low, self.high = (_long(pack[c], slots) for c in ("low", "high"))
        self.floor = _long(pack["bar"], slots)
        self.best = [Best(len(self.rows), k) for _ in range(slots)]
        self.norm = float(np.sqrt((self.v * self.v).sum(1)).max())

    def meet(self, block: dict) -> None:
        x = np.frombuffer(block["m"]).reshape(-1, block["dim"])
        ids, rows, labels = (_long(block[c]) for c in ("ids", "rows", "labels"))
        if self.norm * block["longest"] < EXACT:
            score = (self.v @ x.T).astype(LONG)
        else:
            wide = np.array([[int(z) for z in a] for a in self.v], object) @ np.array([[int(z) for z in a] for a in x], object).T
            if wide.max() >= 2**63 or wide.min() <= NONE:
                raise ValueError("a score doesn't fit in a long")
            score = wide.astype(LONG)
        fits = (self.labels[:, None] == labels) == self.same
        fits &= self.rows[:, None] != rows
        score[~fits] = NONE
        top = score.max(1)
        for slot, best in enumerate(self.best):
            bar = np.maximum(np.maximum(self.low[:, slot], self.floor[:, slot]), np.where(best.row[:, -1] >= 0, best.score[:, -1], NONE + 1))
            some = np.flatnonzero(top >= bar)
            if not len(some):
                continue
            good = score[some]
            good[(good < bar[some, None]) | (good > self.high[some, slot, None])] = NONE
            if good.shape[1] > self.k:
                good[good < np.partition(good, -self.k, axis=1)[:, -self.k, None]] = NONE
            q, c = np.nonzero(good > NONE)
            if len(q):
                best.add(some[q], good[q, c], ids[c], rows[c])

    def told(self) -> Iterator[pa.RecordBatch]:
        for slot, best in enumerate(self.best):
            q, j = np.nonzero(best.row >= 0)
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), self.pack)), pa.array(self.rows[q]), pa.array(np.full(len(q), slot, np.int32)), pa.array(best.id[q, j]), pa.array(best.row[q, j]), pa.array(best.score[q, j])], _names(FOUND))


def _filed(folder: str):
    """Packs as files of the folder; one row a file."""

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        for batch in batches:
            for r in range(batch.num_rows):
                name = f"{uuid.uuid4().hex}.arrow"
                fs.create_dir(base, recursive=True)
                with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                    feather.write_feather(pa.Table.from_batches([batch.slice(r, 1)]).drop_columns(["strips"]), out)
                yield pa.RecordBatch.from_arrays([pa.array([name]), batch.column("strips").slice(r, 1)], _names(FILED))

    return filed


def _scanned(folder: str, files: list[str], of: np.ndarray, strip: np.ndarray, k: int, slots: int, same: bool):
    """Blocks meet the packs that ask for their strips: of a number in ``files``, a strip for each time it asks, sorted by strip."""

    def met(blocks: list[dict]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        asked: dict[int, list[int]] = {}
        for b, block in enumerate(blocks):
            for f in of[np.searchsorted(strip, block["strip"]) : np.searchsorted(strip, block["strip"], side="right")]:
                asked.setdefault(int(f), []).append(b)
        for f, places in asked.items():
            with fs.open_input_file(f"{base}/{files[f]}") as data:
                pack = Searched(feather.read_table(data, memory_map=False).to_pylist()[0], k, slots, same)
            for b in places:
                pack.meet(blocks[b])
            yield from pack.told()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for r in range(batch.num_rows):
                held.append({c: batch.column(c)[r].as_py() for c in batch.schema.names})
                size += len(held[-1]["m"])
                if size >= BATCH_BYTES:
                    yield from met(held)
                    held, size = [], 0
        if held:
            yield from met(held)

    return scan


class Index:
    """Blocks sorted by (pivot, distance), their strips, and packs of anchors."""

    def __init__(self, vectors: DataFrame, anchor: Column):
        spark = vectors.sparkSession
        good = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
        good = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), as_integers(F.col("embedding")).alias("v"), F.coalesce(anchor, F.lit(False)).alias("asked"))
        good = good.withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("v")})
        rows = written(good.withColumn("square", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), "negatives-rows")
        longest = {r.dim: float(np.sqrt(r.m)) * (1 + 1e-12) for r in rows.groupBy("dim").agg(F.max("square").alias("m")).collect()}  # a row for each length of vectors
        pivots, first = {}, 0
        for dim in sorted(longest):
            sample = np.array([r.v for r in rows.where(F.col("dim") == dim).orderBy(F.xxhash64("row")).limit(SAMPLE_ROWS).select("v").collect()])
            lifted = np.column_stack([sample, np.sqrt(np.maximum(longest[dim] ** 2 - (sample * sample).sum(1), 0))])
            pivots[dim] = (first, choose_pivots(lifted))
            first += len(pivots[dim][1])
        self.spark, self.empty = spark, not longest
        if self.empty:
            return
        keyed = written(rows.select("row", "vec_id", "label", "v", "asked", "dim").mapInArrow(_keyed(pivots, longest), KEYED), "negatives-keys")
        discard(rows)
        # quantiles need be near only: strips differ in size then, not in what they hold
        cuts = keyed.groupBy("pivot").agg(F.count("*").alias("n"), F.count_if("asked").alias("asked"), F.percentile_approx("key", [k / STRIPS for k in range(1, STRIPS)], 1000).alias("q")).collect()
        bounds, strip = {}, 0
        for r in sorted(cuts, key=lambda r: r.pivot):
            parts = min(STRIPS, -(-r.n // STRIP))
            at = np.unique([r.q[-(-k * STRIPS // parts) - 1] for k in range(1, parts)]) if parts > 1 else np.zeros(0)
            bounds[r.pivot] = (strip, at)
            strip += len(at) + 1
        dims = {first + k: dim for dim, (first, vectors_) in pivots.items() for k in range(len(vectors_))}
        blocks, packs = (sum(-(-r[c] // _fit(dims[r.pivot], most)) for r in cuts) for c, most in (("n", BLOCK_ROWS), ("asked", PACK_ROWS)))
        cores = 4 * spark.sparkContext.defaultParallelism
        parts, self.shares = (max(1, -(-rows // most), min(cores, rows // 4)) for rows, most in ((blocks, PART), (packs, SHARE)))
        ranged = keyed.repartitionByRange(parts, "pivot", "key", F.xxhash64("row")).sortWithinPartitions("pivot", "key")
        self.blocks = written(ranged.mapInArrow(_blocks(bounds), BLOCK), "negatives-blocks")
        heads = self.blocks.groupBy("dim", "strip").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect()
        at = {s: p for p, (first, cut) in bounds.items() for s in range(first, first + len(cut) + 1)}
        self.strips = {}
        for dim, (first, vectors_) in pivots.items():
            mine = sorted((r.strip, at[r.strip] - first, r.least, r.most) for r in heads if r.dim == dim)
            number, of, least, most = (np.array(x) for x in zip(*mine, strict=True))
            self.strips[dim] = (vectors_, longest[dim], number, of, least, most)
        asked = keyed.where("asked").withColumn("dim", F.size("v")).repartitionByRange(self.shares, "dim", "near", F.xxhash64("row")).sortWithinPartitions("dim", "near", "row")
        self.packs = written(asked.select("row", "vec_id", "label", "v", "dim").mapInArrow(_packs, PACK), "negatives-packs")
        discard(keyed)

    def search(self, packs: DataFrame, k: int, slots: int, same: bool) -> DataFrame:
        """The best k rows of each slot of each anchor: pack, query_row, slot, vec_id, row, score, rank. The packs have low and high."""
        none = F.lit(None)
        state = packs.withColumns({"bar": F.col("low"), "done": F.lit(0), "strips": none.cast("array<int>")})
        order = Window.partitionBy("query_row", "slot").orderBy(F.desc("score"), "vec_id", "row")
        best, width = None, FIRST
        while True:
            asked = written(state.mapInArrow(_chosen(self.strips, width, slots), TAKEN), "negatives-asked")
            if asked.isEmpty():
                discard(asked)
                break
            folder = f"{shared_dir(self.spark).rstrip('/')}/negatives-packs-{uuid.uuid4().hex}"
            # a name for each pack, and the numbers of at most PIVOTS * STRIPS strips
            files = written(asked.mapInArrow(_filed(folder), FILED), "negatives-files").collect()
            of, strip = np.repeat(np.arange(len(files), dtype=np.int32), [len(r.strips) for r in files]), np.concatenate([np.array(r.strips, np.int32) for r in files])
            by_strip = np.argsort(strip, kind="stable")
            scan = _scanned(folder, [r.name for r in files], of[by_strip], strip[by_strip], k, slots, same)
            blocks = self.blocks.where(F.col("strip").isin(np.unique(strip).tolist()))
            found = blocks.select("strip", "dim", "longest", "rows", "ids", "labels", "m").mapInArrow(scan, FOUND)
            if best is not None:
                found = found.unionAll(best.drop("rank"))
            last, best = best, written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "negatives-found")
            if last is not None:
                discard(last)
            at = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
            # a pack holds few anchors, an anchor has one k-th row a slot
            bars = best.where(F.col("rank") == k).groupBy("pack").agg(F.collect_list(F.struct("query_row", "slot", "score")).alias("bars"))
            state = asked.select("pack", "strips").join(bars, "pack", "left")
            state = self._risen(packs if width == FIRST else before, state, slots)
            before = state = written(state, "negatives-state")
            width *= 2
        if best is None:
            return self.spark.createDataFrame([], f"{FOUND}, rank int")
        return best

    def beside(self, packs: DataFrame, told: DataFrame) -> DataFrame:
        """Packs with what is told of them, by a shuffle: vectors pack well, so the size of a file says little of what sending it to all takes."""
        return packs.repartition(self.shares, "pack").hint("merge").join(told, "pack")

    def _risen(self, packs: DataFrame, told: DataFrame, slots: int) -> DataFrame:
        """The packs that were asked, with their bars and the strips they have seen."""
        def rise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for pack in batch.to_pylist():
                    bar = _long(pack["low"], slots).copy()
                    place = {int(r): i for i, r in enumerate(_long(pack["rows"]))}
                    for b in pack["bars"] or []:
                        at = place[b["query_row"]], b["slot"]
                        bar[at] = max(bar[at], b["score"])
                    yield pa.RecordBatch.from_pylist([{c: pack[c] for c in _names(PACK) + ["low", "high"]} | {"bar": _packed(bar), "done": 1, "strips": (pack["seen"] or []) + pack["strips"]}], _arrow(TAKEN))

        seen = F.col("strips") if "strips" in packs.columns else F.lit(None).cast("array<int>")
        old = packs.select(*_names(PACK), "low", "high", seen.alias("seen"))
        return self.beside(old, told).mapInArrow(rise, TAKEN)


def _unbounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pack in batch.to_pylist():
            n = len(_long(pack["rows"]))
            yield pa.RecordBatch.from_pylist([pack | {"low": _packed(np.full(n, NONE + 1)), "high": _packed(np.full(n, np.iinfo(LONG).max))}], _arrow(f"{PACK}, low binary, high binary"))


def _windows(k: int, least: int, most: int):
    """Packs whose slots are the windows of scores of each anchor's positives; a missing one is empty."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack in batch.to_pylist():
                rows = _long(pack["rows"])
                low, high = np.ones((len(rows), k), LONG), np.zeros((len(rows), k), LONG)
                place = {int(r): i for i, r in enumerate(rows)}
                for p in pack["positives"]:
                    at = place[p["query_row"]], p["rank"] - 1
                    low[at], high[at] = -((-least * p["score"]) // 100), most * p["score"] // 100
                yield pa.RecordBatch.from_pylist([{c: pack[c] for c in _names(PACK)} | {"low": _packed(low), "high": _packed(high)}], _arrow(f"{PACK}, low binary, high binary"))

    return windows


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of other labels whose score is ``least`` to ``most`` hundredths of the positive's.

    anchor_id, positive_id, rank, negative_id, positive_score, negative_score; the vectors have vec_id, label, embedding.
    """
    index = Index(vectors, anchor)
    if index.empty:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    everything = index.packs.mapInArrow(_unbounded, f"{PACK}, low binary, high binary")
    near = index.search(written(everything, "negatives-asked"), positives, 1, True)
    told = near.groupBy("pack").agg(F.collect_list(F.struct("query_row", "rank", "score")).alias("positives"))  # of a pack's few anchors
    windows = index.beside(index.packs, told).mapInArrow(_windows(positives, least, most), f"{PACK}, low binary, high binary")
    far = index.search(written(windows, "negatives-asked"), negatives, positives, False)
    good = near.select("query_row", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.select("query_row", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(good, ["query_row", "slot"])
    names = index.packs.mapInArrow(_anchors, "query_row long, anchor_id long")
    return out.join(names, "query_row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, ids in zip(batch.column("rows").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(_long(rows)), pa.array(_long(ids))], ["query_row", "anchor_id"])


def oracle_sql(positives: int = 5, negatives: int = 3) -> str:
    """The same by comparing all with all, for DuckDB."""
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS HUGEINT)) AS v
            FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS MATERIALIZED (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.v) = len(b.v)),
        p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) AS k FROM s WHERE same QUALIFY k <= {positives}),
        n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.ar, p.k ORDER BY s.score DESC, s.vec_id, s.r) AS k
            FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
        SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= {negatives}"""
