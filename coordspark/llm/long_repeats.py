"""Removing long strings that start more than once, by run-length indexes over parts that can hold their copies.

Each string of ``length`` bytes has a key: the least hash of its grams. Strings that are equal
have the same key, so they meet in one group wherever they are. In a text, neighbouring
strings mostly have the same key; they are a segment, and each string is in exactly one. What
is dealt out by key is a segment's digest first. Keys whose gram is seen once hold no repeat and go; equal
segments become one with their number, before any text moves; only then are the bytes of one
segment of each kind taken from a text that holds it.

Groups of segments are gathered to blocks of about ``BLOCK`` bytes, and each block gets a
run-length index (``run_index``), whose matching statistics say which strings of each segment
start elsewhere in the block too. A group of more than ``GROUP`` bytes is dealt out again by
the keys of longer grams, until grams are as long as the strings themselves, when a group is
one string: so no group, of however many texts, is one task's, and none is cut short. The
answers go back from segments to the texts that hold them, where ranges are joined.

Hashes of grams only gather; what is equal is found in the bytes. Segments are told apart by
128-bit digests. A removed byte is one covered by a string that starts anywhere else, in the
same text too, overlapping too; all is judged on the input.

Null texts are empty; texts shorter than ``length`` stay as they are. Rows are told apart by
themselves, so rows that repeat an id, or a whole row, are copies of each other. A text is
taken in parts of ``CHUNK`` bytes, of any length. Columns of the input stay, whatever their
names; ``spans``, ``kept`` and ``n_bytes`` come in a struct of the name given. An empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordspark.llm.run_index import repeated
from coordspark.llm.tables import discard, written

LENGTH, GRAM = 400, 96
CHUNK, BLOCK, GROUP = 256 << 10, 512 << 10, 128 << 10
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
SEGMENTS = "row long, start long, n int, key long, seg binary, met int"
PIECES = "key long, seg binary, copies long, bytes binary"
LINKS = "key long, seg binary, copies long, bytes binary, parent binary, off int, met int"
MARKS = "seg binary, spans array<struct<a:int,b:int>>"
SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
RESULT = "row long, spans array<struct<start:long,end:long>>, kept binary"


def gram_sizes(length: int, gram: int) -> list[int]:
    """Grams from the first size to the strings' own: each halves the grams a string has."""
    n, out = length - gram + 1, [gram]
    while n > 1:
        n = (n + 1) // 2
        out.append(length - n + 1)
    return out


@lru_cache(2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A number for the gram at each position, the same wherever it stands."""
    n = len(data)
    powers, back = (_powers(base, 1 << (n - 1).bit_length()) for base in (BASE, BACK))
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], dtype=np.uint64, out=upto[1:])
    x = (upto[gram:] - upto[:-gram]) * back[: n - gram + 1]
    for shift, by in ((32, 0xD6E8FEB86659FD93), (29, 0xD6E8FEB86659FD93)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(32))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, in two passes over groups of that width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    groups = padded.reshape(-1, width)
    before = np.minimum.accumulate(groups, axis=1).ravel()
    after = np.minimum.accumulate(groups[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def segments(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments of texts, in parts: number of the text, where it starts, how many strings start in it, key, how often the key's gram is in it."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    width = length - gram + 1
    for base in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[base : base + CHUNK + length - 1]
        hashes = _hashes(part, gram)
        key = _least(hashes, width)
        at = base + np.arange(len(key))
        text = np.searchsorted(starts, at, side="right") - 1
        fits = np.flatnonzero(at + length <= starts[text + 1])
        if not len(fits):
            continue
        new = np.ones(len(fits), bool)
        new[1:] = (np.diff(fits) > 1) | (key[fits[1:]] != key[fits[:-1]]) | (np.diff(text[fits]) > 0)
        heads = np.flatnonzero(new)
        counts = np.diff(np.append(heads, len(fits)))
        # a run of one key, as in a text of one sign, is cut
        several = -(-counts // width)
        first = np.repeat(heads, several) + width * (np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several))
        n = np.minimum(np.repeat(heads + counts, several) - first, width)
        begin = fits[first]
        # a periodic text has its gram several times in one segment, and may repeat itself there
        met = np.array([np.count_nonzero(hashes[a : a + k + width - 1] == x) for a, k, x in zip(begin.tolist(), n.tolist(), key[begin], strict=True)], np.int32)
        yield text[begin], base + begin - starts[text[begin]], n, key[begin].view(np.int64), met


def _segmented(length: int, gram: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = batch.column("row").to_numpy(), [t or b"" for t in batch.column("bytes").to_pylist()]
            for text, start, n, key, met in segments(texts, length, gram):
                digests = [xxhash.xxh3_128_digest(texts[t][s : s + k + length - 1]) for t, s, k in zip(text.tolist(), start.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows[text]), pa.array(start), pa.array(n.astype(np.int32)), pa.array(key), pa.array(digests, pa.binary()), pa.array(met)], [f.split()[0] for f in SEGMENTS.split(", ")])

    return cut


def _taken(length: int):
    """The bytes of the segments that a text is asked for."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, want in zip(batch.column("bytes").to_pylist(), batch.column("want").to_pylist(), strict=True):
                for a in range(0, len(want), 4096):
                    w = want[a : a + 4096]
                    cols = [pa.array([x["key"] for x in w]), pa.array([x["seg"] for x in w], pa.binary()), pa.array([x["copies"] for x in w]), pa.array([data[x["start"] : x["start"] + x["n"] + length - 1] for x in w], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in PIECES.split(", ")])

    return take


def _finer(length: int, gram: int):
    """Segments cut again by the keys of longer grams."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parents, copies, texts = batch.column("seg").to_pylist(), batch.column("copies").to_numpy(), batch.column("bytes").to_pylist()
            for text, start, n, key, met in segments(texts, length, gram):
                parts = [texts[t][s : s + k + length - 1] for t, s, k in zip(text.tolist(), start.tolist(), n.tolist(), strict=True)]
                cols = [pa.array(key), pa.array([xxhash.xxh3_128_digest(p) for p in parts], pa.binary()), pa.array(copies[text]), pa.array(parts, pa.binary()), pa.array([parents[t] for t in text], pa.binary()), pa.array(start.astype(np.int32)), pa.array(met)]
                yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in LINKS.split(", ")])

    return cut


def _indexed(length: int, block: int):
    """Groups, whole, gathered to blocks, each with its index; segments without repeats give no row."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, bytes]] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            spans = repeated([h[2] for h in held], length, [h[1] for h in held])
            some = [(h[0], [{"a": a, "b": b} for a, b in s]) for h, s in zip(held, spans, strict=True) if s]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in some], pa.binary()), pa.array([x for _, x in some], SPANS)], ["seg", "spans"])

        for batch in batches:
            for key, seg, copies, data in zip(*(batch.column(c).to_pylist() for c in ("key", "seg", "copies", "bytes")), strict=True):
                if size >= block and key != last:
                    yield flush()
                    size = 0
                held.append((seg, copies, data))
                size, last = size + len(data), key
        if held:
            yield flush()

    return index


def _removed(length: int):
    """Each text's removed ranges, joined, and the rest."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for data, found in zip(batch.column("bytes").to_pylist(), batch.column("found").to_pylist(), strict=True):
                ranges: list[list[int]] = []
                for a, b in sorted((f["start"] + s["a"], f["start"] + s["b"] - 1 + length) for f in found or [] for s in f["spans"]):
                    if ranges and a <= ranges[-1][1]:
                        ranges[-1][1] = max(ranges[-1][1], b)
                    else:
                        ranges.append([a, b])
                data, at, rest = data or b"", 0, []
                for a, b in ranges:
                    rest.append(data[at:a])
                    at = b
                spans.append([{"start": a, "end": b} for a, b in ranges])
                kept.append(b"".join([*rest, data[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["row", "spans", "kept"])

    return remove


def _several(pieces: DataFrame, what: str, *less: str) -> DataFrame:
    """Segments whose key more than one string can have, written without the columns of ``less``."""
    counts = pieces.groupBy("key").agg(F.sum(F.col("copies") * F.col("met")).alias("c"))
    # a table of their own: counted in the join's stage, they keep Spark from dealing a frequent key to several tasks
    keys = written(counts.where("c > 1").select("key"), "repeats-keys")
    # keys are distinct; a semi-join would be moved below the grouping of pieces, whose copies are then dealt by key unjoined
    out = written(pieces.join(keys.hint("merge"), "key").drop(*less), what)
    discard(keys)
    return out


def _marks(pieces: DataFrame, length: int, sizes: list[int], block: int, group: int) -> DataFrame:
    """Which strings of each segment start elsewhere: seg, spans."""
    links, done, level = [], [], 0
    while True:
        size = F.sum(F.length("bytes").cast("long"))
        large = written(pieces.groupBy("key").agg(size.alias("size")).where(F.col("size") > group).select("key"), "repeats-large")
        whole = pieces.join(large, "key", "left_anti")
        # not by the key itself: after a join by key Spark leaves such a deal out, and the join's may split a skewed key
        ordered = whole.repartition(F.xxhash64("key")).sortWithinPartitions("key", "seg")
        done.append(written(ordered.mapInArrow(_indexed(length, block), MARKS), "repeats-marks"))
        if large.isEmpty() or level + 1 == len(sizes):
            discard(large)
            break
        level += 1
        link = written(pieces.join(large, "key", "left_semi").mapInArrow(_finer(length, sizes[level]), LINKS), "repeats-links")
        links.append(link.select("seg", "parent", "off"))
        last = pieces
        pieces = link.groupBy("key", "seg").agg(F.sum("copies").alias("copies"), F.min("bytes").alias("bytes"), F.max("met").alias("met"))
        pieces = _several(pieces, "repeats-pieces", "met")
        discard(large, last)
    discard(pieces)
    marks = done.pop()
    while links:  # a segment has few parts
        up = marks.join(links.pop(), "seg").select(F.col("parent").alias("seg"), F.transform("spans", lambda s: F.struct((s["a"] + F.col("off")).alias("a"), (s["b"] + F.col("off")).alias("b"))).alias("spans"))
        up = up.groupBy("seg").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        marks = written(up.unionAll(done.pop()), "repeats-marks")
    return marks


def remove(docs: DataFrame, text: Column | None = None, name: str = "repeats", length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """The documents with a struct: ``spans`` removed (start and end, in bytes), ``kept`` (the bytes left) and ``n_bytes`` of the input."""
    text = F.col("text") if text is None else text
    columns = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if docs.columns else F.struct()
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), columns.alias("doc"), text.cast("binary").alias("bytes")), "repeats-rows")
    light = written(rows.select("row", "bytes").where(F.length("bytes") >= length).mapInArrow(_segmented(length, gram), SEGMENTS), "repeats-segments")
    near = _several(light.withColumn("copies", F.lit(1)), "repeats-near", "copies", "met")
    discard(light)
    one = F.min(F.struct("row", "start", "n"))
    kinds = written(near.groupBy("key", "seg").agg(F.count("*").alias("copies"), one.alias("at")), "repeats-kinds")
    # a text is asked for few segments, those it holds; in their order, as neighbours share bytes and pack well
    want = kinds.groupBy(F.col("at.row").alias("row")).agg(F.array_sort(F.collect_list(F.struct(F.col("at.start").alias("start"), F.col("at.n").alias("n"), "key", "seg", "copies"))).alias("want"))
    pieces = written(rows.select("row", "bytes").join(want, "row").mapInArrow(_taken(length), PIECES), "repeats-pieces")
    discard(kinds)
    marks = _marks(pieces, length, gram_sizes(length, gram), block, group)
    # of a text, the segments that have some
    found = written(near.join(marks, "seg").groupBy("row").agg(F.collect_list(F.struct("start", "spans")).alias("found")), "repeats-found")
    discard(near, marks)
    out = rows.select("row", "bytes").join(found, "row").mapInArrow(_removed(length), RESULT)
    out = written(out, "repeats-removed")
    whole = rows.join(out, "row", "left")
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    bytes_ = F.coalesce("bytes", F.lit(b""))
    told = F.struct(F.coalesce("spans", none).alias("spans"), F.coalesce("kept", bytes_).alias("kept"), F.length(bytes_).cast("long").alias("n_bytes"))
    return whole.select("doc.*", told.alias(name))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Each text's removed ranges, by counting all strings."""
    from collections import Counter

    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, np.int8)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k + 1 : k + 1 + length] = 1
        out.append([(int(a), int(b)) for a, b in np.flatnonzero(np.diff(gone)).reshape(-1, 2)])
    return out
