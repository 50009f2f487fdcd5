"""Features of GeoJSON documents of any size, read in splits: no document is a cell.

A file is read as pieces that end in a closing brace, which Spark's text reader finds in byte
ranges. What a brace means depends on what is before it: whether a string is open, how many
brackets are, and whether the innermost but one is the document's list of features. The first pass
tells of each split what it makes of these, for both states of a string it may begin in. One small
row a split is then folded in the order of a file, which gives each split the state it begins in,
and the second pass cuts features where it reads them. Only features over the bounds of splits are
put together by a shuffle, and what is around the list of features (the frame). A document may be
several files, whose order is that of their names: the fold goes on from one to the next.

An escape never ends in a brace and a key and its value's bracket have no brace between them, so
both lie within a piece. A feature or a frame of more than ``MOST_RECORD`` bytes is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coordspark.operators.tables import SMALL, fitted, written
from coordspark.sources.csv import MOST_RECORD
from coordspark.sources.texts import as_text

QUOTE, OPEN, CLOSE = 1, 2, 3
KINDS = np.zeros(256, np.uint8)
KINDS[ord('"')], KINDS[[ord("{"), ord("[")]], KINDS[[ord("}"), ord("]")]] = QUOTE, OPEN, CLOSE
LIST = re.compile(rb'(?<!\\)"features"\s*:\s*\[')
BRACE = np.array([ord("}")], np.uint8)
#: What no split tells: a depth that no bracket has.
NEVER = 1 << 40

SUMMARY = "source_id string, at long, size long, bytes long, wide boolean, utf8 boolean, turns int, " + ", ".join(f"{n}{h} long" for h in (0, 1) for n in ("delta", "least", "list", "after"))
ENTRY = "source_id string, at long, base long, inside boolean, depth long, listed boolean, seen boolean, extra boolean, utf8 boolean, problem string"
CUT = "source_id string, at long, nth long, whole boolean, raw binary"


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Pieces with their closing brace, in order within a split: source_id, at, size, k, raw."""
    value = F.concat(F.col("value"), F.lit("}")).cast("binary")
    return spark.read.option("lineSep", "}").text(paths).select(F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("k"), value.alias("raw"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, bool]]:
    """Rows of one split at a time, their bytes, and whether the split is a new one."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        source, at = batch.column("source_id"), batch.column("at").to_numpy()
        other = pc.not_equal(source[1:], source[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | other) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            raw = part.column("raw")
            bounds = np.frombuffer(raw.buffers()[1], np.int64 if pa.types.is_large_binary(raw.type) else np.int32)[raw.offset : raw.offset + len(raw) + 1]
            yield part, np.frombuffer(raw.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], (source[a].as_py(), at[a]) != last
            last = source[a].as_py(), at[a]


def _signs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quotes that aren't escaped and brackets: where, their kind, and the quotes before each."""
    kinds = KINDS[data]
    where = np.flatnonzero(kinds)
    kind = kinds[where]
    if (data == 92).any():
        places = np.arange(len(data))
        plain = np.maximum.accumulate(np.where(data != 92, places, -1))
        before = np.where(where > 0, where - 1 - plain[where - 1], 0)
        keep = (kind != QUOTE) | (before % 2 == 0)
        where, kind = where[keep], kind[keep]
    quotes = np.cumsum(kind == QUOTE)
    return where, kind, quotes - (kind == QUOTE)


def _lists(data: np.ndarray) -> np.ndarray:
    return np.array([m.end() - 1 for m in LIST.finditer(data)], np.int64)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split makes of the state it begins in.

    For a split that begins outside (0) or inside (1) a string: the change of depth, the least
    depth, the depth of the shallowest list named ``features``, the least depth after that list began.
    A split's last brace is left to the fold, as a file's last piece was given one that it may not have.
    """
    names = [f.split()[0] for f in SUMMARY.split(", ")]
    now: dict | None = None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(pd.DataFrame([now], columns=names).astype({"turns": "int32"}), preserve_index=False)

    for part, data, new in _runs(batches):
        if new:
            if now is not None:
                yield out()
            head = data[:4].tobytes()
            wide = part.column("at")[0].as_py() == 0 and (head[:2] in (b"\xff\xfe", b"\xfe\xff") or head == b"\0\0\xfe\xff")
            now = {"source_id": part.column("source_id")[0].as_py(), "at": part.column("at")[0].as_py(), "size": part.column("size")[0].as_py(), "bytes": 0, "wide": wide, "utf8": True, "turns": 0}
            now |= {f"{n}{h}": v for h in (0, 1) for n, v in (("delta", 0), ("least", 0), ("list", NEVER), ("after", NEVER))}
        now["bytes"] += len(data)
        now["utf8"] &= pc.all(part.column("utf8")).as_py()
        data = np.concatenate((BRACE[: 0 if new else 1], data[:-1]))
        where, kind, quotes = _signs(data)
        lists, turned = _lists(data), now["turns"]
        for h in (0, 1):
            live = (kind != QUOTE) & ((quotes + turned + h) % 2 == 0)
            at, step = where[live], np.where(kind[live] == OPEN, 1, -1)
            depth = now[f"delta{h}"] + np.cumsum(step)
            if not len(depth):
                continue
            now[f"least{h}"] = min(now[f"least{h}"], int(depth.min()))
            begun = np.flatnonzero(np.isin(at, lists))
            after = depth
            if len(begun) and (best := int(depth[begun].min()) - 1) < now[f"list{h}"]:
                now[f"list{h}"], now[f"after{h}"] = best, best + 1
                after = depth[begun[np.argmin(depth[begun])] :]
            if now[f"list{h}"] != NEVER:
                now[f"after{h}"] = min(now[f"after{h}"], int(after.min()))
            now[f"delta{h}"] = int(depth[-1])
        now["turns"] = (turned + int((kind == QUOTE).sum())) % 2
    if now is not None:
        yield out()


def _entries(splits: pd.DataFrame) -> pd.DataFrame:
    """The state in which each split of a document begins, and the bytes of the files before its own; a row for each split."""
    splits = splits.assign(name=splits["source_id"].map(unquote)).sort_values(["name", "at"])
    sizes = splits.drop_duplicates("source_id").set_index("source_id")["size"]
    read = splits.groupby("source_id")["bytes"].transform("sum")
    last = splits["at"] == splits.groupby("source_id")["at"].transform("max")
    # the reader leaves out a mark of three bytes; the last piece was given a brace that it hasn't
    splits = splits.assign(extra=last & (read != splits["size"]) & (read != splits["size"] - 3), base=splits["source_id"].map(sizes.cumsum() - sizes))
    inside, depth, listed, seen, rows = False, 0, False, False, []
    for s in splits.itertuples():
        h = int(inside)
        rows.append((s.source_id, s.at, s.base, inside, depth, listed, seen, s.extra))
        delta, least, first, after = (getattr(s, f"{n}{h}") for n in ("delta", "least", "list", "after"))
        inside = inside != bool(s.turns)
        if not inside and not s.extra:
            delta = delta - 1
            least, after = min(least, delta), min(after, delta)
        if not seen and first != NEVER and depth + first == 1:
            seen, listed = True, depth + after >= 2
        elif listed and depth + least < 2:
            listed = False
        depth += delta
    problem = "geojson_wide_charset" if splits["wide"].iloc[0] else "geojson_unclosed" if inside or depth else None
    made = pd.DataFrame(rows, columns=["source_id", "at", "base", "inside", "depth", "listed", "seen", "extra"])
    return made.assign(utf8=bool(splits["utf8"].all()), problem=problem)


class _Cutter:
    """Cuts one split: whole features, pieces of features over its bounds, and the frame."""

    def __init__(self, source: str, at: int, inside: bool, depth: int, listed: bool, seen: bool, extra: bool, most: int):
        self.source, self.at, self.inside, self.depth, self.listed, self.seen, self.extra, self.most = source, at, inside, depth, listed, seen, extra, most
        self.nth = -1 if listed and depth > 2 else None  # the feature that is open: -1 began in an earlier split
        self.count, self.held, self.size, self.frame, self.rows = 0, [], 0, [], []
        self.made: list[pa.RecordBatch] = []
        self.brace = BRACE[:0]  # the last one, which a file's last piece hasn't

    def hold(self, data: np.ndarray) -> None:
        self.held.append(data.tobytes())
        self.size += len(data)
        if self.size > self.most:
            raise ValueError(f"a feature is too large: {self.source}")

    def end(self, whole: bool) -> None:
        self.rows.append((self.source, self.at, self.nth, whole, b"".join(self.held)))
        self.held, self.size = [], 0

    def wholes(self, data: np.ndarray, edges: np.ndarray) -> None:
        """Features that begin and end in these bytes: their first and last brackets in turn."""
        edges = edges.astype(np.int32)
        edges[1::2] += 1
        if int((edges[1::2] - edges[::2]).max()) > self.most:
            raise ValueError(f"a feature is too large: {self.source}")
        n = len(edges) // 2
        # features and what is between them are one array, of which every other value is taken
        both = pa.Array.from_buffers(pa.binary(), 2 * n - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
        columns = [pa.repeat(self.source, n), pa.repeat(self.at, n), pa.array(np.arange(self.count, self.count + n)), pa.repeat(True, n), both.take(pa.array(np.arange(0, 2 * n, 2)))]
        self.made.append(pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in CUT.split(", ")]))
        self.count += n

    def feed(self, data: np.ndarray) -> None:
        if self.extra:
            data, self.brace = np.concatenate((self.brace, data[:-1])), data[-1:]
        where, kind, quotes = _signs(data)
        live = (kind != QUOTE) & ((quotes + self.inside) % 2 == 0)
        at, opens = where[live], kind[live] == OPEN
        depth = self.depth + np.cumsum(np.where(opens, 1, -1))
        done = 0  # bytes that are dealt with
        begin, first = 0, 0  # and brackets
        if not self.listed:
            begun = np.flatnonzero(np.isin(at, _lists(data)) & (depth == 2)) if not self.seen else []
            if len(begun):
                first, self.listed, self.seen = int(begun[0]) + 1, True, True
                done = int(at[first - 1]) + 1
                self.frame.append(data[:done].tobytes())
        if self.listed:
            closed = np.flatnonzero(depth[first:] < 2)
            stop = first + int(closed[0]) if len(closed) else len(at)
            begin = done
            # a feature's first bracket makes depth 3, its last one makes it 2 again
            edges = at[first + np.flatnonzero(np.where(opens[first:stop], depth[first:stop] == 3, depth[first:stop] == 2))]
            if self.nth is not None and len(edges):
                self.hold(data[begin : int(edges[0]) + 1])
                self.end(self.nth >= 0)
                self.nth, edges = None, edges[1:]
            n = len(edges) // 2
            if n:
                self.wholes(data, edges[: 2 * n])
            if len(edges) > 2 * n:
                begin, self.nth = int(edges[-1]), self.count
                self.count += 1
            if stop < len(at):
                self.listed, done = False, int(at[stop])
            else:
                done = len(data)
                if self.nth is not None:
                    self.hold(data[begin:])
        if done < len(data):
            self.frame.append(data[done:].tobytes())
        self.inside ^= bool((kind == QUOTE).sum() % 2)
        if len(depth):
            self.depth = int(depth[-1])

    def finish(self) -> list[pa.RecordBatch]:
        if self.nth is not None:
            self.end(False)
        frame = b"".join(self.frame)
        if len(frame) > self.most:
            raise ValueError(f"what is around the features is too large: {self.source}")
        if frame:
            self.rows.append((self.source, self.at, -2, False, frame))
        return self.flush()

    def flush(self) -> list[pa.RecordBatch]:
        types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        rows, made, self.rows, self.made = self.rows, self.made, [], []
        if rows:
            made.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [f.split()[0] for f in CUT.split(", ")]))
        return made


def _cutting(most: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = None
        for part, data, new in _runs(batches):
            if new:
                if cutter is not None:
                    yield from cutter.finish()
                cutter = _Cutter(*(part.column(c)[0].as_py() for c in ("source_id", "at", "inside", "depth", "listed", "seen", "extra")), most)
            cutter.feed(data)
            yield from cutter.flush()
        if cutter is not None:
            yield from cutter.finish()

    return cut


def _document(file: Column, parts: bool) -> Column:
    """The document that a file is, or is a part of: then its folder."""
    return F.regexp_replace(file, "/[^/]*$", "") if parts else file


def features(spark: SparkSession, path: str | list[str], most: int = MOST_RECORD, parts: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features (source_id, at, nth, x), frames (source_id, text) and problems (source_id, code, n).

    ``nth`` counts within the split that begins at ``at``, so both order a file's features. A frame
    is its document with an empty list of features; a document that is no collection is all frame.
    Members of a list that are neither objects nor lists aren't features. Text is UTF-8, or
    windows-1252 where a file isn't valid UTF-8. A file in UTF-16 or UTF-32, and one whose brackets
    or strings don't close, gives a problem and nothing else. An empty file gives nothing.

    With ``parts`` the files of a folder, joined in the order of their names, are one document with
    the folder as its source, and ``at`` counts from the document's begin. They may be cut anywhere
    but inside a character, an escape or a key with the bracket after it.
    """
    paths = [path] if isinstance(path, str) else list(path)
    pieces = _pieces(spark, paths)
    summed = pieces.withColumn("utf8", F.is_valid_utf8(F.col("raw").cast("string"))).drop("k").mapInArrow(_summaries, SUMMARY)
    entries = written(summed.groupBy(_document(F.col("source_id"), parts)).applyInPandas(_entries, ENTRY), "geojson-splits")
    known = entries.where("problem is null").drop("utf8", "problem")
    placed = pieces.drop("size").join(fitted(known), ["source_id", "at"]).withColumns({"source_id": _document(F.col("source_id"), parts), "at": F.col("at") + F.col("base")}).drop("base")
    entries = entries.withColumn("source_id", _document(F.col("source_id"), parts))
    if entries.limit(SMALL + 1).count() > SMALL:  # joined by a shuffle: pieces of a split are brought in order again
        placed = placed.repartition("source_id", "at").sortWithinPartitions("source_id", "at", "k")
    cut = written(placed.drop("k").mapInArrow(_cutting(most), CUT), "geojson-cut")

    over = cut.where("not whole and nth > -2")
    file = Window.partitionBy("source_id").orderBy("at", "nth").rowsBetween(Window.unboundedPreceding, 0)
    keys = over.select("source_id", "at", "nth").withColumn("begun", F.last(F.when(F.col("nth") >= 0, F.struct("at", "nth")), ignorenulls=True).over(file))  # two rows a split at most
    owned = over.join(fitted(keys), ["source_id", "at", "nth"])
    told = F.raise_error(F.concat(F.lit("a feature is too large: "), F.col("source_id"))).cast("string")
    sizes = owned.groupBy("source_id", "begun").agg(F.sum(F.octet_length("raw").cast("long")).alias("size"))
    owned = owned.join(fitted(sizes.where(F.when(F.col("size") > most, told).isNull()).select("source_id", "begun")), ["source_id", "begun"])
    joined = owned.groupBy("source_id", "begun").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "nth", "raw"))), lambda p: F.hex(p["raw"])).alias("raws"))
    joined = joined.select("source_id", "begun.at", "begun.nth", F.unhex(F.array_join("raws", "")).alias("raw"))
    frames = cut.where("nth = -2").groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "raw"))), lambda p: F.hex(p["raw"])).alias("raws"))
    frames = frames.select("source_id", F.unhex(F.array_join("raws", "")).alias("raw"))

    charsets = fitted(entries.select("source_id", "utf8").distinct())
    text = F.when(F.col("utf8"), F.col("raw").cast("string")).otherwise(as_text(F.col("raw"), "windows-1252"))
    found = cut.where("whole").select("source_id", "at", "nth", "raw").unionAll(joined)
    found = found.join(charsets, "source_id").select("source_id", "at", "nth", text.alias("x"))
    frames = frames.join(charsets, "source_id").select("source_id", text.alias("text"))
    problems = entries.where("problem is not null").select("source_id", F.col("problem").alias("code"), F.lit(1).cast("long").alias("n")).distinct()
    return found, frames, problems
