"""Packing by Karmarkar-Karp multiway differencing.

Each task tokenises the documents it scans, so no text is shuffled. A document longer
than a window gives full windows of its own; what is left of it is cut into pieces of
at most ``PIECE`` tokens. Pieces wait until ``BLOCK`` of them are there, then they are
spread over the fewest windows that can hold them: of all partial partitions, the two
with the largest imbalance merge with opposing order until one is left. A partial
partition holds its windows in use only, and merged windows are kept as pairs that are
unrolled once at the end. The window count rises while a window exceeds its capacity. A
task's last block may be smaller.

Ids are those of ``tokenizers`` for the given file. A byte-level BPE is read into
``tiktoken``, which gives the same ids in a fraction of the time; other kinds of files, and
texts with a run of white space that its matcher can't take, go through ``tokenizers``.
Strings of special tokens in a text give their ids.

Null and empty texts are the closing id alone. Repeated rows are packed one by one, and
a null id is packed as any other. Other columns are ignored, whatever their names. Sequence
ids join the partition's number and a counter: unique, not consecutive. An empty table gives
no piece. Memory holds one document and one block.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordspark.llm.tables import bounded

CAPACITY, PIECE, BLOCK, END = 2048, 512, 2048, 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: How a byte-level BPE cuts a text into words; fixed value of that kind of vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A longer run of white space is left to ``tokenizers``.
LONG_SPACE = re.compile(r"\s{100000}")


def _byte_symbols() -> dict[str, int]:
    """The visible character that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(tokenizer: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer)

    def plain(text: str) -> np.ndarray:
        return np.array(model.encode(text, add_special_tokens=False).ids, "<u4")

    with open(tokenizer, encoding="utf-8") as f:
        kind = json.load(f)
    pre, bpe = kind.get("pre_tokenizer") or {}, kind["model"]
    byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    added = kind.get("added_tokens", [])
    simple = not kind.get("normalizer") and not kind.get("truncation") and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
    if bpe["type"] != "BPE" or not byte_level or not simple or bpe.get("dropout") or bpe.get("ignore_merges"):
        return plain
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in bpe["merges"]]
    made = [bpe["vocab"]["".join(m)] for m in merges]
    if made != sorted(made):  # ids must rank the merges
        return plain
    import tiktoken

    symbols = _byte_symbols()
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(symbols[c] for c in token): k for token, k in bpe["vocab"].items() if token not in special}
    quick = tiktoken.Encoding("read", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)

    def ids(text: str) -> np.ndarray:
        if LONG_SPACE.search(text):
            return plain(text)
        return quick.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)

    return ids


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """The items spread over k windows of near-equal sums; windows without items are left out."""
    if not sizes:
        return []
    pairs: list[tuple[int, int]] = []  # windows made of two others; items are numbered before them
    heap = [(-size, i, np.array([size], np.int64), np.array([i])) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, a, mine = heapq.heappop(heap)
        _, _, b, other = heapq.heappop(heap)
        both = max(0, len(a) + len(b) - k)  # so many windows of each meet: its emptiest, with opposing order
        p, q = len(a) - both, len(b) - both
        met = a[p:] + b[q:][::-1]
        names = np.arange(len(pairs), len(pairs) + both) + len(sizes)
        pairs.extend(zip(mine[p:].tolist(), other[q:][::-1].tolist(), strict=True))
        sums, windows_ = np.concatenate([a[:p], b[:q], met]), np.concatenate([mine[:p], other[:q], names])
        order = np.argsort(-sums, kind="stable")
        sums, windows_ = sums[order], windows_[order]
        if len(sums) == k:
            sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), tie, sums, windows_))
    out = []
    for window in heap[0][3].tolist():
        items, open_ = [], [window]
        while open_:
            x = open_.pop()
            if x < len(sizes):
                items.append(x)
            else:
                open_.extend(pairs[x - len(sizes)])
        out.append(items)
    return out


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """The fewest windows differencing can fill without exceeding the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, k)
        over = sum(max(0, sum(sizes[i] for i in w) - capacity) for w in found)
        if not over:
            return found
        k += max(1, over // capacity)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """One row per piece of each document."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        first, made = TaskContext.get().partitionId() << 33, 0
        rows: list[tuple] = []
        waiting: list[tuple] = []

        def settle() -> None:
            nonlocal made, waiting
            for window in windows([p[2] for p in waiting], capacity):
                offset = 0
                for i in window:
                    rows.append((*waiting[i], first + made, offset))
                    offset += waiting[i][2]
                made += 1
            waiting = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
            rows.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.array(END, "<u4"))
                n, start = len(ids), 0
                while start < n:
                    length = capacity if n - start >= capacity else min(piece, n - start)
                    row = (doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), n)
                    if length == capacity:
                        rows.append((*row, first + made, 0))
                        made += 1
                    else:
                        waiting.append(row)
                        if len(waiting) >= block:
                            settle()
                    start += length
                if len(rows) >= 8192:
                    yield flush()
        settle()
        if rows:
            yield flush()

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(packed, SCHEMA)
