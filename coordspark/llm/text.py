"""Vectorised text kernels over Arrow string buffers.

A batch of texts is one byte buffer with offsets; words, lines and their 64-bit
hashes come out as numpy arrays for the whole batch at once. Buffers are cut into
pieces of bounded size first, so memory doesn't follow the length of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.RandomState(20240607)
#: A random 64-bit number for each byte, and odd multipliers.
BYTE_KEYS = _rng.randint(0, 2**64, 256, dtype=U)
LOWER_KEYS = BYTE_KEYS.copy()
LOWER_KEYS[65:91] = BYTE_KEYS[97:123]
_B = U(0x9E3779B97F4A7C15 & ~7 | 3)
_B_INV = U(pow(int(_B), -1, 2**64))
WORD_KEYS = _rng.randint(0, 2**64, 8, dtype=U) | U(1)
_SEEDS = [U(k * 0x8CB92BA72F3D8DD7 % 2**64) for k in range(9)]
#: Word separators: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> list[np.ndarray]:
    while len(_powers[0]) < n:
        m = len(_powers[0])
        for k, base in enumerate((_B, _B_INV)):
            step = U(pow(int(base), m, 2**64))
            _powers[k] = np.concatenate([_powers[k], _powers[k] * step])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and their offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about that many bytes at most; a longer text stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray = BYTE_KEYS, most: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and don't overlap."""
    out = np.empty(len(starts), U)
    k = 0
    while k < len(starts):
        base = int(starts[k])
        last = max(int(np.searchsorted(ends, base + most, "right")), k + 1)
        s, e = (starts[k:last] - base).astype(np.int64), (ends[k:last] - base).astype(np.int64)
        n = int(e[-1])
        up, down = _power(n + 1)
        sums = np.zeros(n + 1, U)
        np.cumsum(keys[buf[base : base + n]] * up[:n], out=sums[1:])
        out[k:last] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
        k = last
    return out


def spans(buf: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes that aren't breaks, never across texts."""
    inside = ~breaks[buf]
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def line_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the \\n-split lines, empty ones too."""
    cuts = np.flatnonzero(buf == 10)
    owner = np.searchsorted(offsets, cuts, "right") - 1
    n = len(offsets) - 1
    starts = np.concatenate([offsets[:-1], cuts + 1])
    ends = np.concatenate([offsets[1:], cuts])
    text = np.concatenate([np.arange(n), owner])
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    # a line ends at the next cut of its text, or with the text
    ends = np.append(starts[1:] - 1, 0)
    last = np.append(text[1:] != text[:-1], True)
    ends[last] = offsets[text[last] + 1]
    return starts, ends, text


def words(buf: np.ndarray, offsets: np.ndarray, keys: np.ndarray = BYTE_KEYS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes of the words, and where each text's words begin."""
    s, e = spans(buf, offsets, SPACE)
    return s, e, span_hashes(buf, s, e, keys), np.searchsorted(s, offsets)


def windows(hashes: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of that many words inside each text, and where each text's windows begin."""
    count = np.maximum(np.diff(at) - size + 1, 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    if not begin[-1]:
        return np.zeros(0, U), begin
    n = len(hashes) - size + 1
    total = np.full(n, _SEEDS[size], U)
    for k in range(size):
        total += hashes[k : k + n] * WORD_KEYS[k]
    index = np.repeat(at[:-1] - begin[:-1], count) + np.arange(begin[-1])
    return mix(total[index]), begin


def sequence_hash(hashes: np.ndarray) -> np.ndarray:
    """One hash of a whole sequence of fewer than five words."""
    return mix(_SEEDS[len(hashes)] + (hashes * WORD_KEYS[: len(hashes)]).sum(keepdims=True, dtype=U))
