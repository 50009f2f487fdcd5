"""A run-length index of repetitive texts: which strings of a length start more than once.

The texts, each ended by a sign of its own, are sorted by their suffixes; what precedes the
suffixes in that order is the Burrows-Wheeler transform, kept as runs. Of each run the index
holds the sign, the length, and the text positions of its first and last suffix. Copies add
length to runs and hardly any run, so what is kept grows with what is new in the texts.

Matching statistics need no more than that and the text. Where two neighbours in the order are
preceded by the same sign, the suffixes one position earlier are neighbours too and share one
sign more. So a suffix's longest match with its neighbour has to be compared only at the ends
of runs; from there it falls by one a position, and a stream over the text gives it for all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WORD = 8


@dataclass(frozen=True)
class RunIndex:
    """Runs of the transform: sign, length, and the positions of the first and the last suffix."""

    signs: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    last: np.ndarray


@dataclass(frozen=True)
class Joined:
    """Texts in a row: signs from 1, each text followed by 0; words of eight signs, which hold zeros behind an end; how far the end is."""

    signs: np.ndarray
    words: np.ndarray
    rest: np.ndarray
    starts: np.ndarray


def joined(texts: list[bytes]) -> Joined:
    lengths = np.array([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    # no byte of UTF-8 is 255, so a sign fits in a byte
    signs = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)
    rest = np.repeat(starts[1:] - 1, lengths) - np.arange(len(signs))
    words, half = signs.astype(np.uint64), 1
    while half < WORD:
        after = np.zeros_like(words)
        after[:-half] = words[half:]
        words = (words << np.uint64(8 * half)) | np.where(rest >= half, after, 0).astype(np.uint64)
        half *= 2
    return Joined(signs, words, rest, starts[:-1])


def suffix_order(text: Joined) -> np.ndarray:
    """Positions in the order of their suffixes, by prefixes of doubled length; ends are ordered by where they are."""
    n = len(text.signs)
    order = np.argsort(text.words, kind="stable")
    # a new group begins with a new word, and each suffix shorter than a word is one
    new = np.ones(n, bool)
    sorted_ = text.words[order]
    new[1:] = (sorted_[1:] != sorted_[:-1]) | (text.rest[order[1:]] < WORD)
    rank = np.empty(n, np.int64)
    half = WORD
    at = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    while True:
        last = np.append(new[1:], True)
        open_ = np.flatnonzero(~(new & last))  # places in groups of several
        if not len(open_):
            return order
        some = order[open_]
        mine, next_ = rank[some], rank[some + half]
        by = np.argsort(mine * n + next_)
        order[open_] = some[by]
        mine, next_ = mine[by], next_[by]
        new[open_[1:]] = (mine[1:] != mine[:-1]) | (next_[1:] != next_[:-1])
        new[open_[0]] = True
        # a group's rank is the place of its first
        rank[order[open_]] = np.maximum.accumulate(np.where(new[open_], open_, 0))
        half *= 2


def build(text: Joined) -> RunIndex:
    order = suffix_order(text)
    before = text.signs[order - 1]
    head = np.ones(len(order), bool)
    head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)  # no two ends are the same sign
    heads = np.flatnonzero(head)
    ends = np.append(heads[1:], len(order)) - 1
    return RunIndex(before[heads], ends - heads + 1, order[heads], order[ends])


def _shared(text: Joined, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many signs the suffixes at a and b share before an end."""
    out = np.zeros(len(a), np.int64)
    live, step = np.arange(len(a)), 0
    while len(live):
        p, q = a[live] + step, b[live] + step
        differ = text.words[p] ^ text.words[q]
        most = np.minimum(text.rest[p], text.rest[q])
        same = (differ == 0) & (most >= WORD)
        end = ~same
        # leading bytes that are equal
        high = np.zeros(int(end.sum()), np.int64)
        x = differ[end]
        for k in range(1, WORD):
            high += x < (np.uint64(1) << np.uint64(8 * k))
        high += x == 0
        out[live[end]] = step + np.minimum(high, most[end])
        live = live[same]
        step += WORD
    return out


def longest_matches(text: Joined, index: RunIndex) -> np.ndarray:
    """For each position, the length of the longest string there that starts at another position too."""
    n = len(text.signs)
    shared = _shared(text, index.last[:-1], index.first[1:])
    out = np.zeros(n, np.int64)
    at = np.arange(n)
    for samples, values in ((index.first, np.append(0, shared)), (index.last, np.append(shared, 0))):
        value = np.zeros(n, np.int64)
        known = np.zeros(n, bool)
        value[samples], known[samples] = values, True
        from_ = np.maximum.accumulate(np.where(known, at, 0))
        out = np.maximum(out, value[from_] - (at - from_))
    return out


def repeated(texts: list[bytes], length: int, copies: list[int] | None = None) -> list[list[tuple[int, int]]]:
    """Of each text the ranges of positions at which a string of the length starts that starts elsewhere too.

    A text that stands for several equal ones, by ``copies``, is met by itself wherever such a string fits.
    """
    if not texts:
        return []
    text = joined(texts)
    found = longest_matches(text, build(text)) >= length
    if copies is not None:
        several = np.repeat(np.array(copies) > 1, np.diff(np.append(text.starts, len(text.signs))))
        found |= several & (text.rest >= length)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], found.view(np.int8), [0]]))).reshape(-1, 2)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    of = np.searchsorted(text.starts, edges[:, 0], side="right") - 1
    for k, (a, b) in zip(of.tolist(), edges.tolist(), strict=True):
        base = int(text.starts[k])
        out[k].append((a - base, b - base))
    return out
