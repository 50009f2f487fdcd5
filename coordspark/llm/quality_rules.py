"""Quality rules, line first: lines that fail are removed, then documents that lose too much go.

Base figures are exact over whole texts. A line fails by one of four rules:

* punctuation: symbols are a tenth or more of its characters, or half or more of its
  words end in a doubled exclamation mark, or it has no letter or digit at all;
* navigation: a fifth or more of its words are bare separators;
* boilerplate: it is short and holds a stock phrase of web pages;
* repetition: it equals an earlier line, or half or more of its words equal the word before.

A document is rejected when it fails the base rules, when lines with more than
``most_lost`` of its word characters fail, or when no word is left.

Nulls count as empty texts; empty texts have no words and fail the base rules.
Repeated rows are assessed one by one. Other columns pass unread, and a column
of the input called like the result is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordspark.llm import text as tx
from coordspark.llm.tables import bounded

#: Characters that count as symbols, ends of sentences, separators of menus.
SYMBOLS = b"#*$%&|<>"
SEPARATORS = tuple(x.encode() for x in ("|", ">", "»", "·", "•", "/", "::", "<", "«"))
STOCK_PHRASES = (
    "lorem ipsum", "javascript", "cookie policy", "accept cookies", "uses cookies", "privacy policy", "terms of use",
    "all rights reserved", "click here", "sign up", "log in to", "subscribe to our", "read more",
)
MOST_LOST = 0.5
LONGEST_STOCK_LINE = 25

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
#: Bytes of letters, digits and everything outside ASCII.
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("lost_chars", pa.int64()), ("clean_text", pa.string())]
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long, clean_text string"


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


def _keyed(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that are equal inside one text only."""
    return hashes ^ tx.mix(text.astype(tx.U) + tx.U(1))


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which entries are found twice or more, the first included; few are, so sorting the values alone is cheapest."""
    ordered = np.sort(keys)
    values = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(values):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(values, keys), len(values) - 1)
    return values[at] == keys


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier entry."""
    same = _twice(keys)
    some = np.flatnonzero(same)
    same[some[np.unique(keys[some], return_index=True)[1]]] = False
    return same


def _tails(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, tails: tuple[bytes, ...]) -> np.ndarray:
    """Which spans end in one of the byte strings."""
    out = np.zeros(len(starts), bool)
    for tail in tails:
        fits = ends - starts >= len(tail)
        for k, byte in enumerate(reversed(tail), 1):
            fits[fits] = buf[ends[fits] - k] == byte
        out |= fits
    return out


def _equal(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: tuple[bytes, ...]) -> np.ndarray:
    out = np.zeros(len(starts), bool)
    for value in values:
        out |= (ends - starts == len(value)) & _tails(buf, starts, ends, (value,))
    return out


def assess(buf: np.ndarray, offsets: np.ndarray, most_lost: float = MOST_LOST, with_text: bool = False) -> list:
    """The result's columns for a batch of texts."""
    n = len(offsets) - 1
    ws, we, hashes, at = tx.words(buf, offsets)
    n_words = np.diff(at)
    letters = (buf & 0xC0) != 0x80
    word_chars_each = _sums(letters, ws, we)
    per_text = lambda each: _sums(each, at[:-1], at[1:])
    word_chars, n_symbols = per_text(word_chars_each), _sums(_SYMBOL[buf], offsets[:-1], offsets[1:])

    ls, le, owner = tx.line_spans(buf, offsets)
    first, last = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    line_words = last - first
    again = np.zeros(len(ls), bool)
    full = np.flatnonzero(line_words)
    if len(full):
        again[full] = _repeats(_keyed(tx.span_hashes(buf, ls[full], le[full]), owner[full]))
    n_dup = np.bincount(owner[again], minlength=n)

    grams, begin = tx.windows(hashes, at)
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(grams):
        text = np.repeat(np.arange(n), np.diff(begin))
        twice = np.flatnonzero(_twice(_keyed(grams, text)))
        word = twice + (at[text[twice]] - begin[text[twice]])
        covered += np.bincount(word, minlength=len(covered)) - np.bincount(word + 5, minlength=len(covered))
    n_repeat = per_text(np.cumsum(covered[:-1]) > 0)
    base_failed = (n_words < 10) | (100 * n_repeat > 20 * n_words)

    # the line rules
    chars = _sums(letters, ls, le)
    line_chars = _sums(word_chars_each, first, last)
    symbols = _sums(_SYMBOL[buf], ls, le)
    shouted = _sums(_tails(buf, ws, we, (b"!!",)), first, last)
    separators = _sums(_equal(buf, ws, we, SEPARATORS), first, last)
    stutter = np.zeros(len(hashes), bool)
    stutter[1:] = hashes[1:] == hashes[:-1]
    stuttered = _sums(stutter, np.minimum(first + 1, last), last)
    bare = _sums(_PLAIN[buf], ls, le) == 0
    stock = np.zeros(len(ls), bool)
    lower = buf.tobytes().lower()
    for phrase in map(str.encode, STOCK_PHRASES):
        found = lower.find(phrase)
        while found >= 0:
            k = int(np.searchsorted(ls, found, "right")) - 1
            stock[k] |= found + len(phrase) <= le[k] and line_words[k] <= LONGEST_STOCK_LINE
            found = lower.find(phrase, found + len(phrase))
    failed = (line_words > 0) & (
        (10 * symbols >= np.maximum(chars, 1)) | (2 * shouted >= line_words) | bare | (5 * separators >= line_words)
        | stock | again | ((2 * stuttered >= line_words) & (line_words >= 4))
    )
    lost = np.bincount(owner, weights=np.where(failed, line_chars, 0), minlength=n).astype(np.int64)
    kept = ~base_failed & (lost <= most_lost * word_chars) & (lost < word_chars)
    texts = None
    if with_text:
        raw, texts, by = buf.tobytes(), [], np.searchsorted(owner, np.arange(n + 1))
        for k in range(n):
            good = [raw[ls[i] : le[i]] for i in range(by[k], by[k + 1]) if not failed[i]]
            texts.append(b"\n".join(good).decode("utf-8", "replace"))
    return [n_words, word_chars, n_symbols, n_dup, n_repeat, base_failed, kept, lost, texts if with_text else [None] * n]


def quality(text: Column, most_lost: float = MOST_LOST, with_text: bool = True) -> Column:
    """A struct of the figures, the verdict and the text without the lines that failed."""

    @F.arrow_udf(RESULT)
    def rules(texts: pa.Array) -> pa.Array:
        buf, offsets = tx.buffers(texts)
        parts = [assess(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], most_lost, with_text) for a, b in tx.pieces(offsets)]
        columns = [pa.concat_arrays([pa.array(p[k], t) for p in parts]) if parts else pa.array([], t) for k, (_, t) in enumerate(_FIELDS)]
        return pa.StructArray.from_arrays(columns, [name for name, _ in _FIELDS])

    # a filter on the verdict would else have the rules run a second time
    return rules.asNondeterministic()(text)


def clean(docs: DataFrame, text: str = "text", most_lost: float = MOST_LOST, result: str = "quality_rules") -> DataFrame:
    """The documents with their figures, verdict and cleaned text in one more struct column."""
    return bounded(docs).withColumn(result, quality(F.col(f"`{text}`"), most_lost))
