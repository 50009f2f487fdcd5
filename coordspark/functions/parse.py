"""Reading coordinates from text, as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The letter, the unsigned number and the form of a projected number.
_LETTER = r"(?iu)(?<![\p{L}\p{Nl}\p{No}])([NSEWOL])(?![\p{L}\p{Nl}\p{No}])"
_NUMBER = r"[0-9]+(?:[.,][0-9]+)?"
_METRES = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"
#: Characters that are removed before reading, white space as Unicode has it, and what is removed inside projected numbers.
_REMOVED = "[﻿\u0085\u001c-\u001f]"
_WHITE = r"[\s\x0B\u0085   -     　\u001c-\u001f]"
_SPACES = r"[\s\x0B\u0085   -     　\u001c-\u001f﻿']"
#: What a reader may have put for an empty cell, and the marks of an angle.
_BLANKS = ("", "nan", "None", "-")
_ANGULAR = r"""(?iu)[°º'"′″]|[NSEWOL](?![\p{L}\p{N}_])"""


def _clean(text: Column) -> Column:
    out = F.translate(F.regexp_replace(text.cast("string"), _REMOVED, ""), "ºª", "°°")
    return F.regexp_replace(out, f"^{_WHITE}+|{_WHITE}+$", "")


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text.cast("string"), f"^{_WHITE}+|{_WHITE}+$", "")


def blank(text: Column) -> Column:
    """Whether a cell has nothing in it, however that is spelled."""
    return F.coalesce(stripped(text).isin(*_BLANKS), F.lit(True))


def looks_angular(text: Column) -> Column:
    """Whether a cell carries a degree sign, a prime or a hemisphere letter."""
    return F.coalesce(text.rlike(_ANGULAR), F.lit(False))


def letter(text: Column) -> Column:
    """The first isolated hemisphere letter, upper case; empty where there is none."""
    return _letter_of(_clean(text))


def _letter_of(clean: Column) -> Column:
    return F.upper(F.regexp_extract(clean, _LETTER, 1))


def _numbers_of(clean: Column) -> Column:
    return F.regexp_extract_all(clean, F.lit(f"({_NUMBER})"), F.lit(1))


def _value_of(clean: Column, found: Column, numbers: Column) -> Column:
    part = lambda k: F.replace(F.get(numbers, F.lit(k)), F.lit(","), F.lit(".")).cast("double")
    value = part(0) + F.coalesce(part(1), F.lit(0.0)) / 60 + F.coalesce(part(2), F.lit(0.0)) / 3600
    minus = F.when(found != "", found.isin("S", "W", "O")).otherwise(clean.rlike(r"^-\s*[0-9]"))
    bad = clean.isin("", "-", "—") | F.coalesce(part(1) >= 60, F.lit(False)) | F.coalesce(part(2) >= 60, F.lit(False))
    return F.when(~bad, value * F.when(minus, -1.0).otherwise(1.0))


def parse_coordinate(text: Column) -> Column:
    """Decimal degrees; null where the text can't be read. Values out of range are returned."""
    t = _clean(text)
    return _value_of(t, _letter_of(t), _numbers_of(t))


def with_coordinates(df: DataFrame, cells: dict[str, str], mismatch: str | None = None) -> DataFrame:
    """The frame with each named coordinate read from a cell column, and on request whether letters contradict lat and lon.

    Cleaned text, letter and numbers are columns of their own on the way, so the plan computes each once.
    """
    columns, prefix = df.columns, f"read_{uuid.uuid4().hex[:8]}"  # names that no column has
    names = [(out, *(f"{prefix}_{out}_{k}" for k in range(3))) for out in cells]
    df = df.withColumns({t: _clean(F.col(cells[out])) for out, t, _, _ in names})
    df = df.withColumns({k: v for _, t, a, n in names for k, v in ((a, _letter_of(F.col(t))), (n, _numbers_of(F.col(t))))})
    values = {out: _value_of(F.col(t), F.col(a), F.col(n)) for out, t, a, n in names}
    if mismatch is not None:
        letters = {out: F.col(a) for out, _, a, _ in names}
        values[mismatch] = F.coalesce(letters["lat"].isin("E", "W", "O", "L") | letters["lon"].isin("N", "S"), F.lit(False))
    return df.withColumns(values).select(*(c for c in columns if c not in values), *values)


def parse_projected(text: Column) -> Column:
    """Metres: the last of point and comma is the decimal sign and the other one marks thousands; null where the text isn't a finite number."""
    t = F.regexp_replace(text.cast("string"), _SPACES, "")
    both = t.contains(".") & t.contains(",")
    last = F.replace(F.regexp_replace(t, "[.,](?=.*[.,])", ""), F.lit(","), F.lit("."))
    plain = F.when(both, last).otherwise(F.replace(t, F.lit(","), F.lit(".")))
    value = F.when(plain.rlike(_METRES), plain.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def hemisphere_axis(text: Column) -> Column:
    """The axis a cell's letter names: lat, lon or null."""
    found = letter(text)
    return F.when(found.isin("N", "S"), "lat").when(found != "", "lon")


def axis_mismatch(lat: Column, lon: Column) -> Column:
    """Whether a letter proves that a cell stands in the wrong column."""
    return F.coalesce(hemisphere_axis(lat) == "lon", F.lit(False)) | F.coalesce(hemisphere_axis(lon) == "lat", F.lit(False))


def in_range(value: Column, axis: str) -> Column:
    most = 90 if axis == "lat" else 180
    return F.coalesce(value.between(-most, most), F.lit(False))


def valid_pair(lat: Column, lon: Column) -> Column:
    return in_range(lat, "lat") & in_range(lon, "lon")


def bare(text: Column) -> Column:
    """Whether a cell has neither a sign nor a hemisphere letter."""
    clean = _clean(text)
    return F.coalesce(~clean.startswith("-") & (_letter_of(clean) == ""), F.lit(False))


def sign_missing(value: Column, unsigned: Column, axis: str, boxes: tuple) -> Column:
    """Whether only the region's sign is missing: written without one, off the region's span on the axis, and inside it once negated."""
    low, high = (min(b[0] for b in boxes), max(b[1] for b in boxes)) if axis == "lat" else (min(b[2] for b in boxes), max(b[3] for b in boxes))
    return F.coalesce(unsigned & ~value.between(low, high) & (-value).between(low, high), F.lit(False))


def unsigned_outside(text: Column, axis: str, boxes: tuple) -> Column:
    """The same for a cell."""
    return sign_missing(parse_coordinate(text), bare(text), axis, boxes)


def sheet_key_25k(text: Column) -> Column:
    """A 1:25 000 sheet's number and letters, as 349, 162A or 325B/C; null where the text is none."""
    parts = lambda k: F.regexp_extract(stripped(text), r"(?i)^(?:folha\s*)?([0-9]{1,3})(?:[.,]0+)?\s*-?\s*([a-c](?:\s*/\s*[a-c])?)?$", k)
    return F.when(parts(1) != "", F.concat(parts(1).cast("int").cast("string"), F.upper(F.regexp_replace(parts(2), r"\s", ""))))


def sheet_key_50k(text: Column) -> Column:
    """A 1:50 000 sheet's number and letters, as 43-A; null where the text is none."""
    parts = lambda k: F.regexp_extract(stripped(text), r"(?i)^0*([0-9]{1,2})\s*[-\s]?\s*([a-d]{1,2})$", k)
    return F.when(parts(1) != "", F.concat(parts(1), F.lit("-"), F.upper(parts(2))))
