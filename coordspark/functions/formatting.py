"""Writing coordinates as text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coordspark.functions.parse import in_range


def round_half_even(value: Column, decimals: int = 6) -> Column:
    """Rounded by scaling, halves to the even neighbour, with no negative zero."""
    scale = float(10**decimals)
    return F.rint(value * scale) / scale + 0.0


def format_dms(value: Column, axis: str, decimals: int = 3) -> Column:
    """Degrees, minutes and seconds with a letter; null when the value is off its axis."""
    scale, most = 10**decimals, 60 * 10**decimals
    size = F.abs(value)
    whole = (size - F.floor(size)) * 60
    # the count of smallest units carries into minutes and degrees by itself
    units = F.floor(size) * (60 * most) + F.floor(whole) * most + F.rint((whole - F.floor(whole)) * most).cast("long")
    plus, minus = ("N", "S") if axis == "lat" else ("E", "W")
    seconds = F.format_string(f"%.{decimals}f", (units % most) / F.lit(float(scale)))
    text = F.format_string("%d° %d' %s\" %s", F.floor(units / (60 * most)), F.floor(units / most) % 60, F.regexp_replace(seconds, r"\.0*$|(\.[0-9]*?)0+$", "$1"), F.when(value < 0, minus).otherwise(plus))
    return F.when(in_range(value, axis), text)


def number_text(value: Column) -> Column:
    """The shortest decimal that reads back the same: plain from 1e-4 to 1e16 with at least one place, in powers of ten beyond."""
    sign = F.when(value.cast("string").startswith("-"), "-").otherwise("")
    plain = F.regexp_replace(F.abs(value).cast("decimal(38,20)").cast("string"), r"(\.[0-9]*?)0+$", "$1")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    # the first of one to seventeen digits that reads back; such values are few
    tries = [F.format_string(f"%.{places}e", F.abs(value)) for places in range(17)]
    power = F.coalesce(*(F.when(t.cast("double") == F.abs(value), t) for t in tries))
    # a double's own text is that decimal where it has no power of ten, and costs least
    near = F.abs(value).between(1e-3, 9999999.0)
    text = F.when((F.abs(value) >= 1e16) | ((F.abs(value) < 1e-4) & (value != 0)), power).otherwise(plain)
    return F.when(near, value.cast("string")).when(~F.isnan(value) & (F.abs(value) < float("inf")), F.concat(sign, text))


def wkt_point(lat: Column, lon: Column) -> Column:
    """POINT (lon lat) for a pair in range, else null."""
    good = in_range(lat, "lat") & in_range(lon, "lon")
    return F.when(good, F.concat(F.lit("POINT ("), number_text(lon), F.lit(" "), number_text(lat), F.lit(")")))


def gpx_number(value: Column) -> Column:
    """Ten places without trailing zeros or point."""
    plain = F.regexp_replace(F.format_string("%.10f", value), r"\.?0+$", "")
    return F.when(plain == "-0", "0").otherwise(plain)


def csv_safe(text: Column) -> Column:
    """A quote before cells a spreadsheet would run as a formula; signed coordinates stay."""
    # fixed value: the characters of coordinates
    harmless = r"^[0-9 .,\-+eE°ºª'\"′″ NSEWOLnsewol]*\z"
    risky = text.rlike("^[=@]") | (text.rlike(r"^[+\-\t\r]") & ~text.rlike(harmless))
    return F.when(risky, F.concat(F.lit("'"), text)).otherwise(text)


def xml_text(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def xml_attribute(text: Column) -> Column:
    return F.replace(xml_text(text), F.lit('"'), F.lit("&quot;"))


def without_controls(text: Column) -> Column:
    """Without the control characters that a workbook can't hold."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")


#: What each status says.
STATUS_TEXT = {
    "ok": "In range", "missing": "Unreadable or empty", "out_of_range": "Out of range", "swap_range": "Likely reversed: only the other order is in range",
    "swap_cluster": "Likely reversed: away from the rest", "swap_axis": "Reversed: a hemisphere letter says so",
}


def status_text(status: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in STATUS_TEXT.items() for x in pair))[status]
