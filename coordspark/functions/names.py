"""Names of files and fields, and the record of where a result came from."""

from __future__ import annotations

import re
import unicodedata

from coordspark.functions import crs

#: The longest file name and field name, and what stands in for an empty one.
MOST_NAME, MOST_FIELD, FIELD = 60, 10, "field"


def file_name(name: str | None, default: str = "coordinates", most: int = MOST_NAME) -> str:
    """The last part of a path without its ending, in plain letters, digits, dashes and single underscores."""
    last = re.split(r"[\\/]", name or "")[-1]
    stem = last.rsplit(".", 1)[0] if "." in last[1:] else last
    plain = unicodedata.normalize("NFKD", stem).encode("ascii", "ignore").decode()
    tidy = re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_-]+", "_", plain)).strip("_-")
    return tidy[:most].strip("_-") or default


def field_names(names: list[str]) -> list[str]:
    """Names a DBF can hold: ten bytes, letters, digits and underscores, told apart without regard to case."""
    made: list[str] = []
    for name in names:
        base = _cut("".join(c if c.isalnum() else "_" for c in str(name)), MOST_FIELD) or FIELD
        found, k = base, 1
        while found.lower() in (m.lower() for m in made):
            found, k = _cut(base, MOST_FIELD - len(str(k))) + str(k), k + 1
        made.append(found)
    return made


def _cut(text: str, most: int) -> str:
    """The start of a text that takes so many bytes at most."""
    return text.encode()[:most].decode("utf-8", "ignore")


def system_name(system: crs.System | None) -> str:
    if system is None:
        return "WGS84 (EPSG:4326)"
    return f"EPSG:{system.code}" if system.code > 0 else f"{system.ellipsoid} {'projected' if system.projected else 'degrees'}"


def transformation_of(system: crs.System | None, mode: str = "grid") -> str:
    """How a system's values come to WGS84."""
    if system is None or (system.shift is None and not system.needs_grid):
        return "none"
    return "grid shift (NTv2)" if system.needs_grid and mode == "grid" else "seven-parameter shift, position vector"


def provenance(*, date: str, file: str, sheet: str | None = None, source: crs.System | None = None, target: crs.System | None = None, scale: float = 1.0, swaps: int = 0, sheet_fixes: int = 0, mode: str = "grid") -> list[tuple[str, str]]:
    """Labels and values in order."""
    out = [("application", "coordspark"), ("date", date), ("file", f"{file} [{sheet}]" if sheet else file), ("source system", system_name(source)), ("transformation", transformation_of(source, mode))]
    if source is not None and source.shift:
        out.append(("parameters", ",".join(f"{x:g}" for x in source.shift)))
    if scale != 1.0:
        out.append(("scale", f"values read in kilometres (x {scale:g})"))
    if swaps:
        out.append(("corrections", f"{swaps} rows exchanged"))
    if sheet_fixes:
        out.append(("sheet corrections", f"{sheet_fixes} rows"))
    out.append(("degrees", "WGS84, decimal"))
    if target is not None:
        out.append(("second system", f"{system_name(target)}; {transformation_of(target, mode)}"))
    return out


def metadata_text(pairs: list[tuple[str, str]]) -> str:
    return "\n".join(f"{label}: {value}" for label, value in pairs)
