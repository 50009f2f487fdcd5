"""Coordinate reference systems as column expressions; every coefficient is a literal."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import partial
from math import radians, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Semi-major axis and inverse flattening.
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "intl": (6378388.0, 297.0)}
#: Fixed value: the longitude of the Lisbon meridian.
LISBON = -9.1319061111111


@dataclass(frozen=True)
class System:
    """lat_0 and lon_0 in degrees; shift is the seven position-vector parameters to WGS84."""

    code: int
    ellipsoid: str = "WGS84"
    projected: bool = True
    lat_0: float = 0.0
    lon_0: float = 0.0
    scale: float = 1.0
    x_0: float = 0.0
    y_0: float = 0.0
    shift: tuple[float, ...] | None = None
    needs_grid: bool = False  # the shift then stands in for the grid, to a metre or so


def utm(code: int, zone: int, ellipsoid: str = "WGS84", shift: tuple[float, ...] | None = None, south: bool = False) -> System:
    return System(code, ellipsoid, True, 0.0, zone * 6 - 183.0, 0.9996, 500000.0, 1e7 if south else 0.0, shift)


#: Parameters of older datums.
_DATUM_73 = (-230.994, 102.591, 25.199, 0.633, -0.239, 0.900, 1.950)
_LISBOA = (-283.088, -70.693, 117.445, -1.157, 0.059, -0.652, -4.058)
_MADEIRA = (-160.410, -21.066, -99.282, 2.437, -17.250, -7.446, 0.168)
SYSTEMS = {
    s.code: s
    for s in (
        System(4326, "WGS84", False), System(4258, "GRS80", False), System(5013, "GRS80", False),
        System(3763, "GRS80", True, 39.6682583333333, -8.13310833333333),
        utm(25829, 29, "GRS80"), utm(32629, 29), utm(5014, 25, "GRS80"), utm(5015, 26, "GRS80"), utm(5016, 28, "GRS80"),
        System(27493, "intl", True, 39.6666666666667, -8.13190611111111, 1.0, 180.598, -86.99, _DATUM_73, True),
        System(20790, "intl", True, 39.6666666666667, 1 + LISBON, 1.0, 200000.0, 300000.0, _LISBOA, True),
        utm(2188, 25, "intl", (-487.978, -226.275, 102.787, -0.743, 1.677, 2.087, 1.485)),
        utm(2189, 26, "intl", (-185.391, 122.266, 35.989, 0.120, 3.180, 2.046, -1.053)),
        utm(2190, 26, "intl", (-269.089, 186.247, 155.667, 2.005, 3.606, -0.366, 0.097)),
        utm(2191, 28, "intl", _MADEIRA), utm(2942, 28, "intl", _MADEIRA), utm(3061, 28, "intl", _MADEIRA),
    )
}


def get(code: int | System) -> System:
    if isinstance(code, System):
        return code
    if code not in SYSTEMS:
        raise KeyError(f"unknown system: {code}")
    return SYSTEMS[code]


def systems(kind: str | None = None) -> list[System]:
    """The registered systems: all, or those that are geographic or projected."""
    return [s for s in SYSTEMS.values() if kind is None or s.projected == (kind == "projected")]


def utm_zone(zone: int, south: bool = False, ellipsoid: str = "WGS84") -> System:
    """A zone from 1 to 60; its code is negative for GRS80."""
    if not 1 <= zone <= 60 or ellipsoid not in ("WGS84", "GRS80"):
        raise ValueError(f"no such zone: {zone} on {ellipsoid}")
    return utm((32700 if south else 32600) + zone if ellipsoid == "WGS84" else -(100 * zone + south), zone, ellipsoid, south=south)


def utm_label(zone: int, south: bool = False) -> str:
    return f"UTM{zone}{'S' if south else 'N'}"


def from_proj4(text: str) -> System:
    """A pasted definition: longlat, utm or tmerc on a known ellipsoid, with a seven-parameter shift and a meridian if need be."""
    words = dict(w.lstrip("+").partition("=")[::2] for w in text.split() if w.startswith("+"))
    kind = words.get("proj")
    known = {"proj", "ellps", "datum", "zone", "south", "lat_0", "lon_0", "k", "k_0", "x_0", "y_0", "towgs84", "pm", "units", "no_defs", "type", "wktext"}
    name = words.get("datum") or words.get("ellps") or "WGS84"
    if kind not in ("longlat", "latlong", "utm", "tmerc") or set(words) - known or name not in ELLIPSOIDS or words.get("units", "m") != "m":
        raise ValueError(f"unsupported definition: {text}")
    shift = tuple(float(x) for x in words["towgs84"].split(",")) if "towgs84" in words else None
    if shift is not None and len(shift) not in (3, 7):
        raise ValueError(f"a shift has three or seven parameters: {text}")
    shift = None if shift is None or not any(shift) else shift + (0.0,) * (7 - len(shift))
    pm = {"lisbon": LISBON, "greenwich": 0.0}.get(words.get("pm", "greenwich"), words.get("pm"))
    if kind == "utm":
        if not 1 <= int(words.get("zone") or 0) <= 60:
            raise ValueError(f"a zone is missing: {text}")
        return utm(0, int(words["zone"]), name, shift, "south" in words)
    number = lambda *keys, default=0.0: float(next((words[k] for k in keys if k in words), default))
    return System(0, name, kind == "tmerc", number("lat_0"), number("lon_0") + float(pm), number("k", "k_0", default=1.0), number("x_0"), number("y_0"), shift)


def resolve(choice: int | str | System | None) -> System | None:
    """A choice of system: none (degrees as they are), a code, a UTM label such as UTM33S, or a definition."""
    if choice is None or isinstance(choice, (int, System)):
        return None if choice is None else get(choice)
    zone = re.fullmatch(r"UTM([0-9]{1,2})([NS])", choice)
    return utm_zone(int(zone[1]), zone[2] == "S") if zone else from_proj4(choice) if choice.startswith("+") else get(int(choice))


def esri_wkt(system: int | System) -> str:
    """The system as text for a shapefile's .prj."""
    s = get(system)
    a, inv = ELLIPSOIDS[s.ellipsoid]
    names = {"WGS84": ("GCS_WGS_1984", "D_WGS_1984", "WGS_1984"), "GRS80": ("GCS_ETRS_1989", "D_ETRS_1989", "GRS_1980"), "intl": ("GCS_International_1924", "D_International_1924", "International_1924")}
    gcs, datum, spheroid = names[s.ellipsoid]
    base = f'GEOGCS["{gcs}",DATUM["{datum}",SPHEROID["{spheroid}",{a:.1f},{inv:.9g}]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
    if not s.projected:
        return base
    values = {"False_Easting": s.x_0, "False_Northing": s.y_0, "Central_Meridian": s.lon_0, "Scale_Factor": s.scale, "Latitude_Of_Origin": s.lat_0}
    return f'PROJCS["EPSG_{s.code}",{base},PROJECTION["Transverse_Mercator"],' + ",".join(f'PARAMETER["{k}",{v!r}]' for k, v in values.items()) + ',UNIT["Meter",1.0]]'


def _series(ellipsoid: str) -> tuple[float, float, tuple[float, ...], tuple[float, ...]]:
    """Eccentricity, rectifying radius and the forward and inverse series of the third flattening."""
    a, inv = ELLIPSOIDS[ellipsoid]
    f = 1 / inv
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    forward = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    inverse = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    )
    return sqrt(f * (2 - f)), radius, forward, inverse


def _forward_angles(e: float, lat: Column, lon: Column) -> tuple[Column, Column]:
    s = F.sin(lat)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    return F.atan2(t, F.cos(lon)), F.atanh(F.sin(lon) / F.sqrt(1 + t * t))


def _to_tm(s: System, lat: Column, lon: Column) -> tuple[Column, Column]:
    e, radius, forward, _ = _series(s.ellipsoid)
    xi, eta = _forward_angles(e, F.radians(lat), F.radians(lon - s.lon_0))
    northing, easting = xi, eta
    for k, c in enumerate(forward, 1):
        northing = northing + c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        easting = easting + c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    origin = _origin(s)
    return s.x_0 + s.scale * radius * easting, s.y_0 + s.scale * (radius * northing - origin)


def _origin(s: System) -> float:
    from math import asin, atanh, sin, sinh, tanh

    e, radius, forward, _ = _series(s.ellipsoid)
    lat = sin(radians(s.lat_0))
    t = sinh(atanh(lat) - e * atanh(e * lat))
    xi = asin(tanh(0.0) if t == 0 else t / sqrt(1 + t * t))
    return radius * (xi + sum(c * sin(2 * k * xi) for k, c in enumerate(forward, 1)))


def _from_tm(s: System, x: Column, y: Column) -> tuple[Column, Column]:
    _, radius, _, inverse = _series(s.ellipsoid)
    xi = ((y - s.y_0) / s.scale + _origin(s)) / radius
    eta = (x - s.x_0) / (s.scale * radius)
    p, q = xi, eta
    for k, c in enumerate(inverse, 1):
        p = p - c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        q = q - c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    return F.asin(F.sin(p) / F.cosh(q)), F.degrees(F.atan2(F.sinh(q), F.cos(p))) + s.lon_0


def _geographic(s: System, conformal: Column, lon: Column) -> tuple[Column, Column]:
    """Latitude from the conformal one by its series in the third flattening."""
    f = 1 / ELLIPSOIDS[s.ellipsoid][1]
    n = f / (2 - f)
    series = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    return F.degrees(conformal + sum((c * F.sin(2 * k * conformal) for k, c in enumerate(series, 1)), F.lit(0.0))), lon


def _to_space(ellipsoid: str, lat: Column, lon: Column) -> tuple[Column, ...]:
    a, inv = ELLIPSOIDS[ellipsoid]
    e2 = (2 - 1 / inv) / inv
    phi, lam = F.radians(lat), F.radians(lon)
    v = a / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    return v * F.cos(phi) * F.cos(lam), v * F.cos(phi) * F.sin(lam), v * (1 - e2) * F.sin(phi)


def _moved(shift: tuple[float, ...], back: bool, *xyz: Column) -> tuple[Column, ...]:
    """The seven-parameter shift by position vectors, with rotations as small angles; the way back turns by the transpose, as the published answers do."""
    rx, ry, rz = (radians(r / 3600) for r in shift[3:6])
    turn, scale, add = np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]]), 1 + shift[6] * 1e-6, np.array(shift[:3])
    m = turn.T / scale if back else turn * scale
    if back:
        add = -m @ add
    return tuple(float(add[i]) + sum((float(m[i, j]) * xyz[j] for j in range(3)), F.lit(0.0)) for i in range(3))


def _from_space(ellipsoid: str, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Latitude in closed form, good to far under a millimetre near the ground."""
    a, inv = ELLIPSOIDS[ellipsoid]
    b = a * (1 - 1 / inv)
    e2 = (2 - 1 / inv) / inv
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * a, p * b)
    lat = F.atan2(z + e2 / (1 - e2) * b * F.pow(F.sin(theta), 3), p - e2 * a * F.pow(F.cos(theta), 3))
    return F.degrees(lat), F.degrees(F.atan2(y, x))


def _legs(a: System, b: System) -> list:
    """Functions of columns from (x, y) of one system to those of the other, through WGS84."""
    legs = [partial(_from_tm, a), partial(_geographic, a)] if a.projected else [lambda x, y: (y, x)]
    for s, back in ((a, False), (b, True)):
        if s.shift:
            ends = ("WGS84", s.ellipsoid) if back else (s.ellipsoid, "WGS84")
            legs += [partial(_to_space, ends[0]), partial(_moved, s.shift, back), partial(_from_space, ends[1])]
    return legs + [partial(_to_tm, b) if b.projected else (lambda lat, lon: (lon, lat))]


def transform(df: DataFrame, x: str, y: str, source: int | System, target: int | System, out: tuple[str, str] = ("x_out", "y_out"), mode: str = "grid") -> DataFrame:
    """The frame with x and y of the target system; null where a value is null or not finite.

    Systems that need a grid file refuse in mode grid, as none is installed; in mode helmert
    their seven-parameter shift is used. Heights aren't carried: each way through a shift drops
    some metres of height, which moves a point by millimetres there and back. Each leg's values
    are columns on the way, so a plan computes them once.
    """
    a, b = get(source), get(target)
    for s in (a, b):
        if s.needs_grid and a != b and mode != "helmert":
            raise ValueError(f"system {s.code} needs a grid file, and none is installed; mode helmert uses its shift")
    keep = [c for c in df.columns if c not in out]
    values = (F.col(x), F.col(y))
    prefix = f"leg_{uuid.uuid4().hex[:8]}"  # a name that no column has
    for k, leg in enumerate([] if a == b else _legs(a, b)):
        made = dict(zip((f"{prefix}_{k}_{i}" for i in range(3)), leg(*values)))
        df = df.withColumns(made)
        values = tuple(map(F.col, made))
    finite = (F.abs(values[0]) < float("inf")) & (F.abs(values[1]) < float("inf"))
    return df.select(*keep, *(F.when(finite, v).alias(name) for v, name in zip(values, out, strict=True)))


def to_wgs84(df: DataFrame, x: str, y: str, source: int | System, out: tuple[str, str] = ("lon", "lat"), mode: str = "grid") -> DataFrame:
    return transform(df, x, y, source, 4326, out, mode)


def from_wgs84(df: DataFrame, lon: str, lat: str, target: int | System, out: tuple[str, str] = ("x", "y"), mode: str = "grid") -> DataFrame:
    return transform(df, lon, lat, 4326, target, out, mode)
