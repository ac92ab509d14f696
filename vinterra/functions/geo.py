"""Geodesy as Column expressions (P17, P18) and unit-sphere helpers for the
nearest-station join.

All formulas are closed-form and run JVM-side.  The projection constants are
the published IGN values for Lambert-93 (EPSG:2154) on GRS80.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from vinterra.functions._cols import as_col

# --- fixed values -----------------------------------------------------------
EARTH_RADIUS_KM = 6371.0
# Lambert-93 (IGN): cone constant n, projection constant C, false easting Xs,
# pole northing Ys, GRS80 first eccentricity e, central meridian 3 degrees E.
L93_N = 0.725607765053267
L93_C = 11754255.426096
L93_XS = 700000.0
L93_YS = 12655612.049876
L93_E = 0.0818191910428158
L93_LON0_DEG = 3.0
# ---------------------------------------------------------------------------

_INVERSE_ITERATIONS = 8


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km (R = 6371.0), ``asin`` argument clamped to 1."""
    p1, l1, p2, l2 = (F.radians(as_col(x)) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((l2 - l1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """The same formula as SQL text (used by the DuckDB oracles)."""
    return (
        f"(2 * {EARTH_RADIUS_KM} * asin(sqrt(least(1.0, "
        f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * "
        f"pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)))))"
    )


def unit_xyz(lat, lon) -> tuple[Column, Column, Column]:
    """Point on the unit sphere; chord length between two points orders them
    exactly like the great-circle distance."""
    p, l = F.radians(as_col(lat)), F.radians(as_col(lon))
    return F.cos(p) * F.cos(l), F.cos(p) * F.sin(l), F.sin(p)


def km_to_chord(km: float) -> float:
    return 2.0 * math.sin(km / (2.0 * EARTH_RADIUS_KM))


def to_lambert93(lat, lon) -> tuple[Column, Column]:
    """WGS84 degrees -> Lambert-93 metres (x, y)."""
    phi = F.radians(as_col(lat))
    lam = F.radians(as_col(lon))
    # isometric latitude; ((1 - es)/(1 + es))^(e/2) = exp(-e * atanh(es))
    iso = F.log(F.tan(F.lit(math.pi / 4) + phi / 2)) - F.lit(L93_E) * F.atanh(F.lit(L93_E) * F.sin(phi))
    r = F.lit(L93_C) * F.exp(-F.lit(L93_N) * iso)
    gamma = F.lit(L93_N) * (lam - F.lit(math.radians(L93_LON0_DEG)))
    return F.lit(L93_XS) + r * F.sin(gamma), F.lit(L93_YS) - r * F.cos(gamma)


def from_lambert93(x, y) -> tuple[Column, Column]:
    """Lambert-93 metres -> WGS84 degrees (lat, lon); latitude by fixed-point
    iteration unrolled into the expression."""
    dx = as_col(x) - F.lit(L93_XS)
    dy = as_col(y) - F.lit(L93_YS)
    r = F.sqrt(dx * dx + dy * dy)
    gamma = F.atan2(dx, -dy)
    lon = F.degrees(F.lit(math.radians(L93_LON0_DEG)) + gamma / F.lit(L93_N))
    iso = -F.log(r / F.lit(L93_C)) / F.lit(L93_N)
    # phi_{k+1} = 2 atan(((1 + e sin phi)/(1 - e sin phi))^(e/2) exp(L)) - pi/2, written
    # with atanh so that every iteration references phi once (linear expression size)
    phi = 2 * F.atan(F.exp(iso)) - F.lit(math.pi / 2)
    for _ in range(_INVERSE_ITERATIONS):
        phi = 2 * F.atan(F.exp(F.lit(L93_E) * F.atanh(F.lit(L93_E) * F.sin(phi)) + iso)) - F.lit(math.pi / 2)
    return F.degrees(phi), lon


def lambert93_sql(lat: str, lon: str) -> tuple[str, str]:
    """Forward projection as SQL text (oracle side)."""
    phi, lam = f"radians({lat})", f"radians({lon})"
    iso = f"(ln(tan({math.pi / 4} + {phi} / 2)) - {L93_E} * atanh({L93_E} * sin({phi})))"
    r = f"({L93_C} * exp(-{L93_N} * {iso}))"
    gamma = f"({L93_N} * ({lam} - {math.radians(L93_LON0_DEG)}))"
    return f"({L93_XS} + {r} * sin({gamma}))", f"({L93_YS} - {r} * cos({gamma}))"


def lambert93_inverse_sql(x: str, y: str) -> tuple[str, str]:
    dx, dy = f"({x} - {L93_XS})", f"({y} - {L93_YS})"
    r = f"sqrt({dx} * {dx} + {dy} * {dy})"
    gamma = f"atan2({dx}, -{dy})"
    lon = f"degrees({math.radians(L93_LON0_DEG)} + {gamma} / {L93_N})"
    iso = f"(-ln({r} / {L93_C}) / {L93_N})"
    phi = f"(2 * atan(exp({iso})) - {math.pi / 2})"
    for _ in range(_INVERSE_ITERATIONS):
        phi = f"(2 * atan(exp({L93_E} * atanh({L93_E} * sin({phi})) + {iso})) - {math.pi / 2})"
    return f"degrees({phi})", lon
