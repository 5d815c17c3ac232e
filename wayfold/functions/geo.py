"""Distances and ring geometry as column expressions.

Positions are degrees; rings are arrays of ``struct<lat, lon>``, latitude first, closing
point optional. Everything stays inside built-in functions, so scans keep their codegen.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the sphere's radius that published distances are based on.
EARTH_RADIUS_M = 6_371_000.0

RING_TYPE = "array<struct<lat:double,lon:double>>"


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; null if any coordinate is."""
    dlat, dlon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = dlat * dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * dlon * dlon
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(h))


def haversine_of(lat1: float, lon1: float, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """haversine_m() of one place and many, in the same steps."""
    dlat, dlon = np.sin(np.radians(lat2 - lat1) / 2), np.sin(np.radians(lon2 - lon1) / 2)
    h = dlat * dlat + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * dlon * dlon
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(h))


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """Values from 0 as F.round() has them: half up by the shortest decimals. Only those next to a half need their decimals."""
    scale = 10.0**digits
    scaled = values * scale
    out = np.floor(scaled + 0.5)
    for k in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) <= 1e-9 + scaled * 1e-15):
        out[k] = float(Decimal(repr(float(values[k]))).scaleb(digits).to_integral_value(ROUND_HALF_UP))
    return out / scale


def near_box(lat: Column, lon: Column, at_lat: Column, at_lon: Column, radius_m: Column) -> Column:
    """A box that holds the circle, on plain columns so that file statistics can skip.

    Latitudes only bound the distance from below by |dlat|; longitudes are used while the
    circle stays off the poles and within half a turn."""
    dlat = F.degrees(radius_m / EARTH_RADIUS_M) * 1.000001
    widest = F.greatest(F.abs(at_lat - dlat), F.abs(at_lat + dlat))
    spread = F.sin(F.radians(dlat)) / F.cos(F.radians(at_lat))
    dlon = F.when((widest < 89.9) & (spread < 1), F.degrees(F.asin(spread)) * 1.000001).otherwise(360.0)
    turned = F.abs(F.pmod(lon - at_lon + 180.0, F.lit(360.0)) - 180.0)
    return lat.between(at_lat - dlat, at_lat + dlat) & (turned <= dlon)


def round_coord(x: Column) -> Column:
    """Seven decimals, decided on the exact value of the double; ties away from zero."""
    return F.signum(x) * scaled_digits(x, 7) / 10.0**7


def _halves(x: Column) -> tuple[Column, Column]:
    """The upper and lower half of a double's digits, whose sum it is."""
    wide = x * 134217729.0
    upper = wide - (wide - x)
    return upper, x - upper


def scaled_digits(x: Column, decimals: int) -> Column:
    """|x| * 10^decimals as a whole number (a double), nearest to the exact value of the
    binary fraction, the greater of two equally near: 9.95 is just below its decimal, so it
    has 99 tenths. The product's rounding error is found exactly from half-length factors."""
    scale = 10.0**decimals
    a = F.abs(x)
    product = a * scale
    high, low = _halves(a)
    wide = scale * 134217729.0
    up = wide - (wide - scale)
    down = scale - up
    error = ((high * up - product) + high * down + low * up) + low * down
    whole = F.floor(product).cast("double")
    return F.when(product >= 2.0**52, product).when((product - whole) - 0.5 >= -error, whole + 1).otherwise(whole)


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ring(points: Sequence[tuple[float, float]]) -> Column:
    """A literal ring."""
    if not points:
        return F.array().cast(RING_TYPE)
    return F.array(*(F.struct(F.lit(float(a)).alias("lat"), F.lit(float(o)).alias("lon")) for a, o in points))


def _edges(points: Column) -> Column:
    """Pairs (this point, the one before; the last before the first)."""
    last = F.slice(points, F.greatest(F.size(points), F.lit(1)), 1)
    before = F.slice(F.concat(last, points), F.lit(1), F.size(points))
    return F.arrays_zip(points.alias("b"), before.alias("a"))


def in_ring(lat: Column, lon: Column, points: Column) -> Column:
    """Even-odd ray casting with the closing edge implied; false for an empty ring."""

    def crosses(e: Column) -> Column:
        b, a = e["b"], e["a"]
        straddles = (b["lat"] > lat) != (a["lat"] > lat)
        at = b["lon"] + (lat - b["lat"]) * (a["lon"] - b["lon"]) / F.nullif(a["lat"] - b["lat"], F.lit(0.0))
        return straddles & F.coalesce(lon < at, F.lit(False))

    return F.size(F.filter(_edges(points), crosses)) % 2 == 1


def in_fixed_ring(lat: str, lon: str, points: Sequence[tuple[float, float]]) -> str:
    """in_ring for constant points as SQL over two columns' names: one boolean expression
    over the edges, all in generated code, parsed at once."""
    odd = []
    for k, (lat_b, lon_b) in enumerate(points):
        lat_a, lon_a = points[k - 1]
        if lat_a != lat_b:
            at = f"{lon_b!r}D + ({lat} - {lat_b!r}D) * {lon_a - lon_b!r}D / {lat_a - lat_b!r}D"
            odd.append(f"int(({lat_b!r}D > {lat}) <> ({lat_a!r}D > {lat}) AND {lon} < {at})")
    return f"(({' + '.join(odd)}) % 2 = 1)" if odd else "false"


def ring_distance_m(lat: Column, lon: Column, points: Column) -> Column:
    """Metres to the ring's boundary on the flat plane at the point; infinite if empty."""
    across = F.cos(F.radians(lat)) * EARTH_RADIUS_M
    flat = F.transform(points, lambda p: F.struct((F.radians(p["lon"] - lon) * across).alias("x"), (F.radians(p["lat"] - lat) * EARTH_RADIUS_M).alias("y")))

    def gap(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.coalesce(-(a["x"] * dx + a["y"] * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.hypot(a["x"] + t * dx, a["y"] + t * dy)

    return F.coalesce(F.array_min(F.transform(_edges(flat), gap)), F.lit(float("inf")))


def circle_within(lat: Column, lon: Column, radius_m: Column, include: Column, exclude: Column) -> Column:
    """Inside some include ring, in no exclude ring, and at least the radius away from
    every boundary. ``include`` and ``exclude`` are arrays of rings."""
    inside = F.exists(include, lambda r: in_ring(lat, lon, r)) & ~F.exists(exclude, lambda r: in_ring(lat, lon, r))
    return inside & F.forall(F.concat(include, exclude), lambda r: ring_distance_m(lat, lon, r) >= radius_m)
