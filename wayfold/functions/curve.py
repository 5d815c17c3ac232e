"""Places along a Hilbert curve over the globe.

Positions near each other lie near each other on the curve, mostly, so a table that is
sorted by the key has a circle's places in few files, and the circle's key ranges say which.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.geo import EARTH_RADIUS_M

#: Halvings of each axis, and the number of squares that a circle is covered by at most, about.
LEVELS, SQUARES = 16, 64


def _step(x, y, half, pick):
    """One level of the curve: the quarter's place in the order, and the position within it,
    turned as the curve turns there. ``pick``(condition, then, else) works on numbers and columns alike."""
    right, upper = x >= half, y >= half
    quarter = pick(right, pick(upper, 2, 3), pick(upper, 1, 0))
    ix, iy = pick(right, x - half, x), pick(upper, y - half, y)
    # the first quarter is mirrored along one diagonal, the last one along the other
    turned_x = pick(upper, ix, pick(right, half - 1 - iy, iy))
    turned_y = pick(upper, iy, pick(right, half - 1 - ix, ix))
    return quarter, turned_x, turned_y


def square_index(x: int, y: int, levels: int) -> int:
    """The place on the curve of the square (x, y) of 2**levels by 2**levels."""
    out = 0
    for k in reversed(range(levels)):
        quarter, x, y = _step(x, y, 1 << k, lambda c, a, b: a if c else b)
        out = out * 4 + quarter
    return out


def hilbert(lat: Column, lon: Column, levels: int = LEVELS) -> Column:
    """The key of a position (a long); null if a coordinate is."""
    side = 1 << levels
    cell = lambda v: F.least(F.greatest(F.floor(v * side), F.lit(0)), F.lit(side - 1)).cast("long")
    start = F.struct(cell(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0).alias("x"), cell((lat + 90.0) / 180.0).alias("y"), F.lit(0).cast("long").alias("d"))

    def level(a: Column, half: Column) -> Column:
        q, x, y = _step(a["x"], a["y"], half, lambda c, t, e: F.when(c, t).otherwise(e))
        return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), (a["d"] * 4 + q).cast("long").alias("d"))

    halves = F.array(*(F.lit(1 << k).cast("long") for k in reversed(range(levels))))
    key = F.aggregate(halves, start, level)["d"]
    return F.when(lat.isNotNull() & lon.isNotNull(), key)


def circle_ranges(lat: float, lon: float, radius_m: float, levels: int = LEVELS, squares: int = SQUARES) -> list[tuple[int, int]]:
    """Ranges of keys (both ends included, in order) that hold every place of the circle.

    The circle's box is covered by squares that are halved as long as they are few."""
    reach = math.degrees(radius_m / EARTH_RADIUS_M) * 1.000001
    south, north = max(-90.0, lat - reach), min(90.0, lat + reach)
    spread = math.sin(math.radians(min(reach, 90.0))) / max(math.cos(math.radians(lat)), 1e-12)
    wide = math.degrees(math.asin(spread)) * 1.000001 if abs(lat) + reach < 89.9 and spread < 1 else 180.0
    at = (lon + 180.0) % 360.0
    if wide >= 180.0:
        spans = [(0.0, 360.0)]
    else:
        west, east = at - wide, at + wide
        spans = [(west, east)] if 0 <= west and east < 360 else [(west % 360.0, 360.0), (0.0, east % 360.0)]

    def meets(x: int, y: int, k: int) -> bool:
        size_x, size_y = 360.0 / (1 << k), 180.0 / (1 << k)
        # the last square's upper edge belongs to it
        if (y + 1) * size_y - 90 < south or y * size_y - 90 > north:
            return False
        return any((x + 1) * size_x >= w and x * size_x <= e for w, e in spans)

    now, k = [(0, 0)], 0
    while k < levels:
        then = [(2 * x + i, 2 * y + j) for x, y in now for i in (0, 1) for j in (0, 1) if meets(2 * x + i, 2 * y + j, k + 1)]
        if len(then) > squares:
            break
        now, k = then, k + 1
    shift = 2 * (levels - k)
    out: list[tuple[int, int]] = []
    for d in sorted(square_index(x, y, k) for x, y in now):
        low, high = d << shift, ((d + 1) << shift) - 1
        if out and out[-1][1] + 1 == low:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out
