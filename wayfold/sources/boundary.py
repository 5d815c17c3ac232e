"""Boundary files (.poly): a name, sections of "lon lat" lines closed by END, holes marked
with !, and a final END. Any malformation raises."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession

_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def _number(token: str) -> float:
    """The number a token starts with; trailing junk is ignored, as in the files' other readers."""
    m = _NUMBER.match(token)
    return float(m[0]) if m else math.nan


def parse_boundary(text: str) -> dict[str, list[list[tuple[float, float]]]]:
    """include and exclude rings of (lat, lon)."""
    lines = [x for x in (y.strip() for y in re.split(r"\r?\n", text)) if x]
    if not lines:
        raise ValueError("the boundary file is empty")
    out: dict[str, list] = {"include": [], "exclude": []}
    rest = iter(enumerate(lines[1:], 1))
    for at, header in rest:
        if header == "END":
            if at != len(lines) - 1:
                raise ValueError("there is content after the final END")
            return out
        points = []
        for _, line in rest:
            if line == "END":
                break
            tokens = line.split()
            lon, lat = (_number(t) for t in (tokens + ["", ""])[:2])
            if len(tokens) != 2 or not (math.isfinite(lon) and math.isfinite(lat)):
                raise ValueError(f'"{line}" is not a "lon lat" pair')
            points.append((lat, lon))
        else:
            raise ValueError(f'section "{header}" is never closed by END')
        out["exclude" if header.startswith("!") else "include"].append(points)
    raise ValueError("the final END is missing")


def coverage_frame(spark: SparkSession, text: str) -> DataFrame:
    """role, ring_no, points: a few rings as rows."""
    rings = parse_boundary(text)
    rows = [(role, k, [{"lat": a, "lon": o} for a, o in points]) for role in ("include", "exclude") for k, points in enumerate(rings[role])]
    return spark.createDataFrame(rows, "role string, ring_no int, points array<struct<lat:double,lon:double>>")


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """From any path that Spark reads."""
    return coverage_frame(spark, spark.read.text(path, wholetext=True).first()[0])
