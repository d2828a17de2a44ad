"""Bearings and points between coordinates, and polygon measures."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_KM = 6371.0088


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(angle + 360, F.lit(360.0))


def point_along(lat1: Column, lon1: Column, lat2: Column, lon2: Column, share: float) -> tuple[Column, Column]:
    return lat1 + (lat2 - lat1) * share, lon1 + (lon2 - lon1) * share


def bend(lat1: Column, lon1: Column, lat2: Column, lon2: Column, by: float) -> tuple[Column, Column]:
    """The midpoint moved sideways by a share of the distance."""
    return (lat1 + lat2) / 2 + (lon2 - lon1) * by, (lon1 + lon2) / 2 - (lat2 - lat1) * by


def _rings(geometry: str | None) -> list[list[list[list[float]]]]:
    """Rings of each polygon, outer first; empty rings, and polygons whose outer ring is empty, are left out."""
    try:
        shape = json.loads(geometry or "")
    except ValueError:
        return []
    kind, at = (shape.get("type"), shape.get("coordinates") or []) if isinstance(shape, dict) else ("", [])
    polygons = [at] if kind == "Polygon" else at if kind == "MultiPolygon" else []
    return [[r for r in rings if r] for rings in polygons if rings and rings[0]]


def ring_area(ring: list[list[float]]) -> float:
    """Spherical area of a ring in square kilometres, signed by its direction."""
    total = 0.0
    for (x1, y1, *_), (x2, y2, *_) in zip(ring, ring[1:] + ring[:1], strict=True):
        total += math.radians(x2 - x1) * (2 + math.sin(math.radians(y1)) + math.sin(math.radians(y2)))
    return total * EARTH_KM**2 / 2


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("area_km2", "lat", "lon")]))
def polygon_measures(geometry: pd.Series) -> pd.DataFrame:
    """Area and mean-vertex centroid of a GeoJSON polygon or multipolygon; null if there is none, also for a null or empty geometry."""
    rows = []
    for text in geometry:
        shapes = _rings(text)
        if not shapes:
            rows.append((None, None, None))
            continue
        area = sum(abs(ring_area(rings[0])) - sum(abs(ring_area(r)) for r in rings[1:]) for rings in shapes)
        corners = [p for rings in shapes for p in (rings[0][:-1] if rings[0][:1] == rings[0][-1:] and len(rings[0]) > 1 else rings[0])]
        rows.append((area, sum(p[1] for p in corners) / len(corners), sum(p[0] for p in corners) / len(corners)))
    return pd.DataFrame(rows, columns=["area_km2", "lat", "lon"])


def square(lon: str, lat: str, side: float = 1.0) -> Column:
    """GeoJSON of the square that begins at a point, in degrees; null where the point is."""
    corner = lambda a, b: F.concat(F.lit("["), (F.col(lon) + a).cast("string"), F.lit(","), (F.col(lat) + b).cast("string"), F.lit("]"))
    ring = [corner(a, b) for a, b in ((0, 0), (side, 0), (side, side), (0, side), (0, 0))]
    # concat gives null for a null corner, where concat_ws would leave it out
    body = F.concat(*[x for c in ring for x in (c, F.lit(","))][:-1])
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), body, F.lit("]]}"))


def area_or_measured(area: Column, measured: Column) -> Column:
    """The stated area in square kilometres if it is above 0, else that of the polygon, else null."""
    return F.coalesce(F.when(area > 0, area), F.when(measured > 0, measured))
