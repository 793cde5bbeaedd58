"""Coordinates and polygons. Coordinate systems are Columns; polygon tests are vectorized by cell."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EARTH_M = 6378137.0
# Fixed values of the public map projection: the lower bounds of its bands and each band's coefficients.
MERCATOR_BANDS = (12890594.86, 8362377.87, 5591021.0, 3481989.83, 1678043.12, 0.0)
MERCATOR_FACTORS = (
    (1.410526172116255e-8, 0.00000898305509648872, -1.9939833816331, 200.9824383106796, -187.2403703815547, 91.6087516669843, -23.38765649603339, 2.57121317296198, -0.03801003308653, 17337981.2),
    (-7.435856389565537e-9, 0.000008983055097726239, -0.78625201886289, 96.32687599759846, -1.85204757529826, -59.36935905485877, 47.40033549296737, -16.50741931063887, 2.28786674699375, 10260144.86),
    (-3.030883460898826e-8, 0.00000898305509983578, 0.30071316287616, 59.74293618442277, 7.357984074871, -25.38371002664745, 13.45380521110908, -3.29883767235584, 0.32710905363475, 6856817.37),
    (-1.981981304930552e-8, 0.000008983055099779535, 0.03278182852591, 40.31678527705744, 0.65659298677277, -4.44255534477492, 0.85341911805263, 0.12923347998204, -0.04625736007561, 4482777.06),
    (3.09191371068437e-9, 0.000008983055096812155, 0.00006995724062, 23.10934304144901, -0.00023663490511, -0.6321817810242, -0.00663494467273, 0.03430082397953, -0.00466043876332, 2555164.4),
    (2.890871144776878e-9, 0.000008983055095805407, -3.068298e-8, 7.47137025468032, -0.00000353937994, -0.02145144861037, -0.00001234426596, 0.00010322952773, -0.00000323890364, 826088.5),
)
LNG_SHIFT, LAT_SHIFT, RADIUS_WAVE, ANGLE_WAVE = 0.0065, 0.006, 0.00002, 0.000003


def mercator_to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """(lng, lat) by the polynomial of the band that |y| falls in."""
    lng = lat = None
    for bound, factor in reversed(list(zip(MERCATOR_BANDS, MERCATOR_FACTORS, strict=True))):
        c = F.abs(y) / factor[9]
        poly = F.lit(factor[8])
        for k in range(7, 1, -1):
            poly = poly * c + factor[k]
        here = F.lit(factor[0]) + F.lit(factor[1]) * F.abs(x)
        lng, lat = (here, poly) if lng is None else (F.when(F.abs(y) >= bound, here).otherwise(lng), F.when(F.abs(y) >= bound, poly).otherwise(lat))
    return F.when(x < 0, -lng).otherwise(lng), F.when(y < 0, -lat).otherwise(lat)


def unshift(lng: Column, lat: Column) -> tuple[Column, Column]:
    """(lng, lat) of a shifted coordinate in the plain national system."""
    x, y = lng - LNG_SHIFT, lat - LAT_SHIFT
    radius = F.sqrt(x * x + y * y) - RADIUS_WAVE * F.sin(y * math.pi)
    angle = F.atan2(y, x) - ANGLE_WAVE * F.cos(x * math.pi)
    return radius * F.cos(angle), radius * F.sin(angle)


def drift(lat: Column, lng: Column, other_lat: Column, other_lng: Column) -> Column:
    return F.sqrt((lat - other_lat) * (lat - other_lat) + (lng - other_lng) * (lng - other_lng))


def haversine_m(lat: Column, lng: Column, other_lat: Column, other_lng: Column) -> Column:
    up, across = F.radians(other_lat - lat) / 2, F.radians(other_lng - lng) / 2
    part = F.sin(up) * F.sin(up) + F.cos(F.radians(lat)) * F.cos(F.radians(other_lat)) * F.sin(across) * F.sin(across)
    return 2 * EARTH_M * F.asin(F.sqrt(part))


def polyline_rings(c: Column) -> Column:
    """Rings of [lng, lat] from 'x,y;x,y|x,y;…', those of three points or more, closed."""
    rings = F.transform(F.split(c, r"\|"), lambda ring: F.transform(F.split(ring, ";"), lambda p: F.transform(F.split(p, ","), lambda v: v.try_cast("double"))))
    return F.transform(F.filter(rings, lambda ring: F.size(ring) >= 3), close_ring)


def close_ring(ring: Column) -> Column:
    return F.when(ring[0] == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.array(ring[0])))


@F.pandas_udf(DoubleType())
def ring_area_m2(rings: pd.Series) -> pd.Series:
    """Area of each ring of [lng, lat] on the sphere."""

    def area(ring: object) -> float | None:
        if ring is None or len(ring) < 4:
            return None
        p = np.radians(np.array([list(q) for q in ring], float))
        before, after = np.roll(p[:-1, 0], 1), np.roll(p[:-1, 0], -1)
        return float(abs(((after - before) * np.sin(p[:-1, 1])).sum()) * EARTH_M**2 / 2)

    return rings.map(area)


def smallest_containing(points: DataFrame, polygons: DataFrame, cell: float = 0.01) -> DataFrame:
    """(point_id, polygon_id): the smallest polygon around each point (point_id, lng, lat).

    Polygons (polygon_id, ring) are dealt to the grid cells that their bounds touch, points to
    their own cell; an equi-join on the cell proposes pairs and ray casting decides them.
    """
    x, y = F.transform("ring", lambda p: p[0]), F.transform("ring", lambda p: p[1])
    shapes = polygons.select("polygon_id", "ring", ring_area_m2("ring").alias("area"), *[f(a).alias(n) for n, f, a in (("x0", F.array_min, x), ("x1", F.array_max, x), ("y0", F.array_min, y), ("y1", F.array_max, y))])
    across = F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell))
    up = F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))
    shapes = shapes.withColumn("cx", F.explode(across)).withColumn("cy", F.explode(up))
    spots = points.select("point_id", "lng", "lat", F.floor(F.col("lng") / cell).alias("cx"), F.floor(F.col("lat") / cell).alias("cy"))
    near = spots.join(shapes, ["cx", "cy"]).filter("lng between x0 and x1 and lat between y0 and y1")
    hits = near.filter(inside(F.col("lng"), F.col("lat"), F.col("ring")))
    return hits.groupBy("point_id").agg(F.min_by("polygon_id", F.struct("area", "polygon_id")).alias("polygon_id"))


def inside(lng: Column, lat: Column, ring: Column) -> Column:
    """Ray casting over a closed ring as one expression."""
    edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("p"), F.slice(ring, 2, F.size(ring) - 1).alias("q"))

    def crosses(edge: Column) -> Column:
        p, q = edge["p"], edge["q"]
        at = (q[0] - p[0]) * (lat - p[1]) / (q[1] - p[1]) + p[0]
        return F.coalesce((p[1] > lat) != (q[1] > lat), F.lit(False)) & F.when(q[1] != p[1], lng < at).otherwise(False)

    return F.size(F.filter(edges, crosses)) % 2 == 1
