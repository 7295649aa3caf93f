"""Geospatial Column expressions. All stay inside whole-stage codegen."""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from beatwise.params import EARTH_KM, KM_PER_LAT, KM_PER_LNG, ROAD_DETOUR

Distance = Callable[[Column, Column, Column, Column], Column]
RAD = math.pi / 180.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    sin_lat = F.sin((lat2 - lat1) * F.lit(RAD) / 2)
    sin_lng = F.sin((lng2 - lng1) * F.lit(RAD) / 2)
    a = sin_lat * sin_lat + F.cos(lat1 * F.lit(RAD)) * F.cos(lat2 * F.lit(RAD)) * sin_lng * sin_lng
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def octile_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Street-grid distance: the diagonal part at sqrt(2) a side, the rest straight."""
    ns = haversine_km(lat1, lng1, lat2, lng1)
    ew = haversine_km(lat1, lng1, lat1, lng2)
    return F.abs(ns - ew) + F.lit(math.sqrt(2)) * F.least(ns, ew)


def road_estimate_km(straight_km: Column, crossings: Column, penalty: float = 4.0) -> Column:
    return straight_km * F.lit(ROAD_DETOUR) + crossings * F.lit(penalty)


def distance(mode: str) -> Distance:
    """The distance plug-in of a mode that needs no table: straight line or street grid."""
    return {"haversine": haversine_km, "grid": octile_km}[mode]


def cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size)).cast("bigint")


def local_x_km(lng: Column, lat0: Column) -> Column:
    return lng * F.lit(KM_PER_LNG) * F.cos(lat0 * F.lit(RAD))


def local_y_km(lat: Column) -> Column:
    return lat * F.lit(KM_PER_LAT)


def box_gap_km(a: str, b: str) -> Column:
    """Lower bound of the gap between two boxes; columns <prefix>min_lat, max_lat, min_lng, max_lng."""
    c = F.col
    dlat = F.greatest(F.lit(0.0), c(f"{a}min_lat") - c(f"{b}max_lat"), c(f"{b}min_lat") - c(f"{a}max_lat"))
    dlng = F.greatest(F.lit(0.0), c(f"{a}min_lng") - c(f"{b}max_lng"), c(f"{b}min_lng") - c(f"{a}max_lng"))
    mid = (c(f"{a}min_lat") + c(f"{a}max_lat") + c(f"{b}min_lat") + c(f"{b}max_lat")) / 4 * F.lit(RAD)
    return F.hypot(dlat * F.lit(KM_PER_LAT), dlng * F.lit(KM_PER_LNG) * F.cos(mid))


def orientation(ay, ax, by, bx, cy, cx) -> Column:
    """0 collinear (within 1e-12), 1 or 2 for the turn a -> b -> c; first of each pair is latitude."""
    v = (bx - ax) * (cy - by) - (by - ay) * (cx - bx)
    return F.when(F.abs(v) < 1e-12, 0).when(v > 0, 1).otherwise(2)


def segments_cross(p1, p2, p3, p4) -> Column:
    """Whether segment p1-p2 meets p3-p4; every point is a (lat, lng) pair of Columns."""
    return (orientation(*p1, *p2, *p3) != orientation(*p1, *p2, *p4)) & (
        orientation(*p3, *p4, *p1) != orientation(*p3, *p4, *p2))


def point_in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against an ARRAY<STRUCT<x,y>> ring (closed implicitly)."""
    n = F.size(ring)
    edge = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        F.element_at(ring, i).alias("a"),
        F.element_at(ring, F.when(i == 1, n).otherwise(i - 1)).alias("b")))
    hit = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (
        x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"])
        / F.when(e["b"]["y"] != e["a"]["y"], e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    return F.when(n < 3, F.lit(False)).otherwise(
        F.size(F.filter(edge, lambda e: F.coalesce(hit(e), F.lit(False)))) % 2 == 1)


def ring_literal(points: list[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def ring_centroid(ring: Column) -> Column:
    """Area centroid of an ARRAY<STRUCT<x,y>> ring, the mean of its points when it has no area."""
    n = F.size(ring)
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc, i):
        p, q = F.element_at(ring, i), F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))
        w = p["x"] * q["y"] - q["x"] * p["y"]
        return F.struct((acc["a"] + w).alias("a"), (acc["x"] + (p["x"] + q["x"]) * w).alias("x"),
                        (acc["y"] + (p["y"] + q["y"]) * w).alias("y"))

    area = F.aggregate(F.sequence(F.lit(1), n), start, add)
    total = lambda f: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[f]) / n
    flat = (n < 3) | (F.abs(area["a"]) < 1e-12)
    return F.struct(F.when(flat, total("x")).otherwise(area["x"] / (3 * area["a"])).alias("x"),
                    F.when(flat, total("y")).otherwise(area["y"] / (3 * area["a"])).alias("y"))


def map_link(lat: Column, lng: Column) -> Column:
    return F.format_string("https://www.google.com/maps/search/?api=1&query=%.6f,%.6f", lat, lng)


def hilbert_d(x: Column, y: Column, bits: int = 16) -> Column:
    """Position of grid point (x, y) along the Hilbert curve of 2^bits cells a side."""
    state = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("d"))
    sides = F.array(*[F.lit(1 << b).cast("bigint") for b in range(bits - 1, -1, -1)])

    def descend(st, s):
        right = F.when(st["x"].bitwiseAND(s) > 0, F.lit(1)).otherwise(F.lit(0))
        upper = F.when(st["y"].bitwiseAND(s) > 0, F.lit(1)).otherwise(F.lit(0))
        quadrant = F.when(right == 0, upper).otherwise(3 - upper)
        flip = (upper == 0) & (right == 1)
        fx = F.when(flip, s - 1 - st["x"]).otherwise(st["x"])
        fy = F.when(flip, s - 1 - st["y"]).otherwise(st["y"])
        return F.struct(F.when(upper == 0, fy).otherwise(fx).alias("x"),
                        F.when(upper == 0, fx).otherwise(fy).alias("y"),
                        (st["d"] + s * s * quadrant).cast("bigint").alias("d"))

    return F.aggregate(sides, state, descend)["d"]
