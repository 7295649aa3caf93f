"""Known road distances and barriers between points."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwise.functions.geo import haversine_km, road_estimate_km, segments_cross


def point_key(lat: Column, lng: Column) -> Column:
    """A point on the 1e-4 degree grid road pairs are known on."""
    return F.struct(F.floor(lat * 1e4 + 0.5).cast("bigint").alias("lat_i"), F.floor(lng * 1e4 + 0.5).cast("bigint").alias("lng_i"))


def pair_key(lat1, lng1, lat2, lng2) -> list[Column]:
    a, b = point_key(lat1, lng1), point_key(lat2, lng2)
    lo, hi = F.least(a, b), F.greatest(a, b)
    return [lo["lat_i"].alias("lat1_i"), lo["lng_i"].alias("lng1_i"), hi["lat_i"].alias("lat2_i"), hi["lng_i"].alias("lng2_i")]


PAIR = ["lat1_i", "lng1_i", "lat2_i", "lng2_i"]


def road_pairs_from_matrix(matrix: DataFrame) -> DataFrame:
    """Unordered pairs from directed rows (lat1, lng1, lat2, lng2, km, minutes): the shorter direction with its minutes."""
    keyed = matrix.select(*pair_key(*[F.col(x) for x in ("lat1", "lng1", "lat2", "lng2")]), "km", "minutes")
    same = (F.col("lat1_i") == F.col("lat2_i")) & (F.col("lng1_i") == F.col("lng2_i"))
    return keyed.filter(~same).groupBy(*PAIR).agg(F.min(F.struct("km", "minutes")).alias("_b")).select(
        *PAIR, F.col("_b.km").alias("km"), F.col("_b.minutes").alias("minutes"))


def barrier_segments(barriers: DataFrame) -> DataFrame:
    """(barrier, seg, lat_a, lng_a, lat_b, lng_b) from (barrier, points ARRAY<STRUCT<lat,lng>>)."""
    e = barriers.select("barrier", F.posexplode("points").alias("pos", "p"), "points")
    nxt = F.get("points", F.col("pos") + 1)
    return e.filter(F.col("pos") + 1 < F.size("points")).select(
        "barrier", F.col("pos").alias("seg"), F.col("p.lat").alias("lat_a"), F.col("p.lng").alias("lng_a"),
        nxt["lat"].alias("lat_b"), nxt["lng"].alias("lng_b"))


def barrier_crossings(pairs: DataFrame, barriers: list[tuple[str, list[tuple[float, float]]]]) -> Column:
    """Number of barriers the straight line of a pair crosses, each counted once.

    Barriers are plan settings, a handful of polylines: their segments are literals of one
    expression, tested in place without a join.
    """
    p1, p2 = (F.col("lat1"), F.col("lng1")), (F.col("lat2"), F.col("lng2"))
    total = F.lit(0)
    for _, points in barriers:
        hit = F.lit(False)
        for (a, b), (c, d) in zip(points, points[1:]):
            box = ((F.least("lat1", "lat2") <= max(a, c)) & (F.greatest("lat1", "lat2") >= min(a, c))
                   & (F.least("lng1", "lng2") <= max(b, d)) & (F.greatest("lng1", "lng2") >= min(b, d)))
            hit = hit | (box & segments_cross(p1, p2, (F.lit(a), F.lit(b)), (F.lit(c), F.lit(d))))
        total = total + F.when(hit, 1).otherwise(0)
    return total


def road_distance(pairs: DataFrame, road_pairs: DataFrame, barriers=()) -> DataFrame:
    """Add ``road_km``: the known pair's km, else the estimate with barrier detours."""
    keyed = pairs.select("*", *pair_key(*[F.col(x) for x in ("lat1", "lng1", "lat2", "lng2")]))
    known = road_pairs.select(*PAIR, F.col("km").alias("_known"))
    straight = haversine_km(*[F.col(x) for x in ("lat1", "lng1", "lat2", "lng2")])
    return (keyed.join(known, PAIR, "left")
            .withColumn("road_km", F.coalesce("_known", road_estimate_km(straight, barrier_crossings(pairs, list(barriers)))))
            .drop(*PAIR, "_known"))
