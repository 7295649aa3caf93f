"""Legs, distances and minutes of driven routes; identity of routes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatwise.functions.geo import Distance, haversine_km
from beatwise.operators.prefix import running_total, with_previous
from beatwise.operators.roads import PAIR, pair_key
from beatwise.params import Workday

CELL = ["market_id", "rep_id", "week", "day_of_week"]


def route_legs(stops: DataFrame, route: list[str] = CELL, dist: Distance = haversine_km) -> DataFrame:
    """Stops with the kilometres from the stop before, 0 for the first."""
    prev = with_previous(stops, route, "seq", {"_plat": "latitude", "_plng": "longitude"})
    km = dist(F.col("_plat"), F.col("_plng"), F.col("latitude"), F.col("longitude"))
    return prev.withColumn("leg_km", F.coalesce(km, F.lit(0.0))).drop("_plat", "_plng")


def road_legs(stops: DataFrame, road_pairs: DataFrame, route: list[str] = CELL) -> DataFrame:
    """``route_legs`` with the road's km and minutes (``road_km``, ``road_min``) from the stop before, null where the pair
    (``roads.road_pairs_from_matrix``) is unknown and for the first stop."""
    prev = with_previous(stops, route, "seq", {"_plat": "latitude", "_plng": "longitude"})
    ends = [F.col(x) for x in ("_plat", "_plng", "latitude", "longitude")]
    known = road_pairs.select(*PAIR, F.col("km").alias("road_km"), F.col("minutes").alias("road_min"))
    legs = prev.withColumn("leg_km", F.coalesce(haversine_km(*ends), F.lit(0.0))).select("*", *pair_key(*ends))
    return legs.join(known, PAIR, "left").drop(*PAIR, "_plat", "_plng")


def cumulative_km(legs: DataFrame, route: list[str] = CELL) -> DataFrame:
    """Kilometres from the first stop to each, as ``at_km``."""
    return running_total(legs, route, F.floor(F.col("seq") / 4096), ["seq"], "leg_km", "at_km")


def route_position(legs: DataFrame, marks: DataFrame, route: list[str] = CELL) -> DataFrame:
    """Where a marker is after ``mark_km`` along a route: interpolated point and stops reached.

    A mark beyond the route stands at its last stop, one before it at the first.
    """
    at = cumulative_km(legs, route)
    prev = with_previous(at, route, "seq", {"_km": "at_km", "_lat": "latitude", "_lng": "longitude"})
    ends = at.groupBy(*route).agg(F.max("at_km").alias("_end"), F.max("seq").alias("_last"))
    wanted = marks.join(ends, route).withColumn("_m", F.greatest(F.lit(0.0), F.least(F.col("mark_km"), F.col("_end"))))
    one = F.col("_last") == 1
    done = F.col("_m") >= F.col("_end")
    leg = (F.col("_km") <= F.col("_m")) & (F.col("_m") < F.col("at_km"))
    hit = prev.join(wanted, route).filter(F.when(one | done, F.col("seq") == F.col("_last")).otherwise(leg))
    t = F.when(one | done, 1.0).otherwise((F.col("_m") - F.col("_km")) / (F.col("at_km") - F.col("_km")))
    start = lambda a, b: F.coalesce(F.col(a), F.col(b))
    return hit.select(*route, "mark_km",
                      (start("_lat", "latitude") + (F.col("latitude") - start("_lat", "latitude")) * t).alias("lat"),
                      (start("_lng", "longitude") + (F.col("longitude") - start("_lng", "longitude")) * t).alias("lng"),
                      F.when(one | done, F.col("seq")).otherwise(F.col("seq") - 1).alias("stops_reached"))


def drive_minutes(straight_km: Column, wd: Workday, road_km: Column | None = None, road_min: Column | None = None) -> Column:
    """Driving minutes: the road's own time when known, else road km, else stretched straight km, at the usual speed."""
    km = straight_km * F.lit(wd.detour)
    if road_km is not None:
        km = F.coalesce(road_km, km)
    by_speed = km / F.lit(max(1.0, wd.speed_kmh)) * 60
    return by_speed if road_min is None else F.coalesce(road_min * F.lit(wd.road_time_factor), by_speed)


def scorecard_days(legs: DataFrame, wd: Workday = Workday(), keep: tuple[str, ...] = ("run", "day_group"),
                   hop_km: float = 4.0, cell: list[str] = CELL) -> DataFrame:
    """One row per driven day: visits, km, call, drive and total minutes, legs over the hop limit.

    Legs that carry road figures (``road_legs``) count with the known km and minutes, others with the stretched straight
    line; without any, ``km`` is the straight line. Hops are always measured straight.
    """
    keep = tuple(k for k in keep if k in legs.columns)
    straight, by_road = F.col("leg_km"), "road_km" in legs.columns
    km = F.coalesce("road_km", straight * F.lit(wd.detour)) if by_road else straight
    drive = drive_minutes(straight, wd, F.col("road_km"), F.col("road_min")) if by_road else None
    days = legs.groupBy(*cell, *keep).agg(
        F.count(F.lit(1)).alias("visits"), F.sum(km).alias("km"), F.sum("call_minutes").alias("call_min"),
        F.max("leg_km").alias("longest_km"), F.count_if(F.col("leg_km") > hop_km).alias("long_legs"), *([F.sum(drive).alias("drive_min")] if by_road else []))
    drive = F.col("drive_min") if by_road else drive_minutes(F.col("km"), wd)
    return days.withColumn("drive_min", drive).withColumn(
        "total_min", F.col("call_min") + drive + F.lit(wd.commute + wd.pause))


def distinct_routes(stops: DataFrame, rep: list[str] = ["market_id", "rep_id"]) -> DataFrame:
    """One cell per different set of stops of a rep (a route driven on several days counts once).

    Sets are compared by an order-free fingerprint (count and two independent 64-bit hash sums),
    an ordinary aggregate however long a route is.
    """
    h = F.xxhash64("outlet_id").cast("decimal(38,0)")
    g = F.xxhash64("outlet_id", F.lit(17)).cast("decimal(38,0)")
    sets = stops.groupBy(*rep, "week", "day_of_week").agg(
        F.count(F.lit(1)).alias("stops"), F.sum(h).alias("_h"), F.sum(g).alias("_g"))
    at = F.min(F.struct("week", "day_of_week"))
    return sets.groupBy(*rep, "stops", "_h", "_g").agg(at.alias("_at"), F.count(F.lit(1)).alias("times")).select(
        *rep, F.col("_at.week").alias("week"), F.col("_at.day_of_week").alias("day_of_week"), "stops", "times")


def leg_cost(km: Column, hop_km: float, weight: float = 10.0) -> Column:
    """A leg priced at its km, plus ten times what it runs over the hop limit."""
    return km + F.lit(weight) * F.greatest(F.lit(0.0), km - F.lit(hop_km))


def route_limits(days: DataFrame, max_km: float | None, max_minutes: float | None, max_visits: int | None) -> DataFrame:
    """Days with the limits they break, as an array of texts."""
    rules = [("km", max_km, "distance"), ("total_min", max_minutes, "duration"), ("visits", max_visits, "visits")]
    found = F.array_compact(F.array(*[F.when(F.col(col) > limit, F.lit(f"{label} over {limit:g}"))
                                      for col, limit, label in rules if limit]))
    return days.withColumn("violations", found)


def spread_tour(points: DataFrame, group: list[str]) -> DataFrame:
    """Expected length of a good tour per group from its spread alone: 0.7124 sqrt(n * pi * variance)."""
    from beatwise.functions.geo import local_x_km, local_y_km
    from beatwise.params import TOUR_CONSTANT
    mean = points.groupBy(*group).agg(F.avg("latitude").alias("_lat0"), F.avg("longitude").alias("_lng0"),
                                      F.count(F.lit(1)).alias("n"))
    d = points.join(mean, group)
    dx = local_x_km(F.col("longitude") - F.col("_lng0"), F.col("_lat0"))
    dy = local_y_km(F.col("latitude") - F.col("_lat0"))
    out = d.groupBy(*group, "n").agg(F.sum(dx * dx + dy * dy).alias("_ss"))
    return out.select(*group, "n", F.when(F.col("n") < 2, 0.0).otherwise(
        F.lit(TOUR_CONSTANT) * F.sqrt(F.lit(3.141592653589793) * F.col("_ss"))).alias("tour_km"))
