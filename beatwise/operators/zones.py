"""Figures about zones of outlets, and worth of covering them."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatwise.functions.geo import haversine_km
from beatwise.operators.neighbours import nearest
from beatwise.operators.prefix import median_of, median_ranks, order_statistics
from beatwise.session import cut


def zone_metrics(outlets: DataFrame, keys: list[str], zone: str = "zone_id") -> DataFrame:
    """Centroid, radius, visits, value and isolation (nearest other centroid) of each zone."""
    c = F.col
    base = outlets.groupBy(*keys, zone).agg(
        F.avg("latitude").alias("lat"), F.avg("longitude").alias("lng"), F.count(F.lit(1)).alias("outlets"),
        F.greatest(F.lit(1), F.sum("vf")).alias("monthly_visits"), F.sum("value").alias("total_value"))
    radius = outlets.join(base.select(*keys, zone, "lat", "lng"), [*keys, zone]).groupBy(*keys, zone).agg(
        F.max(haversine_km(c("latitude"), c("longitude"), c("lat"), c("lng"))).alias("radius_km"))
    spots = base.select(*keys, zone, c("lat").alias("latitude"), c("lng").alias("longitude"))
    near = nearest(spots, spots, keys, 1, zone, zone).select(*keys, zone, c("km").alias("isolation_km"))
    return base.join(radius, [*keys, zone]).join(near, [*keys, zone], "left")


def coverage_worth(metrics: DataFrame, keys: list[str], mode: str = "isolation", zone: str = "zone_id", top: int = 15) -> DataFrame:
    """Zones that cost far more driving per visit than the median zone, worst first (a top-k report).

    Markets of fewer than three zones have none. ``value`` weighs the drive against commercial value.
    """
    from pyspark.sql import Window
    c = F.col
    drive = 2 * c("isolation_km") + 2 * c("radius_km")
    m = cut(metrics.withColumn("cost_km", drive / c("monthly_visits")).withColumn("value_km", F.coalesce("total_value", F.lit(0.0)) / F.greatest(F.lit(0.1), drive)))
    med = order_statistics(m, keys, "cost_km", median_ranks("m")).select(*keys, F.greatest(F.lit(0.1), median_of("m")).alias("_med"), c("n").alias("_n"))
    m = m.join(med, keys).filter("_n >= 3")
    if mode == "value":
        v = order_statistics(m, keys, "value_km", median_ranks("v")).select(*keys, F.greatest(F.lit(0.001), median_of("v")).alias("_v"))
        m = m.join(v, keys)
        flag = (c("value_km") < c("_v") / 3) & (c("cost_km") > 2 * c("_med"))
    else:
        flag = c("cost_km") > F.greatest(3 * c("_med"), F.lit(2.0))
    w = Window.partitionBy(*keys).orderBy(F.desc("cost_km"), zone)
    return m.filter(flag).withColumn("place", F.row_number().over(w)).filter(c("place") <= top).drop("_med", "_n", "_v")


def silhouette(points: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    """Exact mean silhouette by great-circle distance per key.

    Every outlet meets every other of its key, so the key should be one of bounded size, such as a
    rep; ``silhouette_squared`` is linear in the outlets and serves whole markets.
    """
    c = F.col
    a = points.select(*keys, c("outlet_id").alias("a_id"), c(cluster).alias("a_c"), c("latitude").alias("a_lat"), c("longitude").alias("a_lng"))
    b = points.select(*keys, c("outlet_id").alias("b_id"), c(cluster).alias("b_c"), c("latitude").alias("b_lat"), c("longitude").alias("b_lng"))
    d = a.join(b, keys).filter("a_id <> b_id")
    mean = d.groupBy(*keys, "a_id", "a_c", "b_c").agg(F.avg(haversine_km(c("a_lat"), c("a_lng"), c("b_lat"), c("b_lng"))).alias("m"))
    ab = mean.groupBy(*keys, "a_id").agg(
        F.coalesce(F.max(F.when(c("a_c") == c("b_c"), c("m"))), F.lit(0.0)).alias("a"), F.min(F.when(c("a_c") != c("b_c"), c("m"))).alias("b"))
    s = F.when(c("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((c("b") - c("a")) / F.greatest("a", "b"))
    n = points.groupBy(*keys).agg(F.count_distinct(cluster).alias("_c"), F.count(F.lit(1)).alias("_n"))
    total = ab.groupBy(*keys).agg(F.sum(s).alias("_s"))
    return n.join(total, keys, "left").select(*keys, F.when(c("_c") <= 1, 1.0).otherwise(F.coalesce("_s", F.lit(0.0)) / c("_n")).alias("silhouette"))


def silhouette_squared(points: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    """Mean silhouette by squared local distance, from per-cluster sums: no outlet meets another.

    Mean squared distance of a point to a cluster is |p|^2 - 2 p.mean + mean of |q|^2, so a point
    only meets the clusters of its key.
    """
    c = F.col
    centre = points.groupBy(*keys).agg(F.avg("latitude").alias("_la"), F.avg("longitude").alias("_lo"))
    p = points.join(centre, keys).withColumn("_x", (c("longitude") - c("_lo")) * F.lit(111.32) * F.cos(F.radians("_la"))).withColumn(
        "_y", (c("latitude") - c("_la")) * F.lit(110.57))
    s = p.groupBy(*keys, c(cluster).alias("_c")).agg(F.sum("_x").alias("_sx"), F.sum("_y").alias("_sy"),
                                                     F.sum(c("_x") ** 2 + c("_y") ** 2).alias("_ss"), F.count(F.lit(1)).alias("_n"))
    d = p.join(s, keys)
    own = c(cluster) == c("_c")
    tot = c("_n") * (c("_x") ** 2 + c("_y") ** 2) - 2 * (c("_x") * c("_sx") + c("_y") * c("_sy")) + c("_ss")
    ab = d.groupBy(*keys, "outlet_id").agg(
        F.max(F.when(own, F.greatest(F.lit(0.0), tot) / F.greatest(F.lit(1), c("_n") - 1))).alias("a"), F.min(F.when(~own, F.greatest(F.lit(0.0), tot) / c("_n"))).alias("b"))
    one = F.when(c("b").isNull() | (F.greatest("a", "b") <= 0), 0.0).otherwise((c("b") - c("a")) / F.greatest("a", "b"))
    return ab.groupBy(*keys).agg(F.avg(one).alias("silhouette"))


def cluster_quality(points: DataFrame, keys: list[str], cluster: str, weight: str = "vf") -> DataFrame:
    """Compactness + 100 x workload imbalance + 50 x (1 - silhouette); lower is better."""
    c = F.col
    z = points.groupBy(*keys, cluster).agg(F.avg("latitude").alias("_la"), F.avg("longitude").alias("_lo"), F.sum(weight).alias("_w"))
    km = haversine_km(c("latitude"), c("longitude"), c("_la"), c("_lo"))
    compact = points.join(z, [*keys, cluster]).groupBy(*keys).agg(F.sum(km * km).alias("compactness"))
    mean = z.groupBy(*keys).agg(F.avg("_w").alias("_m"))
    bal = z.join(mean, keys).groupBy(*keys).agg(F.sum(((c("_w") - c("_m")) / c("_m")) ** 2).alias("imbalance"))
    return compact.join(bal, keys).join(silhouette(points, keys, cluster), keys).withColumn(
        "score", c("compactness") + 100 * c("imbalance") + 50 * (1 - c("silhouette")))
