"""Spatial joins: neighbours within a distance, k nearest neighbours, connected components.

Every join is an equi-join on grid cells with a residual distance test; a grid level suits the
distance searched. Outlets on one spot are collapsed before pairs are built, and the work per
outlet is bounded by its own surroundings, not by its market.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatwise.functions.geo import haversine_km
from beatwise.session import cut

KM_PER_DEGREE = 6371.0 * math.pi / 180
# Cell sizes in degrees, from about 450 m up to one cell for the whole globe.
LADDER = [0.004, 0.016, 0.064, 0.512, 4.096, 512.0]
AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def _offsets(pairs) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in pairs])


def _gridded(df: DataFrame, size: Column | float) -> DataFrame:
    size = size if isinstance(size, Column) else F.lit(size)
    return (df.withColumn("_cy", F.floor(F.col("latitude") / size).cast("bigint"))
            .withColumn("_cx", F.floor(F.col("longitude") / size).cast("bigint")))


def _spread(df: DataFrame, pairs=AROUND) -> DataFrame:
    """One row per cell to look into."""
    return (df.withColumn("_o", F.explode(_offsets(pairs)))
            .withColumn("_cy", F.col("_cy") + F.col("_o.dy")).withColumn("_cx", F.col("_cx") + F.col("_o.dx"))
            .drop("_o"))


def reach_degrees(km: Column) -> Column:
    """Degrees that surely cover ``km`` around a row in both directions."""
    lat = F.least(F.lit(89.0), F.abs(F.col("latitude")) + km / KM_PER_DEGREE)
    return km / (KM_PER_DEGREE * F.cos(F.radians(lat))) * (1 + 1e-9) + 1e-12


def spots(outlets: DataFrame, keys: list[str], id_col: str = "outlet_id") -> DataFrame:
    """Distinct positions with how many outlets each holds; the spot id is its lowest outlet id."""
    return outlets.groupBy(*keys, "latitude", "longitude").agg(
        F.min(id_col).alias("spot_id"), F.count(F.lit(1)).alias("n"))


def within_km(left: DataFrame, right: DataFrame, keys: list[str], km: float) -> DataFrame:
    """Pairs of rows of two frames at most ``km`` apart; columns get the suffixes _a and _b, plus ``km``.

    The cell follows the latitude band with the longest reach, so nine cells always cover the radius.
    """
    top = F.abs(F.col("latitude"))
    lat = right.agg(F.max(top).alias("m")).first()["m"]
    size = km / (KM_PER_DEGREE * max(0.01, math.cos(math.radians(min(89.0, (lat or 0.0) + km / KM_PER_DEGREE))))) * (1 + 1e-9)
    rename = lambda df, s: df.select(*keys, "_cy", "_cx", *[F.col(c).alias(c + s) for c in df.columns
                                                              if c not in (*keys, "_cy", "_cx")])
    a = rename(_spread(_gridded(left, size)), "_a")
    b = rename(_gridded(right, size), "_b")
    d = haversine_km(F.col("latitude_a"), F.col("longitude_a"), F.col("latitude_b"), F.col("longitude_b"))
    return a.join(b, [*keys, "_cy", "_cx"]).withColumn("km", d).filter(F.col("km") <= km).drop("_cy", "_cx")


def within_km_join(outlets: DataFrame, keys: list[str], km: float) -> DataFrame:
    """Pairs of distinct spots within ``km`` (lower id first) with the outlets on each.

    Outlets on one spot are all 0 km apart: that group is its row in ``spots``, its pairs are
    never spelled out.
    """
    s = spots(outlets, keys)
    pairs = within_km(s, s, keys, km).filter("spot_id_a < spot_id_b")
    return pairs.select(*keys, F.col("spot_id_a").alias("spot_a"), F.col("spot_id_b").alias("spot_b"),
                        F.col("n_a").alias("outlets_a"), F.col("n_b").alias("outlets_b"), "km")


def nearest(queries: DataFrame, candidates: DataFrame, keys: list[str], k: int, query_id: str = "outlet_id",
            candidate_id: str = "outlet_id", carry: tuple[str, ...] = (), not_self: bool = True,
            differing: str | None = None, few: bool = False) -> DataFrame:
    """The k nearest candidates of every query: keys, query_id, nbr_id, km, rank, carried candidate columns.

    Ties go to the lower id. A query is settled at the finest grid level whose nine cells surely
    hold its k nearest; the rest move to a coarser level. Queries still open at a level have fewer
    than k candidates around them, so few of them can meet in a crowded cell. Of outlets sharing a
    spot only the k + 1 lowest ids can be among anybody's k nearest. ``differing`` names a column
    that must differ between the two (nearest outlet of another group). Queries and candidates meet by a
    shuffle join, as queries that are spread are larger than Spark expects; ``few`` candidates it may broadcast.
    """
    spot_keys = [*keys, "latitude", "longitude", *([differing] if differing else [])]
    top = Window.partitionBy(*spot_keys).orderBy(candidate_id)
    cands = (candidates.select(*{c: None for c in [*spot_keys, candidate_id, *carry]})
             .withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= k + 1).drop("_r"))
    extra = [c for c in carry if c not in keys]
    cands = cands.select(*keys, F.col("latitude").alias("_lat"), F.col("longitude").alias("_lng"),
                         F.col(candidate_id).alias("nbr_id"), *[F.col(c).alias(f"nbr_{c}") for c in extra],
                         *([F.col(differing).alias("_other")] if differing else []))
    cands = cut(cands)
    open_ = queries.select(*keys, F.col(query_id).alias("_q"), "latitude", "longitude",
                           *([F.col(differing).alias("_own")] if differing else []))
    by_query = Window.partitionBy(*keys, "_q").orderBy("km", "nbr_id")
    done = []
    for level, size in enumerate(LADDER):
        last = level == len(LADDER) - 1
        there = (cands.withColumn("_cy", F.floor(F.col("_lat") / size).cast("bigint"))
                 .withColumn("_cx", F.floor(F.col("_lng") / size).cast("bigint")))
        there = there if few else there.hint("shuffle_hash")
        pairs = _spread(_gridded(open_, size)).join(there, [*keys, "_cy", "_cx"])
        if not_self:
            pairs = pairs.filter(F.col("_q") != F.col("nbr_id"))
        if differing:
            pairs = pairs.filter(F.col("_own") != F.col("_other"))
        found = (pairs.withColumn("km", haversine_km(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lng")))
                 .withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
                 .select(*keys, "_q", "latitude", "nbr_id", "km", "rank", *[f"nbr_{c}" for c in extra]))
        # Everything within one cell size of the query has been seen.
        edge = F.least(F.lit(89.9), F.abs(F.col("latitude")) + size)
        seen = F.least(F.lit(KM_PER_DEGREE * size),
                       F.lit(12742.0) * F.asin(F.sqrt(F.cos(F.radians("latitude")) * F.cos(F.radians(edge)))
                                               * F.lit(math.sin(math.radians(min(size, 90.0)) / 2))))
        if last:
            done.append(found.drop("latitude"))
            break
        sure = Window.partitionBy(*keys, "_q")
        found = cut(found.withColumn("_sure", F.sum(((F.col("rank") == k) & (F.col("km") < seen)).cast("int")).over(sure)))
        settled = found.filter("_sure > 0")
        done.append(settled.drop("_sure", "latitude"))
        open_ = cut(open_.join(settled.filter("rank = 1").select(*keys, "_q").hint("shuffle_hash"), [*keys, "_q"], "left_anti"))
        if open_.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("_q", query_id)


def kth_neighbour_km(outlets: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Distance to the k-th nearest other outlet of the key, 0 where the key has no more than k outlets."""
    kth = nearest(outlets, outlets, keys, k).filter(F.col("rank") == k).select(*keys, "outlet_id", "km")
    return outlets.select(*keys, "outlet_id").join(kth, [*keys, "outlet_id"], "left").withColumn(
        "km", F.coalesce("km", F.lit(0.0)))


# ------------------------------------------------------------------ components

def min_labels(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Connected components: every node gets the id of one node of its component, as ``label``.

    ``nodes`` has keys + node, ``edges`` keys + src + dst (any direction). Every round hooks each
    node to its lowest neighbour, follows those hooks a few steps and contracts the graph, so the
    edges shrink from round to round and a long chain takes few rounds.
    """
    c = F.col
    moves = []
    live = cut(edges.select(*keys, "src", "dst").union(edges.select(*keys, c("dst"), c("src")))
               .filter("src <> dst").distinct())
    while not live.isEmpty():
        hooks = live.groupBy(*keys, "src").agg(F.min("dst").alias("_m")).select(
            *keys, c("src").alias("node"), F.least("src", "_m").alias("parent"))
        step = hooks.select(*keys, c("node").alias("parent"), c("parent").alias("_next"))
        move = hooks
        for _ in range(3):
            move = move.join(step, [*keys, "parent"]).select(*keys, "node", c("_next").alias("parent"))
        move = cut(move)
        moves.append(move)
        at = lambda end: move.select(*keys, c("node").alias(end), c("parent").alias(f"_{end}"))
        kept = live.join(at("src"), [*keys, "src"]).join(at("dst"), [*keys, "dst"]).select(
            *keys, c("_src").alias("src"), c("_dst").alias("dst"))
        # A node that others moved to and that moves on itself stays linked to where it goes.
        onward = move.select(*keys, c("parent").alias("src")).distinct().join(at("src"), [*keys, "src"]).select(
            *keys, "src", c("_src").alias("dst"))
        onward = onward.union(onward.select(*keys, c("dst"), c("src")))
        live = cut(kept.union(onward).filter("src <> dst").distinct())
    labels = nodes.select(*keys, "node").distinct().withColumn("label", c("node"))
    for move in moves:
        labels = labels.join(move.select(*keys, c("node").alias("label"), c("parent").alias("_next")),
                             [*keys, "label"], "left").select(*keys, "node", F.coalesce("_next", "label").alias("label"))
    return labels


def box_bounds(a: str, b: str) -> tuple[Column, Column]:
    """Bounds of the distance between points of two boxes (columns min_lat_<a>, max_lat_<a>, ...): no pair is
    nearer than the first, none farther than the second. Rounded outward by a thousandth."""
    c = lambda x, e: F.col(f"{x}_{e}")
    gap_lat = F.greatest(F.lit(0.0), c("min_lat", a) - c("max_lat", b), c("min_lat", b) - c("max_lat", a))
    gap_lng = F.greatest(F.lit(0.0), c("min_lng", a) - c("max_lng", b), c("min_lng", b) - c("max_lng", a))
    all_lat = F.greatest(c("max_lat", a), c("max_lat", b)) - F.least(c("min_lat", a), c("min_lat", b))
    all_lng = F.greatest(c("max_lng", a), c("max_lng", b)) - F.least(c("min_lng", a), c("min_lng", b))
    sides = [F.abs(c(x, e)) for x in ("min_lat", "max_lat") for e in (a, b)]
    far_cos, near_cos = F.cos(F.radians(F.greatest(*sides))), F.cos(F.radians(F.least(*sides)))
    equator = F.least(c("min_lat", a), c("min_lat", b)) * F.greatest(c("max_lat", a), c("max_lat", b)) < 0
    least = F.hypot(gap_lat, gap_lng * far_cos) * KM_PER_DEGREE * 0.999
    most = F.hypot(all_lat, all_lng * F.when(equator, 1.0).otherwise(near_cos)) * KM_PER_DEGREE * 1.001
    return least, most


def components(outlets: DataFrame, keys: list[str], km: float, id_col: str = "outlet_id") -> DataFrame:
    """Single-linkage components at ``km``: keys, id, ``component`` (its lowest id).

    Outlets in one grid cell whose diagonal is at most ``km`` are linked for certain, so the graph
    has cells as nodes and at most a few dozen edges each. Two cells are linked for certain, or not
    at all, by their bounding boxes; only cells between the two, and not linked already by another
    way, are tested outlet by outlet.
    """
    side = km / (KM_PER_DEGREE * math.sqrt(2)) * (1 - 1e-9)
    points = cut(_gridded(outlets.select(*keys, F.col(id_col).alias("_id"), "latitude", "longitude"), side))
    cells = cut(points.groupBy(*keys, "_cy", "_cx").agg(
        F.min("_id").alias("node"), F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lng"), F.max("longitude").alias("max_lng")))
    lat = cells.agg(F.max(F.greatest(F.abs("min_lat"), F.abs("max_lat"))).alias("m")).first()["m"] or 0.0
    wide = math.ceil(math.sqrt(2) / max(0.02, math.cos(math.radians(min(89.0, lat + side * 2))))) + 1
    ahead = [(dy, dx) for dy in range(0, 3) for dx in range(-wide, wide + 1) if dy > 0 or dx > 0]
    named = lambda s: [F.col(c).alias(c + s) for c in ("node", "min_lat", "max_lat", "min_lng", "max_lng")]
    pairs = (_spread(cells, ahead).select(*keys, "_cy", "_cx", *named("_a"))
             .join(cells.select(*keys, "_cy", "_cx", *named("_b")), [*keys, "_cy", "_cx"]))
    c = F.col
    least_km, most_km = box_bounds("a", "b")
    pairs = cut(pairs.filter(least_km <= km).withColumn("_sure", most_km <= km)
                .select(*keys, c("node_a").alias("src"), c("node_b").alias("dst"), "_sure",
                        *[c(f"{x}_{s}") for s in ("a", "b") for x in ("min_lat", "max_lat", "min_lng", "max_lng")]))
    sure = pairs.filter("_sure")
    labels = cut(min_labels(cells, sure, keys))
    doubt = pairs.filter("not _sure")
    if not doubt.isEmpty():
        lab = lambda end: labels.select(*keys, c("node").alias(end), c("label").alias(f"{end}_label"))
        doubt = doubt.join(lab("src"), [*keys, "src"]).join(lab("dst"), [*keys, "dst"]).filter("src_label <> dst_label")
        members = points.join(cells.select(*keys, "_cy", "_cx", "node"), [*keys, "_cy", "_cx"]).select(
            *keys, "node", "latitude", "longitude").distinct()
        # Only outlets that can reach the other cell's box take part.
        def facing(end: str, box: str) -> DataFrame:
            m = members.withColumnRenamed("node", end)
            near_box = F.hypot(
                F.greatest(F.lit(0.0), c(f"min_lat_{box}") - c("latitude"), c("latitude") - c(f"max_lat_{box}")),
                F.greatest(F.lit(0.0), c(f"min_lng_{box}") - c("longitude"), c("longitude") - c(f"max_lng_{box}"))
                * F.cos(F.radians(F.greatest(F.abs("latitude"), F.abs(f"min_lat_{box}"), F.abs(f"max_lat_{box}"))))
            ) * KM_PER_DEGREE * 0.999
            return doubt.join(m, [*keys, end]).filter(near_box <= km).select(
                *keys, "src", "dst", c("latitude").alias(f"lat_{end}"), c("longitude").alias(f"lng_{end}"))
        met = (facing("src", "b").join(facing("dst", "a"), [*keys, "src", "dst"])
               .filter(haversine_km(c("lat_src"), c("lng_src"), c("lat_dst"), c("lng_dst")) <= km)
               .select(*keys, "src", "dst").distinct())
        # Contract what is linked already and join the found links on top.
        top = (met.join(lab("src"), [*keys, "src"]).join(lab("dst"), [*keys, "dst"])
               .select(*keys, c("src_label").alias("src"), c("dst_label").alias("dst")).distinct())
        top = cut(top)
        if not top.isEmpty():
            roots = labels.select(*keys, c("label").alias("node")).distinct()
            final = min_labels(roots, top, keys).select(*keys, c("node").alias("label"), c("label").alias("_root"))
            labels = labels.join(final, [*keys, "label"]).select(*keys, "node", c("_root").alias("label"))
    named = cells.select(*keys, "_cy", "_cx", "node").join(labels, [*keys, "node"])
    lowest = named.groupBy(*keys, "label").agg(F.min("node").alias("component"))
    return (points.join(named.join(lowest, [*keys, "label"]), [*keys, "_cy", "_cx"])
            .select(*keys, c("_id").alias(id_col), "component"))


def component_sizes(members: DataFrame, keys: list[str]) -> DataFrame:
    return members.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("size"))
