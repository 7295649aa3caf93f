"""Outliers, duplicates, misfits and strays: outlets judged by what lies around them."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatwise.functions import text
from beatwise.functions.geo import box_gap_km, haversine_km
from beatwise.functions.numbers import half_up
from beatwise.operators.neighbours import KM_PER_DEGREE, LADDER, _spread, box_bounds, components, min_labels, nearest, reach_degrees, within_km
from beatwise.session import cut

c = F.col  # resolved when called, inside operators only


def _cells_in_reach(a: DataFrame, b: DataFrame, keys: list[str], n: int, m: int) -> DataFrame:
    """Rows of ``a`` (ya, xa) and ``b`` (yb, xb) in cells at most n rows and m columns apart.

    They meet by blocks of n by m cells: a row goes to nine blocks, however many cells are in reach. It is a shuffle
    join whatever the size looks like, as a table that is spread inside the join is larger than Spark expects."""
    block = lambda y, x: [F.floor(c(y) / n).cast("bigint").alias("_cy"), F.floor(c(x) / m).cast("bigint").alias("_cx")]
    met = _spread(a.select("*", *block("ya", "xa"))).join(b.select("*", *block("yb", "xb")).hint("merge"), [*keys, "_cy", "_cx"])
    return met.filter((F.abs(c("ya") - c("yb")) <= n) & (F.abs(c("xa") - c("xb")) <= m)).drop("_cy", "_cx")


def group_gap_km(points: DataFrame, keys: list[str], group: str, up_to: float, levels: tuple[int, ...] = (4, 32)) -> DataFrame:
    """Gap (closest pair) of every two groups of a key at most ``up_to`` km apart: a, b, gap_km, box_gap_km.

    A group is first its boxes per grid cell. Of two groups only box pairs that can still hold the
    closest pair go on: their least distance is no more than the least of all greatest ones. That is
    done on two grids, a quarter and a 32nd of ``up_to`` wide, before outlets are measured.
    """
    pts = points.select(*keys, c(group).alias("g"), "latitude", "longitude").distinct()
    lat = pts.agg(F.max(F.abs("latitude")).alias("m")).first()["m"] or 0.0
    wide = max(0.02, math.cos(math.radians(min(89.0, lat + up_to / KM_PER_DEGREE))))
    step = lambda n: up_to / KM_PER_DEGREE / n
    edges = [F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"), F.min("longitude").alias("min_lng"), F.max("longitude").alias("max_lng")]
    names = ["min_lat", "max_lat", "min_lng", "max_lng"]
    grid = lambda df, n, tag: df.withColumn(f"y{tag}", F.floor(c("latitude") / step(n)).cast("bigint")).withColumn(f"x{tag}", F.floor(c("longitude") / step(n)).cast("bigint"))
    at = cut(grid(grid(pts, levels[0], 1), levels[1], 2))
    named = lambda end: [c("g").alias(end), *[c(x).alias(f"{x}_{end}") for x in names]]

    def closest(pairs: DataFrame) -> DataFrame:
        low, high = box_bounds("a", "b")
        both = cut(pairs.withColumn("_low", low).withColumn("_high", high).filter(c("_low") <= up_to))
        best = both.groupBy(*keys, "a", "b").agg(F.min("_high").alias("_best"))
        return both.join(best, [*keys, "a", "b"]).filter(c("_low") <= c("_best")).drop("_low", "_high", "_best", *[f"{x}_{e}" for x in names for e in ("a", "b")])

    n, m = levels[0] + 1, math.ceil(levels[0] / wide) + 1
    coarse = at.groupBy(*keys, "g", "y1", "x1").agg(*edges)
    pairs = cut(closest(_cells_in_reach(coarse.select(*keys, *named("a"), c("y1").alias("ya"), c("x1").alias("xa")),
                                        coarse.select(*keys, *named("b"), c("y1").alias("yb"), c("x1").alias("xb")), keys, n, m).filter("a < b")))
    fine = at.groupBy(*keys, "g", "y1", "x1", "y2", "x2").agg(*edges)
    end = lambda e, *more: fine.select(*keys, *named(e), c("y1").alias(f"y{e}"), c("x1").alias(f"x{e}"), c("y2").alias(f"y2{e}"), c("x2").alias(f"x2{e}"))
    pairs = cut(closest(pairs.join(end("a"), [*keys, "a", "ya", "xa"]).join(end("b"), [*keys, "b", "yb", "xb"])))
    side = lambda e: at.select(*keys, c("g").alias(e), c("y2").alias(f"y2{e}"), c("x2").alias(f"x2{e}"), c("latitude").alias(f"la_{e}"), c("longitude").alias(f"lo_{e}"))
    met = pairs.select(*keys, "a", "b", "y2a", "x2a", "y2b", "x2b").join(side("a"), [*keys, "a", "y2a", "x2a"]).join(side("b"), [*keys, "b", "y2b", "x2b"])
    out = met.groupBy(*keys, "a", "b").agg(F.min(haversine_km(c("la_a"), c("lo_a"), c("la_b"), c("lo_b"))).alias("gap_km")).filter(c("gap_km") <= up_to)
    box = points.groupBy(*keys, group).agg(*edges)
    whole = lambda e: box.select(*keys, c(group).alias(e), *[c(x).alias(f"{e}_{x}") for x in names])
    return out.join(whole("a"), [*keys, "a"]).join(whole("b"), [*keys, "b"]).select(*keys, "a", "b", "gap_km", box_gap_km("a_", "b_").alias("box_gap_km"))


def geo_outliers(outlets: DataFrame, keys: list[str], link_km: float = 5.0, anchor_km: float = 30.0) -> DataFrame:
    """Outlets far from their market's mass, farthest first: keys, outlet_id, gap_km to the nearest main part.

    A part is a component at ``link_km``; a main part holds at least max(10, 1%) of the market. A
    small part counts as anchored when a chain of parts at most ``anchor_km`` apart leads to a main
    one, that is when its component at ``anchor_km`` holds a main part.
    """
    n = outlets.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    near = cut(components(outlets, keys, link_km))
    wide = components(outlets, keys, anchor_km).withColumnRenamed("component", "wide")
    size = near.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("_size")).join(n, keys).withColumn(
        "main", c("_size") >= F.greatest(F.lit(10), F.floor(c("_n") * 0.01)))
    parts = cut(outlets.select(*keys, "outlet_id", "latitude", "longitude").join(near, [*keys, "outlet_id"])
                .join(size.select(*keys, "component", "main", "_n"), [*keys, "component"]).join(wide, [*keys, "outlet_id"]))
    anchored = parts.groupBy(*keys, "wide").agg(F.max("main").alias("anchored"))
    flagged = parts.filter("_n >= 10").join(anchored.filter("not anchored").select(*keys, "wide"), [*keys, "wide"], "left_semi")
    flagged = cut(flagged.join(parts.filter("main").select(*keys).distinct(), keys, "left_semi"))
    # Nearest main outlet: bound the gap by boxes of half-degree cells first, then measure only cells that can win.
    cell = [F.floor(c("latitude") / 0.5).alias("_cy"), F.floor(c("longitude") / 0.5).alias("_cx")]
    box = [f(x).alias(a) for x, lo, hi in (("latitude", "min_lat", "max_lat"), ("longitude", "min_lng", "max_lng")) for f, a in ((F.min, lo), (F.max, hi))]
    mains = parts.filter("main").select(*keys, "latitude", "longitude", *cell).distinct()
    cells = mains.groupBy(*keys, "_cy", "_cx").agg(*box)
    lost = flagged.groupBy(*keys, "component").agg(*box)
    names = ["min_lat", "max_lat", "min_lng", "max_lng"]
    both = lost.select(*keys, "component", *[c(x).alias(f"a_{x}") for x in names]).join(
        cells.select(*keys, "_cy", "_cx", *[c(x).alias(f"b_{x}") for x in names]), keys)
    at_most = haversine_km(c("a_min_lat"), c("a_min_lng"), c("b_min_lat"), c("b_min_lng")) + haversine_km(
        c("b_min_lat"), c("b_min_lng"), c("b_max_lat"), c("b_max_lng")) + haversine_km(c("a_min_lat"), c("a_min_lng"), c("a_max_lat"), c("a_max_lng"))
    away = F.greatest(F.lit(0.0), haversine_km(c("a_min_lat"), c("a_min_lng"), c("b_min_lat"), c("b_min_lng")) - haversine_km(
        c("b_min_lat"), c("b_min_lng"), c("b_max_lat"), c("b_max_lng")) - haversine_km(c("a_min_lat"), c("a_min_lng"), c("a_max_lat"), c("a_max_lng")))
    bound = Window.partitionBy(*keys, "component")
    worth = both.withColumn("_best", F.min(at_most).over(bound)).filter(away <= c("_best")).select(*keys, "component", "_cy", "_cx")
    there = flagged.select(*keys, "component", c("latitude").alias("_la"), c("longitude").alias("_lo")).distinct()
    gap = (there.join(worth, [*keys, "component"]).join(mains, [*keys, "_cy", "_cx"])
           .groupBy(*keys, "component").agg(F.min(haversine_km(c("_la"), c("_lo"), c("latitude"), c("longitude"))).alias("_gap")))
    return flagged.join(gap, [*keys, "component"]).select(*keys, "outlet_id", half_up(c("_gap"), 1).alias("gap_km"))


# ------------------------------------------------------------------ duplicates

def duplicate_links(outlets: DataFrame, keys: list[str], radius_m: float = 10.0, name_radius_m: float = 150.0) -> DataFrame:
    """Spots that may hold one shop twice: links between positions within the radius, or between
    positions that hold the same normalised name within the wider one (src, dst position ids)."""
    named = cut(outlets.select(*keys, "outlet_id", "latitude", "longitude", text.normalise_name(c("name")).alias("name_key")))
    at = cut(named.groupBy(*keys, "latitude", "longitude").agg(F.min("outlet_id").alias("spot")))
    near = within_km(at, at, keys, radius_m / 1000).filter("spot_a < spot_b").select(*keys, c("spot_a").alias("src"), c("spot_b").alias("dst"))
    names = named.filter(F.length("name_key") >= 2).join(at, [*keys, "latitude", "longitude"]).select(
        *keys, "name_key", "spot", "latitude", "longitude").distinct()
    same = within_km(names, names, [*keys, "name_key"], name_radius_m / 1000).filter("spot_a < spot_b").select(
        *keys, c("spot_a").alias("src"), c("spot_b").alias("dst"))
    return near.union(same).distinct()


def first_fit_groups(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Groups as a walk in order would form them: a node joins the first group whose leader it is alike, else leads a
    new one. ``nodes``: keys, node (its order); ``edges``: keys, src < dst, alike nodes. Returns keys, node, leader.

    The leaders are the lexicographically first independent set. They are found in rounds: a node leads once no
    earlier node alike is open; what is alike a leader is out. A key leaves when all its nodes are decided.
    """
    open_ = cut(edges.select(*keys, "src", "dst").distinct())
    every = open_
    leaders = nodes.select(*keys, "node").join(every.select(*keys, c("dst").alias("node")).distinct(), [*keys, "node"], "left_anti")
    new = leaders
    while not open_.isEmpty():
        lead = new.select(*keys, c("node").alias("src"))
        out = cut(open_.join(lead, [*keys, "src"], "left_semi").select(*keys, c("dst").alias("node")).distinct())
        was = open_.select(*keys, c("src").alias("node")).union(open_.select(*keys, c("dst").alias("node"))).distinct()
        gone = lambda end: out.select(*keys, c("node").alias(end))
        open_ = cut(open_.join(lead, [*keys, "src"], "left_anti").join(gone("src"), [*keys, "src"], "left_anti").join(gone("dst"), [*keys, "dst"], "left_anti"))
        # Those that no earlier open node is alike to any more, and that are not out, lead now.
        waiting = was.join(out, [*keys, "node"], "left_anti").join(leaders, [*keys, "node"], "left_anti")
        new = cut(waiting.join(open_.select(*keys, c("dst").alias("node")).distinct(), [*keys, "node"], "left_anti"))
        leaders = cut(leaders.unionByName(new))
    first = every.join(leaders.select(*keys, c("node").alias("src")), [*keys, "src"], "left_semi").groupBy(*keys, c("dst").alias("node")).agg(F.min("src").alias("_first"))
    own = leaders.select(*keys, "node", c("node").alias("_own"))
    return nodes.select(*keys, "node").join(own, [*keys, "node"], "left").join(first, [*keys, "node"], "left").select(
        *keys, "node", F.coalesce("_own", "_first").alias("leader"))


def duplicate_clusters(outlets: DataFrame, keys: list[str], radius_m: float = 10.0, name_radius_m: float = 150.0,
                       alike: float = 0.6) -> DataFrame:
    """Groups of outlets that may be one shop: keys, outlet_id, group_id, kind, confidence, reason, span_m, keep.

    Within a cluster of linked spots, from south to north, an outlet joins the first group whose first name is
    at least ``alike`` its own; outlets left alone that have another outlet within the radius form one more.
    Names are compared once per distinct name of a cluster, not once per outlet. ``reason`` is a code: what
    is the same (name, spot, or neither), how far apart, and whether two scripts meet.
    """
    from beatwise.operators.scorecard import route_diameters
    base = cut(outlets.select(*keys, "outlet_id", "name", "vf", "latitude", "longitude", text.normalise_name(c("name")).alias("name_key")))
    at = base.groupBy(*keys, "latitude", "longitude").agg(F.min("outlet_id").alias("spot"))
    # Only what hangs together matters here, so links are one per outlet and component, never pairs.
    tied = base.join(at, [*keys, "latitude", "longitude"]).select(*keys, "name_key", "spot", "latitude", "longitude").distinct()
    star = lambda comp: comp.select(*keys, c("component").alias("src"), c("spot").alias("dst"))
    near_links = components(at, keys, radius_m / 1000, "spot")
    name_links = components(tied.filter(F.length("name_key") >= 2), [*keys, "name_key"], name_radius_m / 1000, "spot")
    links = cut(star(near_links).union(star(name_links)).filter("src <> dst").distinct())
    labels = min_labels(at.select(*keys, c("spot").alias("node")), links, keys).select(*keys, c("node").alias("spot"), c("label").alias("cluster"))
    member = cut(base.join(at, [*keys, "latitude", "longitude"]).join(labels, [*keys, "spot"]))
    size = member.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    member = cut(member.join(size.select(*keys, "cluster"), [*keys, "cluster"]))
    # Distinct names of a cluster, in the order of their first outlets; those with a shared bigram are scored.
    ck = [*keys, "cluster"]
    names = cut(member.filter("name_key <> ''").groupBy(*ck, "name_key").agg(F.min(F.struct("latitude", "outlet_id")).alias("node")))
    grams = names.withColumn("_g", F.explode(F.array_distinct(F.when(F.length("name_key") > 1, text.bigrams(c("name_key"))).otherwise(F.array("name_key")))))
    a = grams.select(*ck, "_g", c("name_key").alias("x"), c("node").alias("src"))
    b = grams.select(*ck, "_g", c("name_key").alias("y"), c("node").alias("dst"))
    scored = a.join(b, [*ck, "_g"]).filter("src < dst").select(*ck, "src", "dst", "x", "y").distinct().filter(
        text.normalised_similarity(c("x"), c("y")) >= alike)
    group = first_fit_groups(names, scored, ck).select(*ck, "node", c("leader.outlet_id").alias("group_id"))
    named = cut(member.join(names.join(group, [*ck, "node"]).select(*ck, "name_key", "group_id"), [*ck, "name_key"], "left")
                .withColumn("group_id", F.coalesce("group_id", "outlet_id")))
    counts = named.groupBy(*keys, "group_id").agg(F.count(F.lit(1)).alias("_n"))
    named = cut(named.join(counts, [*keys, "group_id"]))
    alone = named.filter("_n = 1")
    # Leftovers: those whose nearest other member of the cluster is within the radius.
    near = nearest(alone, named, [*keys, "cluster"], 1).filter(c("km") <= radius_m / 1000)
    rest = alone.join(near.select(*keys, "outlet_id"), [*keys, "outlet_id"], "left_semi")
    several = rest.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select(*keys, "cluster")
    both = (named.filter("_n > 1").withColumn("kind", F.lit("name")).unionByName(
        rest.join(several, [*keys, "cluster"], "left_semi").withColumn("kind", F.lit("spot")).withColumn("group_id", c("cluster"))))
    both = cut(both.select(*keys, "outlet_id", "group_id", "kind", "name", "vf", "latitude", "longitude"))
    gk = [*keys, "group_id", "kind"]
    # The farthest two of a group lie on its hull, so only hull points are paired.
    span = route_diameters(both, gk).select(*gk, (c("diameter_km") * 1000).alias("_span"))
    script = text.script_of(c("name"))
    info = both.groupBy(*gk).agg(
        (F.max((script == "ar").cast("int")) + F.max((script == "la").cast("int")) == 2).alias("_mixed"),
        F.max(F.struct(c("vf"), F.length("name").alias("l"), (-c("outlet_id")).alias("o"))).alias("_keep"))
    j = both.join(span, gk).join(info, gk)
    tight, name = c("_span") <= 0.5, c("kind") == "name"
    confidence = (F.when(name & (c("_span") <= 50), "high").when(name, "medium").when(tight & c("_mixed"), "high")
                  .when(tight | c("_mixed"), "medium").otherwise("low"))
    what = F.when(name & tight, "name_and_spot").when(name & (c("_span") <= 50), "name_near").when(name, "name_far").when(tight, "spot").otherwise("near")
    reason = F.when(~name & c("_mixed"), F.concat(what, F.lit("_two_scripts"))).otherwise(what)
    return j.select(*keys, "outlet_id", "group_id", "kind", confidence.alias("confidence"), reason.alias("reason"),
                    half_up(c("_span"), 1).alias("span_m"), (c("outlet_id") == -c("_keep.o")).alias("keep"))


# ------------------------------------------------------------------ misfits and strays

def misfit_outlets(outlets: DataFrame, keys: list[str], group: str = "rep_id", reach_km: float = 11.0) -> DataFrame:
    """Outlets much nearer to another rep's outlets than to their own rep's, with what moving saves.

    Own distance is the 3rd nearest of the same rep (or the farthest of fewer). Another rep's
    nearest counts when it is under half of that and more than 1 km nearer, so it is searched for
    only within that radius (at most ``reach_km``), at the grid level that suits it.
    """
    own = nearest(outlets, outlets, [*keys, group], 3).groupBy(*keys, group, "outlet_id").agg(F.max("km").alias("own_km"))
    radius = F.least(F.lit(reach_km), F.least(c("own_km") * 0.5, c("own_km") - 1))
    q = outlets.select(*keys, group, "outlet_id", "latitude", "longitude").join(own, [*keys, group, "outlet_id"]).withColumn("_r", radius).filter("_r > 0")
    fit = reach_degrees(c("_r"))
    level = F.lit(len(LADDER) - 1)
    for i in range(len(LADDER) - 2, -1, -1):
        level = F.when(fit <= LADDER[i], F.lit(i)).otherwise(level)
    size = F.element_at(F.array(*[F.lit(x) for x in LADDER]), c("_level") + 1)
    q = cut(q.withColumn("_level", level).withColumn("_cy", F.floor(c("latitude") / size).cast("bigint")).withColumn(
        "_cx", F.floor(c("longitude") / size).cast("bigint")))
    used = [r["_level"] for r in q.select("_level").distinct().collect()]  # at most one row per grid level
    there = outlets.select(*keys, c(group).alias("_g"), c("latitude").alias("_la"), c("longitude").alias("_lo")).distinct()
    there = there.withColumn("_level", F.explode(F.array(*[F.lit(u) for u in used] or [F.lit(0)]))).withColumn(
        "_cy", F.floor(c("_la") / size).cast("bigint")).withColumn("_cx", F.floor(c("_lo") / size).cast("bigint"))
    hit = _spread(q).join(there, [*keys, "_level", "_cy", "_cx"]).filter(c("_g") != c(group)).withColumn(
        "km", haversine_km(c("latitude"), c("longitude"), c("_la"), c("_lo")))
    hit = hit.filter((c("km") < c("own_km") * 0.5) & (c("own_km") - c("km") > 1) & (c("km") <= reach_km))
    best = hit.groupBy(*keys, "outlet_id", group, "own_km").agg(F.min(F.struct("km", "_g")).alias("b"))
    return best.select(*keys, "outlet_id", c(group).alias("current"), "own_km", c("b._g").alias("suggested"), c("b.km").alias("other_km"),
                       (c("own_km") - c("b.km")).alias("savings_km"))


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in the order (a report); the limit reaches the map side."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).filter(c("place") <= n)


def top_of_all(df: DataFrame, keys: list[str], order: list[Column], n: int = 100) -> DataFrame:
    """``top_rows`` with the number of rows they were taken from (``total``)."""
    rows = cut(df)
    return top_rows(rows, keys, order, n).join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")), keys)


def stray_votes(graph: DataFrame, owners: DataFrame, keys: list[str], group: str, k: int = 8) -> DataFrame:
    """Outlets most of whose k nearest belong to another group: outlet_id, from, to, margin.

    ``graph`` is the neighbour list (outlet_id, nbr_id), ``owners`` outlet_id -> group.
    """
    g = owners.select(*keys, "outlet_id", c(group).alias("_own"))
    n = owners.select(*keys, c("outlet_id").alias("nbr_id"), c(group).alias("_g"))
    votes = graph.join(n, [*keys, "nbr_id"]).groupBy(*keys, "outlet_id", "_g").agg(F.count(F.lit(1)).alias("_v"))
    j = votes.join(g, [*keys, "outlet_id"])
    best = j.groupBy(*keys, "outlet_id", "_own").agg(
        F.coalesce(F.max(F.when(c("_g") == c("_own"), c("_v"))), F.lit(0)).alias("_mine"),
        F.max(F.when(c("_g") != c("_own"), F.struct(c("_v").alias("v"), (-c("_g")).alias("g")))).alias("_b"), F.sum("_v").alias("_k"))
    ok = (c("_b.v") * 2 > F.least(F.lit(k), c("_k"))) & (c("_b.v") > c("_mine"))
    return best.filter(ok & (c("_k") >= 3)).select(*keys, "outlet_id", c("_own").alias("from_group"), (-c("_b.g")).alias("to_group"), (c("_b.v") - c("_mine")).alias("margin"))


# ------------------------------------------------------------------ density clusters

def dbscan(outlets: DataFrame, keys: list[str], eps_km: float, min_pts: int) -> DataFrame:
    """Density clusters: keys, outlet_id, cluster (null for noise).

    A core outlet has at least ``min_pts`` outlets (itself included) within eps: its
    (min_pts - 1)-th nearest is that near, so no neighbourhood is spelled out. Cores link at eps,
    a border outlet joins its nearest core's cluster.
    """
    base = outlets.select(*keys, "outlet_id", "latitude", "longitude")
    kth = nearest(base, base, keys, min_pts - 1).filter((c("rank") == min_pts - 1) & (c("km") <= eps_km)).select(*keys, "outlet_id")
    core = cut(base.join(kth, [*keys, "outlet_id"]))
    labels = cut(components(core, keys, eps_km))
    tagged = core.join(labels, [*keys, "outlet_id"])
    rim = base.join(core.select(*keys, "outlet_id"), [*keys, "outlet_id"], "left_anti")
    near = nearest(rim, tagged, keys, 1, carry=("component",)).filter(c("km") <= eps_km).select(*keys, "outlet_id", c("nbr_component").alias("component"))
    return base.select(*keys, "outlet_id").join(labels.unionByName(near), [*keys, "outlet_id"], "left").select(*keys, "outlet_id", c("component").alias("cluster"))


def density_clusters(outlets: DataFrame, keys: list[str], k: int, cut_km: float) -> DataFrame:
    """Clusters by mutual reachability at a cut: outlets whose k-th neighbour is within the cut link when
    they are that near each other; the rest stand alone."""
    base = outlets.select(*keys, "outlet_id", "latitude", "longitude")
    kth = nearest(base, base, keys, k).filter((c("rank") == k) & (c("km") <= cut_km)).select(*keys, "outlet_id")
    dense = base.join(kth, [*keys, "outlet_id"])
    labels = components(dense, keys, cut_km)
    return base.select(*keys, "outlet_id").join(labels, [*keys, "outlet_id"], "left").select(*keys, "outlet_id", F.coalesce("component", "outlet_id").alias("cluster"))


def village_blocks(outlets: DataFrame, keys: list[str], radius_km: float, load: str, max_load: float) -> DataFrame:
    """Outlets with the unit they move as: a component at ``radius_km`` whose load fits, else themselves."""
    comp = components(outlets, keys, radius_km)
    o = outlets.join(comp, [*keys, "outlet_id"])
    s = o.groupBy(*keys, "component").agg(F.sum(load).alias("_l"), F.count(F.lit(1)).alias("_n"), F.max("offset").alias("_off"))
    whole = (c("_n") > 1) & (c("_l") <= max_load) & ~c("_off")
    return o.join(s, [*keys, "component"]).withColumn("unit", F.when(whole, c("component")).otherwise(c("outlet_id"))).withColumn(
        "blocked", whole).drop("_l", "_n", "_off", "component")


def footprint_cells(outlets: DataFrame, group: list[str], size: float = 0.01) -> DataFrame:
    """Grid cells a group covers, each outlet's cell grown by one, with the piece each belongs to."""
    from beatwise.operators.neighbours import _gridded, _spread
    own = _gridded(outlets.select(*group, "latitude", "longitude"), size).select(*group, "_cy", "_cx").distinct()
    cells = cut(_spread(own).distinct().withColumn("node", c("_cy") * 10000000 + c("_cx")))
    ahead = _spread(cells.withColumnRenamed("node", "src"), [(0, 1), (1, 0)])
    edges = ahead.join(cells.withColumnRenamed("node", "dst"), [*group, "_cy", "_cx"]).select(*group, "src", "dst")
    labels = min_labels(cells, edges, group)
    low = labels.groupBy(*group, "label").agg(F.min("node").alias("piece"), F.count(F.lit(1)).alias("piece_cells"))
    return cells.join(labels, [*group, "node"]).join(low, [*group, "label"]).select(
        *group, c("_cy").alias("cell_y"), c("_cx").alias("cell_x"), "piece", "piece_cells")


# ------------------------------------------------------------------ plan against ownership

def stale_missing(owned: DataFrame, stops: DataFrame, void_reps: DataFrame | None = None) -> DataFrame:
    """Per rep: outlets scheduled but not owned (stale) and owned but not scheduled (missing), and what to
    do: regroup when there are any, resequence when only a stored distance is void."""
    sched = stops.select("rep_id", "outlet_id").distinct()
    own = owned.select("rep_id", "outlet_id")
    stale = sched.join(own, ["rep_id", "outlet_id"], "left_anti").groupBy("rep_id").agg(F.count(F.lit(1)).alias("stale"))
    missing = own.join(sched, ["rep_id", "outlet_id"], "left_anti").groupBy("rep_id").agg(F.count(F.lit(1)).alias("missing"))
    out = stale.join(missing, "rep_id", "full").fillna(0, ["stale", "missing"])
    if void_reps is not None:
        out = out.join(void_reps.select("rep_id").distinct().withColumn("_void", F.lit(True)), "rep_id", "full").fillna(0, ["stale", "missing"])
    else:
        out = out.withColumn("_void", F.lit(False))
    return out.withColumn("action", F.when(c("stale") + c("missing") > 0, "regroup").when(c("_void"), "resequence").otherwise("none")).drop("_void")


def affected_reps(edits: DataFrame, outlets: DataFrame, stops: DataFrame) -> DataFrame:
    """Reps that own or drive to any edited outlet."""
    ids = edits.select("outlet_id").distinct()
    owner = outlets.select("rep_id", "outlet_id").join(ids, "outlet_id", "left_semi").select("rep_id")
    driver = stops.select("rep_id", "outlet_id").join(ids, "outlet_id", "left_semi").select("rep_id")
    return owner.union(driver).distinct()


def nearest_receiver(outlets: DataFrame, capacity: DataFrame, keys: list[str], limit: int = 30) -> DataFrame:
    """Outlets an overloaded rep should hand on: those nearest a rep with spare room, until its excess is
    covered, at most ``limit`` per market (a report).

    ``capacity`` has keys, rep_id, capacity. The nearest receiving rep's centre is found through the
    grid, not by meeting every receiver.
    """
    load = outlets.groupBy(*keys, "rep_id").agg(F.sum("vf").alias("_load"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
    state = cut(load.join(capacity.select("rep_id", "capacity"), "rep_id").withColumn("_excess", c("_load") - c("capacity")))
    spare = state.filter("_excess < 0").select(*keys, "rep_id", "latitude", "longitude")
    over = state.filter("_excess > 0").select(*keys, "rep_id", "_excess")
    mine = outlets.select(*keys, "rep_id", "outlet_id", "vf", "latitude", "longitude").join(over, [*keys, "rep_id"])
    near = nearest(mine, spare, keys, 1, candidate_id="rep_id", not_self=False).select(*keys, "outlet_id", c("nbr_id").alias("to_rep_id"), "km")
    w = Window.partitionBy(*keys, "rep_id").orderBy("km", "outlet_id")
    upto = F.coalesce(F.sum("vf").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = mine.join(near, [*keys, "outlet_id"]).withColumn("_before", upto).filter(c("_before") < c("_excess"))
    return top_rows(chosen, keys, [c("rep_id"), c("km"), c("outlet_id")], limit).select(
        *keys, "outlet_id", c("rep_id").alias("from_rep_id"), "to_rep_id", "vf", "km")


def mirror_cells(stops: DataFrame, targets: DataFrame) -> DataFrame:
    """Cells of the same rep and weekday that drive mostly the same stops as a target cell (rep_id, week, day_of_week)."""
    cell = ["rep_id", "week", "day_of_week"]
    size = stops.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    t = stops.select(*cell, "outlet_id").join(targets.select(*cell).distinct(), cell, "left_semi").withColumnRenamed("week", "target_week")
    hits = t.join(stops.select(*cell, "outlet_id"), ["rep_id", "day_of_week", "outlet_id"]).groupBy(*cell, "target_week").agg(F.count(F.lit(1)).alias("shared"))
    tn = size.select("rep_id", c("week").alias("target_week"), "day_of_week", c("_n").alias("_tn"))
    j = hits.join(size, cell).join(tn, ["rep_id", "target_week", "day_of_week"])
    enough = F.greatest(F.lit(1), F.ceil(0.4 * F.least("_n", "_tn")))
    return j.filter((c("shared") >= enough) | (c("week") == c("target_week"))).select("rep_id", "day_of_week", "target_week", "week", "shared")
