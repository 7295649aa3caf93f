"""Partition jobs. The curve cut, day apportioning and single rounds have SQL; the rest is checked by invariants."""
from __future__ import annotations

from pyspark.sql import functions as F

from beatwise.checks.neighbours import HAB, STRAY
from beatwise.checks.sql import OUTLETS
from beatwise.functions.numbers import six
from beatwise.operators import partition as pt
from beatwise.operators import zones as zn
from beatwise.sources import testdata as td

QUERIES, SQL = {}, {}
c = F.col
M, REP = ["market_id"], ["market_id", "rep_id"]
ACT = 'act AS (SELECT * FROM outlets WHERE NOT excluded AND NOT "offset")'


def units(spark, sf):
    return td.outlets(spark, sf).filter("not excluded and not offset").withColumn("weight", c("vf").cast("double"))


CURVE = f"""bx AS (SELECT market_id, min(latitude) AS a, max(latitude) AS b, min(longitude) AS x, max(longitude) AS y FROM act GROUP BY 1),
sp AS (SELECT *, 111.32::DOUBLE * cos(radians((a + b) / 2)) AS kx, greatest((y - x) * 111.32::DOUBLE * cos(radians((a + b) / 2)), (b - a) * 110.57::DOUBLE, 1e-9) AS span FROM bx),
gx AS (SELECT market_id, outlet_id, vf, CAST(least(65535, floor((longitude - sp.x) * kx / span * 65535)) AS BIGINT) AS px, CAST(least(65535, floor((latitude - sp.a) * 110.57::DOUBLE / span * 65535)) AS BIGINT) AS py FROM act JOIN sp USING (market_id)),
walk(outlet_id, s, x, y, d) AS (SELECT outlet_id, 32768::BIGINT, px, py, 0::BIGINT FROM gx UNION ALL SELECT outlet_id, s // 2,
  CASE WHEN (y & s) > 0 THEN x WHEN (x & s) > 0 THEN s - 1 - y ELSE y END, CASE WHEN (y & s) > 0 THEN y WHEN (x & s) > 0 THEN s - 1 - x ELSE x END,
  d + s * s * xor(CASE WHEN (x & s) > 0 THEN 3 ELSE 0 END, CASE WHEN (y & s) > 0 THEN 1 ELSE 0 END) FROM walk WHERE s > 0),
curve AS (SELECT market_id, outlet_id, vf, d FROM walk JOIN gx USING (outlet_id) WHERE s = 0),
cum AS (SELECT *, sum(vf) OVER (PARTITION BY market_id ORDER BY d, outlet_id) AS cu, sum(vf) OVER (PARTITION BY market_id) AS tot FROM curve)"""
QUERIES["hilbert_partition"] = lambda spark, sf: pt.hilbert_partition(units(spark, sf), M, F.lit(5)).select("market_id", "outlet_id", "d", "group")
SQL["hilbert_partition"] = f"""WITH RECURSIVE {OUTLETS}, {ACT}, {CURVE}
SELECT market_id, outlet_id, d, CAST(greatest(0, least(4, ceil((cu - vf / 2) * 5 / tot - 1e-9) - 1)) AS INTEGER) AS "group" FROM cum"""
QUERIES["capacity_runs"] = lambda spark, sf: pt.capacity_runs(units(spark, sf).withColumn("d", c("lat_e6")), M, F.lit(7)).select("outlet_id", "group")
SQL["capacity_runs"] = f"""WITH {OUTLETS}, {ACT}, cum AS (SELECT *, sum(vf) OVER (PARTITION BY market_id ORDER BY lat_e6, outlet_id) AS cu, sum(vf) OVER (PARTITION BY market_id) AS tot FROM act)
SELECT outlet_id, CAST(greatest(0, least(6, ceil((cu - vf / 2) * 7 / tot - 1e-9) - 1)) AS INTEGER) AS "group" FROM cum"""


def _start(spark, sf):
    return pt.hilbert_partition(units(spark, sf), M, F.lit(5)).select(*M, "outlet_id", "weight", "group")


def _skewed(spark, sf):
    """Groups by rep, whose loads are uneven."""
    return units(spark, sf).select(*M, "outlet_id", "weight", (c("rep_id") % 25).cast("int").alias("group"))


def _shape(state, points, keys):
    """Groups of a partition in figures: members, load and mean distance to the group's centre."""
    at = state.join(points.select(*keys, "outlet_id", "latitude", "longitude"), [*keys, "outlet_id"])
    return at.groupBy(*keys, "group").agg(F.count(F.lit(1)).alias("outlets"), F.sum("weight").alias("load"),
                                          six(F.avg("latitude")).alias("lat"), six(F.avg("longitude")).alias("lng"))


def _job(run):
    def query(spark, sf):
        u = units(spark, sf)
        return _shape(run(u, _skewed(spark, sf)), u, M)
    return query


QUERIES["repair_loads"] = _job(lambda u, s: pt.repair_loads(s, pt.neighbour_graph(u, M), M, 0.05, 0.05))
QUERIES["cohesion_moves"] = _job(lambda u, s: pt.cohesion_moves(s, pt.neighbour_graph(u, M), M, 0.3, 0.3))
QUERIES["compact_swaps"] = _job(lambda u, s: pt.compact_swaps(s, u, pt.neighbour_graph(u, M), M))
QUERIES["balanced_kmeans"] = _job(lambda u, s: pt.balanced_kmeans(u, M, F.lit(5)))
QUERIES["pocket_exchange"] = _job(lambda u, s: pt.pocket_exchange(s, u, M, 2.0))
QUERIES["hand_over_strays"] = lambda spark, sf: pt.hand_over_strays(_skewed(spark, sf), pt.neighbour_graph(units(spark, sf), M), M, 9.0, 9.0, 1).select("market_id", "outlet_id", "group")
SQL["hand_over_strays"] = f"""WITH {OUTLETS}, {ACT}, {STRAY} SELECT market_id, outlet_id, CAST(coalesce(to_group, rep_id) % 25 AS INTEGER) AS "group" FROM act LEFT JOIN strays USING (market_id, outlet_id)"""

QUERIES["line_split"] = lambda spark, sf: pt.line_split(units(spark, sf), REP, 4, below=0.15, above=0.15).groupBy(*REP, "part").agg(F.count(F.lit(1)).alias("outlets"), F.sum("weight").alias("load"))
QUERIES["kmeans_zones"] = lambda spark, sf: zn.zone_metrics(pt.kmeans_zones(units(spark, sf), M, F.lit(6), 2).join(units(spark, sf).select("outlet_id", "vf", "value"), "outlet_id"), M).select("market_id", "zone_id", "outlets", six(c("radius_km")).alias("radius_km"))
QUERIES["choose_k"] = lambda spark, sf: pt.choose_k(units(spark, sf), M, [3, 5]).select("market_id", "k", six(c("score")).alias("score"), "best")


def _zones(spark, sf):
    return pt.hilbert_partition(units(spark, sf), M, F.lit(12)).select(*M, "outlet_id", "latitude", "longitude", "weight", c("group").alias("zone_id"))


QUERIES["split_oversized_zones"] = lambda spark, sf: pt.split_oversized_zones(_zones(spark, sf), M, 2.0).groupBy(*M, "zone_id").agg(F.count(F.lit(1)).alias("outlets"))
QUERIES["merge_undersized_zones"] = lambda spark, sf: pt.merge_undersized_zones(_zones(spark, sf), M, 30, 80, 8.0).groupBy(*M, "zone_id").agg(F.count(F.lit(1)).alias("outlets"))
QUERIES["assign_zones_to_reps"] = lambda spark, sf: pt.assign_zones_to_reps(_zones(spark, sf).groupBy(*M, "zone_id").agg(
    F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.sum("weight").alias("weight")), M, F.lit(3))
QUERIES["zones_to_days"] = lambda spark, sf: pt.zones_to_days(_zones(spark, sf), M, 10, 120.0).groupBy(*M, "zone_id").agg(F.sum("weight").alias("load"))

_pieces = lambda spark, sf: units(spark, sf).groupBy(*REP, c("day_group").alias("piece")).agg(F.sum(c("weight") * (c("day_group") * 3 + 1)).alias("load"))
QUERIES["apportion_days"] = lambda spark, sf: pt.apportion_days(_pieces(spark, sf), REP, F.lit(13))
SQL["apportion_days"] = f"""WITH {OUTLETS}, {ACT}, p AS (SELECT market_id, rep_id, day_group AS piece, CAST(sum(vf * (day_group * 3 + 1)) AS DOUBLE) AS load FROM act GROUP BY ALL),
q AS (SELECT *, load / (sum(load) OVER (PARTITION BY rep_id) / 13) AS q FROM p), d AS (SELECT *, greatest(1, floor(q)) AS d FROM q),
l AS (SELECT *, 13 - sum(d) OVER (PARTITION BY rep_id) AS lft, row_number() OVER (PARTITION BY rep_id ORDER BY q - d DESC, piece) AS r FROM d),
b AS (SELECT *, coalesce(sum(d - 1) OVER (PARTITION BY rep_id ORDER BY CASE WHEN d > 1 THEN load / (d - 1) END DESC NULLS LAST, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM l)
SELECT market_id, rep_id, piece, load, CAST(CASE WHEN lft >= 0 THEN d + CASE WHEN r <= lft THEN 1 ELSE 0 END ELSE d - greatest(0, least(d - 1, -lft - bef)) END AS INTEGER) AS days FROM b"""
QUERIES["anchor_days"] = lambda spark, sf: pt.anchor_days(units(spark, sf), REP, 5).groupBy(*REP, "day_group").agg(F.count(F.lit(1)).alias("outlets"))
QUERIES["overflow_memberships"] = lambda spark, sf: pt.overflow_memberships(units(spark, sf), units(spark, sf).select(*REP, "outlet_id", "day_group"), REP, 2)


def _feedback(spark, sf):
    u = units(spark, sf)
    s = _skewed(spark, sf)
    load = s.groupBy(*M, "group").agg(F.sum("weight").alias("load"))
    mean = load.groupBy(*M).agg(F.avg("load").alias("mean"))
    need = load.join(mean, M).select(*M, "group", (c("mean") - c("load")).alias("need"))
    return _shape(pt.territory_feedback(s, pt.neighbour_graph(u, M), need, M, 2.0), u, M)


QUERIES["territory_feedback"] = _feedback

# ------------------------------------------------------------------ single rounds
GRAPH = f"""kg AS (SELECT a.market_id, a.outlet_id, CAST(a.rep_id % 25 AS INTEGER) AS g, CAST(b.rep_id % 25 AS INTEGER) AS h, a.vf AS w, {HAB} AS km FROM act a JOIN act b ON a.market_id = b.market_id AND a.outlet_id <> b.outlet_id
  QUALIFY row_number() OVER (PARTITION BY a.outlet_id ORDER BY {HAB}, b.outlet_id) <= 8),
gl AS (SELECT market_id, CAST(rep_id % 25 AS INTEGER) AS g, sum(vf) AS load FROM act GROUP BY ALL), gm AS (SELECT market_id, sum(load) / count(*) AS mean FROM gl GROUP BY 1)"""


def _one_to_one(score: str) -> str:
    """Pairs of groups that are the best of both, from candidates d (market_id, outlet_id, g, h)."""
    return f"""pr AS (SELECT market_id, g, h, {score} AS s, outlet_id AS o FROM d QUALIFY row_number() OVER (PARTITION BY market_id, g, h ORDER BY {score}, outlet_id) = 1),
en AS (SELECT *, unnest([g, h]) AS e FROM pr), be AS (SELECT * FROM en QUALIFY row_number() OVER (PARTITION BY market_id, e ORDER BY s, o, g, h) = 1),
ch AS (SELECT market_id, g, h FROM be GROUP BY ALL HAVING count(*) = 2)"""


QUERIES["repair_loads_round"] = lambda spark, sf: pt.repair_loads(_skewed(spark, sf), pt.neighbour_graph(units(spark, sf), M), M, 0.05, 0.05, rounds=1).select("market_id", "outlet_id", "group")
SQL["repair_loads_round"] = f"""WITH {OUTLETS}, {ACT}, {GRAPH}, tc AS (SELECT market_id, outlet_id, g, h, w, min(km) AS km FROM kg WHERE g <> h AND km <= 4 GROUP BY ALL),
d AS (SELECT tc.*, x.load AS gload, y.load AS hload, mean, mean * 0.95::DOUBLE AS lo, mean * 1.05::DOUBLE AS hi FROM tc JOIN gl x USING (market_id, g) JOIN gl y ON y.market_id = tc.market_id AND y.g = tc.h JOIN gm ON gm.market_id = tc.market_id
  WHERE ((x.load > hi AND y.load < mean) OR (y.load < lo AND x.load > mean)) AND x.load - w >= lo AND y.load + w <= hi), {_one_to_one('km')},
mv AS (SELECT d.*, sum(w) OVER (PARTITION BY d.market_id, d.g, d.h ORDER BY km, outlet_id) AS cu FROM d JOIN ch USING (market_id, g, h)),
go AS (SELECT outlet_id, h FROM mv WHERE cu <= greatest(w, least(gload - mean, mean - hload)) AND gload - cu >= lo AND hload + cu <= hi)
SELECT market_id, outlet_id, coalesce(h, CAST(rep_id % 25 AS INTEGER)) AS "group" FROM act LEFT JOIN go USING (outlet_id)"""

QUERIES["cohesion_round"] = lambda spark, sf: pt.cohesion_moves(_skewed(spark, sf), pt.neighbour_graph(units(spark, sf), M), M, 0.3, 0.3, rounds=1).select("market_id", "outlet_id", "group")
SQL["cohesion_round"] = f"""WITH {OUTLETS}, {ACT}, {GRAPH}, tc AS (SELECT market_id, outlet_id, g, h, w, min(km) AS km FROM kg GROUP BY ALL), fr AS (SELECT outlet_id, max(km) AS far FROM kg GROUP BY 1),
ow AS (SELECT outlet_id, km AS own FROM tc WHERE g = h), c AS (SELECT tc.*, coalesce(own, far) AS own_km FROM tc JOIN fr USING (outlet_id) LEFT JOIN ow USING (outlet_id) WHERE g <> h),
d AS (SELECT c.*, x.load AS gload, y.load AS hload, mean FROM c JOIN gl x USING (market_id, g) JOIN gl y ON y.market_id = c.market_id AND y.g = c.h JOIN gm ON gm.market_id = c.market_id
  WHERE km < 0.8::DOUBLE * own_km AND x.load - w >= mean * 0.7::DOUBLE AND y.load + w <= mean * 1.3::DOUBLE), {_one_to_one('(km - own_km)')},
mv AS (SELECT d.*, sum(w) OVER (PARTITION BY d.market_id, d.g, d.h ORDER BY km - own_km, outlet_id) AS cu FROM d JOIN ch USING (market_id, g, h)),
go AS (SELECT outlet_id, h FROM mv WHERE gload - cu >= mean * 0.7::DOUBLE AND hload + cu <= mean * 1.3::DOUBLE)
SELECT market_id, outlet_id, coalesce(h, CAST(rep_id % 25 AS INTEGER)) AS "group" FROM act LEFT JOIN go USING (outlet_id)"""
