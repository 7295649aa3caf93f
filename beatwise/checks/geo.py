"""Geospatial functions and their SQL. Pairs are consecutive stops of the stored routes."""
from __future__ import annotations

from pyspark.sql import functions as F

from beatwise.checks.sql import LEGS, OUTLETS, STOPS, hav
from beatwise.functions import geo
from beatwise.functions.numbers import six
from beatwise.operators import market, roads, route_metrics
from beatwise.operators.hulls import convex_hulls
from beatwise.operators.prefix import with_previous
from beatwise.params import COUNTRY_BOXES, LEBANON_OUTLINE
from beatwise.sources import testdata as td

QUERIES, SQL = {}, {}
c = F.col
CELL = route_metrics.CELL
COAST = [("coast", [(33.40, 35.52), (33.60, 35.48), (33.80, 35.53)]), ("river", [(33.45, 34.0), (33.52, 38.0)]),
         ("ridge", [(33.56, 35.4), (33.561, 39.5)])]


def _pairs(spark, sf):
    s = with_previous(td.stops(spark, sf), CELL, "seq", {"lat1": "latitude", "lng1": "longitude"})
    return s.filter("lat1 is not null").select("rep_id", "week", "day_of_week", "seq", "lat1", "lng1",
                                               c("latitude").alias("lat2"), c("longitude").alias("lng2"))


PAIRS = f"""{STOPS}, pairs AS (SELECT rep_id, week, day_of_week, seq, lag(latitude) OVER w AS lat1, lag(longitude) OVER w AS lng1,
  latitude AS lat2, longitude AS lng2 FROM stops WINDOW w AS (PARTITION BY rep_id, week, day_of_week ORDER BY seq)
  QUALIFY lag(latitude) OVER w IS NOT NULL)"""
KEY = ["rep_id", "week", "day_of_week", "seq"]
ENDS = lambda: [c("lat1"), c("lng1"), c("lat2"), c("lng2")]
H = hav("lat1", "lng1", "lat2", "lng2")

QUERIES["haversine_km"] = lambda spark, sf: _pairs(spark, sf).select(*KEY, six(geo.haversine_km(*ENDS())).alias("km"))
SQL["haversine_km"] = f"WITH {PAIRS} SELECT rep_id, week, day_of_week, seq, round({H}, 6) AS km FROM pairs"

QUERIES["octile_km"] = lambda spark, sf: _pairs(spark, sf).select(*KEY, six(geo.distance("grid")(*ENDS())).alias("km"))
NS, EW = hav("lat1", "lng1", "lat2", "lng1"), hav("lat1", "lng1", "lat1", "lng2")
SQL["octile_km"] = f"""WITH {PAIRS} SELECT rep_id, week, day_of_week, seq,
  round(greatest({NS}, {EW}) - least({NS}, {EW}) + sqrt(2.0) * least({NS}, {EW}), 6) AS km FROM pairs"""


def _orient(a, b, p):
    v = f"(({b[1]}) - ({a[1]})) * (({p[0]}) - ({b[0]})) - (({b[0]}) - ({a[0]})) * (({p[1]}) - ({b[1]}))"
    return f"(CASE WHEN abs({v}) < 1e-12 THEN 0 WHEN {v} > 0 THEN 1 ELSE 2 END)"


def _crossing_sql():
    rows = [f"('{n}', {a[0]}, {a[1]}, {b[0]}, {b[1]})" for n, pts in COAST for a, b in zip(pts, pts[1:])]
    p1, p2, p3, p4 = ("lat1", "lng1"), ("lat2", "lng2"), ("a", "b"), ("c", "d")
    cond = f"{_orient(p1, p2, p3)} <> {_orient(p1, p2, p4)} AND {_orient(p3, p4, p1)} <> {_orient(p3, p4, p2)}"
    return f"""{PAIRS}, seg(name, a, b, c, d) AS (VALUES {', '.join(rows)}),
hits AS (SELECT rep_id, week, day_of_week, seq, count(DISTINCT name) AS n FROM pairs JOIN seg ON {cond} GROUP BY ALL),
crossed AS (SELECT p.*, coalesce(n, 0) AS crossings FROM pairs p LEFT JOIN hits USING (rep_id, week, day_of_week, seq))"""


QUERIES["barrier_crossings"] = lambda spark, sf: (lambda p: p.select(
    *KEY, roads.barrier_crossings(p, COAST).cast("bigint").alias("crossings")))(_pairs(spark, sf))
SQL["barrier_crossings"] = f"WITH {_crossing_sql()} SELECT rep_id, week, day_of_week, seq, crossings FROM crossed"

QUERIES["road_estimate_km"] = lambda spark, sf: (lambda p: p.select(
    *KEY, six(geo.road_estimate_km(geo.haversine_km(*ENDS()), roads.barrier_crossings(p, COAST))).alias("km")))(_pairs(spark, sf))
SQL["road_estimate_km"] = f"WITH {_crossing_sql()} SELECT rep_id, week, day_of_week, seq, round({H} * 1.3 + 4.0 * crossings, 6) AS km FROM crossed"


def _matrix(spark, sf):
    p = _pairs(spark, sf)
    km = geo.haversine_km(*ENDS()) * 1.25
    there = p.select("lat1", "lng1", "lat2", "lng2", six(km).alias("km"), (c("seq") + 10.0).alias("minutes"))
    back = p.select(c("lat2").alias("lat1"), c("lng2").alias("lng1"), c("lat1").alias("lat2"), c("lng1").alias("lng2"),
                    six(km * F.when(c("seq") % 2 == 0, 0.9).otherwise(1.1)).alias("km"), (c("seq") + 20.0).alias("minutes"))
    return there.union(back)


QUERIES["road_pairs_from_matrix"] = lambda spark, sf: roads.road_pairs_from_matrix(_matrix(spark, sf))
MATRIX = f"""{PAIRS}, matrix AS (
  SELECT lat1, lng1, lat2, lng2, round({H} * 1.25, 6) AS km, seq + 10.0::DOUBLE AS minutes FROM pairs UNION ALL
  SELECT lat2, lng2, lat1, lng1, round({H} * 1.25 * CASE WHEN seq % 2 = 0 THEN 0.9::DOUBLE ELSE 1.1::DOUBLE END, 6), seq + 20.0::DOUBLE FROM pairs),
ij AS (SELECT CAST(floor(lat1 * 1e4 + 0.5) AS BIGINT) AS a, CAST(floor(lng1 * 1e4 + 0.5) AS BIGINT) AS b,
  CAST(floor(lat2 * 1e4 + 0.5) AS BIGINT) AS c, CAST(floor(lng2 * 1e4 + 0.5) AS BIGINT) AS d, km, minutes FROM matrix),
lohi AS (SELECT CASE WHEN a < c OR (a = c AND b <= d) THEN [a, b, c, d] ELSE [c, d, a, b] END AS k, km, minutes FROM ij WHERE NOT (a = c AND b = d)),
road_pairs AS (SELECT k[1] AS lat1_i, k[2] AS lng1_i, k[3] AS lat2_i, k[4] AS lng2_i, km, minutes FROM lohi
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY km, minutes) = 1)"""
SQL["road_pairs_from_matrix"] = f"WITH {MATRIX} SELECT * FROM road_pairs"

QUERIES["geo_dist_road"] = lambda spark, sf: roads.road_distance(
    _pairs(spark, sf), roads.road_pairs_from_matrix(_matrix(spark, sf))).select(*KEY, six(c("road_km")).alias("road_km"))
SQL["geo_dist_road"] = f"""WITH {MATRIX}, pk AS (SELECT *, CAST(floor(lat1 * 1e4 + 0.5) AS BIGINT) AS a, CAST(floor(lng1 * 1e4 + 0.5) AS BIGINT) AS b,
  CAST(floor(lat2 * 1e4 + 0.5) AS BIGINT) AS c, CAST(floor(lng2 * 1e4 + 0.5) AS BIGINT) AS d FROM pairs),
pq AS (SELECT *, CASE WHEN a < c OR (a = c AND b <= d) THEN [a, b, c, d] ELSE [c, d, a, b] END AS q FROM pk)
SELECT p.rep_id, p.week, p.day_of_week, p.seq, round(coalesce(r.km, {hav('p.lat1', 'p.lng1', 'p.lat2', 'p.lng2')} * 1.3), 6) AS road_km FROM pq p LEFT JOIN road_pairs r ON
  r.lat1_i = q[1] AND r.lng1_i = q[2] AND r.lat2_i = q[3] AND r.lng2_i = q[4]"""

# Roads are known where they are a kilometre or more.
QUERIES["scorecard_days_by_road"] = lambda spark, sf: route_metrics.scorecard_days(route_metrics.road_legs(
    td.stops(spark, sf), roads.road_pairs_from_matrix(_matrix(spark, sf)).filter("km >= 1"))).select(
    "market_id", "rep_id", "week", "day_of_week", "visits", six(c("km")).alias("km"), six(c("drive_min")).alias("drive_min"), six(c("total_min")).alias("total_min"), "long_legs")
SQL["scorecard_days_by_road"] = f"""WITH {MATRIX}, lp AS (SELECT *, lag(latitude) OVER w AS la, lag(longitude) OVER w AS lo FROM stops WINDOW w AS (PARTITION BY rep_id, week, day_of_week ORDER BY seq)),
lk AS (SELECT *, CAST(floor(la * 1e4 + 0.5) AS BIGINT) AS a, CAST(floor(lo * 1e4 + 0.5) AS BIGINT) AS b, CAST(floor(latitude * 1e4 + 0.5) AS BIGINT) AS c, CAST(floor(longitude * 1e4 + 0.5) AS BIGINT) AS d FROM lp),
lq AS (SELECT *, CASE WHEN a < c OR (a = c AND b <= d) THEN [a, b, c, d] ELSE [c, d, a, b] END AS q, coalesce({hav('la', 'lo', 'latitude', 'longitude')}, 0.0) AS straight FROM lk),
lj AS (SELECT lq.*, r.km AS rk, r.minutes AS rm FROM lq LEFT JOIN road_pairs r ON r.km >= 1 AND r.lat1_i = q[1] AND r.lng1_i = q[2] AND r.lat2_i = q[3] AND r.lng2_i = q[4]),
ld AS (SELECT market_id, rep_id, week, day_of_week, count(*) AS visits, sum(coalesce(rk, straight * 1.3)) AS km, sum(coalesce(rm * 1.6, coalesce(rk, straight * 1.3) / 25 * 60)) AS drive, sum(call_minutes) AS calls,
  count(*) FILTER (straight > 4) AS long_legs FROM lj GROUP BY ALL)
SELECT market_id, rep_id, week, day_of_week, visits, round(km, 6) AS km, round(drive, 6) AS drive_min, round(calls + drive + 70, 6) AS total_min, long_legs FROM ld"""

QUERIES["cell_of"] = lambda spark, sf: td.outlets(spark, sf).select(
    "outlet_id", *[geo.cell(c(x), s).alias(f"{n}_{x[:3]}") for n, s in (("fine", 0.01), ("mid", 0.02), ("wide", 5 / 111)) for x in ("latitude", "longitude")])
SQL["cell_of"] = f"""WITH {OUTLETS} SELECT outlet_id, """ + ", ".join(
    f"CAST(floor({x} / {s}) AS BIGINT) AS {n}_{x[:3]}" for n, s in (("fine", "0.01::DOUBLE"), ("mid", "0.02::DOUBLE"), ("wide", "(5::DOUBLE / 111)")) for x in ("latitude", "longitude")) + " FROM outlets"

XY = lambda: (((c("lat_e6") - 33000000) / 10).cast("bigint") % 65536, ((c("lng_e6") - 10000000) / 100).cast("bigint") % 65536)
QUERIES["hilbert_index"] = lambda spark, sf: td.outlets(spark, sf).select("outlet_id", geo.hilbert_d(*XY()).alias("d"))
SQL["hilbert_index"] = f"""WITH RECURSIVE {OUTLETS}, walk(outlet_id, s, x, y, d) AS (
  SELECT outlet_id, 32768::BIGINT, ((lat_e6 - 33000000) // 10) % 65536, ((lng_e6 - 10000000) // 100) % 65536, 0::BIGINT FROM outlets
  UNION ALL SELECT outlet_id, s // 2,
    CASE WHEN (y & s) > 0 THEN x WHEN (x & s) > 0 THEN s - 1 - y ELSE y END,
    CASE WHEN (y & s) > 0 THEN y WHEN (x & s) > 0 THEN s - 1 - x ELSE x END,
    d + s * s * xor(CASE WHEN (x & s) > 0 THEN 3 ELSE 0 END, CASE WHEN (y & s) > 0 THEN 1 ELSE 0 END) FROM walk WHERE s > 0)
SELECT outlet_id, d FROM walk WHERE s = 0"""

QUERIES["local_projection"] = lambda spark, sf: td.outlets(spark, sf).select(
    "outlet_id", six(geo.local_x_km(c("longitude"), F.lit(33.5))).alias("x_km"), six(geo.local_y_km(c("latitude"))).alias("y_km"))
SQL["local_projection"] = f"""WITH {OUTLETS} SELECT outlet_id, round(longitude * 111.32::DOUBLE * cos(radians(33.5::DOUBLE)), 6) AS x_km,
  round(latitude * 110.57::DOUBLE, 6) AS y_km FROM outlets"""

RING_ROWS = ", ".join(f"({i}, {p[0]}, {p[1]}, {q[0]}, {q[1]})" for i, (p, q) in enumerate(
    zip(LEBANON_OUTLINE, LEBANON_OUTLINE[-1:] + LEBANON_OUTLINE[:-1])))
IN_LEBANON = f"""(SELECT count(*) % 2 = 1 FROM (VALUES {RING_ROWS}) e(i, x1, y1, x2, y2)
  WHERE (y1 > LAT) <> (y2 > LAT) AND LNG < (x2 - x1)::DOUBLE * (LAT - y1) / (y2 - y1) + x1)"""
QUERIES["point_in_polygon"] = lambda spark, sf: td.outlets(spark, sf).select(
    "outlet_id", geo.point_in_ring(geo.ring_literal(LEBANON_OUTLINE), c("longitude"), c("latitude")).alias("inside"))
SQL["point_in_polygon"] = f"WITH {OUTLETS} SELECT outlet_id, {IN_LEBANON.replace('LAT', 'latitude').replace('LNG', 'longitude')} AS inside FROM outlets"

BOXES = " ".join(f"WHEN lat BETWEEN {a} AND {b} AND lng BETWEEN {x} AND {y} THEN '{n}'" for n, a, b, x, y, _ in COUNTRY_BOXES[1:])
COUNTRY = f"CASE WHEN {IN_LEBANON.replace('LAT', 'lat').replace('LNG', 'lng')} THEN 'Lebanon' {BOXES} END"
WEEKS = "CASE country " + " ".join(f"WHEN '{n}' THEN '{','.join(map(str, w))}'" for n, *_, w in COUNTRY_BOXES) + " ELSE '1,2,3,4,5,6' END"


def _country(spark, sf):
    mid = market.centre(td.outlets(spark, sf).filter("not excluded and not offset"), ["rep_id"])
    out = mid.withColumn("country", market.guess_country(c("centre_lat"), c("centre_lng")))
    week = market.week_of_country(c("country"))
    return out.select("rep_id", six(c("centre_lat")).alias("lat"), six(c("centre_lng")).alias("lng"), "country",
                      F.array_join(week, ",").alias("week"), market.week_label(week).alias("label"))


QUERIES["guess_country_week"] = _country
SQL["guess_country_week"] = f"""WITH {OUTLETS}, m AS (SELECT rep_id, median(latitude) AS lat, median(longitude) AS lng FROM outlets
  WHERE NOT excluded AND NOT "offset" GROUP BY 1), k AS (SELECT *, {COUNTRY} AS country FROM m)
SELECT rep_id, round(lat, 6) AS lat, round(lng, 6) AS lng, country, {WEEKS} AS week,
  CASE WHEN {WEEKS} = '1,2,3,4,5,6' THEN 'Mon-Sat' ELSE 'Sat-Thu' END AS label FROM k"""


def _gaps(spark, sf):
    box = td.outlets(spark, sf).filter("not offset").groupBy("market_id", "rep_id").agg(
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"), F.min("longitude").alias("min_lng"), F.max("longitude").alias("max_lng"))
    a = box.select("market_id", *[c(x).alias(f"a_{x}") for x in box.columns[1:]])
    b = box.select("market_id", *[c(x).alias(f"b_{x}") for x in box.columns[1:]])
    # Territories of the block next to each other, an equi-join on the next rep.
    return a.withColumn("b_rep_id", c("a_rep_id") + 1).join(b, ["market_id", "b_rep_id"]).select(
        "a_rep_id", "b_rep_id", six(geo.box_gap_km("a_", "b_")).alias("gap_km"))


QUERIES["box_gap_km"] = _gaps
SQL["box_gap_km"] = f"""WITH {OUTLETS}, x AS (SELECT market_id, rep_id, min(latitude) AS p, max(latitude) AS q, min(longitude) AS r, max(longitude) AS s
  FROM outlets WHERE NOT "offset" GROUP BY ALL)
SELECT a.rep_id AS a_rep_id, b.rep_id AS b_rep_id, round(sqrt(power(greatest(0, a.p - b.q, b.p - a.q) * 110.57, 2)
  + power(greatest(0, a.r - b.s, b.r - a.s) * 111.32 * cos(radians((a.p + a.q + b.p + b.q) / 4)), 2)), 6) AS gap_km
FROM x a JOIN x b ON a.market_id = b.market_id AND b.rep_id = a.rep_id + 1"""

QUERIES["map_link"] = lambda spark, sf: td.outlets(spark, sf).select("outlet_id", geo.map_link(c("latitude"), c("longitude")).alias("link"))
SQL["map_link"] = f"""WITH {OUTLETS} SELECT outlet_id, 'https://www.google.com/maps/search/?api=1&query=' || (lat_e6 // 1000000) || '.' || lpad(CAST(lat_e6 % 1000000 AS VARCHAR), 6, '0')
  || ',' || (lng_e6 // 1000000) || '.' || lpad(CAST(lng_e6 % 1000000 AS VARCHAR), 6, '0') AS link FROM outlets"""


def _position(spark, sf):
    legs = route_metrics.route_legs(td.stops(spark, sf))
    marks = td.stops(spark, sf).select(*CELL).distinct().withColumn("mark_km", F.explode(F.array(F.lit(0.5), F.lit(3.0), F.lit(500.0))))
    return route_metrics.route_position(legs, marks).select("rep_id", "week", "day_of_week", "mark_km", six(c("lat")).alias("lat"),
                                                            six(c("lng")).alias("lng"), "stops_reached")


QUERIES["route_position"] = _position
SQL["route_position"] = f"""WITH {LEGS}, cum AS (SELECT *, sum(leg_km) OVER w AS at_km, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plng,
  count(*) OVER (PARTITION BY rep_id, week, day_of_week) AS n FROM legs WINDOW w AS (PARTITION BY rep_id, week, day_of_week ORDER BY seq)),
m AS (SELECT c.*, c.at_km - c.leg_km AS from_km, unnest([0.5::DOUBLE, 3.0::DOUBLE, 500.0::DOUBLE]) AS mark_km FROM cum c),
e AS (SELECT *, max(at_km) OVER (PARTITION BY rep_id, week, day_of_week) AS total FROM m)
SELECT rep_id, week, day_of_week, mark_km, round(CASE WHEN n = 1 OR mark_km >= total THEN latitude ELSE plat + (latitude - plat) * (mark_km - from_km) / leg_km END, 6) AS lat,
  round(CASE WHEN n = 1 OR mark_km >= total THEN longitude ELSE plng + (longitude - plng) * (mark_km - from_km) / leg_km END, 6) AS lng,
  CAST(CASE WHEN n = 1 OR mark_km >= total THEN seq ELSE seq - 1 END AS INTEGER) AS stops_reached
FROM e WHERE CASE WHEN n = 1 OR mark_km >= total THEN seq = n ELSE from_km <= mark_km AND mark_km < at_km END"""

QUERIES["leg_cost"] = lambda spark, sf: route_metrics.route_legs(td.stops(spark, sf)).groupBy("rep_id", "week", "day_of_week").agg(
    six(F.sum(route_metrics.leg_cost(c("leg_km"), 4.0))).alias("cost"))
SQL["leg_cost"] = f"WITH {LEGS} SELECT rep_id, week, day_of_week, round(sum(leg_km + 10 * greatest(0, leg_km - 4)), 6) AS cost FROM legs GROUP BY ALL"

QUERIES["polygon_centroid"] = lambda spark, sf: convex_hulls(td.outlets(spark, sf), ["market_id", "rep_id"]).select(
    "rep_id", F.size("ring").alias("corners"), *[six(geo.ring_centroid(c("ring"))[k]).alias(k) for k in ("x", "y")])
QUERIES["convex_hull"] = lambda spark, sf: convex_hulls(td.outlets(spark, sf), ["market_id", "rep_id"]).select(
    "rep_id", F.posexplode("ring").alias("corner", "p")).select("rep_id", "corner", c("p.x").alias("x"), c("p.y").alias("y"))
