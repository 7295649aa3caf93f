"""Route order and its SQL for single rounds."""
from __future__ import annotations

from pyspark.sql import functions as F

from beatwise.checks.sql import OUTLETS, STOPS, hav
from beatwise.functions.numbers import six
from beatwise.operators import route_metrics as rm
from beatwise.operators import routes as rt
from beatwise.sources import testdata as td

QUERIES, SQL = {}, {}
c = F.col
CELL = rm.CELL
K = "rep_id, week, day_of_week"


def _ordered(spark, sf):
    return rt.order_stops(td.stops(spark, sf), CELL, 4.0)


QUERIES["order_stops"] = lambda spark, sf: rm.route_legs(_ordered(spark, sf)).groupBy(*CELL).agg(F.count(F.lit(1)).alias("stops"), six(F.sum("leg_km")).alias("km"))
QUERIES["order_stops_positions"] = lambda spark, sf: _ordered(spark, sf).groupBy(*CELL).agg(
    F.count(F.lit(1)).alias("stops"), F.sum("seq").alias("seq_sum"), F.max("seq").alias("seq_max"), F.count_distinct("seq").alias("places"))
SQL["order_stops_positions"] = f"WITH {STOPS} SELECT market_id, {K}, count(*) AS stops, CAST(sum(seq) AS BIGINT) AS seq_sum, max(seq) AS seq_max, count(DISTINCT seq) AS places FROM stops GROUP BY ALL"

PRICE = lambda a, b, d, e: f"coalesce({hav(a, b, d, e)}, 0)"
FLIP = f"""{STOPS}, nb AS (SELECT *, lag(latitude) OVER w AS pa, lag(longitude) OVER w AS po, lead(latitude) OVER w AS na, lead(longitude) OVER w AS nn FROM stops WINDOW w AS (PARTITION BY {K} ORDER BY seq)),
fl AS (SELECT a.rep_id, a.week, a.day_of_week, a.seq AS i, b.seq AS j, round({PRICE('a.pa', 'a.po', 'a.latitude', 'a.longitude')} + {PRICE('b.latitude', 'b.longitude', 'b.na', 'b.nn')}
  - {PRICE('a.pa', 'a.po', 'b.latitude', 'b.longitude')} - {PRICE('a.latitude', 'a.longitude', 'b.na', 'b.nn')}, 9) AS gain
  FROM nb a JOIN nb b ON (a.rep_id, a.week, a.day_of_week) = (b.rep_id, b.week, b.day_of_week) AND a.seq < b.seq AND (a.seq - 1) // 64 = (b.seq - 1) // 64 AND (a.pa IS NOT NULL OR b.na IS NOT NULL)),
be AS (SELECT * FROM fl WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY gain DESC, i, j) = 1)"""
QUERIES["two_opt_round"] = lambda spark, sf: rt.two_opt_round(td.stops(spark, sf), CELL).select("rep_id", "week", "day_of_week", "outlet_id", "seq")
SQL["two_opt_round"] = f"WITH {FLIP} SELECT rep_id, week, day_of_week, outlet_id, CASE WHEN seq BETWEEN i AND j THEN i + j - seq ELSE seq END AS seq FROM stops LEFT JOIN be USING ({K})"

QUERIES["or_opt_round"] = lambda spark, sf: rt.or_opt_candidates(td.stops(spark, sf), CELL).groupBy(*CELL).agg(six(F.max("gain")).alias("gain"))
SQL["or_opt_round"] = f"""WITH {STOPS}, n AS (SELECT *, count(*) OVER (PARTITION BY {K}) AS n FROM stops),
r AS (SELECT s.market_id, s.rep_id, s.week, s.day_of_week, s.n, s.seq AS s, e.seq AS e, s.latitude AS sa, s.longitude AS so, e.latitude AS ea, e.longitude AS eo, p.latitude AS pa, p.longitude AS po, x.latitude AS xa, x.longitude AS xo
  FROM n s JOIN n e ON (s.rep_id, s.week, s.day_of_week) = (e.rep_id, e.week, e.day_of_week) AND e.seq - s.seq BETWEEN 0 AND 2 AND e.seq - s.seq + 1 < s.n
  LEFT JOIN n p ON (s.rep_id, s.week, s.day_of_week) = (p.rep_id, p.week, p.day_of_week) AND p.seq = s.seq - 1 LEFT JOIN n x ON (s.rep_id, s.week, s.day_of_week) = (x.rep_id, x.week, x.day_of_week) AND x.seq = e.seq + 1),
q AS (SELECT *, {PRICE('pa', 'po', 'sa', 'so')} + {PRICE('ea', 'eo', 'xa', 'xo')} - {PRICE('pa', 'po', 'xa', 'xo')} AS saved FROM r),
sl AS (SELECT rep_id, week, day_of_week, seq AS k, lag(latitude) OVER w AS ba, lag(longitude) OVER w AS bo, latitude AS aa, longitude AS ao FROM stops WINDOW w AS (PARTITION BY {K} ORDER BY seq)
  UNION ALL SELECT rep_id, week, day_of_week, seq + 1, latitude, longitude, NULL, NULL FROM n WHERE seq = n),
g AS (SELECT q.market_id, q.rep_id, q.week, q.day_of_week, saved - least({PRICE('ba', 'bo', 'sa', 'so')} + {PRICE('ea', 'eo', 'aa', 'ao')}, {PRICE('ba', 'bo', 'ea', 'eo')} + {PRICE('sa', 'so', 'aa', 'ao')}) + {PRICE('ba', 'bo', 'aa', 'ao')} AS gain
  FROM q JOIN sl ON (q.rep_id, q.week, q.day_of_week) = (sl.rep_id, sl.week, sl.day_of_week) AND (k < s OR k > e + 1) WHERE saved > 1e-9)
SELECT market_id, rep_id, week, day_of_week, round(max(gain), 6) AS gain FROM g GROUP BY ALL"""
QUERIES["or_opt_applied"] = lambda spark, sf: rt.or_opt_round(td.stops(spark, sf), CELL).groupBy(*CELL).agg(F.count_distinct("seq").alias("places"), F.max("seq").alias("seq_max"))
SQL["or_opt_applied"] = f"WITH {STOPS} SELECT market_id, {K}, count(*) AS places, max(seq) AS seq_max FROM stops GROUP BY ALL"


def _arrivals(spark, sf):
    """Outlets without a route, offered to every route of their rep."""
    free = td.outlets(spark, sf).filter("not excluded and not offset and outlet_id % 89 = 5").select("market_id", "rep_id", "outlet_id", "latitude", "longitude")
    cells = td.stops(spark, sf).select(*CELL).distinct()
    return free.join(cells, ["market_id", "rep_id"])


QUERIES["cheapest_insertion"] = lambda spark, sf: rt.cheapest_insertion(td.stops(spark, sf), _arrivals(spark, sf), CELL).select("rep_id", "week", "day_of_week", "outlet_id", "at", six(c("added_km")).alias("added_km"))
SQL["cheapest_insertion"] = f"""WITH {STOPS}, sl AS (SELECT rep_id, week, day_of_week, seq AS k, lag(latitude) OVER w AS ba, lag(longitude) OVER w AS bo, latitude AS aa, longitude AS ao FROM stops WINDOW w AS (PARTITION BY {K} ORDER BY seq)
  UNION ALL (SELECT rep_id, week, day_of_week, seq + 1, latitude, longitude, NULL, NULL FROM stops QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY seq DESC) = 1)),
f AS (SELECT * FROM outlets WHERE NOT excluded AND NOT "offset" AND outlet_id % 89 = 5),
g AS (SELECT f.rep_id, sl.week, sl.day_of_week, f.outlet_id, k, round({PRICE('ba', 'bo', 'f.latitude', 'f.longitude')} + {PRICE('f.latitude', 'f.longitude', 'aa', 'ao')} - {PRICE('ba', 'bo', 'aa', 'ao')}, 9) AS cost FROM f JOIN sl ON sl.rep_id = f.rep_id)
SELECT rep_id, week, day_of_week, outlet_id, k AS "at", round(cost, 6) AS added_km FROM g QUALIFY row_number() OVER (PARTITION BY outlet_id, week, day_of_week ORDER BY cost, k) = 1"""


def _day_centres(spark, sf):
    return td.outlets(spark, sf).filter("not excluded and not offset").groupBy("market_id", "rep_id", "day_group").agg(
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.count(F.lit(1)).alias("outlets"))


QUERIES["sequence_days"] = lambda spark, sf: rt.sequence_days(_day_centres(spark, sf), ["market_id", "rep_id"])
# All orders of a rep's days; legs in whole millimetres.
SQL["sequence_days"] = f"""WITH RECURSIVE {OUTLETS}, ce AS (SELECT market_id, rep_id, day_group, avg(latitude) AS a, avg(longitude) AS o FROM outlets WHERE NOT excluded AND NOT "offset" GROUP BY ALL),
le AS (SELECT x.market_id, x.rep_id, x.day_group AS src, y.day_group AS dst, CAST(round({hav('x.a', 'x.o', 'y.a', 'y.o')} * 1000000) AS BIGINT) AS mm FROM ce x JOIN ce y ON x.market_id = y.market_id AND x.rep_id = y.rep_id),
pa AS (SELECT market_id, rep_id, [day_group] AS path, day_group AS last, CAST(0 AS BIGINT) AS mm FROM ce UNION ALL
  SELECT pa.market_id, pa.rep_id, list_append(path, dst), dst, pa.mm + le.mm FROM pa JOIN le ON le.market_id = pa.market_id AND le.rep_id = pa.rep_id AND le.src = pa.last WHERE NOT list_contains(path, dst)),
be AS (SELECT market_id, rep_id, path FROM pa QUALIFY row_number() OVER (PARTITION BY market_id, rep_id ORDER BY len(path) DESC, mm, path) = 1)
SELECT market_id, rep_id, unnest(path) AS day_group, CAST(generate_subscripts(path, 1) AS INTEGER) AS place FROM be"""
