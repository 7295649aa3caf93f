"""Market, scorecard and plan figures, sorts and scenarios, and their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from beatwise.checks.geo import COUNTRY
from beatwise.checks.sql import LEGS, OUTLETS, REPS, STOPS, channel_case, hav, minutes_case
from beatwise.functions import geo
from beatwise.functions.numbers import half_up, six
from beatwise.functions.text import natural_key
from beatwise.operators import market as mk
from beatwise.operators import route_metrics as rm
from beatwise.operators import scenarios as sc
from beatwise.operators import schedule as sch
from beatwise.operators import scorecard as card
from beatwise.operators import zones as zn
from beatwise.operators.neighbours import nearest
from beatwise.params import Band
from beatwise.sources import testdata as td

QUERIES, SQL = {}, {}
c = F.col
M, REP = ["market_id"], ["market_id", "rep_id"]
ACTIVE = "not excluded and not offset"
ACT = 'NOT excluded AND NOT "offset"'
act = lambda spark, sf: td.outlets(spark, sf).filter(ACTIVE)
stops = td.stops
days = lambda spark, sf: rm.scorecard_days(rm.route_legs(td.stops(spark, sf)))


def rounded(df, *names):
    for n in names:
        df = df.withColumn(n, six(c(n)))
    return df


# ------------------------------------------------------------------ market
QUERIES["frequency_mix"] = lambda spark, sf: mk.frequency_mix(act(spark, sf), M)
SQL["frequency_mix"] = f"""WITH {OUTLETS} SELECT market_id, count(*) AS outlets, """ + ", ".join(f"count(*) FILTER (vf = {v}) AS vf{v}" for v in (1, 2, 3, 4)) + f""",
  CAST(sum(vf) AS BIGINT) AS monthly_visits FROM outlets WHERE {ACT} GROUP BY 1"""

QUERIES["channel_mix"] = lambda spark, sf: mk.channel_mix(act(spark, sf), M)
SQL["channel_mix"] = f"""WITH {OUTLETS}, k AS (SELECT market_id, {channel_case('channel')} AS channel_key FROM outlets WHERE {ACT}),
n AS (SELECT market_id, channel_key, count(*) AS outlets FROM k WHERE channel_key IS NOT NULL GROUP BY ALL)
SELECT *, CAST({minutes_case('channel_key')} AS INTEGER) AS call_minutes, CAST(row_number() OVER (PARTITION BY market_id ORDER BY outlets DESC, channel_key) AS INTEGER) AS place FROM n"""

NEAR = f"""{OUTLETS}, act AS (SELECT * FROM outlets WHERE {ACT}), pr AS (
  SELECT a.outlet_id, {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS km, row_number() OVER (PARTITION BY a.outlet_id ORDER BY km, b.outlet_id) AS r
  FROM act a JOIN act b ON a.market_id = b.market_id AND a.outlet_id <> b.outlet_id),
near AS (SELECT act.*, coalesce(max(km) FILTER (r = 2), 0) AS nn2, coalesce(max(km) FILTER (r = 3), 0) AS nn3 FROM act LEFT JOIN pr ON pr.outlet_id = act.outlet_id AND r <= 3 GROUP BY ALL)"""
SHAPE = f"""{NEAR}, mid AS (SELECT market_id, median(latitude) AS centre_lat, median(longitude) AS centre_lng FROM near GROUP BY 1),
aw AS (SELECT market_id, {hav('centre_lat', 'centre_lng', 'latitude', 'longitude')} AS d, nn2, nn3 FROM near JOIN mid USING (market_id)),
shape AS (SELECT market_id, centre_lat, centre_lng, list_sort(list(d))[CAST(floor((count(*) - 1) * 0.9 + 0.5) AS BIGINT) + 1] AS radius_km, count(*) AS outlets,
  median(nn2) AS neighbour_km, list_sort(list(nn3))[CAST(floor((count(*) - 1) * 0.75 + 0.5) AS BIGINT) + 1] AS nn3_p75 FROM aw JOIN mid USING (market_id) GROUP BY ALL)"""
CHARACTER = "CASE WHEN neighbour_km < 0.12 THEN 'dense city' WHEN neighbour_km < 0.3 THEN 'city' WHEN neighbour_km < 0.8 THEN 'city and towns' ELSE 'towns and villages' END"
QUERIES["market_shape"] = lambda spark, sf: rounded(mk.market_shape(mk.second_neighbours(act(spark, sf), M), M), "centre_lat", "centre_lng", "radius_km", "neighbour_km", "nn3_p75")
SQL["market_shape"] = f"""WITH {SHAPE} SELECT market_id, round(centre_lat, 6) AS centre_lat, round(centre_lng, 6) AS centre_lng, round(radius_km, 6) AS radius_km, outlets,
  round(neighbour_km, 6) AS neighbour_km, round(nn3_p75, 6) AS nn3_p75, {CHARACTER} AS character FROM shape"""

WORK = f"""pv AS (SELECT *, call_minutes + least(nn2, 6) * 1.3 / 25 * 60 AS m FROM near),
work AS (SELECT market_id, CAST(sum(vf) AS BIGINT) AS monthly_visits, sum(vf * call_minutes) / sum(vf) AS call_min, avg(least(nn2, 6)) * 1.3 / 25 * 60 AS travel_min,
  sum(vf * m) / sum(vf) AS wm FROM pv GROUP BY 1),
work2 AS (SELECT w.market_id, monthly_visits, call_min, travel_min, CAST(greatest(4, floor(410 / greatest(1, call_min + travel_min))) AS INTEGER) AS sustainable_calls,
  sqrt(sum(vf * power(m - wm, 2)) / sum(vf)) / wm AS spread FROM pv JOIN work w USING (market_id) GROUP BY w.market_id, monthly_visits, call_min, travel_min, wm)"""
QUERIES["workload_model"] = lambda spark, sf: rounded(mk.workload_model(mk.second_neighbours(act(spark, sf), M), M), "call_min", "travel_min", "spread")
SQL["workload_model"] = f"""WITH {NEAR}, {WORK} SELECT market_id, monthly_visits, round(call_min, 6) AS call_min, round(travel_min, 6) AS travel_min, sustainable_calls,
  round(spread, 6) AS spread, CASE WHEN spread > 0.2 THEN 'time' ELSE 'visits' END AS balance_by FROM work2"""

QUERIES["workload_weights"] = lambda spark, sf: rounded(mk.workload_weights(mk.second_neighbours(act(spark, sf), M), M), "weight")
SQL["workload_weights"] = f"""WITH {NEAR}, {WORK} SELECT market_id, outlet_id, round(greatest(0.3, least(4, m / wm)), 6) AS weight FROM pv JOIN work USING (market_id)"""


def _demand(spark, sf):
    o = act(spark, sf).groupBy(*REP).agg(F.sum(c("vf") * (c("outlet_id") % 9 + 1)).alias("visits"))
    k = c("rep_id")
    return o.withColumn("slots", (20 + k % 7).cast("int")).withColumn("low", (20 + k % 6).cast("int")).withColumn("high", (22 + k % 11).cast("int"))


DEMAND = f"""{OUTLETS}, demand AS (SELECT market_id, rep_id, CAST(sum(vf * (outlet_id % 9 + 1)) AS BIGINT) AS visits, 20 + rep_id % 7 AS slots, 20 + rep_id % 6 AS low, 22 + rep_id % 11 AS high
  FROM outlets WHERE {ACT} GROUP BY ALL),
bands AS (SELECT rep_id, visits, slots, least(low, high) AS lo, greatest(least(low, high), high) AS hi FROM demand),
cand AS (SELECT *, CAST(greatest(1, ceil(visits / (slots * hi))) AS INTEGER) AS fewest, CAST(greatest(1, floor(visits / (slots * lo))) AS INTEGER) AS most FROM bands),
opts AS (SELECT *, unnest(CASE WHEN fewest <= most THEN [CAST(least(greatest(floor(visits / (slots * (lo + hi) / 2.0) + 0.5), fewest), most) AS INTEGER)] ELSE list_distinct([most, fewest]) END) AS k FROM cand),
priced AS (SELECT *, visits / (k * slots) AS p, CASE WHEN visits / (k * slots) > hi THEN 1.5 * (visits / (k * slots) - hi) / hi WHEN visits / (k * slots) < lo THEN (lo - visits / (k * slots)) / lo ELSE 0 END AS cost FROM opts),
chosen AS (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY rep_id ORDER BY round(cost, 12), k) = 1)"""
QUERIES["choose_headcount"] = lambda spark, sf: mk.choose_headcount(_demand(spark, sf), "visits", "slots", "low", "high").select(
    "rep_id", "headcount.reps", "headcount.visits_per_day", "headcount.fits", F.size("options").alias("options"))
SQL["choose_headcount"] = f"""WITH {DEMAND} SELECT rep_id, k AS reps, floor(p * 10 + 0.5) / 10 AS visits_per_day, p >= lo - 1e-9 AND p <= hi + 1e-9 AS fits,
  CAST(least(6, greatest(k, most) + 1 - greatest(1, least(k, fewest) - 1) + 1) AS INTEGER) AS options FROM chosen"""

QUERIES["headcount_vs_shift"] = lambda spark, sf: mk.choose_headcount(_demand(spark, sf), "visits", "slots", "low", "high").select(
    "rep_id", mk.headcount_for_shift(c("headcount.reps"), c("visits"), c("slots"), (c("rep_id") % 13 + 12).cast("double"), c("low"), mk.Workday()).alias("reps"))
SQL["headcount_vs_shift"] = f"""WITH {DEMAND}, grow AS (SELECT c.rep_id, c.k, unnest(range(c.k, c.k + 200)) AS n, c.visits, c.slots, d.low FROM chosen c JOIN demand d USING (rep_id)),
stop AS (SELECT rep_id, min(n) AS reps FROM grow WHERE (visits / (n * slots) * (rep_id % 13 + 12) + 70) / 60 <= 0.95 * 8 OR visits / ((n + 1) * slots) < low * 0.9 GROUP BY 1)
SELECT rep_id, CAST(reps AS INTEGER) AS reps FROM stop"""

QUERIES["blueprint"] = lambda spark, sf: rounded(mk.blueprint(td.outlets(spark, sf), M), "radius_km", "neighbour_km", "call_min", "travel_min").select(
    "market_id", "listed", "excluded", "held", "duplicates", "outlets", "radius_km", "neighbour_km", "character", "vf1", "vf2", "vf3", "vf4", "monthly_visits", "call_min", "travel_min",
    "sustainable_calls", "balance_by", "country", "week_label", "band_low", "band_high", "hop_km", "slots", "reps", "visits_per_day", "day_hours",
    F.array_join(F.transform("checks", lambda x: x["status"]), ",").alias("checks"))
SQL["blueprint"] = f"""WITH {SHAPE}, {WORK}, st AS (SELECT market_id, count(*) AS listed, count(*) FILTER (excluded) AS excluded, count(*) FILTER (NOT excluded AND "offset") AS held FROM outlets GROUP BY 1),
mix AS (SELECT market_id, count(*) FILTER (vf = 1) AS vf1, count(*) FILTER (vf = 2) AS vf2, count(*) FILTER (vf = 3) AS vf3, count(*) FILTER (vf = 4) AS vf4 FROM act GROUP BY 1),
dk AS (SELECT market_id, lower(trim(name)) AS k, lat_e6 // 10 AS a, lng_e6 // 10 AS b, count(*) AS n FROM act GROUP BY ALL), du AS (SELECT market_id, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM dk GROUP BY 1),
j AS (SELECT *, centre_lat AS lat, centre_lng AS lng FROM shape JOIN work2 USING (market_id) JOIN st USING (market_id) JOIN mix USING (market_id) JOIN du USING (market_id)),
k AS (SELECT *, {COUNTRY} AS country, CAST(greatest(6, floor(sustainable_calls * 0.85 + 0.5)) AS INTEGER) AS band_low, greatest(8, least(45, sustainable_calls)) AS band_high, 24 AS slots FROM j),
h AS (SELECT *, CAST(greatest(1, ceil(monthly_visits / (slots * band_high))) AS INTEGER) AS fewest, CAST(greatest(1, floor(monthly_visits / (slots * band_low))) AS INTEGER) AS most FROM k),
o AS (SELECT *, unnest(CASE WHEN fewest <= most THEN [CAST(least(greatest(floor(monthly_visits / (slots * (band_low + band_high) / 2.0) + 0.5), fewest), most) AS INTEGER)] ELSE list_distinct([most, fewest]) END) AS t FROM h),
q AS (SELECT *, CASE WHEN monthly_visits / (t * slots) > band_high THEN 1.5 * (monthly_visits / (t * slots) - band_high) / band_high WHEN monthly_visits / (t * slots) < band_low THEN (band_low - monthly_visits / (t * slots)) / band_low ELSE 0 END AS cost FROM o
  QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY round(cost, 12), t) = 1),
g AS (SELECT q.*, (SELECT min(n) FROM (SELECT unnest(range(q.t, q.t + 500)) AS n) WHERE (q.monthly_visits / (n * q.slots) * (q.call_min + q.travel_min) + 70) / 60 <= 7.6 OR q.monthly_visits / ((n + 1) * q.slots) < q.band_low * 0.9) AS reps FROM q)
SELECT market_id, listed, excluded, held, duplicates, outlets, round(radius_km, 6) AS radius_km, round(neighbour_km, 6) AS neighbour_km, {CHARACTER} AS character, vf1, vf2, vf3, vf4, monthly_visits,
  round(call_min, 6) AS call_min, round(travel_min, 6) AS travel_min, sustainable_calls, CASE WHEN spread > 0.2 THEN 'time' ELSE 'visits' END AS balance_by, country,
  CASE WHEN country IN ('Syria', 'Iraq', 'Jordan', 'Egypt', 'Saudi Arabia', 'Oman', 'Kuwait', 'Qatar', 'Bahrain') THEN 'Sat-Thu' ELSE 'Mon-Sat' END AS week_label, band_low, band_high,
  CASE WHEN nn3_p75 > 1.5 THEN 8.0 ELSE 4.0 END AS hop_km, slots, CAST(reps AS INTEGER) AS reps, floor(monthly_visits / (reps * slots) * 10 + 0.5) / 10 AS visits_per_day,
  floor((monthly_visits / (reps * slots) * (call_min + travel_min) + 70) / 60 * 10 + 0.5) / 10 AS day_hours,
  'pass,' || CASE WHEN held > 0 THEN 'warn' ELSE 'pass' END || ',' || CASE WHEN duplicates > 0 THEN 'warn' ELSE 'pass' END || ','
  || CASE WHEN monthly_visits / (reps * slots) BETWEEN band_low AND band_high THEN 'pass' ELSE 'warn' END AS checks FROM g"""


def _means(spark, sf):
    d = _demand(spark, sf)
    return d.withColumn("mean", c("visits") / c("slots") / 3).withColumn("reps", F.lit(3))


QUERIES["band_helpers"] = lambda spark, sf: rounded(_means(spark, sf).select(
    "rep_id", mk.room_below(c("mean"), c("low"), c("high")).alias("below"), mk.room_above(c("mean"), c("low"), c("high")).alias("above")), "below", "above")
SQL["band_helpers"] = f"""WITH {DEMAND}, m AS (SELECT *, visits / slots / 3 AS mean FROM demand)
SELECT rep_id, round(CASE WHEN low > mean THEN 0.1 WHEN high < mean THEN least(0.1, least(0.35, greatest(0, (mean - low) / mean))) ELSE least(0.35, greatest(0, (mean - low) / mean)) END, 6) AS below,
  round(CASE WHEN high < mean THEN 0.1 WHEN low > mean THEN least(0.1, least(0.35, greatest(0, (high - mean) / mean))) ELSE least(0.35, greatest(0, (high - mean) / mean)) END, 6) AS above FROM m"""

QUERIES["territory_band"] = lambda spark, sf: rounded(_means(spark, sf).select(
    "rep_id", mk.territory_room(c("visits") / 3, c("low"), c("high"), c("slots")).alias("t")).select("rep_id", "t.*"), "below", "above")
SQL["territory_band"] = f"""WITH {DEMAND} SELECT rep_id, round(least(0.025, greatest(0.005, (visits / 3 - low * slots) / (visits / 3))), 6) AS below,
  round(least(0.025, greatest(0.005, (high * slots - visits / 3) / (visits / 3))), 6) AS above FROM demand"""

QUERIES["zone_sizing"] = lambda spark, sf: rounded(mk.frequency_mix(act(spark, sf), REP).select("rep_id", mk.zone_sizing(
    c("monthly_visits"), c("outlets"), F.lit(15), F.lit(25), F.lit(4)).alias("z")).select("rep_id", "z.*"), "share")
SQL["zone_sizing"] = f"""WITH {OUTLETS}, z AS (SELECT rep_id, least(1.0, greatest(0.25, sum(vf) / 4 / count(*))) AS s FROM outlets WHERE {ACT} GROUP BY 1)
SELECT rep_id, round(s, 6) AS share, CAST(greatest(1, floor(15 / s + 0.5)) AS INTEGER) AS min_outlets, CAST(greatest(greatest(1, floor(15 / s + 0.5)) + 1, floor(25 / s + 0.5)) AS INTEGER) AS max_outlets FROM z"""

QUERIES["capacity_warning"] = lambda spark, sf: _means(spark, sf).select("rep_id", mk.capacity_warning(
    c("visits"), c("reps"), c("slots"), F.lit(4), c("low")).alias("w")).select("rep_id", "w.visits_per_day", "w.supported_days")
SQL["capacity_warning"] = f"""WITH {DEMAND} SELECT rep_id, CASE WHEN visits / (3 * slots) < low THEN floor(visits / (3 * slots) * 10 + 0.5) / 10 END AS visits_per_day,
  CASE WHEN visits / (3 * slots) < low THEN CAST(greatest(1, floor(visits / (3 * 4 * low))) AS INTEGER) END AS supported_days FROM demand"""

QUERIES["suggested_reps"] = lambda spark, sf: rounded(mk.suggested_reps(act(spark, sf), REP), "spread_km")
SQL["suggested_reps"] = f"""WITH {OUTLETS}, s AS (SELECT market_id, rep_id, CAST(sum(vf) AS BIGINT) AS visits, count(*) AS outlets, min(latitude) AS a, max(latitude) AS b, min(longitude) AS x, max(longitude) AS y FROM outlets WHERE {ACT} GROUP BY ALL),
k AS (SELECT *, {hav('a', 'x', 'b', 'y')} AS km FROM s)
SELECT market_id, rep_id, visits, outlets, round(km, 6) AS spread_km, CAST(greatest(1, least(ceil(ceil(visits / (9.0::DOUBLE * (1 - least(0.3, km / 50)) * 5)) / 0.85::DOUBLE), ceil(outlets / 3))) AS INTEGER) AS reps FROM k"""

QUERIES["time_based_band"] = lambda spark, sf: mk.time_band(act(spark, sf), REP, 8.0, 30.0)
SQL["time_based_band"] = f"""WITH {OUTLETS}, t AS (SELECT market_id, rep_id, CAST(floor(480 / (least(avg(coalesce(time_per_visit, 30)), 30) + 10)) AS INTEGER) AS max_visits FROM outlets WHERE {ACT} GROUP BY ALL)
SELECT *, CAST(greatest(1, floor(max_visits * 0.8)) AS INTEGER) AS min_visits FROM t"""

# ------------------------------------------------------------------ days and scorecard
QUERIES["route_legs"] = lambda spark, sf: rounded(rm.route_legs(stops(spark, sf)), "leg_km").select("rep_id", "week", "day_of_week", "seq", "outlet_id", "leg_km")
SQL["route_legs"] = f"WITH {LEGS} SELECT rep_id, week, day_of_week, seq, outlet_id, round(leg_km, 6) AS leg_km FROM legs"
QUERIES["cumulative_km"] = lambda spark, sf: rounded(rm.cumulative_km(rm.route_legs(stops(spark, sf))), "at_km").select("rep_id", "week", "day_of_week", "seq", "at_km")
SQL["cumulative_km"] = f"WITH {LEGS} SELECT rep_id, week, day_of_week, seq, round(sum(leg_km) OVER (PARTITION BY rep_id, week, day_of_week ORDER BY seq), 6) AS at_km FROM legs"

QUERIES["scorecard_days"] = lambda spark, sf: rounded(days(spark, sf), "km", "drive_min", "total_min").select(
    *REP, "week", "day_of_week", "visits", "km", "call_min", "drive_min", "total_min", "long_legs")
SQL["scorecard_days"] = f"""WITH {LEGS}, ll AS (SELECT rep_id, week, day_of_week, count(*) FILTER (leg_km > 4) AS long_legs FROM legs GROUP BY ALL)
SELECT market_id, rep_id, week, day_of_week, visits, round(km, 6) AS km, CAST(call_min AS BIGINT) AS call_min, round(drive_min, 6) AS drive_min, round(total_min, 6) AS total_min, long_legs FROM days JOIN ll USING (rep_id, week, day_of_week)"""

QUERIES["month_baseline"] = lambda spark, sf: rounded(days(spark, sf), "total_min").select("rep_id", "day_group", "run", "visits", c("total_min").alias("minutes"))
SQL["month_baseline"] = f"WITH {LEGS} SELECT rep_id, day_group, run, visits, round(total_min, 6) AS minutes FROM days"

ROUTES = f"""{LEGS}, sets AS (SELECT market_id, rep_id, week, day_of_week, count(*) AS stops, string_agg(CAST(outlet_id AS VARCHAR), ',' ORDER BY outlet_id) AS k FROM stops GROUP BY ALL),
routes AS (SELECT market_id, rep_id, week, day_of_week, stops, count(*) OVER (PARTITION BY rep_id, k) AS times FROM sets QUALIFY row_number() OVER (PARTITION BY rep_id, k ORDER BY week, day_of_week) = 1)"""
QUERIES["distinct_routes"] = lambda spark, sf: rm.distinct_routes(stops(spark, sf))
SQL["distinct_routes"] = f"WITH {ROUTES} SELECT * FROM routes"

BAND = Band(4, 8)
KP = ["day_routes", "reps", "min_visits", "avg_visits", "max_visits", "in_band", "even_days", "km_per_day", "km_per_month", "workday_min", "longest_min", "overloaded_days", "typical_min", "balance", "outlets", "excluded", "held", "planned", "unplanned", "coverage"]
QUERIES["scorecard_kpis"] = lambda spark, sf: rounded(card.scorecard_kpis(days(spark, sf), td.outlets(spark, sf), stops(spark, sf), BAND), "avg_visits", "in_band", "even_days", "km_per_day", "km_per_month",
                                                      "workday_min", "longest_min", "typical_min", "balance", "coverage").select("market_id", *KP)
KPIS = f"""typ AS (SELECT market_id, list_sort(list(total_min))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS typical_min FROM days GROUP BY 1),
kp AS (SELECT market_id, count(*) AS day_routes, count(DISTINCT rep_id) AS reps, min(visits) AS min_visits, avg(visits) AS avg_visits, max(visits) AS max_visits,
  avg(CASE WHEN visits BETWEEN 4 AND 8 THEN 1.0 ELSE 0 END) AS in_band, avg(CASE WHEN abs(total_min - typical_min) <= 0.12::DOUBLE * typical_min THEN 1.0 ELSE 0 END) AS even_days,
  avg(km) AS km_per_day, sum(km) AS km_per_month, avg(total_min) AS workday_min, max(total_min) AS longest_min, count(*) FILTER (total_min > 495) AS overloaded_days, max(typical_min) AS typical_min
  FROM days JOIN typ USING (market_id) GROUP BY 1),
ld AS (SELECT market_id, rep_id, sum(visits) AS l FROM days GROUP BY ALL), ba AS (SELECT market_id, (max(l) - min(l)) / avg(l) AS balance FROM ld GROUP BY 1),
co AS (SELECT market_id, count(*) AS outlets, count(*) FILTER (excluded) AS excluded, count(*) FILTER (NOT excluded AND "offset") AS held,
  count(*) FILTER (outlet_id IN (SELECT outlet_id FROM stops)) AS planned FROM outlets GROUP BY 1),
kpis AS (SELECT *, greatest(0, outlets - excluded - held - planned) AS unplanned, planned / greatest(1, outlets - excluded - held) AS coverage FROM kp JOIN ba USING (market_id) JOIN co USING (market_id))"""
RND = ["avg_visits", "in_band", "even_days", "km_per_day", "km_per_month", "workday_min", "longest_min", "typical_min", "balance", "coverage"]
SQL["scorecard_kpis"] = f"WITH {LEGS}, {KPIS} SELECT market_id, " + ", ".join(f"round({k}, 6) AS {k}" if k in RND else k for k in KP) + " FROM kpis"


def _parts(spark, sf):
    """Scorecard inputs with shares that stand in for the slower geometric ones."""
    k = card.scorecard_kpis(days(spark, sf), td.outlets(spark, sf), stops(spark, sf), BAND)
    m = c("market_id")
    return (k.withColumn("route_overlap", m / 50.0).withColumn("territory_overlap", m / 100.0).withColumn("avoidable_share", m / 25.0)
            .withColumn("overload_share", c("overloaded_days") / c("day_routes")).withColumn("routes_with_long_hop", m))


QUERIES["plan_score"] = lambda spark, sf: card.plan_score(_parts(spark, sf)).select("market_id", "score", "grade")
SQL["plan_score"] = f"""WITH {LEGS}, {KPIS}, p AS (SELECT market_id, 20 * least(1, coverage) + 15 * in_band + CASE WHEN balance <= 0.05 THEN 15 WHEN balance <= 0.1 THEN 10 WHEN balance <= 0.2 THEN 5 ELSE 0 END
  + CASE WHEN market_id / 50 <= 0.01 THEN 15 WHEN market_id / 50 <= 0.03 THEN 10 WHEN market_id / 50 <= 0.08 THEN 5 ELSE 0 END
  + CASE WHEN market_id / 100 <= 0.01 THEN 10 WHEN market_id / 100 <= 0.03 THEN 7 WHEN market_id / 100 <= 0.08 THEN 3 ELSE 0 END
  + CASE WHEN market_id / 25 <= 0.05 THEN 10 WHEN market_id / 25 <= 0.15 THEN 6 WHEN market_id / 25 <= 0.3 THEN 3 ELSE 0 END
  + CASE WHEN overloaded_days = 0 THEN 15 WHEN overloaded_days / day_routes <= 0.05 THEN 10 WHEN overloaded_days / day_routes <= 0.15 THEN 5 ELSE 0 END AS pts FROM kpis)
SELECT market_id, CAST(floor(pts + 0.5) AS INTEGER) AS score, CASE WHEN floor(pts + 0.5) >= 90 THEN 'A' WHEN floor(pts + 0.5) >= 80 THEN 'B' WHEN floor(pts + 0.5) >= 65 THEN 'C' ELSE 'D' END AS grade FROM p"""

QUERIES["plan_checks"] = lambda spark, sf: card.plan_checks(_parts(spark, sf)).select("market_id", "id", "status")
SQL["plan_checks"] = f"""WITH {LEGS}, {KPIS}, s AS (SELECT *, unplanned / greatest(1, outlets - excluded - held) AS u FROM kpis)
SELECT market_id, 'coverage' AS id, CASE WHEN unplanned = 0 THEN 'pass' WHEN u > 0.02 THEN 'fail' ELSE 'warn' END AS status FROM s
UNION ALL SELECT market_id, 'held', CASE WHEN held > 0 THEN 'warn' ELSE 'pass' END FROM s
UNION ALL SELECT market_id, 'band', CASE WHEN 1 - in_band > 0.15 THEN 'warn' ELSE 'pass' END FROM s
UNION ALL SELECT market_id, 'balance', CASE WHEN balance <= 0.05 THEN 'pass' WHEN balance <= 0.12 THEN 'warn' ELSE 'fail' END FROM s
UNION ALL SELECT market_id, 'overlap', CASE WHEN market_id / 50 <= 0.01 THEN 'pass' WHEN market_id / 50 <= 0.03 THEN 'warn' ELSE 'fail' END FROM s
UNION ALL SELECT market_id, 'territories', CASE WHEN market_id / 100 <= 0.01 THEN 'pass' WHEN market_id / 100 <= 0.03 THEN 'warn' ELSE 'fail' END FROM s
UNION ALL SELECT market_id, 'hops', CASE WHEN market_id = 0 THEN 'pass' WHEN market_id / 25 <= 0.1 THEN 'warn' ELSE 'fail' END FROM s
UNION ALL SELECT market_id, 'workday', CASE WHEN overloaded_days = 0 THEN 'pass' WHEN overloaded_days / day_routes <= 0.05 THEN 'warn' ELSE 'fail' END FROM s"""

QUERIES["rep_scores"] = lambda spark, sf: card.rep_scores(days(spark, sf), stops(spark, sf))
SQL["rep_scores"] = f"""WITH {LEGS}, ou AS (SELECT market_id, rep_id, count(DISTINCT outlet_id) AS outlets, count(*) FILTER (leg_km > 4) AS long_legs FROM legs GROUP BY ALL)
SELECT market_id, rep_id, outlets, CAST(sum(visits) AS BIGINT) AS monthly_visits, min(visits) AS min_visits, floor(avg(visits) * 10 + 0.5) / 10 AS avg_visits, max(visits) AS max_visits, floor(sum(km) + 0.5) AS km_per_month,
  floor(avg(km) * 10 + 0.5) / 10 AS km_per_day, floor(avg(total_min) / 60 * 10 + 0.5) / 10 AS hours_per_day, floor(max(total_min) / 60 * 10 + 0.5) / 10 AS max_hours_per_day, long_legs
FROM days JOIN ou USING (market_id, rep_id) GROUP BY ALL"""

HOP = 2.0
_hop_days = lambda spark, sf: rm.scorecard_days(rm.route_legs(stops(spark, sf)), hop_km=HOP)
QUERIES["avoidable_long_hops"] = lambda spark, sf: card.avoidable_long_hops(_hop_days(spark, sf), stops(spark, sf), rm.distinct_routes(stops(spark, sf)), HOP)
SQL["avoidable_long_hops"] = f"""WITH RECURSIVE {ROUTES}, lo AS (SELECT market_id, rep_id, week, day_of_week, count(*) AS long_legs FROM legs JOIN routes USING (market_id, rep_id, week, day_of_week) WHERE leg_km > {HOP} GROUP BY ALL),
pt AS (SELECT s.* FROM stops s JOIN lo USING (rep_id, week, day_of_week)),
e AS (SELECT a.rep_id, a.week, a.day_of_week, a.outlet_id AS src, b.outlet_id AS dst FROM pt a JOIN pt b ON (a.rep_id, a.week, a.day_of_week) = (b.rep_id, b.week, b.day_of_week) AND {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= {HOP}),
walk(rep_id, week, day_of_week, src, label) AS (SELECT rep_id, week, day_of_week, outlet_id, outlet_id FROM pt UNION SELECT e.rep_id, e.week, e.day_of_week, e.dst, w.label FROM walk w JOIN e ON (e.rep_id, e.week, e.day_of_week, e.src) = (w.rep_id, w.week, w.day_of_week, w.src)),
lab AS (SELECT rep_id, week, day_of_week, src, min(label) AS l FROM walk GROUP BY ALL), pc AS (SELECT rep_id, week, day_of_week, count(DISTINCT l) AS pieces FROM lab GROUP BY ALL)
SELECT market_id, rep_id, week, day_of_week, long_legs, pieces, greatest(0, long_legs - (pieces - 1)) AS avoidable FROM lo JOIN pc USING (rep_id, week, day_of_week)"""

QUERIES["route_overlap_share"] = lambda spark, sf: rounded(card.route_overlap(stops(spark, sf), rm.distinct_routes(stops(spark, sf))), "share")
QUERIES["territory_overlap_share"] = lambda spark, sf: rounded(card.territory_overlap(stops(spark, sf)), "share")
QUERIES["full_scorecard"] = lambda spark, sf: card.full_scorecard(days(spark, sf), td.outlets(spark, sf), stops(spark, sf), BAND).select("market_id", "score", "grade", "reps", "distinct_routes", "avoidable_long_hops")

DIAM = f"""{LEGS}, dm AS (SELECT a.market_id, a.rep_id, a.week, a.day_of_week, max({hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}) AS diameter_km
  FROM stops a JOIN stops b USING (rep_id, week, day_of_week) GROUP BY ALL)"""
QUERIES["plan_kpis"] = lambda spark, sf: card.plan_kpis(days(spark, sf), td.outlets(spark, sf), stops(spark, sf), td.reps(spark, sf)).drop("reps")
SQL["plan_kpis"] = f"""WITH {DIAM}, x AS (SELECT d.*, CASE WHEN visits > 1 THEN diameter_km END AS dia FROM days d JOIN dm USING (rep_id, week, day_of_week)),
ld AS (SELECT market_id, rep_id, sum(vf) AS l FROM outlets WHERE NOT excluded GROUP BY ALL), av AS (SELECT market_id, avg(l) AS a FROM ld GROUP BY 1), dv AS (SELECT market_id, max(abs(l - a) / a) AS d FROM ld JOIN av USING (market_id) GROUP BY 1),
o AS (SELECT market_id, count(*) AS outlets, count(*) FILTER (NOT excluded) AS active, count(*) FILTER (excluded) AS excluded, count(*) FILTER (NOT excluded AND outlet_id IN (SELECT outlet_id FROM stops)) AS cov FROM outlets GROUP BY 1)
SELECT market_id, outlets, active, excluded, count(*) AS day_routes, floor(avg(visits) * 10 + 0.5) / 10 AS avg_visits_per_day, floor(avg(CASE WHEN visits BETWEEN 4 AND 6 THEN 1.0 ELSE 0 END) * 1000 + 0.5) / 10 AS days_in_band_pct,
  floor(max(dia) * 10 + 0.5) / 10 AS max_diameter_km, floor(avg(CASE WHEN dia > 15 THEN 1.0 WHEN dia IS NOT NULL THEN 0 END) * 1000 + 0.5) / 10 AS over_15km_pct, floor(sum(km) + 0.5) AS total_km,
  floor(median(visits) + 0.5) AS median_visits_per_day, floor(median(dia) * 100 + 0.5) / 100 AS median_diameter_km, floor(max(d) * 1000 + 0.5) / 10 AS workload_deviation_pct,
  floor(cov / active * 1000 + 0.5) / 10 AS coverage_pct, active - cov AS unscheduled FROM x JOIN o USING (market_id) JOIN dv USING (market_id) GROUP BY market_id, outlets, active, excluded, cov"""

QUERIES["day_spread_flag"] = lambda spark, sf: rounded(card.day_spread(stops(spark, sf)), "widest_km", "territory_km")
SQL["day_spread_flag"] = f"""WITH {DIAM}, t AS (SELECT a.rep_id, max({hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}) AS km FROM (SELECT DISTINCT rep_id, latitude, longitude FROM stops) a JOIN (SELECT DISTINCT rep_id, latitude, longitude FROM stops) b USING (rep_id) GROUP BY 1),
w AS (SELECT market_id, rep_id, max(diameter_km) AS widest_km FROM dm GROUP BY ALL)
SELECT market_id, rep_id, round(widest_km, 6) AS widest_km, round(km, 6) AS territory_km, km > 0.5 AND widest_km / km > 0.7 AND widest_km > 4 AS flag FROM w JOIN t USING (rep_id)"""

QUERIES["dashboard_metrics"] = lambda spark, sf: card.dashboard_metrics(td.outlets(spark, sf), td.reps(spark, sf), days(spark, sf))
SQL["dashboard_metrics"] = f"""WITH {LEGS}, {REPS}, r AS (SELECT market_id, count(*) AS active_reps, min(min_daily_visits) AS min_daily_visits, max(max_daily_visits) AS max_daily_visits FROM reps WHERE is_active GROUP BY 1),
o AS (SELECT market_id, count(*) AS outlets, sum(vf) FILTER (vf <> 3) AS mv FROM outlets GROUP BY 1), d AS (SELECT market_id, floor(avg(visits) + 0.5) AS avg_daily_visits, floor(sum(km) + 0.5) AS total_km FROM days GROUP BY 1),
ld AS (SELECT market_id, rep_id, sum(vf) AS l FROM outlets WHERE NOT excluded GROUP BY ALL), av AS (SELECT market_id, avg(l) AS a FROM ld GROUP BY 1), dv AS (SELECT market_id, max(abs(l - a) / a) AS dev FROM ld JOIN av USING (market_id) GROUP BY 1)
SELECT market_id, outlets, active_reps, min_daily_visits, max_daily_visits, avg_daily_visits, total_km, CAST(ceil(mv / 120.0) AS BIGINT) AS recommended_reps, greatest(0, floor(100 - dev * 100 + 0.5)) AS territory_balance
FROM o JOIN r USING (market_id) JOIN d USING (market_id) JOIN dv USING (market_id)"""

QUERIES["rep_balance_report"] = lambda spark, sf: rounded(card.rep_balance(act(spark, sf)), "target")
SQL["rep_balance_report"] = f"""WITH {OUTLETS}, l AS (SELECT market_id, rep_id, CAST(sum(vf) AS BIGINT) AS monthly_visits, count(*) AS unique_outlets FROM outlets WHERE {ACT} GROUP BY ALL),
t AS (SELECT *, avg(monthly_visits) OVER (PARTITION BY market_id) AS target FROM l), d AS (SELECT *, floor((monthly_visits - target) / target * 1000 + 0.5) / 10 AS deviation_pct FROM t)
SELECT market_id, rep_id, monthly_visits, unique_outlets, round(target, 6) AS target, deviation_pct, abs(deviation_pct) <= 10 AS within FROM d"""

QUERIES["territory_summary"] = lambda spark, sf: rounded(card.territory_summary(td.outlets(spark, sf), days(spark, sf)), "km")
SQL["territory_summary"] = f"""WITH {LEGS}, d AS (SELECT rep_id, count(*) AS route_days, sum(km) AS km FROM days GROUP BY 1),
o AS (SELECT market_id, rep_id, count(*) AS outlets, """ + ", ".join(f"count(*) FILTER (vf = {v}) AS vf{v}" for v in (1, 2, 3, 4)) + """, sum(vf) AS monthly_visits FROM outlets GROUP BY ALL)
SELECT market_id, rep_id, """ + ", ".join(f"CAST(sum({x}) AS BIGINT) AS {x}" for x in ("outlets", "vf1", "vf2", "vf3", "vf4", "monthly_visits")) + """, CAST(sum(coalesce(route_days, 0)) AS BIGINT) AS route_days,
  round(sum(coalesce(km, 0)), 6) AS km FROM o LEFT JOIN d USING (rep_id) GROUP BY GROUPING SETS ((market_id, rep_id), (market_id))"""

QUERIES["route_km_projection"] = lambda spark, sf: rounded(card.route_km_projection(days(spark, sf), td.reps(spark, sf)), "weekly_km", "daily_km", "monthly_km", "annual_km")
SQL["route_km_projection"] = f"""WITH {LEGS}, w AS (SELECT market_id, rep_id, week, sum(km) AS km FROM days GROUP BY ALL)
SELECT market_id, rep_id, round(avg(km), 6) AS weekly_km, round(avg(km) / 5, 6) AS daily_km, round(sum(km), 6) AS monthly_km, round(sum(km) * 12, 6) AS annual_km FROM w GROUP BY ALL"""

QUERIES["capacity_check"] = lambda spark, sf: card.capacity_check(td.outlets(spark, sf), td.reps(spark, sf), 20)
SQL["capacity_check"] = f"""WITH {OUTLETS} SELECT rep_id, CAST(sum(vf) AS BIGINT) AS monthly_visits, 6 AS max_daily_visits, 120 AS capacity, sum(vf) > 120 AS over FROM outlets WHERE NOT excluded GROUP BY 1"""

QUERIES["month_issues"] = lambda spark, sf: rounded(card.month_issues(days(spark, sf), BAND), "issues")
SQL["month_issues"] = f"""WITH {LEGS} SELECT market_id, rep_id, round(sum(power(greatest(0, total_min - 495) / 15, 2) + power(greatest(0, 4 - visits, visits - 8), 2)), 6) AS issues FROM days GROUP BY ALL"""

QUERIES["spread_tour_estimate"] = lambda spark, sf: rounded(rm.spread_tour(stops(spark, sf), ["rep_id", "week", "day_of_week"]), "tour_km")
SQL["spread_tour_estimate"] = f"""WITH {STOPS}, m AS (SELECT rep_id, week, day_of_week, avg(latitude) AS a, avg(longitude) AS o, count(*) AS n FROM stops GROUP BY ALL)
SELECT rep_id, week, day_of_week, n, round(CASE WHEN n < 2 THEN 0 ELSE 0.7124::DOUBLE * sqrt(pi() * sum(power((longitude - o) * 111.32::DOUBLE * cos(radians(a)), 2) + power((latitude - a) * 110.57::DOUBLE, 2))) END, 6) AS tour_km
FROM stops JOIN m USING (rep_id, week, day_of_week) GROUP BY rep_id, week, day_of_week, n"""

# ------------------------------------------------------------------ zones
ZONED = f"""{OUTLETS}, z AS (SELECT *, CAST(floor(latitude / 0.02::DOUBLE) AS BIGINT) * 100000 + CAST(floor(longitude / 0.02::DOUBLE) AS BIGINT) AS zone_id FROM outlets WHERE {ACT})"""


def zoned(spark, sf, frame=None):
    frame = act(spark, sf) if frame is None else frame
    return frame.withColumn("zone_id", geo.cell(c("latitude"), 0.02) * 100000 + geo.cell(c("longitude"), 0.02))


ZM = f"""{ZONED}, b AS (SELECT market_id, zone_id, avg(latitude) AS lat, avg(longitude) AS lng, count(*) AS outlets, CAST(greatest(1, sum(vf)) AS BIGINT) AS monthly_visits, sum(value) AS total_value FROM z GROUP BY ALL),
ra AS (SELECT z.market_id, z.zone_id, max({hav('latitude', 'longitude', 'lat', 'lng')}) AS radius_km FROM z JOIN b USING (market_id, zone_id) GROUP BY ALL),
iso AS (SELECT x.market_id, x.zone_id, min({hav('x.lat', 'x.lng', 'y.lat', 'y.lng')}) AS isolation_km FROM b x JOIN b y ON x.market_id = y.market_id AND x.zone_id <> y.zone_id GROUP BY ALL),
zm AS (SELECT * FROM b JOIN ra USING (market_id, zone_id) LEFT JOIN iso USING (market_id, zone_id))"""
QUERIES["zone_metrics"] = lambda spark, sf: rounded(zn.zone_metrics(zoned(spark, sf), M), "lat", "lng", "radius_km", "isolation_km", "total_value")
SQL["zone_metrics"] = f"WITH {ZM} SELECT market_id, zone_id, round(lat, 6) AS lat, round(lng, 6) AS lng, outlets, monthly_visits, round(total_value, 6) AS total_value, round(radius_km, 6) AS radius_km, round(isolation_km, 6) AS isolation_km FROM zm"

for _mode in ("isolation", "value"):
    QUERIES[f"coverage_worth_{_mode}"] = lambda spark, sf, m=_mode: rounded(zn.coverage_worth(zn.zone_metrics(zoned(spark, sf), M), M, m), "cost_km").select("market_id", "zone_id", "cost_km", "place")
WORTH = f"""{ZM}, cw AS (SELECT *, (2 * isolation_km + 2 * radius_km) / monthly_visits AS cost_km, coalesce(total_value, 0) / greatest(0.1, 2 * isolation_km + 2 * radius_km) AS vk FROM zm),
md AS (SELECT market_id, greatest(0.1, median(cost_km)) AS med, greatest(0.001, median(vk)) AS mv, count(*) AS n FROM cw GROUP BY 1)"""
for _mode, _cond in (("isolation", "cost_km > greatest(3 * med, 2)"), ("value", "vk < mv / 3 AND cost_km > 2 * med")):
    SQL[f"coverage_worth_{_mode}"] = f"""WITH {WORTH} SELECT market_id, zone_id, round(cost_km, 6) AS cost_km, CAST(row_number() OVER (PARTITION BY market_id ORDER BY cost_km DESC, zone_id) AS INTEGER) AS place
FROM cw JOIN md USING (market_id) WHERE n >= 3 AND {_cond} QUALIFY place <= 15"""

SIL = f"""p AS (SELECT a.market_id, a.rep_id, a.outlet_id, a.day_group AS ac, b.day_group AS bc, avg({hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}) AS m
  FROM act a JOIN act b ON a.rep_id = b.rep_id AND a.outlet_id <> b.outlet_id GROUP BY ALL),
ab AS (SELECT market_id, rep_id, outlet_id, coalesce(max(m) FILTER (ac = bc), 0) AS a, min(m) FILTER (ac <> bc) AS b FROM p GROUP BY ALL),
sil AS (SELECT market_id, rep_id, avg(CASE WHEN b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ab GROUP BY ALL)"""
QUERIES["silhouette"] = lambda spark, sf: rounded(zn.silhouette(act(spark, sf), REP, "day_group"), "silhouette")
SQL["silhouette"] = f"WITH {OUTLETS}, act AS (SELECT * FROM outlets WHERE {ACT}), {SIL} SELECT market_id, rep_id, round(silhouette, 6) AS silhouette FROM sil"
QUERIES["cluster_quality"] = lambda spark, sf: rounded(zn.cluster_quality(act(spark, sf), REP, "day_group"), "compactness", "imbalance", "silhouette", "score")
SQL["cluster_quality"] = f"""WITH {OUTLETS}, act AS (SELECT * FROM outlets WHERE {ACT}), {SIL}, g AS (SELECT rep_id, day_group, avg(latitude) AS la, avg(longitude) AS lo, sum(vf) AS w FROM act GROUP BY ALL),
co AS (SELECT act.market_id, act.rep_id, sum(power({hav('latitude', 'longitude', 'la', 'lo')}, 2)) AS c FROM act JOIN g USING (rep_id, day_group) GROUP BY ALL),
av AS (SELECT rep_id, avg(w) AS m FROM g GROUP BY 1), im AS (SELECT rep_id, sum(power((w - m) / m, 2)) AS i FROM g JOIN av USING (rep_id) GROUP BY 1)
SELECT market_id, rep_id, round(c, 6) AS compactness, round(i, 6) AS imbalance, round(silhouette, 6) AS silhouette, round(c + 100 * i + 50 * (1 - silhouette), 6) AS score FROM co JOIN im USING (rep_id) JOIN sil USING (market_id, rep_id)"""
QUERIES["silhouette_squared"] = lambda spark, sf: rounded(zn.silhouette_squared(act(spark, sf), M, "rep_id"), "silhouette")
SQL["silhouette_squared"] = f"""WITH {OUTLETS}, act AS (SELECT * FROM outlets WHERE {ACT}), ce AS (SELECT market_id, avg(latitude) AS la, avg(longitude) AS lo FROM act GROUP BY 1),
q AS (SELECT market_id, rep_id, outlet_id, (longitude - lo) * 111.32::DOUBLE * cos(radians(la)) AS x, (latitude - la) * 110.57::DOUBLE AS y FROM act JOIN ce USING (market_id)),
p AS (SELECT a.market_id, a.outlet_id, a.rep_id AS ac, b.rep_id AS bc, sum(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS s, count(*) AS n FROM q a JOIN q b USING (market_id) GROUP BY ALL),
ab AS (SELECT market_id, outlet_id, max(s / greatest(1, n - 1)) FILTER (ac = bc) AS a, min(s / n) FILTER (ac <> bc) AS b FROM p GROUP BY ALL)
SELECT market_id, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM ab GROUP BY 1"""

QUERIES["zone_of_route"] = lambda spark, sf: card.zone_of_route(zoned(spark, sf, stops(spark, sf)))
SQL["zone_of_route"] = f"""WITH {STOPS}, n AS (SELECT market_id, rep_id, week, day_of_week, CAST(floor(latitude / 0.02::DOUBLE) AS BIGINT) * 100000 + CAST(floor(longitude / 0.02::DOUBLE) AS BIGINT) AS zone_id, count(*) AS stops FROM stops GROUP BY ALL)
SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY rep_id, week, day_of_week ORDER BY stops DESC, zone_id) = 1"""

# ------------------------------------------------------------------ sorts and scenarios
QUERIES["natural_sort"] = lambda spark, sf: td.reps(spark, sf).orderBy(*natural_key(c("rep_name"))).select(
    "rep_name", natural_key(c("rep_name"))[0].alias("head"), natural_key(c("rep_name"))[1].alias("number"))
SQL["natural_sort"] = f"WITH {OUTLETS}, {REPS} SELECT rep_name, 'rep ' AS head, rep_id AS number FROM reps"


def _scenarios(spark, sf):
    return td.table(spark, sf, "events").select(
        c("event_id").alias("scenario_id"), (c("user_id") % 40).alias("upload"), c("ts").alias("created_at"),
        F.when(c("event_type") != "error", six(c("value"))).alias("score"), (c("event_id") * 7919 % 1000).alias("total_km"))


SCEN = "sc AS (SELECT event_id AS scenario_id, user_id % 40 AS upload, ts AS created_at, CASE WHEN event_type <> 'error' THEN round(value, 6) END AS score, event_id * 7919 % 1000 AS total_km FROM events)"
QUERIES["previous_scenario"] = lambda spark, sf: rounded(sc.previous_scenario(_scenarios(spark, sf), ["score", "total_km"]), "score_delta").select("scenario_id", "previous_id", "score_delta", "total_km_delta")
SQL["previous_scenario"] = f"""WITH {SCEN} SELECT scenario_id, lag(scenario_id) OVER w AS previous_id, round(score - lag(score) OVER w, 6) AS score_delta, total_km - lag(total_km) OVER w AS total_km_delta
FROM sc WHERE score IS NOT NULL WINDOW w AS (PARTITION BY upload ORDER BY created_at, scenario_id)"""
QUERIES["keep_last_10_scenarios"] = lambda spark, sf: sc.keep_last(_scenarios(spark, sf)).select("upload", "scenario_id")
SQL["keep_last_10_scenarios"] = f"WITH {SCEN} SELECT upload, scenario_id FROM sc QUALIFY row_number() OVER (PARTITION BY upload ORDER BY created_at DESC, scenario_id DESC) <= 10"
QUERIES["scenario_compare"] = lambda spark, sf: sc.compare_scenarios(_scenarios(spark, sf), {"score": "high", "total_km": "low"})
SQL["scenario_compare"] = f"""WITH {SCEN},
l AS (SELECT upload, scenario_id, 'score' AS kpi, score AS value FROM sc UNION ALL SELECT upload, scenario_id, 'total_km', CAST(total_km AS DOUBLE) FROM sc)
SELECT upload, scenario_id, kpi, value, value = CASE WHEN kpi = 'score' THEN max(value) OVER (PARTITION BY upload, kpi) ELSE min(value) OVER (PARTITION BY upload, kpi) END AS is_best FROM l"""


def _snapshot(spark, sf):
    return td.outlets(spark, sf).filter("outlet_id % 4 <> 0").select("outlet_id", (c("rep_id") + 1).alias("rep_id"), (c("outlet_id") % 9 == 1).alias("excluded"))


QUERIES["scenario_apply"] = lambda spark, sf: sc.apply_scenario(td.outlets(spark, sf), _snapshot(spark, sf)).select("outlet_id", "rep_id", "excluded")
SQL["scenario_apply"] = f"""WITH {OUTLETS} SELECT outlet_id, CASE WHEN outlet_id % 4 <> 0 THEN rep_id + 1 ELSE rep_id END AS rep_id, CASE WHEN outlet_id % 4 <> 0 THEN outlet_id % 9 = 1 ELSE excluded END AS excluded FROM outlets"""

# ------------------------------------------------------------------ sets
QUERIES["planned_and_unplanned"] = lambda spark, sf: card.unplanned_outlets(td.outlets(spark, sf), stops(spark, sf)).select("market_id", "outlet_id")
SQL["planned_and_unplanned"] = f"WITH {STOPS} SELECT market_id, outlet_id FROM outlets WHERE {ACT} AND outlet_id NOT IN (SELECT outlet_id FROM stops)"


def _moves(spark, sf):
    now = act(spark, sf).select("rep_id", "outlet_id").filter("outlet_id % 13 <> 0")
    was = td.memberships(spark, sf).select(F.when(c("outlet_id") % 10 == 0, c("rep_id") + 1).otherwise(c("rep_id")).alias("rep_id"), "outlet_id")
    return card.membership_changes(now, was)


QUERIES["kept_left_arrived"] = _moves
SQL["kept_left_arrived"] = f"""WITH {STOPS}, n AS (SELECT rep_id, outlet_id FROM outlets WHERE {ACT} AND outlet_id % 13 <> 0),
w AS (SELECT CASE WHEN outlet_id % 10 = 0 THEN rep_id + 1 ELSE rep_id END AS rep_id, outlet_id FROM members)
SELECT *, 'kept' AS state FROM (FROM n INTERSECT FROM w) UNION ALL SELECT *, 'left' FROM (FROM w EXCEPT FROM n) UNION ALL SELECT *, 'arrived' FROM (FROM n EXCEPT FROM w)"""


QUERIES["shared_outlets"] = lambda spark, sf: card.shared_outlets(stops(spark, sf))
SQL["shared_outlets"] = f"""WITH {STOPS} SELECT a.rep_id, a.week, a.day_of_week, count(*) AS shared FROM stops a JOIN stops b ON a.rep_id = b.rep_id AND b.week = a.week + 1 AND a.day_of_week = b.day_of_week AND a.outlet_id = b.outlet_id GROUP BY ALL"""
