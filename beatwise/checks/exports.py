"""Exports and plan tables and their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from beatwise.checks.calendar import TEMPLATE, _dates, _roles
from beatwise.checks.sql import LEGS, OUTLETS, REPS, STOPS
from beatwise.functions.numbers import six
from beatwise.sources import exports as ex
from beatwise.sources import tables
from beatwise.sources import testdata as td

QUERIES, SQL = {}, {}
c = F.col
WEEK = [1, 2, 3, 4, 5]
DATE = "CAST(DATE '2026-10-05' + (week - 1) * 7 + day_of_week - 1 AS VARCHAR)"
DAY = "(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday'])[day_of_week]"
text_date = lambda df: df.withColumn("date", c("date").cast("string"))
zoned = lambda spark, sf: td.outlets(spark, sf).withColumn("zone_id", c("rep_id") % 5)

QUERIES["schedule_export"] = lambda spark, sf: text_date(ex.schedule_export(td.stops(spark, sf), zoned(spark, sf), _dates(spark, sf), WEEK))
SQL["schedule_export"] = f"""WITH {STOPS} SELECT s.rep_id, {DATE} AS date, {DAY} AS day, week, seq, outlet_id, name, code, 'VF' || s.vf AS frequency, o.rep_id % 5 AS zone_id
FROM stops s JOIN outlets o USING (outlet_id)"""


def _territory(spark, sf, part):
    from beatwise.operators.route_metrics import route_legs, scorecard_days
    days = scorecard_days(route_legs(td.stops(spark, sf)))
    return ex.territory_export(td.outlets(spark, sf), td.stops(spark, sf), days, WEEK)[part]


for _part in ("outlets", "unassigned", "held"):
    QUERIES[f"territory_export_{_part}"] = lambda spark, sf, p=_part: _territory(spark, sf, p)
FIRST = f"""{STOPS}, v AS (SELECT outlet_id, row_number() OVER (PARTITION BY rep_id ORDER BY week, day_of_week, seq) AS n FROM stops), f AS (SELECT outlet_id, min(n) AS visit_no FROM v GROUP BY 1)"""
SQL["territory_export_outlets"] = f"""WITH {FIRST} SELECT market_id, rep_id, visit_no, outlet_id, name, code, vf FROM outlets JOIN f USING (outlet_id) WHERE NOT excluded AND NOT "offset" """
SQL["territory_export_unassigned"] = f"""WITH {STOPS} SELECT market_id, rep_id, outlet_id, name FROM outlets WHERE NOT excluded AND NOT "offset" AND outlet_id NOT IN (SELECT outlet_id FROM stops)"""
SQL["territory_export_held"] = f"""WITH {OUTLETS} SELECT market_id, outlet_id, name, CASE WHEN excluded THEN 'Excluded' ELSE 'Held for review' END AS status FROM outlets WHERE excluded OR "offset" """

QUERIES["cluster_export"] = lambda spark, sf: ex.cluster_export(zoned(spark, sf), ["Zone 1", "Zone 4", "2"])["outlets"]
SQL["cluster_export"] = f"""WITH {OUTLETS} SELECT market_id, rep_id % 5 AS zone_id, 'Zone ' || (rep_id % 5 + 1) AS zone, outlet_id, name, latitude, longitude, 'VF' || vf AS frequency, rep_id FROM outlets WHERE rep_id % 5 IN (0, 3, 2)"""
QUERIES["cluster_summary"] = lambda spark, sf: ex.cluster_export(zoned(spark, sf))["summary"].withColumn("lat", six(c("lat"))).withColumn("lng", six(c("lng")))
SQL["cluster_summary"] = f"""WITH {OUTLETS} SELECT market_id, rep_id % 5 AS zone_id, count(*) AS outlets, CAST(sum(vf) AS BIGINT) AS monthly_visits, """ + ", ".join(
    f"count(*) FILTER (vf = {v}) AS vf{v}" for v in (1, 2, 3, 4)) + ", round(avg(latitude), 6) AS lat, round(avg(longitude), 6) AS lng FROM outlets GROUP BY 1, 2"

QUERIES["role_schedule_export"] = lambda spark, sf: text_date(ex.role_schedule_export(td.stops(spark, sf), _roles(spark, sf), _dates(spark, sf), WEEK))
SQL["role_schedule_export"] = f"""WITH {STOPS}, {TEMPLATE}, k AS (SELECT rep_id, week, day_of_week, count(*) AS stops FROM stops GROUP BY ALL),
u AS (SELECT rep_id, 'rep' AS role, 'Sales Rep' AS role_name, week, day_of_week, day_of_week AS original_day_of_week, stops FROM k
UNION ALL SELECT rep_id, role, role_name, CAST((week - 1 + (day_of_week - 1 + offset_days) // 5) % 4 + 1 AS INTEGER), CAST((day_of_week - 1 + offset_days) % 5 + 1 AS INTEGER), day_of_week, stops FROM k, t WHERE role <> 'rep' AND rep_id % 3 <> 1)
SELECT *, {DATE} AS date, {DAY} AS day FROM u"""

QUERIES["route_export"] = lambda spark, sf: ex.route_export(td.stops(spark, sf), td.outlets(spark, sf), [0, 3, 7], [1, 2, 5])
SQL["route_export"] = f"""WITH {LEGS} SELECT l.market_id, l.rep_id, week, day_of_week, seq, outlet_id, l.latitude, l.longitude, floor(leg_km * 100 + 0.5) / 100 AS km, name, 'VF' || l.vf AS frequency, {DAY} AS day
FROM legs l JOIN outlets o USING (outlet_id) WHERE l.rep_id IN (0, 3, 7) AND day_of_week IN (1, 2, 5) AND week = 1"""

for _part in ("stops", "rep_days", "outlets"):
    QUERIES[f"journey_plan_{_part}"] = lambda spark, sf, p=_part: (lambda d: text_date(d) if "date" in d.columns else d)(
        ex.journey_plan(td.stops(spark, sf), td.outlets(spark, sf), _dates(spark, sf), WEEK)[p])
LINK = "'https://www.google.com/maps/search/?api=1&query=' || (o.lat_e6 // 1000000) || '.' || lpad(CAST(o.lat_e6 % 1000000 AS VARCHAR), 6, '0') || ',' || (o.lng_e6 // 1000000) || '.' || lpad(CAST(o.lng_e6 % 1000000 AS VARCHAR), 6, '0')"
SQL["journey_plan_stops"] = f"""WITH {LEGS} SELECT l.market_id, l.rep_id, {DATE} AS date, {DAY} AS day, week, seq, outlet_id, name, code, channel, l.vf AS visits_a_month, l.call_minutes,
  CASE WHEN seq > 1 THEN floor(leg_km * 10 + 0.5) / 10 END AS km_from_previous, l.latitude, l.longitude, {LINK} AS map FROM legs l JOIN outlets o USING (outlet_id)"""
SQL["journey_plan_rep_days"] = f"""WITH {LEGS} SELECT market_id, rep_id, {DATE} AS date, {DAY} AS day, week, visits, floor(km * 10 + 0.5) / 10 AS km, floor(call_min / 60 * 10 + 0.5) / 10 AS call_hours,
  floor(drive_min / 60 * 10 + 0.5) / 10 AS driving_hours, floor(total_min / 60 * 10 + 0.5) / 10 AS workday_hours FROM days"""
SQL["journey_plan_outlets"] = f"""WITH {STOPS}, s AS (SELECT outlet_id, string_agg(DISTINCT day_of_week || '-' || week, ' ' ORDER BY day_of_week || '-' || week) AS d FROM stops GROUP BY 1)
SELECT market_id, outlet_id, name, code, rep_id, vf, CASE WHEN excluded THEN 'Excluded' WHEN "offset" THEN 'Held for review' WHEN d IS NOT NULL THEN 'Planned' ELSE 'Not planned' END AS status, coalesce(d, '') AS visit_days
FROM outlets LEFT JOIN s USING (outlet_id)"""

QUERIES["edited_universe"] = lambda spark, sf: ex.edited_universe(td.outlets(spark, sf), td.reps(spark, sf))
SQL["edited_universe"] = f"""WITH {OUTLETS}, {REPS} SELECT o.market_id, coalesce(code, '') AS "Outlet Code", name AS "Outlet Name", latitude AS "Latitude", longitude AS "Longitude", vf AS "VF", channel AS "Channel",
  time_per_visit AS "Time Per Visit", value AS "Value", rep_name AS "Assigned Rep", CASE WHEN excluded THEN 'Excluded' WHEN "offset" THEN 'Held for review' ELSE 'Active' END AS "Plan Status" FROM outlets o JOIN reps USING (rep_id)"""

QUERIES["cells_round_trip"] = lambda spark, sf: tables.stops_of(tables.cells_of(td.stops(spark, sf)))
SQL["cells_round_trip"] = f"WITH {STOPS} SELECT market_id, rep_id, week, day_of_week, seq, outlet_id FROM stops"
