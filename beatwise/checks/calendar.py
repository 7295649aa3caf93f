"""Calendar and visit expansion and their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from beatwise.checks.sql import LEGS, OUTLETS, REPS, STOPS
from beatwise.functions import cycle
from beatwise.functions.numbers import six
from beatwise.operators import route_metrics as rm
from beatwise.operators import schedule as sch
from beatwise.params import ROLE_PRESETS, PlanSettings
from beatwise.sources import testdata as td

QUERIES, SQL = {}, {}
c = F.col
WEEK6 = [6, 7, 1, 2, 3, 4]
joined = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")


def _shapes(spark, sf):
    k = c("outlet_id")
    return td.outlets(spark, sf).select(k, cycle.cycle_shape((k % 7).cast("int"), (k % 40).cast("int")).alias("s")).select(k, "s.*")


QUERIES["cycle_shape"] = _shapes
SQL["cycle_shape"] = f"""WITH {OUTLETS}, a AS (SELECT outlet_id, CASE WHEN outlet_id % 40 > 0 THEN outlet_id % 40 ELSE 4 * CASE WHEN outlet_id % 7 = 0 THEN 5 ELSE outlet_id % 7 END END AS p FROM outlets),
b AS (SELECT outlet_id, p, CASE WHEN p % 4 = 0 THEN [p, 4] WHEN p % 2 = 0 THEN [p, 2] WHEN p > 2 AND (p - 1) % 4 = 0 THEN [p - 1, 4]
  WHEN p > 2 AND (p - 1) % 2 = 0 THEN [p - 1, 2] WHEN p % 3 = 0 THEN [p, 3] WHEN p % 5 = 0 THEN [p, 5]
  WHEN p > 2 AND (p - 1) % 3 = 0 THEN [p - 1, 3] WHEN p > 2 AND (p - 1) % 5 = 0 THEN [p - 1, 5] ELSE [greatest(2, p - p % 2), 2] END AS x FROM a)
SELECT outlet_id, CAST(x[1] AS INTEGER) AS cycle_days, CAST(x[2] AS INTEGER) AS repeats,
  CAST(greatest(1, floor(x[1] / x[2] + 0.5)) AS INTEGER) AS day_groups, CAST(greatest(x[1], p) AS INTEGER) AS plan_days FROM b"""

_months = lambda spark, sf: td.table(spark, sf, "orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month_start")).distinct()
QUERIES["month_plan_dates"] = lambda spark, sf: sch.month_plan_dates(_months(spark, sf), WEEK6, "wholeWeeks").select(
    c("month_start").cast("string").alias("month_start"), c("date").cast("string").alias("date"), "dow")
SQL["month_plan_dates"] = """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS ms FROM orders),
d AS (SELECT ms, CAST(unnest(generate_series(ms, last_day(ms), INTERVAL 1 DAY)) AS DATE) AS date FROM m),
b AS (SELECT ms, min(date) FILTER (isodow(date) = 6) AS s, max(date) FILTER (isodow(date) = 4) AS e FROM d GROUP BY ms)
SELECT CAST(ms AS VARCHAR) AS month_start, CAST(date AS VARCHAR) AS date, CAST(isodow(date) AS INTEGER) AS dow
FROM d JOIN b USING (ms) WHERE isodow(date) IN (6, 7, 1, 2, 3, 4) AND date BETWEEN s AND e"""


def _positions(spark, sf):
    return td.visits(td.memberships(spark, sf)).select("outlet_id", "run", "day_group")


QUERIES["calendar_cell"] = lambda spark, sf: _positions(spark, sf).select("outlet_id", "run", cycle.calendar_cell(
    c("run"), c("day_group") + 1, F.lit(13), WEEK6, 2).alias("x")).select("outlet_id", "run", "x.*")
SQL["calendar_cell"] = f"""WITH {STOPS} SELECT outlet_id, run, CAST((run - 1) * 13 + day_group + 1 AS INTEGER) AS cycle_day,
  CAST((2 + (run - 1) * 13 + day_group) // 6 + 1 AS INTEGER) AS week, ([6, 7, 1, 2, 3, 4])[(2 + (run - 1) * 13 + day_group) % 6 + 1] AS day_of_week FROM visits"""

QUERIES["cycle_cell_of"] = lambda spark, sf: _positions(spark, sf).withColumn(
    "at", cycle.calendar_cell(c("run"), c("day_group") + 1, F.lit(13), WEEK6, 2)).withColumn(
    "back", cycle.cycle_cell_of(c("at.week"), (c("at.day_of_week") + c("outlet_id") % 2).cast("int"), WEEK6, 13, 26, 2)).select(
    "outlet_id", "run", c("back.day_group").alias("day_group"), c("back.run").alias("back_run"))
SQL["cycle_cell_of"] = f"""WITH {STOPS}, a AS (SELECT outlet_id, run, (2 + (run - 1) * 13 + day_group) // 6 + 1 AS w,
  ([6, 7, 1, 2, 3, 4])[(2 + (run - 1) * 13 + day_group) % 6 + 1] + outlet_id % 2 AS d FROM visits),
b AS (SELECT *, (w - 1) * 6 + list_position([6, 7, 1, 2, 3, 4], CAST(d AS INTEGER)) - 1 - 2 AS n FROM a)
SELECT outlet_id, run, CAST(CASE WHEN n >= 0 AND n < 26 THEN n % 13 END AS INTEGER) AS day_group,
  CAST(CASE WHEN n >= 0 AND n < 26 THEN n // 13 + 1 END AS INTEGER) AS back_run FROM b"""

_starts = lambda spark, sf: td.outlets(spark, sf).select("outlet_id", F.when(c("outlet_id") % 2 == 0, F.date_add(F.lit("2026-10-01").cast("date"), (c("outlet_id") % 30).cast("int"))).alias("plan_start"),
                                                         F.date_add(F.lit("2026-09-10").cast("date"), (c("outlet_id") % 17).cast("int")).alias("now"))
QUERIES["upcoming_working_dates"] = lambda spark, sf: sch.upcoming_dates(_starts(spark, sf), 8, WEEK6).withColumn("date", c("date").cast("string"))
SQL["upcoming_working_dates"] = f"""WITH {OUTLETS}, s AS (SELECT outlet_id, CASE WHEN outlet_id % 2 = 0 THEN DATE '2026-10-01' + CAST(outlet_id % 30 AS INTEGER)
  ELSE DATE '2026-09-10' + CAST(outlet_id % 17 AS INTEGER) + 1 END AS b FROM outlets),
d AS (SELECT outlet_id, b + CAST(unnest(range(0, 70)) AS INTEGER) AS date FROM s),
w AS (SELECT outlet_id, CAST(row_number() OVER (PARTITION BY outlet_id ORDER BY date) - 1 AS INTEGER) AS ordinal, CAST(date AS VARCHAR) AS date FROM d WHERE isodow(date) <> 5)
SELECT * FROM w WHERE ordinal < 8"""


def _dates(spark, sf, keys=("rep_id",)):
    starts = td.reps(spark, sf).select(*keys, F.lit("2026-10-03").cast("date").alias("plan_start"), F.lit("2026-09-01").cast("date").alias("now"))
    return sch.upcoming_dates(starts, 30, [1, 2, 3, 4, 5])


QUERIES["date_of_cell"] = lambda spark, sf: sch.date_of_cell(td.stops(spark, sf).select("rep_id", "week", "day_of_week").distinct(), _dates(spark, sf),
                                                             [1, 2, 3, 4, 5], ["rep_id"]).withColumn("date", c("date").cast("string"))
SQL["date_of_cell"] = f"""WITH {STOPS} SELECT DISTINCT rep_id, week, day_of_week, CAST(DATE '2026-10-05' + (week - 1) * 7 + day_of_week - 1 AS VARCHAR) AS date FROM stops"""

QUERIES["memberships_for"] = lambda spark, sf: td.outlets(spark, sf).select("outlet_id", joined(cycle.memberships_for(c("vf"), F.lit(2))).alias("on_two"),
                                                                            joined(cycle.memberships_for(c("vf"), F.lit(4))).alias("on_four"))
SQL["memberships_for"] = f"""WITH {OUTLETS} SELECT outlet_id, CASE vf WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '2,1' ELSE '2,2' END AS on_two, CAST(vf AS VARCHAR) AS on_four FROM outlets"""

QUERIES["buckets_for_frequency"] = lambda spark, sf: td.outlets(spark, sf).select("outlet_id", *[cycle.buckets_for_frequency(c("vf"), F.lit(r)).alias(f"runs_{r}") for r in (2, 3, 4, 5)])
SQL["buckets_for_frequency"] = f"""WITH {OUTLETS} SELECT outlet_id, """ + ", ".join(
    f"CAST(CASE WHEN {r} % least(vf, {r}) = 0 THEN {r} // least(vf, {r}) ELSE {r} END AS INTEGER) AS runs_{r}" for r in (2, 3, 4, 5)) + " FROM outlets"

QUERIES["repeats_for_bucket"] = lambda spark, sf: td.outlets(spark, sf).select("outlet_id", *[joined(cycle.runs_of_bucket(c("vf"), F.lit(r), (c("outlet_id") % 2).cast("int"))).alias(f"runs_{r}") for r in (2, 3, 4, 5)])
SQL["repeats_for_bucket"] = f"""WITH {OUTLETS} SELECT outlet_id, """ + ", ".join(
    f"array_to_string(list_sort(list_distinct(list_transform(range(0, least(vf, {r})), lambda j: (outlet_id % 2 + (j * {r}) // least(vf, {r})) % {r} + 1))), ',') AS runs_{r}" for r in (2, 3, 4, 5)) + " FROM outlets"


def _members(spark, sf):
    return td.memberships(spark, sf).select("market_id", "rep_id", "outlet_id", "day_group", c("vf").alias("visits"), "vf", "bucket")


QUERIES["expand_visits"] = lambda spark, sf: sch.expand_visits(_members(spark, sf), PlanSettings(), 22).select(
    "outlet_id", "run", "bonus", "cycle_day", "week", "day_of_week")
SQL["expand_visits"] = f"""WITH {STOPS} SELECT outlet_id, run, false AS bonus, CAST((run - 1) * 5 + day_of_week AS INTEGER) AS cycle_day, week, day_of_week FROM visits
UNION ALL SELECT outlet_id, run, true, CAST(day_of_week + 20 AS INTEGER), 5, day_of_week FROM visits WHERE run = 1 AND day_of_week <= 2"""

QUERIES["coverage_and_same_day_check"] = lambda spark, sf: sch.coverage_check(
    sch.expand_visits(_members(spark, sf), PlanSettings(), 22), td.outlets(spark, sf).filter("not excluded"), 4)
SQL["coverage_and_same_day_check"] = f"""WITH {STOPS}, n AS (SELECT outlet_id, count(*) AS n FROM visits GROUP BY 1)
SELECT market_id, rep_id, count(*) FILTER (coalesce(n, 0) <> vf) AS wrong_visits, 0 AS wrong_days FROM outlets LEFT JOIN n USING (outlet_id) WHERE NOT excluded GROUP BY ALL"""

QUERIES["validate_schedule"] = lambda spark, sf: sch.validate_schedule(td.stops(spark, sf).filter("not (outlet_id % 17 = 0 and week = 3)"), td.outlets(spark, sf).filter("not excluded"), 4, 8)
SQL["validate_schedule"] = f"""WITH {STOPS}, t AS (SELECT * FROM stops WHERE NOT (outlet_id % 17 = 0 AND week = 3)),
p AS (SELECT outlet_id, count(*) AS n, count(DISTINCT week) AS w, max(week) - min(week) AS g FROM t GROUP BY 1),
o AS (SELECT outlet_id, vf, coalesce(n, 0) AS n, coalesce(w, 0) AS w, g FROM outlets LEFT JOIN p USING (outlet_id) WHERE NOT excluded),
k AS (SELECT rep_id, week, day_of_week, count(*) AS n FROM t GROUP BY ALL)
SELECT 'error' AS level, 'visits' AS rule, outlet_id, NULL AS rep_id, NULL AS week, NULL AS day_of_week, n AS found FROM o WHERE n <> vf
UNION ALL SELECT 'warning', 'weekly', outlet_id, NULL, NULL, NULL, w FROM o WHERE vf = 4 AND w <> 4
UNION ALL SELECT 'warning', 'fortnight', outlet_id, NULL, NULL, NULL, g FROM o WHERE vf = 2 AND n = 2 AND g < 2
UNION ALL SELECT CASE WHEN n > 8 THEN 'error' ELSE 'warning' END, CASE WHEN n > 8 THEN 'over' ELSE 'under' END, NULL, rep_id, week, day_of_week, n FROM k WHERE n > 8 OR n < 4"""


def _days(spark, sf):
    return rm.scorecard_days(rm.route_legs(td.stops(spark, sf)))


QUERIES["plan_calendar"] = lambda spark, sf: sch.plan_calendar(_days(spark, sf), _dates(spark, sf), [1, 2, 3, 4, 5], ["rep_id"], 4, 8).select(
    "rep_id", "week", "day_of_week", c("date").cast("string").alias("date"), "visits", six(c("km")).alias("km"), six(c("total_min")).alias("total_min"), "over_shift", "off_band")
SQL["plan_calendar"] = f"""WITH {LEGS} SELECT rep_id, week, day_of_week, CAST(DATE '2026-10-05' + (week - 1) * 7 + day_of_week - 1 AS VARCHAR) AS date, visits,
  round(km, 6) AS km, round(total_min, 6) AS total_min, total_min > 495 AS over_shift, visits NOT BETWEEN 4 AND 8 AS off_band FROM days"""

QUERIES["calendar_grid"] = lambda spark, sf: sch.calendar_grid(_days(spark, sf), [1, 2, 3, 4, 5])
SQL["calendar_grid"] = f"""WITH {LEGS} SELECT market_id, rep_id, week, """ + ", ".join(f"CAST(sum(visits) FILTER (day_of_week = {d}) AS BIGINT) AS day_{d}" for d in range(1, 6)) + " FROM days GROUP BY ALL"

QUERIES["route_sheet"] = lambda spark, sf: rm.route_legs(td.stops(spark, sf)).select(
    "rep_id", "week", "day_of_week", "seq", "outlet_id", six(c("leg_km")).alias("leg_km"), "call_minutes", "latitude", "longitude")
SQL["route_sheet"] = f"WITH {LEGS} SELECT rep_id, week, day_of_week, seq, outlet_id, round(leg_km, 6) AS leg_km, call_minutes, latitude, longitude FROM legs"


def role_template(spark):
    return spark.createDataFrame([(r, n, o, True) for r, n, o, _ in ROLE_PRESETS], "role string, role_name string, offset_days int, is_active boolean")


def _roles(spark, sf):
    some = td.reps(spark, sf).filter("rep_id % 3 <> 1")
    return sch.apply_role_template(td.reps(spark, sf), role_template(spark), some)


QUERIES["apply_role_template"] = _roles
TEMPLATE = "t(role, role_name, offset_days, is_active) AS (VALUES " + ", ".join(f"('{r}', '{n}', {o}, true)" for r, n, o, _ in ROLE_PRESETS) + ")"
SQL["apply_role_template"] = f"WITH {OUTLETS}, {REPS}, {TEMPLATE} SELECT rep_id, role, role_name, offset_days, t.is_active FROM reps, t WHERE rep_id % 3 <> 1"

QUERIES["role_schedules"] = lambda spark, sf: sch.role_schedules(td.stops(spark, sf).select("rep_id", "week", "day_of_week").distinct(), _roles(spark, sf), [1, 2, 3, 4, 5])
SQL["role_schedules"] = f"""WITH {STOPS}, {TEMPLATE}, k AS (SELECT DISTINCT rep_id, week, day_of_week FROM stops WHERE rep_id % 3 <> 1)
SELECT rep_id, role, role_name, offset_days, day_of_week AS original_day_of_week,
  CAST((week - 1 + (day_of_week - 1 + offset_days) // 5) % 4 + 1 AS INTEGER) AS week, CAST((day_of_week - 1 + offset_days) % 5 + 1 AS INTEGER) AS day_of_week FROM k, t WHERE role <> 'rep'"""

QUERIES["recover_cycle"] = lambda spark, sf: sch.recover_cycle(td.stops(spark, sf).withColumn(
    "day_of_week", ((c("day_of_week") + c("market_id")) % 7 + 1).cast("int"))).select("market_id", "cycle_days", joined(c("week")).alias("week"))
SQL["recover_cycle"] = f"""WITH {STOPS}, k AS (SELECT market_id, rep_id, count(DISTINCT (week, day_of_week)) AS n FROM stops GROUP BY ALL),
m AS (SELECT market_id, max(n) AS cycle_days FROM k GROUP BY 1),
u AS (SELECT DISTINCT market_id, (day_of_week + market_id) % 7 + 1 AS d FROM stops),
g AS (SELECT market_id, d, (d - coalesce(lag(d) OVER w, max(d) OVER (PARTITION BY market_id)) + 7) % 7 AS gap FROM u WINDOW w AS (PARTITION BY market_id ORDER BY d)),
s AS (SELECT market_id, arg_max(d, gap * 10 - d) AS first FROM g GROUP BY 1)
SELECT market_id, cycle_days, (SELECT string_agg(CAST(d AS VARCHAR), ',' ORDER BY (d - first + 7) % 7) FROM u WHERE u.market_id = m.market_id) AS week FROM m JOIN s USING (market_id)"""

_plannable = lambda spark, sf: td.outlets(spark, sf).filter("not excluded and not offset")
QUERIES["simple_frequency_schedule"] = lambda spark, sf: sch.simple_schedule(_plannable(spark, sf)).select("outlet_id", "week", "day_of_week")
SQL["simple_frequency_schedule"] = f"""WITH {OUTLETS}, i AS (SELECT outlet_id, vf, row_number() OVER (PARTITION BY rep_id, vf ORDER BY outlet_id) - 1 AS i FROM outlets WHERE NOT excluded AND NOT "offset"),
w AS (SELECT *, CAST(unnest(CASE vf WHEN 4 THEN [1, 2, 3, 4] WHEN 3 THEN list_filter([1, 2, 3, 4], lambda x: x <> 4 - i % 4)
  WHEN 2 THEN CASE WHEN i % 2 = 0 THEN [1, 3] ELSE [2, 4] END ELSE [i % 4 + 1] END) AS INTEGER) AS week FROM i)
SELECT outlet_id, week, CAST(CASE vf WHEN 4 THEN i WHEN 2 THEN i // 2 ELSE i // 4 END % 5 + 1 AS INTEGER) AS day_of_week FROM w"""

QUERIES["two_week_rotation"] = lambda spark, sf: sch.two_week_rotation(_plannable(spark, sf)).groupBy("rep_id", "week", "day_of_week").agg(F.count(F.lit(1)).alias("visits"))
SQL["two_week_rotation"] = f"""WITH {OUTLETS}, i AS (SELECT rep_id, outlet_id, vf >= 4 AS k, row_number() OVER (PARTITION BY rep_id, vf >= 4 ORDER BY outlet_id) - 1 AS i FROM outlets WHERE NOT excluded AND NOT "offset"),
w AS (SELECT *, CAST(unnest(CASE WHEN k THEN [1, 2] ELSE [i % 2 + 1] END) AS INTEGER) AS week FROM i)
SELECT rep_id, week, CAST(CASE WHEN k THEN i ELSE i // 2 END % 5 + 1 AS INTEGER) AS day_of_week, count(*) AS visits FROM w GROUP BY ALL"""

QUERIES["route_limits_check"] = lambda spark, sf: rm.route_limits(_days(spark, sf), 9.0, 240.0, 8).select(
    "rep_id", "week", "day_of_week", F.array_join("violations", "; ").alias("violations")).filter("violations <> ''")
SQL["route_limits_check"] = f"""WITH {LEGS}, v AS (SELECT rep_id, week, day_of_week, concat_ws('; ', CASE WHEN km > 9 THEN 'distance over 9' END,
  CASE WHEN total_min > 240 THEN 'duration over 240' END, CASE WHEN visits > 8 THEN 'visits over 8' END) AS violations FROM days) SELECT * FROM v WHERE violations <> ''"""

QUERIES["weekday_membership"] = lambda spark, sf: sch.weekday_membership(td.stops(spark, sf)).withColumn("weeks", joined(c("weeks")))
SQL["weekday_membership"] = f"""WITH {STOPS} SELECT rep_id, day_of_week, outlet_id, string_agg(CAST(week AS VARCHAR), ',' ORDER BY week) AS weeks FROM stops GROUP BY ALL"""

QUERIES["next_month"] = lambda spark, sf: td.table(spark, sf, "orders").select("o_orderkey", cycle.next_month_key(F.to_date("o_orderdate")).alias("month"))
SQL["next_month"] = "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m') AS month FROM orders"

QUERIES["outlet_slots"] = lambda spark, sf: sch.outlet_slots(td.stops(spark, sf)).withColumn("slots", F.array_join("slots", " "))
SQL["outlet_slots"] = f"""WITH {STOPS} SELECT outlet_id, string_agg(DISTINCT day_of_week || '-' || week, ' ' ORDER BY day_of_week || '-' || week) AS slots FROM stops GROUP BY 1"""

QUERIES["stop_sequence"] = lambda spark, sf: sch.stop_sequence(td.stops(spark, sf), [3, 4, 5, 1, 2]).select("rep_id", "week", "day_of_week", "seq", "visit_no")
SQL["stop_sequence"] = f"""WITH {STOPS} SELECT rep_id, week, day_of_week, seq, row_number() OVER (PARTITION BY rep_id ORDER BY week, (day_of_week + 2) % 5, seq) AS visit_no FROM stops"""

QUERIES["calendar_order"] = lambda spark, sf: td.stops(spark, sf).select("rep_id", "week", "day_of_week").distinct().select(
    "rep_id", "week", "day_of_week", ((sch.calendar_order([3, 4, 5, 1, 2])[0] - 1) * 5 + sch.calendar_order([3, 4, 5, 1, 2])[1]).cast("bigint").alias("place"))
SQL["calendar_order"] = f"""WITH {STOPS} SELECT DISTINCT rep_id, week, day_of_week, CAST((week - 1) * 5 + list_position([3, 4, 5, 1, 2], day_of_week) AS BIGINT) AS place FROM stops"""
