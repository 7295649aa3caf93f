"""Plan building and maintenance; SQL where one pass defines the result."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from beatwise.checks.sql import EDITS, OUTLETS, STOPS
from beatwise.functions.numbers import six
from beatwise.operators import route_metrics as rm
from beatwise.operators import status
from beatwise.params import Band, PlanSettings
from beatwise.plans import build, keep_days
from beatwise.sources import testdata as td

QUERIES, SQL = {}, {}
c = F.col
SETTINGS = PlanSettings(band=Band(4, 8))
CELL = rm.CELL


def _cut_month(spark, sf):
    return td.stops(spark, sf).filter("not (outlet_id % 17 = 0 and week = 3)")


QUERIES["read_back_bands"] = lambda spark, sf: keep_days.read_back_bands(_cut_month(spark, sf), SETTINGS).select(
    "market_id", "rep_id", "outlet_id", "day_group", "visits", "bucket")
SQL["read_back_bands"] = f"""WITH {STOPS}, pat AS (SELECT v, b, array_to_string(list_sort(list_distinct(list_transform(range(0, v), lambda j: (b + (j * 4) // v) % 4 + 1))), ',') AS k
  FROM (SELECT unnest([1, 2, 3, 4]) AS v), (SELECT unnest([0, 1, 2, 3]) AS b) WHERE b < CASE WHEN 4 % v = 0 THEN 4 // v ELSE 4 END),
s AS (SELECT market_id, rep_id, outlet_id, day_group, count(DISTINCT run) AS v, string_agg(DISTINCT CAST(run AS VARCHAR), ',' ORDER BY CAST(run AS VARCHAR)) AS k FROM stops WHERE NOT (outlet_id % 17 = 0 AND week = 3) GROUP BY ALL)
SELECT market_id, rep_id, outlet_id, day_group, CAST(s.v AS INTEGER) AS visits, CAST(min(b) AS INTEGER) AS bucket FROM s LEFT JOIN pat ON pat.v = s.v AND pat.k = s.k GROUP BY market_id, rep_id, outlet_id, day_group, s.v"""


def _members(spark, sf):
    return td.memberships(spark, sf).select("market_id", "rep_id", "outlet_id", "day_group", c("vf").alias("visits"), "bucket")


def _active(spark, sf):
    return td.outlets(spark, sf).filter("not excluded and not offset")


def _placed(spark, sf):
    new = _active(spark, sf).filter("outlet_id % 89 = 5").select("market_id", "rep_id", "outlet_id", c("vf").alias("visits"))
    return keep_days.place_arrivals(_members(spark, sf), new, td.outlets(spark, sf), SETTINGS)


QUERIES["place_arrivals"] = lambda spark, sf: _placed(spark, sf).filter("outlet_id % 89 = 5")
QUERIES["place_arrivals_coverage"] = lambda spark, sf: _placed(spark, sf).groupBy("rep_id").agg(F.count(F.lit(1)).alias("memberships"), F.sum("visits").alias("visits"))
SQL["place_arrivals_coverage"] = f"""WITH {OUTLETS} SELECT rep_id, count(*) AS memberships, CAST(sum(vf) AS BIGINT) AS visits FROM outlets WHERE NOT excluded AND NOT "offset" GROUP BY 1"""


def _runs(spark, sf):
    s = td.stops(spark, sf).join(_members(spark, sf).select("outlet_id", "visits", "bucket"), "outlet_id")
    return s.select(*keep_days.RUN, "seq", "outlet_id", "latitude", "longitude", (c("call_minutes") * 3).alias("call_minutes"), "visits", "bucket")


TIGHT = PlanSettings(band=Band(2, 12))
QUERIES["relieve_overloaded_days"] = lambda spark, sf: keep_days.day_loads(keep_days.relieve_overloaded_days(_runs(spark, sf), TIGHT)).select(
    "rep_id", "day_group", "run", "n", six(c("minutes")).alias("minutes"))
QUERIES["relieve_keeps_visits"] = lambda spark, sf: keep_days.relieve_overloaded_days(_runs(spark, sf), TIGHT).groupBy("market_id", "rep_id", "outlet_id").agg(F.count(F.lit(1)).alias("visits"))
SQL["relieve_keeps_visits"] = f"WITH {STOPS} SELECT market_id, rep_id, outlet_id, count(*) AS visits FROM stops GROUP BY ALL"


def _restored(spark, sf):
    was = _runs(spark, sf).groupBy(*keep_days.RUN).agg(F.count(F.lit(1)).alias("visits"))
    gone = _runs(spark, sf).filter("outlet_id % 5 <> 0")
    w = Window.partitionBy(*keep_days.RUN).orderBy("seq")
    return keep_days.restore_band(gone.withColumn("seq", F.row_number().over(w)), SETTINGS, was)


QUERIES["restore_band"] = lambda spark, sf: keep_days.day_loads(_restored(spark, sf)).select("rep_id", "day_group", "run", "n", six(c("minutes")).alias("minutes"))


def _pins(spark, sf):
    return td.memberships(spark, sf).filter("outlet_id % 23 = 1").select("rep_id", "outlet_id", (c("outlet_id") % 4 + 1).cast("int").alias("week"), ((c("outlet_id") + 2) % 5 + 1).cast("int").alias("day_of_week"))


QUERIES["place_pin"] = lambda spark, sf: keep_days.place_pins(td.stops(spark, sf), _pins(spark, sf), td.outlets(spark, sf))
QUERIES["place_pin_visits"] = lambda spark, sf: keep_days.place_pins(td.stops(spark, sf), _pins(spark, sf), td.outlets(spark, sf)).groupBy("outlet_id").agg(F.count(F.lit(1)).alias("visits"))
SQL["place_pin_visits"] = f"WITH {STOPS} SELECT outlet_id, count(*) AS visits FROM stops GROUP BY 1"

_plan = lambda spark, sf: build.build_plan(_active(spark, sf), F.lit(5), SETTINGS)
QUERIES["build_plan"] = lambda spark, sf: rm.scorecard_days(rm.route_legs(_plan(spark, sf))).select("market_id", "rep_id", "week", "day_of_week", "visits", six(c("km")).alias("km"))
QUERIES["build_plan_visits"] = lambda spark, sf: _plan(spark, sf).groupBy("market_id", "outlet_id").agg(F.count(F.lit(1)).alias("visits"), F.count_distinct("rep_id").alias("reps"))
SQL["build_plan_visits"] = f"""WITH {OUTLETS} SELECT market_id, outlet_id, CAST(vf AS BIGINT) AS visits, 1 AS reps FROM outlets WHERE NOT excluded AND NOT "offset" """


def _edited(spark, sf):
    return status.apply_edits(td.outlets(spark, sf), td.edits(spark, sf)).filter("not excluded and not offset").withColumn("market_id", F.expr("(rep_id % 25) DIV 5"))


OWNED = f"""{OUTLETS}, {EDITS}, last AS (SELECT outlet_id, kind, to_rep_id FROM edits QUALIFY row_number() OVER (PARTITION BY outlet_id ORDER BY ts DESC, edit_id DESC) = 1),
owned AS (SELECT outlet_id, vf, CASE WHEN kind = 'move' THEN to_rep_id ELSE rep_id END AS rep_id FROM outlets LEFT JOIN last USING (outlet_id)
  WHERE (kind IS NULL OR kind <> 'delete') AND NOT "offset" AND NOT CASE WHEN kind = 'exclude' THEN true WHEN kind = 'restore' THEN false ELSE excluded END)"""
QUERIES["replan_keep_days"] = lambda spark, sf: build.replan_keep_days(_edited(spark, sf), td.stops(spark, sf), SETTINGS).groupBy("rep_id", "outlet_id").agg(F.count(F.lit(1)).alias("visits"))
SQL["replan_keep_days"] = f"WITH {OWNED} SELECT rep_id, outlet_id, CAST(vf AS BIGINT) AS visits FROM owned"
QUERIES["partial_replan"] = lambda spark, sf: build.partial_replan(_edited(spark, sf), td.stops(spark, sf), SETTINGS, td.stops(spark, sf).filter("day_of_week = 2").select("rep_id", "week", "day_of_week")).groupBy(
    "rep_id", "outlet_id").agg(F.count(F.lit(1)).alias("visits"))
SQL["partial_replan"] = SQL["replan_keep_days"]
