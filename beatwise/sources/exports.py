"""Exports of a plan as tables, and their writers. Every export is a lazy DataFrame; ``write`` lands it as CSV."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwise.functions.geo import map_link
from beatwise.functions.numbers import half_up
from beatwise.operators.route_metrics import CELL, route_legs, scorecard_days
from beatwise.operators.schedule import date_of_cell, outlet_slots, role_schedules, stop_sequence
from beatwise.operators.scorecard import territory_summary
from beatwise.operators.status import outlet_status

c = F.col
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def day_name(day_of_week: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), day_of_week)


def vf_label(vf: Column) -> Column:
    return F.concat(F.lit("VF"), vf.cast("string"))


def write(export: DataFrame | dict[str, DataFrame], folder: str, by: str | None = None) -> None:
    """Write an export (or several by name) as CSV with a header, in a folder per ``by`` value if given."""
    for name, df in (export.items() if isinstance(export, dict) else [("data", export)]):
        w = df.write.mode("overwrite").option("header", True)
        (w.partitionBy(by) if by else w).csv(f"{folder}/{name}")


def schedule_export(stops: DataFrame, outlets: DataFrame, dates: DataFrame, week: list[int]) -> DataFrame:
    """One row per stop of every rep: date, day, outlet, frequency label and zone."""
    o = outlets.select("outlet_id", "name", "code", "vf", "zone_id")
    dated = date_of_cell(stops.select(*CELL, "seq", "outlet_id"), dates, week, ["rep_id"])
    return dated.join(o, "outlet_id").select(
        "rep_id", "date", day_name(c("day_of_week")).alias("day"), "week", "seq", "outlet_id", "name", "code", vf_label(c("vf")).alias("frequency"), "zone_id")


def territory_export(outlets: DataFrame, stops: DataFrame, days: DataFrame, week: list[int]) -> dict[str, DataFrame]:
    """Summary per rep, all outlets in drive sequence, outlets without a route and outlets held out."""
    first = stop_sequence(stops, week).groupBy("outlet_id").agg(F.min("visit_no").alias("visit_no"))
    o = outlets.select("market_id", "rep_id", "outlet_id", "name", "code", "vf", "excluded", "offset").join(first, "outlet_id", "left")
    held = c("excluded") | c("offset")
    return {"summary": territory_summary(outlets, days),
            "outlets": o.filter(~held & c("visit_no").isNotNull()).select("market_id", "rep_id", "visit_no", "outlet_id", "name", "code", "vf"),
            "unassigned": o.filter(~held & c("visit_no").isNull()).select("market_id", "rep_id", "outlet_id", "name"),
            "held": o.filter(held).select("market_id", "outlet_id", "name", F.when(c("excluded"), "Excluded").otherwise("Held for review").alias("status"))}


def zone_number(label: Column) -> Column:
    """Zone id behind a label: ``Zone N`` is N - 1, a plain number is itself."""
    n = F.regexp_extract(label, r"(\d+)\s*$", 1).try_cast("bigint")
    return F.when(F.lower(label).startswith("zone"), n - 1).otherwise(n)


def cluster_export(outlets: DataFrame, chosen: list[str] | None = None) -> dict[str, DataFrame]:
    """Outlets per zone and a summary of each zone, for all zones or the chosen labels."""
    o = outlets
    if chosen:
        o = o.filter(F.array_contains(F.transform(F.array(*[F.lit(x) for x in chosen]), zone_number), c("zone_id").cast("bigint")))
    rows = o.select("market_id", "zone_id", F.concat(F.lit("Zone "), (c("zone_id") + 1).cast("string")).alias("zone"), "outlet_id", "name", "latitude", "longitude", vf_label(c("vf")).alias("frequency"), "rep_id")
    summary = o.groupBy("market_id", "zone_id").agg(
        F.count(F.lit(1)).alias("outlets"), F.sum("vf").alias("monthly_visits"), *[F.count_if(c("vf") == v).alias(f"vf{v}") for v in (1, 2, 3, 4)],
        F.avg("latitude").alias("lat"), F.avg("longitude").alias("lng"))
    return {"outlets": rows, "summary": summary}


def role_schedule_export(stops: DataFrame, roles: DataFrame, dates: DataFrame, week: list[int], weeks_in_cycle: int = 4) -> DataFrame:
    """The rep's cells and those of each of its roles, dated, with the number of stops."""
    cells = stops.groupBy(*CELL).agg(F.count(F.lit(1)).alias("stops"))
    base = cells.select("rep_id", F.lit("rep").alias("role"), F.lit("Sales Rep").alias("role_name"), "week", "day_of_week", c("day_of_week").alias("original_day_of_week"), "stops")
    shifted = role_schedules(cells, roles, week, weeks_in_cycle).select("rep_id", "role", "role_name", "week", "day_of_week", "original_day_of_week", "stops")
    return date_of_cell(base.unionByName(shifted), dates, week, ["rep_id"]).withColumn("day", day_name(c("day_of_week")))


def route_export(stops: DataFrame, outlets: DataFrame, rep_ids: list[int], days: list[int], week_no: int = 1) -> DataFrame:
    """Ordered stops of chosen reps and weekdays of one week, with km from the stop before."""
    picked = stops.filter(c("rep_id").isin(rep_ids) & c("day_of_week").isin(days) & (c("week") == week_no))
    legs = route_legs(picked).select(*CELL, "seq", "outlet_id", "latitude", "longitude", half_up(c("leg_km"), 2).alias("km"))
    return legs.join(outlets.select("outlet_id", "name", vf_label(c("vf")).alias("frequency")), "outlet_id").withColumn("day", day_name(c("day_of_week")))


def journey_plan(stops: DataFrame, outlets: DataFrame, dates: DataFrame, week: list[int], summary: DataFrame | None = None) -> dict[str, DataFrame]:
    """The journey plan: stop list with date and map link, load of every rep day, outlet master with its days."""
    legs = route_legs(stops)
    days = scorecard_days(legs)
    o = outlets.select("outlet_id", "name", "code", "channel", c("vf").alias("visits_a_month"))
    listed = date_of_cell(legs, dates, week, ["rep_id"]).join(o, "outlet_id").select(
        "market_id", "rep_id", "date", day_name(c("day_of_week")).alias("day"), "week", "seq", "outlet_id", "name", "code", "channel", "visits_a_month", "call_minutes",
        F.when(c("seq") > 1, half_up(c("leg_km"), 1)).alias("km_from_previous"), "latitude", "longitude", map_link(c("latitude"), c("longitude")).alias("map"))
    load = date_of_cell(days, dates, week, ["rep_id"]).select(
        "market_id", "rep_id", "date", day_name(c("day_of_week")).alias("day"), "week", "visits", half_up(c("km"), 1).alias("km"), half_up(c("call_min") / 60, 1).alias("call_hours"),
        half_up(c("drive_min") / 60, 1).alias("driving_hours"), half_up(c("total_min") / 60, 1).alias("workday_hours"))
    slots = outlet_slots(stops)
    master = outlets.join(slots, "outlet_id", "left").select(
        "market_id", "outlet_id", "name", "code", "rep_id", "vf", outlet_status(c("excluded"), c("offset"), c("slots").isNotNull()).alias("status"),
        F.array_join(F.coalesce("slots", F.array().cast("array<string>")), " ").alias("visit_days"))
    out = {"stops": listed, "rep_days": load, "outlets": master}
    return out if summary is None else {"summary": summary, **out}


def edited_universe(outlets: DataFrame, reps: DataFrame) -> DataFrame:
    """The outlet list under upload headers, with assigned rep and plan status, ready to upload again."""
    r = reps.select("rep_id", "rep_name")
    return outlets.join(r, "rep_id", "left").select(
        "market_id", F.coalesce("code", F.lit("")).alias("Outlet Code"), c("name").alias("Outlet Name"), c("latitude").alias("Latitude"), c("longitude").alias("Longitude"),
        c("vf").alias("VF"), F.coalesce("channel", F.lit("")).alias("Channel"), c("time_per_visit").alias("Time Per Visit"), c("value").alias("Value"),
        F.coalesce("rep_name", F.lit("")).alias("Assigned Rep"), outlet_status(c("excluded"), c("offset")).alias("Plan Status"))
