"""Calendars and visits: dates of a plan, visits of a frequency, checks, roles, simple schedules."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beatwise.functions import cycle
from beatwise.operators.prefix import running_total
from beatwise.operators.route_metrics import CELL
from beatwise.params import PlanSettings, Workday

REP = ["market_id", "rep_id"]


def month_plan_dates(months: DataFrame, week: list[int], edges: str = "wholeWeeks") -> DataFrame:
    """Working dates of each month (column ``month_start``): whole weeks only, or all working days."""
    days = cycle.week_array(week or [1, 2, 3, 4, 5])
    first, last = (week or [1, 2, 3, 4, 5])[0], (week or [1, 2, 3, 4, 5])[-1]
    d = months.withColumn("date", F.explode(F.sequence("month_start", F.last_day("month_start"))))
    d = d.withColumn("dow", cycle.iso_weekday(F.col("date")))
    bounds = d.groupBy("month_start").agg(
        F.min(F.when(F.col("dow") == first, F.col("date"))).alias("_s"), F.max(F.when(F.col("dow") == last, F.col("date"))).alias("_e"))
    inside = F.lit(True)
    if edges == "wholeWeeks":
        inside = ~(F.col("_s") <= F.col("_e")) | F.col("date").between(F.col("_s"), F.col("_e"))
    return d.join(bounds, "month_start").filter(F.array_contains(days, F.col("dow")) & inside).select("month_start", "date", "dow")


def upcoming_dates(starts: DataFrame, count: int, week: list[int], planned: str = "plan_start", now: str = "now") -> DataFrame:
    """The next ``count`` working days of each row: from its plan start, else from the day after ``now``; ordinal from 0."""
    begin = F.coalesce(F.col(planned), F.date_add(now, 1))
    days = F.filter(F.sequence(begin, F.date_add(begin, count * 7 + 13)),
                    lambda d: F.array_contains(cycle.week_array(week), cycle.iso_weekday(d)))
    return starts.select(*[c for c in starts.columns if c not in (planned, now)],
                         F.posexplode(F.slice(days, 1, count)).alias("ordinal", "date"))


def date_of_cell(cells: DataFrame, dates: DataFrame, week: list[int], keys: list[str], start_slot: int = 0) -> DataFrame:
    """Cells with the date their week and weekday fall on; null off the working week."""
    slot = F.array_position(cycle.week_array(week), F.col("day_of_week")) - 1
    at = cells.withColumn("ordinal", F.when(slot >= 0, (F.col("week") - 1) * len(week) + slot - start_slot).cast("int"))
    return at.join(dates.select(*keys, "ordinal", "date"), [*keys, "ordinal"], "left").drop("ordinal")


def expand_visits(members: DataFrame, settings: PlanSettings, plan_days: int | None = None) -> DataFrame:
    """One row per visit of a membership (outlet_id, day_group from 0, visits, bucket): run, week, weekday.

    A plan longer than its pattern drives day 1, 2, ... again on its last days (``bonus``).
    """
    g, r = settings.day_groups, settings.repeats
    runs = members.withColumn("run", F.explode(cycle.runs_of_bucket(F.col("visits"), F.lit(r), F.col("bucket"))))
    at = cycle.calendar_cell(F.col("run"), F.col("day_group") + 1, F.lit(g), settings.week, settings.start_slot)
    base = runs.withColumn("_at", at).withColumn("bonus", F.lit(False))
    extra = (plan_days or settings.cycle_days) - settings.cycle_days
    if extra > 0:
        again = cycle.calendar_cell(F.lit(1), F.col("_at.cycle_day") + settings.cycle_days, F.lit(1), settings.week)
        more = base.filter(F.col("_at.cycle_day") <= extra).withColumn("_at", again).withColumn("bonus", F.lit(True))
        base = base.unionByName(more)
    return base.select("*", F.col("_at.cycle_day").alias("cycle_day"), F.col("_at.week").alias("week"),
                       F.col("_at.day_of_week").alias("day_of_week")).drop("_at")


def coverage_check(visits: DataFrame, outlets: DataFrame, repeats: int) -> DataFrame:
    """Per rep: whether every outlet gets its visits and keeps to as many day-groups as it has memberships."""
    got = visits.filter(~F.col("bonus")).groupBy("outlet_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("day_group").alias("_g"))
    shares = cycle.memberships_for(F.col("vf"), F.lit(repeats))
    want = F.aggregate(shares, F.lit(0), lambda a, x: a + x)
    o = outlets.join(got, "outlet_id", "left").fillna(0, ["_n", "_g"])
    return o.groupBy(*REP).agg(F.count_if(F.col("_n") != want).alias("wrong_visits"),
                               F.count_if(F.col("_g") > F.size(shares)).alias("wrong_days"))


def validate_schedule(stops: DataFrame, outlets: DataFrame, low: int, high: int) -> DataFrame:
    """Issues of a schedule, one row each: level, rule, outlet or cell, found, wanted."""
    c = F.col
    none = lambda *names: [F.lit(None).cast("bigint").alias(n) for n in names]
    per = stops.groupBy("outlet_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("week").alias("weeks"),
                                         (F.max("week") - F.min("week")).alias("gap"))
    o = outlets.select("outlet_id", "vf").join(per, "outlet_id", "left").fillna(0, ["n", "weeks"])
    row = lambda level, rule, found: F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"), found.cast("bigint").alias("found"))
    issues = F.array_compact(F.array(
        F.when(c("n") != c("vf"), row("error", "visits", c("n"))),
        F.when((c("vf") == 4) & (c("weeks") != 4), row("warning", "weekly", c("weeks"))),
        F.when((c("vf") == 2) & (c("n") == 2) & (c("gap") < 2), row("warning", "fortnight", c("gap")))))
    by_outlet = o.select("outlet_id", F.inline(issues)).select("level", "rule", "outlet_id", *none("rep_id", "week", "day_of_week"), "found")
    cell = stops.groupBy("rep_id", "week", "day_of_week").agg(F.count(F.lit(1)).alias("n"))
    by_cell = cell.filter((c("n") > high) | (c("n") < low)).select(
        F.when(c("n") > high, "error").otherwise("warning").alias("level"), F.when(c("n") > high, "over").otherwise("under").alias("rule"),
        *none("outlet_id"), "rep_id", c("week").cast("bigint").alias("week"), c("day_of_week").cast("bigint").alias("day_of_week"), c("n").alias("found"))
    return by_outlet.unionByName(by_cell)


def plan_calendar(days: DataFrame, dates: DataFrame, week: list[int], keys: list[str], low: int, high: int,
                  wd: Workday = Workday()) -> DataFrame:
    """Driven days with date, load against the shift and band flags (``days`` from scorecard_days)."""
    out = date_of_cell(days, dates, week, keys)
    return out.withColumn("over_shift", F.col("total_min") > wd.shift + 15).withColumn(
        "off_band", ~F.col("visits").between(low, high))


def calendar_grid(days: DataFrame, week: list[int]) -> DataFrame:
    """Visits of each rep and week with a column per working day."""
    return days.groupBy(*REP, "week").pivot("day_of_week", week).agg(F.sum("visits")).select(
        *REP, "week", *[F.col(str(d)).alias(f"day_{d}") for d in week])


def calendar_order(week: list[int]) -> list[Column]:
    """Sort keys of a plan: week, then the slot of the working week, not the weekday number."""
    return [F.col("week"), F.array_position(cycle.week_array(week), F.col("day_of_week"))]


def stop_sequence(stops: DataFrame, week: list[int]) -> DataFrame:
    """Number the stops of each rep in calendar order (``visit_no``), cell by cell."""
    slot = F.array_position(cycle.week_array(week), F.col("day_of_week"))
    cells = stops.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n")).withColumn("_slot", slot)
    before = F.sum("_n").over(Window.partitionBy(*REP).orderBy("week", "_slot").rowsBetween(Window.unboundedPreceding, -1))
    offset = cells.select(*CELL, F.coalesce(before, F.lit(0)).alias("_before"))
    return stops.join(offset, CELL).withColumn("visit_no", F.col("_before") + F.col("seq")).drop("_before")


def role_schedules(cells: DataFrame, roles: DataFrame, week: list[int], weeks_in_cycle: int = 4) -> DataFrame:
    """Cells of each active role of a rep, shifted by its offset in working days and wrapped at the cycle's end.

    ``roles`` is per rep: rep_id, role, role_name, offset_days, is_active.
    """
    n = len(week)
    r = roles.filter(F.col("is_active") & (F.col("role") != "rep")).select("rep_id", "role", "role_name", "offset_days")
    slot = F.greatest(F.lit(0), F.array_position(cycle.week_array(week), F.col("day_of_week")).cast("int") - 1)
    shifted = slot + F.col("offset_days")
    new_week = F.greatest(F.lit(1), F.col("week") + F.floor(shifted / n).cast("int"))
    return (cells.join(r, "rep_id").withColumn("original_day_of_week", F.col("day_of_week"))
            .withColumn("_w", F.when(new_week > weeks_in_cycle, (new_week - 1) % weeks_in_cycle + 1).otherwise(new_week))
            .withColumn("day_of_week", F.element_at(cycle.week_array(week), F.pmod(shifted, F.lit(n)) + 1))
            .withColumn("week", F.col("_w")).drop("_w"))


def apply_role_template(reps: DataFrame, template: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Every rep (or the selected ones) with every role of the template, a handful of rows."""
    chosen = reps if selected is None else reps.join(selected.select("rep_id").distinct(), "rep_id", "left_semi")
    rows = template.limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("a role template is a short list; this one has over 1000 roles")
    roles = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.asDict().items()]) for r in rows])
    return chosen.select("rep_id", F.inline(roles))


def recover_cycle(stops: DataFrame, keys: list[str] = ["market_id"]) -> DataFrame:
    """Cycle length (most cells of any rep) and working week (weekdays in use, starting after the longest gap)."""
    cells = stops.groupBy(*keys, "rep_id").agg(F.count_distinct("week", "day_of_week").alias("_n"),
                                               F.collect_set("day_of_week").alias("_d"))
    m = cells.groupBy(*keys).agg(F.max("_n").alias("cycle_days"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_d")))).alias("_d"))
    n = F.size("_d")
    gap = lambda i: F.struct(F.pmod(F.element_at("_d", i) - F.element_at("_d", F.when(i == 1, n).otherwise(i - 1)) + 7, F.lit(7)).alias("g"), (-i).alias("i"))
    start = -F.array_max(F.transform(F.sequence(F.lit(1), n), gap))["i"]
    return m.withColumn("_s", start).select(*keys, "cycle_days", F.when(n < 2, F.col("_d")).otherwise(
        F.concat(F.slice("_d", F.col("_s"), n), F.slice("_d", F.lit(1), F.col("_s") - 1))).alias("week"))


def simple_schedule(outlets: DataFrame, days_per_week: int = 5) -> DataFrame:
    """Four-week schedule by frequency alone: outlets of a frequency are dealt round the days in turn,
    so day loads differ by at most one per frequency."""
    dealt = running_total(outlets, [*REP, "vf"], F.floor(F.col("outlet_id") / 100000), ["outlet_id"], F.lit(1), "_i")
    i = F.col("_i") - 1
    div = lambda k: F.floor(i / k)
    weeks = (F.when(F.col("vf") == 4, F.array(*[F.lit(w) for w in (1, 2, 3, 4)]))
             .when(F.col("vf") == 3, F.filter(F.array(*[F.lit(w) for w in (1, 2, 3, 4)]), lambda w: w != 4 - i % 4))
             .when(F.col("vf") == 2, F.when(i % 2 == 0, F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(2), F.lit(4))))
             .otherwise(F.array((i % 4 + 1).cast("int"))))
    step = F.when(F.col("vf") == 4, i).when(F.col("vf") == 2, div(2)).otherwise(div(4))
    return dealt.select(*REP, "outlet_id", "vf", F.explode(weeks).alias("week"), (step % days_per_week + 1).cast("int").alias("day_of_week"))


def two_week_rotation(outlets: DataFrame, days_per_week: int = 5) -> DataFrame:
    """Two-week schedule: weekly outlets both weeks, the rest in one of the two, dealt round the days."""
    weekly = F.col("vf") >= 4
    dealt = running_total(outlets.withColumn("_k", weekly), [*REP, "_k"], F.floor(F.col("outlet_id") / 100000), ["outlet_id"], F.lit(1), "_i")
    i = F.col("_i") - 1
    weeks = F.when(F.col("_k"), F.array(F.lit(1), F.lit(2))).otherwise(F.array((i % 2 + 1).cast("int")))
    day = F.when(F.col("_k"), i).otherwise(F.floor(i / 2)) % days_per_week + 1
    return dealt.select(*REP, "outlet_id", F.explode(weeks).alias("week"), day.cast("int").alias("day_of_week"))


def weekday_membership(stops: DataFrame) -> DataFrame:
    """Per rep, weekday and outlet: the weeks it is visited in."""
    return stops.groupBy("rep_id", "day_of_week", "outlet_id").agg(F.array_sort(F.collect_set("week")).alias("weeks"))


def outlet_slots(stops: DataFrame) -> DataFrame:
    """Weekday-week labels of each outlet, such as ``2-1`` for Tuesday of week 1."""
    label = F.format_string("%d-%d", F.col("day_of_week"), F.col("week"))
    return stops.groupBy("outlet_id").agg(F.array_sort(F.collect_set(label)).alias("slots"))
