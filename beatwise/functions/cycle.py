"""Calendar rules as Column expressions: cycle shapes, cells, runs of a frequency."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_weekday(d: Column) -> Column:
    return F.weekday(d) + 1


def parse_week(days: Column, count: Column) -> Column:
    """Working week from a list of texts (kept in order, valid and distinct), else the first N weekdays."""
    listed = F.array_distinct(F.filter(F.transform(days, lambda d: d.try_cast("int")), lambda d: d.between(1, 7)))
    n = F.least(F.lit(7), F.greatest(F.lit(1), F.coalesce(F.when(count != 0, count), F.lit(5))))
    return F.when(F.size(listed) > 0, listed).otherwise(F.sequence(F.lit(1), n))


def _first_divisor(n: Column, prefs: list[int]) -> Column:
    out = F.when(n % prefs[0] == 0, F.lit(prefs[0]))
    for p in prefs[1:]:
        out = out.when(n % p == 0, F.lit(p))
    return out


def cycle_shape(week_length: Column, requested: Column) -> Column:
    """STRUCT(cycle_days, repeats, day_groups, plan_days) of a cycle.

    Even runs (4, then 2) are preferred, with one bonus day if that helps, then 3 or 5 runs.
    """
    wd = F.greatest(F.lit(1), F.coalesce(F.when(week_length != 0, week_length), F.lit(5)))
    plan = F.when(requested > 0, requested).otherwise(wd * 4)
    tries = [(plan, [4, 2], F.lit(True)), (plan - 1, [4, 2], plan > 2),
             (plan, [3, 5], F.lit(True)), (plan - 1, [3, 5], plan > 2)]
    picks = [F.when(ok & _first_divisor(n, prefs).isNotNull(),
                    F.struct(n.cast("int").alias("days"), _first_divisor(n, prefs).cast("int").alias("runs")))
             for n, prefs, ok in tries]
    rest = F.struct(F.greatest(F.lit(2), plan - plan % 2).cast("int").alias("days"), F.lit(2).cast("int").alias("runs"))
    pick = F.coalesce(*picks, rest)
    groups = F.greatest(F.lit(1), F.floor(pick["days"] / pick["runs"] + 0.5)).cast("int")
    return F.struct(pick["days"].alias("cycle_days"), pick["runs"].alias("repeats"), groups.alias("day_groups"),
                    F.greatest(pick["days"], plan.cast("int")).alias("plan_days"))


def week_array(week) -> Column:
    return week if isinstance(week, Column) else F.array(*[F.lit(int(d)) for d in week])


def calendar_cell(run: Column, group: Column, day_groups: Column, week, start_slot: Column | int = 0) -> Column:
    """STRUCT(cycle_day, week, day_of_week) of run (1-based) and day-group (1-based)."""
    days = week_array(week)
    start = start_slot if isinstance(start_slot, Column) else F.lit(start_slot)
    day = (run - 1) * day_groups + group
    pos = start + day - 1
    return F.struct(day.cast("int").alias("cycle_day"),
                    (F.floor(pos / F.size(days)) + 1).cast("int").alias("week"),
                    F.element_at(days, (pos % F.size(days) + 1).cast("int")).alias("day_of_week"))


def cycle_cell_of(week_no: Column, day_of_week: Column, week, day_groups, cycle_days, start_slot=0) -> Column:
    """The inverse of calendar_cell: STRUCT(day_group 0-based, run 1-based), null outside the pattern."""
    days = week_array(week)
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    slot = F.array_position(days, day_of_week) - 1
    day = (week_no - 1) * F.size(days) + slot - lit(start_slot)
    ok = (slot >= 0) & (week_no >= 1) & (day >= 0) & (day < lit(cycle_days))
    return F.when(ok, F.struct((day % lit(day_groups)).cast("int").alias("day_group"),
                               (F.floor(day / lit(day_groups)) + 1).cast("int").alias("run")))


def memberships_for(vf: Column, repeats: Column) -> Column:
    """Visits of a frequency split over day-groups that each carry at most ``repeats``."""
    need = F.greatest(F.lit(1), F.least(F.when(vf > 0, vf).otherwise(1), repeats * 2))
    return F.when(need <= repeats, F.array(need)).otherwise(F.array(repeats, need - repeats))


def buckets_for_frequency(vf: Column, repeats: Column) -> Column:
    times = F.least(F.greatest(F.lit(1), vf), repeats)
    return F.when(repeats % times == 0, repeats / times).otherwise(repeats).cast("int")


def runs_of_bucket(vf: Column, repeats: Column, bucket: Column) -> Column:
    """Sorted runs (1-based) a bucket of this frequency is visited in."""
    times = F.least(F.greatest(F.lit(1), vf), repeats)
    step = lambda j: ((bucket + F.floor((j - 1) * repeats / times)) % repeats + 1).cast("int")
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), times), step)))


def next_month_key(now: Column) -> Column:
    return F.date_format(F.add_months(F.trunc(now, "month"), 1), "yyyy-MM")
