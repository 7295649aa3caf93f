"""Relief of days: reps that go through all rounds in one task end as by joins."""
import random

from pyspark.sql import functions as F

from beatwise.params import Band, PlanSettings
from beatwise.plans import keep_days

COLS = "market_id int, rep_id int, day_group int, run int, seq int, outlet_id long, latitude double, longitude double, call_minutes int, visits int, bucket int"


def stops(spark, reps=(1, 2, 3), odd=False):
    rows = []
    for rep in reps:
        r, of = random.Random(rep), {}
        for o in range(24):
            v, day = r.choice([1, 2, 4]), 0 if r.random() < 0.5 else r.randrange(3)
            b = r.randrange({1: 4, 2: 2, 4: 1}[v])
            at = (33.5 + r.random() * 0.05, 35.5 + r.random() * 0.05, 20 + r.randrange(30), v, b)
            for run in [(b + j * 4 // v) % 4 + 1 for j in range(v)]:
                of.setdefault((day, run), []).append((rep * 100 + o, *at))
        for (day, run), here in of.items():
            rows += [(0, rep, day, run, i + 1, *x) for i, x in enumerate(here)]
    if odd:
        rows += [(None, 9, 0, 1, 1, 900, 33.5, 35.5, 30, 1, 0), (0, None, 0, 1, 1, 901, 33.5, 35.5, 30, 1, 0), (0, 8, 0, 1, 1, 902, None, 35.5, 600, 1, 0), (0, 7, 0, 1, 3, 903, 33.5, 35.5, 600, 1, 0)]
    return spark.createDataFrame(rows, COLS)


def test_reps_of_one_task_are_relieved_as_by_joins(spark, monkeypatch):
    s, st = stops(spark), PlanSettings(day_groups=3, band=Band(3, 7), hop_km=2.0)
    was = s.groupBy(*keep_days.RUN).agg(F.count(F.lit(1)).alias("visits"))
    pinned = s.select("outlet_id").filter("outlet_id % 5 = 0").distinct()
    start = sorted(map(tuple, s.collect()))
    for restore, rounds in ((None, None), (was.withColumn("visits", F.col("visits") + F.when(F.col("run") == 1, 3).otherwise(-2)), 4)):
        found = []
        for rows in (keep_days.REP_STOPS, 0):
            monkeypatch.setattr(keep_days, "REP_STOPS", rows)
            found.append(sorted(map(tuple, keep_days.relieve_overloaded_days(s, st, restore, pinned, rounds).collect())))
            monkeypatch.undo()
        assert found[0] == found[1] != start


def test_relief_takes_few_steps_and_keeps_odd_rows(spark, monkeypatch):
    s, st = stops(spark, odd=True), PlanSettings(day_groups=3, band=Band(3, 7))
    out = keep_days.relieve_overloaded_days(s, st).collect()
    assert sorted(x.outlet_id for x in out if x.outlet_id >= 900) == [900, 901, 902, 903] and len(out) == s.count()
    written, cut = [], keep_days.cut
    monkeypatch.setattr(keep_days, "cut", lambda df: written.append(1) or cut(df))
    assert keep_days.relieve_overloaded_days(stops(spark), st).count() == stops(spark).count()
    assert len(written) <= 3
