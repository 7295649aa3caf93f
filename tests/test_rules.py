"""Literal cases of the planning rules."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from beatwise.functions import cycle, geo, numbers, text
from beatwise.operators import market, roads, schedule
from beatwise.operators.partition import apportion_days
from beatwise.params import TIGRIS
from beatwise.sources import uploads


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("week,asked,shape", [(5, 0, (20, 4, 5, 20)), (6, 0, (24, 4, 6, 24)), (6, 26, (26, 2, 13, 26)),
                                              (6, 23, (22, 2, 11, 23)), (6, 27, (26, 2, 13, 27)), (5, 21, (20, 4, 5, 21))])
def test_cycle_shape(spark, week, asked, shape):
    assert tuple(value(spark, cycle.cycle_shape(F.lit(week), F.lit(asked)))) == shape


def test_month_of_october_2026(spark):
    m = spark.range(1).select(F.lit("2026-10-01").cast("date").alias("month_start"))
    whole = [r.date for r in schedule.month_plan_dates(m, [6, 7, 1, 2, 3, 4]).orderBy("date").collect()]
    assert (len(whole), whole[0], whole[-1]) == (24, dt.date(2026, 10, 3), dt.date(2026, 10, 29))
    assert schedule.month_plan_dates(m, [6, 7, 1, 2, 3, 4], "allDays").count() == 26


def test_runs_stay_even(spark):
    for runs in (2, 3, 4, 5):
        for vf in range(1, runs + 1):
            n = value(spark, cycle.buckets_for_frequency(F.lit(vf), F.lit(runs)))
            seen = [r for b in range(n) for r in value(spark, cycle.runs_of_bucket(F.lit(vf), F.lit(runs), F.lit(b)))]
            per_run = {seen.count(r) for r in range(1, runs + 1)}
            assert len(per_run) == 1
    assert value(spark, cycle.runs_of_bucket(F.lit(2), F.lit(4), F.lit(1))) == [2, 4]
    assert value(spark, cycle.memberships_for(F.lit(4), F.lit(2))) == [2, 2]


def test_calendar_cell_and_back(spark):
    week = [6, 7, 1, 2, 3, 4]
    cell = cycle.calendar_cell(F.lit(2), F.lit(1), F.lit(13), week)
    assert tuple(value(spark, cell)) == (14, 3, 7)
    back = cycle.cycle_cell_of(F.lit(3), F.lit(7), week, 13, 26)
    assert tuple(value(spark, back)) == (0, 2)
    assert value(spark, cycle.cycle_cell_of(F.lit(1), F.lit(5), week, 13, 26)) is None


@pytest.mark.parametrize("visits,slots,low,high,reps", [(4058, 26, 20, 25, 7), (728, 24, 25, 30, 1), (2300, 24, 25, 30, 4), (0, 24, 25, 30, 1)])
def test_headcount(spark, visits, slots, low, high, reps):
    f = spark.createDataFrame([(visits, slots, low, high)], "v long, s int, lo int, hi int")
    row = market.choose_headcount(f, "v", "s", "lo", "hi").first()
    assert row.headcount.reps == reps
    assert 1 <= len(row.options) <= 6


@pytest.mark.parametrize("raw,key", [("Super Market", "supermarket"), ("mini-market", "minimarket"), ("Hyper", "hypermarket"), ("سوبر ماركت", "supermarket"),
                                     ("ميني ماركت", "minimarket"), ("Cash & Carry", "wholesale"), ("Newelneh", "kiosk"), ("GROCERY", "grocery"),
                                     ("SM", "supermarket"), ("Small", "other"), ("   ", None), (None, None), ("CAFÉ", "horeca")])
def test_channels(spark, raw, key):
    assert value(spark, text.classify_channel(F.lit(raw).cast("string"))) == key


@pytest.mark.parametrize("lat,lng,country,first", [(33.89, 35.5, "Lebanon", 1), (33.51, 36.29, "Syria", 6), (33.31, 44.37, "Iraq", 6), (25.2, 55.27, "UAE", 1),
                                                   (33.75, -84.39, None, 1), (34.43, 35.84, "Lebanon", 1)])
def test_working_week(spark, lat, lng, country, first):
    c = market.guess_country(F.lit(lat), F.lit(lng))
    assert value(spark, c) == country
    assert value(spark, market.week_of_country(c))[0] == first


def test_names(spark):
    sim = lambda a, b: value(spark, text.name_similarity(F.lit(a), F.lit(b)))
    assert sim("Al Noor Market", "Al Noor") == 1.0
    assert sim("الرايق", "الرايق اسبرسو") == 0.8
    assert sim("", "x") == 0.0
    assert 0 < sim("Cedars", "Cedras") < 1
    # Arabic shop words are no ASCII words and stay.
    assert "ماركت" in value(spark, text.normalise_name(F.lit("ماركت النور")))


def test_numbers(spark):
    assert value(spark, numbers.float_prefix(F.lit("33.5N"))) == 33.5
    assert value(spark, numbers.float_prefix(F.lit("abc"))) is None
    assert value(spark, numbers.int_prefix(F.lit("12 min"))) == 12
    assert value(spark, numbers.half_up(F.lit(-2.5))) == -2.0


def test_headers():
    assert uploads.header_key("﻿Outlet_Name ") == "outletname"
    tables = {"summary": type("T", (), {"columns": ["a"]}), "list": type("T", (), {"columns": ["GPS Lat", "GPS Lng"]})}
    assert uploads.pick_table(tables) == ("list", ["summary"])


def test_read_csv(spark, tmp_path):
    (tmp_path / "o.csv").write_text("﻿Outlet Name,Latitude,Longitude\nA,33.1,35.2\n\nB,33.2,35.3\n", encoding="utf-8")
    df = uploads.read_outlets_csv(spark, str(tmp_path / "o.csv"))
    assert df.columns == ["outletname", "latitude", "longitude"] and df.count() == 2


def test_null_distance_is_null(spark):
    none = F.lit(None).cast("double")
    assert value(spark, geo.haversine_km(none, F.lit(1.0), F.lit(1.0), F.lit(1.0))) is None
    assert abs(value(spark, geo.haversine_km(F.lit(33.0), F.lit(35.0), F.lit(34.0), F.lit(35.0))) - 111.19492664) < 1e-6


def test_river_crossing(spark):
    p = spark.createDataFrame([(33.35, 44.30, 33.35, 44.60), (33.35, 44.20, 33.35, 44.30)], "lat1 double, lng1 double, lat2 double, lng2 double")
    assert [r.n for r in p.select(roads.barrier_crossings(p, [("river", TIGRIS)]).alias("n")).collect()] == [1, 0]


def test_apportion(spark):
    p = spark.createDataFrame([(1, 1, 65.0), (1, 2, 59.0), (1, 3, 40.0), (2, 1, 100.0), (2, 2, 1.0), (2, 3, 1.0), (2, 4, 90.0)], "k int, piece int, load double")
    rows = {(r.k, r.piece): r.days for r in apportion_days(p, ["k"], F.when(F.col("k") == 1, 6).otherwise(4)).collect()}
    assert [rows[1, i] for i in (1, 2, 3)] == [2, 2, 2]
    # Four days for four pieces after 2 + 1 + 1 + 1: the piece with days to spare gives one back.
    assert [rows[2, i] for i in (1, 2, 3, 4)] == [1, 1, 1, 1]


def test_weeks_read_back_in_order(spark):
    s = spark.createDataFrame([(1, 1, w, d) for w in (1, 2) for d in (7, 1, 2, 3, 4)], "market_id int, rep_id int, week int, day_of_week int")
    row = schedule.recover_cycle(s).first()
    assert row.cycle_days == 10 and row.week == [7, 1, 2, 3, 4]
