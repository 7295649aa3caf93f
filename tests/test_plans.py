"""Invariants of partitions, routes, plans and their repair."""
import random

import pytest
from pyspark.sql import functions as F

from beatwise.operators import partition as pt
from beatwise.operators import route_metrics as rm
from beatwise.operators import routes as rt
from beatwise.params import Band, PlanSettings
from beatwise.plans import build, cuts, keep_days
from beatwise.sources import testdata as td

SF = "/root/testdata/sf0.001"
M = ["market_id"]


def points(spark, n=120, keys=1, seed=1):
    r = random.Random(seed)
    rows = [(i % keys, i, 33.5 + r.random() * 0.1, 35.5 + r.random() * 0.1, float(r.choice([1, 2, 4]))) for i in range(n)]
    return spark.createDataFrame(rows, "market_id int, outlet_id long, latitude double, longitude double, weight double")


def loads(state, name="group"):
    return [r.load for r in state.groupBy("market_id", name).agg(F.sum("weight").alias("load")).collect()]


def test_hilbert_partition_is_even(spark):
    p = pt.hilbert_partition(points(spark, 400), M, F.lit(8))
    ls = loads(p)
    assert p.count() == 400 and len(ls) == 8 and max(ls) - min(ls) <= 8


def test_line_split_keeps_band(spark):
    parts = pt.line_split(points(spark, 140, 2), M, 5, below=0.2, above=0.2)
    assert parts.select("outlet_id").distinct().count() == parts.count() == 140
    ls = loads(parts, "part")
    mean = sum(ls) / len(ls)
    assert len(ls) == 10 and max(ls) < 1.45 * mean and min(ls) > 0.55 * mean


def test_zones_to_days_gives_exactly_the_days(spark):
    many = points(spark, 120).withColumn("zone_id", F.col("outlet_id") % 40)
    few = points(spark, 60, seed=2).withColumn("market_id", F.lit(7)).withColumn("outlet_id", F.col("outlet_id") + 1000).withColumn("zone_id", F.lit(0).cast("long"))
    tight = points(spark, 30, seed=3).withColumn("market_id", F.lit(8)).withColumn("outlet_id", F.col("outlet_id") + 2000).withColumn("zone_id", F.col("outlet_id"))
    out = pt.zones_to_days(many.unionByName(few).unionByName(tight), M, 6, 60.0).cache()
    assert out.select("outlet_id").distinct().count() == out.count() == 210
    assert {r.market_id: r.z for r in out.groupBy("market_id").agg(F.count_distinct("zone_id").alias("z")).collect()} == {0: 6, 7: 6, 8: 6}


def test_zones_fit_their_caps(spark):
    p = points(spark, 60).withColumn("zone_id", F.lit(3).cast("long"))
    split = pt.split_oversized_zones(p, M, 3.0).cache()
    assert pt._radius(split, M).agg(F.max("radius_km")).first()[0] <= 3.0 and split.count() == 60
    merged = pt.merge_undersized_zones(split.withColumn("offset", F.col("outlet_id") == 5), M, 12, 40, 5.0).cache()
    size = merged.groupBy(*M, "zone_id").count().collect()
    assert merged.count() == 60 and len(size) < split.select(*M, "zone_id").distinct().count() and max(r["count"] for r in size) <= 40
    own = lambda z: {r.outlet_id for r in z.join(z.filter("outlet_id = 5").select("market_id", "zone_id"), ["market_id", "zone_id"]).collect()}
    assert own(merged) == own(split)


def test_pieces_share_the_days(spark):
    # A core, a pocket that is a day of its own, and two loose outlets that are not.
    rows = [(0, 1, i, 33.5 + 0.002 * (i % 10), 35.5 + 0.002 * (i // 10), 1.0) for i in range(80)]
    rows += [(0, 1, 100 + i, 33.8 + 0.002 * (i % 5), 35.5 + 0.002 * (i // 5), 1.0) for i in range(20)] + [(0, 1, 200, 33.9, 35.5, 1.0), (0, 1, 201, 33.3, 35.5, 1.0)]
    o = spark.createDataFrame(rows, "market_id int, rep_id long, outlet_id long, latitude double, longitude double, weight double")
    members, pieces = cuts.pieces_and_days(o, ["market_id", "rep_id"], 5, Band(15, 25), 4.0)
    of = {r.outlet_id: r.piece for r in members.collect()}
    assert of[200] == of[100] != of[0] == of[201]
    assert sorted((r.load, r.days) for r in pieces.collect()) == [(21.0, 1), (81.0, 4)]
    groups = cuts.best_cut(o.join(members, ["market_id", "rep_id", "outlet_id"]).join(pieces.select("market_id", "rep_id", "piece", F.col("days").alias("k")), ["market_id", "rep_id", "piece"]),
                           ["market_id", "rep_id", "piece"], Band(15, 25), 4.0, 0.75, 4)
    load = sorted(r["count"] for r in groups.groupBy("piece", "group").count().collect())
    assert sum(load) == 102 and len(load) == 5 and load[0] >= 15 and load[-1] <= 25

def test_moves_keep_every_outlet_and_improve(spark):
    p = points(spark, 90)
    graph = pt.neighbour_graph(p, M)
    start = p.withColumn("group", F.when(F.col("latitude") < 33.53, 0).when(F.col("latitude") < 33.58, 1).otherwise(2).cast("int")).select("market_id", "outlet_id", "group", "weight")
    even = pt.repair_loads(start, graph, M, 0.05, 0.05, 4.0).cache()
    spread = lambda s: max(loads(s)) - min(loads(s))
    assert even.count() == 90 and spread(even) < spread(start)
    mean = sum(loads(start)) / 3
    tidy = pt.cohesion_moves(even, graph, M, 0.1, 0.1).cache()
    assert tidy.count() == 90 and max(loads(tidy)) <= max(1.1 * mean, max(loads(even)))
    swapped = pt.compact_swaps(even, p, graph, M)
    assert sorted(loads(swapped)) == sorted(loads(even))
    km = pt.balanced_kmeans(p, M, F.lit(4), rounds=2).cache()
    assert km.count() == 90 and len(loads(km)) == 4


def length(df):
    return rm.route_legs(df, ["market_id"]).agg(F.sum("leg_km").alias("km")).first()["km"]


def test_rounds_gain_what_they_say(spark):
    p = rt.curve_order(points(spark, 50), M)
    for candidates, apply in ((rt.two_opt_candidates, rt.two_opt_round), (rt.or_opt_candidates, rt.or_opt_round)):
        cur = p
        for _ in range(2):
            gain = candidates(cur, M).agg(F.max("gain").alias("g")).first()["g"]
            nxt = apply(cur, M)
            nxt = spark.createDataFrame(nxt.select("market_id", "outlet_id", "latitude", "longitude", "seq").collect(), "market_id int, outlet_id long, latitude double, longitude double, seq int")
            assert sorted(r.seq for r in nxt.collect()) == list(range(1, 51))
            if gain > 1e-9:
                assert length(cur) - length(nxt) == pytest.approx(gain, abs=1e-6)
            cur = nxt


def test_order_is_shorter_and_whole(spark):
    p = points(spark, 200, 1)
    start = rt.curve_order(p, M)
    best = rt.order_stops(p, M)
    assert sorted(r.seq for r in best.collect()) == list(range(1, 201))
    assert length(best) < length(start)
    street = spark.createDataFrame([(0, i, 33.5 + 0.001 * x, 35.5) for i, x in enumerate([3, 0, 4, 1, 2])], "market_id int, outlet_id long, latitude double, longitude double")
    assert length(rt.order_stops(street, M)) == pytest.approx(0.4448, abs=1e-3)


def test_cheapest_slot(spark):
    s = spark.createDataFrame([(0, i, i + 1, 33.5 + 0.001 * i, 35.5) for i in range(5)], "market_id int, outlet_id long, seq int, latitude double, longitude double")
    new = spark.createDataFrame([(0, 50, 33.4995, 35.5), (0, 51, 33.5025, 35.5), (0, 52, 33.5055, 35.5)], "market_id int, outlet_id long, latitude double, longitude double")
    at = {r.outlet_id: r.at for r in rt.cheapest_insertion(s, new, M).collect()}
    assert at == {50: 1, 51: 4, 52: 6}


SETTINGS = PlanSettings(band=Band(4, 8))
#: The searched plan is compared with SQL in test_registered.
DRAFT = PlanSettings(band=Band(4, 8), search=False)


def test_plan_covers_every_visit(spark):
    o = td.outlets(spark, SF).filter("not excluded and not offset")
    plan = build.build_plan(o, F.lit(2), DRAFT, plan_days=21).cache()
    n = {r.outlet_id: r.n for r in plan.filter("week <= 4").groupBy("outlet_id").agg(F.count("*").alias("n")).collect()}
    assert n == {r.outlet_id: r.vf for r in o.collect()}
    assert plan.filter("week = 5").count() == plan.filter("week = 1 and day_of_week = 1").count()
    assert plan.groupBy("outlet_id").agg(F.count_distinct("rep_id").alias("r")).filter("r > 1").count() == 0


def test_two_run_cycle_uses_second_days(spark):
    o = td.outlets(spark, SF).filter("not excluded and not offset").withColumn("rep_id", F.lit(1)).withColumn("market_id", F.lit(0))
    members = build.day_plan(o, PlanSettings(week=(1, 2, 3, 4, 5, 6), repeats=2, day_groups=6, band=Band(4, 12), search=False))
    v = {r.outlet_id: r.v for r in members.groupBy("outlet_id").agg(F.sum("visits").alias("v")).collect()}
    assert v == {r.outlet_id: r.vf for r in o.collect()}
    assert members.groupBy("outlet_id", "day_group").count().filter("count > 1").count() == 0


def test_relief_lowers_overtime(spark):
    rows = []
    for d in range(2):
        for i in range(12 if d == 0 else 4):
            for run in (1, 2, 3, 4):
                rows.append((0, 1, d, run, i + 1, d * 100 + i, 33.5 + 0.001 * (i + 12 * d), 35.5, 45, 4, 0))
    s = spark.createDataFrame(rows, "market_id int, rep_id int, day_group int, run int, seq int, outlet_id long, latitude double, longitude double, call_minutes int, visits int, bucket int")
    st = PlanSettings(day_groups=2, band=Band(2, 14))
    before = {(r.day_group, r.run): r.minutes for r in keep_days.day_loads(s).collect()}
    done = keep_days.relieve_overloaded_days(s, st)
    after = {(r.day_group, r.run): r.minutes for r in keep_days.day_loads(done).collect()}
    assert max(after.values()) < max(before.values()) and done.count() == len(rows)
    assert done.groupBy("outlet_id").agg(F.count_distinct("day_group").alias("g")).filter("g > 1").count() == 0
    pinned = spark.createDataFrame([(i,) for i in range(12)], "outlet_id long")
    kept = keep_days.relieve_overloaded_days(s, st, pinned=pinned)
    assert kept.filter("day_group = 0").count() == 48


def test_relief_of_forty_moves(spark):
    # Four long days of 30 calls, sixteen of 6: about forty moves are needed, and all days end within the shift.
    rows = [(0, 1, d, run, i + 1, d * 1000 + run * 100 + i, 33.5 + 0.0001 * i, 35.5 + 0.0001 * d + 0.00001 * run, 20, 1, run - 1) for d in range(5) for run in (1, 2, 3, 4) for i in range(30 if d == 0 else 6)]
    s = spark.createDataFrame(rows, "market_id int, rep_id int, day_group int, run int, seq int, outlet_id long, latitude double, longitude double, call_minutes int, visits int, bucket int")
    st = PlanSettings(band=Band(2, 70))
    done = keep_days.relieve_overloaded_days(s, st).cache()
    after = keep_days.day_loads(done).collect()
    assert max(r.minutes for r in after) <= 480 and len(after) == 20 and done.select("outlet_id").distinct().count() == done.count() == len(rows)
    assert done.join(s.select("outlet_id", F.col("day_group").alias("d"), F.col("run").alias("r")), "outlet_id").filter("d <> day_group or r <> run").count() >= 36


def test_relief_chooses_the_moves_of_a_rep_in_few_steps(spark, monkeypatch):
    rows = [(0, rep, d, run, i + 1, rep * 10000 + d * 1000 + i, 33.5 + 0.0001 * i, 35.5 + 0.0001 * d, 20, 4, 0) for rep in (1, 2) for d in range(5) for i in range(30 if d < 2 else 6) for run in (1, 2, 3, 4)]
    s = spark.createDataFrame(rows, "market_id int, rep_id int, day_group int, run int, seq int, outlet_id long, latitude double, longitude double, call_minutes int, visits int, bucket int")
    st = PlanSettings(band=Band(2, 70))
    written, cut = [], keep_days.cut
    monkeypatch.setattr(keep_days, "cut", lambda df: written.append(1) or cut(df))
    go, _ = keep_days.relief_moves(s, keep_days._judged(s, st, None), st)
    assert go.count() > 0 and len(written) <= 5


def test_small_keys_are_cut_as_large_ones(spark, monkeypatch):
    p = points(spark, 160, 2).withColumn("k", F.when(F.col("market_id") == 0, 5).otherwise(2))
    twice = p.filter("outlet_id % 13 = 0")
    for df in (p, p.unionByName(twice), p.withColumn("latitude", F.when(F.col("outlet_id") % 20 != 0, F.col("latitude")))):
        found = []
        for rows in (8192, 0):
            monkeypatch.setattr(pt, "LINE_ROWS", rows)
            found.append(sorted((r.market_id, r.outlet_id, r.part) for r in pt.line_split(df, M, F.col("k")).collect()))
        assert found[0] == found[1] and len({x[2] for x in found[0] if x[0] == 0}) == 5


def test_wide_zones_are_cut_in_few_steps(spark, monkeypatch):
    # Clusters at growing gaps come off one by one, so there are many levels.
    rows = [(0, 10 * i + j, 33.5, 35.5 + 0.01 * i * i + 0.0001 * j, 3) for i in range(9) for j in range(4)]
    z = spark.createDataFrame(rows, "market_id int, outlet_id long, latitude double, longitude double, zone_id int")
    written, cut = [], pt.cut
    monkeypatch.setattr(pt, "cut", lambda df: written.append(1) or cut(df))
    out = pt.split_oversized_zones(z, M, 0.3).collect()
    zones = {(r.zone_id, r.outlet_id // 10) for r in out}
    ids = {z for z, _ in zones}
    assert len(out) == len({r.outlet_id for r in out}) == 36 and {i for _, i in zones} == set(range(9))
    # No zone reaches over two clusters, and ids go on from the zone's own without a gap.
    assert len(ids) == len(zones) and ids == set(range(3, 3 + len(ids)))
    assert len(written) <= 4


def test_small_keys_are_cut_without_strips(spark):
    out = pt.line_split(points(spark, 160, 2), M, 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_strip" not in plan and out.count() == 160


def test_one_round_of_relief_shares_no_day(spark):
    rows = [(0, rep, d, run, i + 1, rep * 10000 + d * 1000 + i, 33.5 + 0.0001 * i, 35.5 + 0.0001 * d, 20, 4, 0) for rep in (1, 2) for d in range(5) for i in range(30 if d < 2 else 6) for run in (1, 2, 3, 4)]
    s = spark.createDataFrame(rows, "market_id int, rep_id int, day_group int, run int, seq int, outlet_id long, latitude double, longitude double, call_minutes int, visits int, bucket int")
    st = PlanSettings(band=Band(2, 70))
    judged = keep_days._judged(s, st, None)
    go, _ = keep_days.relief_moves(s, judged, st)
    moves = go.collect()
    for rep in (1, 2):
        days = [(m.day_group, r) for m in moves if m.rep_id == rep for r in m.give] + [(m.d2, r) for m in moves if m.rep_id == rep for r in m.recv]
        assert len(days) == len(set(days)) == 16 and len({m.outlet_id for m in moves}) == len(moves)
    cost = lambda f: keep_days._judged(f, st, None).agg(F.sum("cost")).first()[0]
    gain = -sum(m["rank"]["g"] for m in moves)
    assert cost(s) - cost(keep_days.relieve_overloaded_days(s, st, rounds=1)) == pytest.approx(gain, abs=1e-3)

def test_keep_days_changes_only_what_it_must(spark):
    o = td.outlets(spark, SF).filter("not excluded and not offset and outlet_id % 89 <> 5")
    stops = td.stops(spark, SF)
    same = build.replan_keep_days(o, stops, PlanSettings(band=Band(0, 50)), compare=False)
    at = lambda df: {(r.outlet_id, r.week, r.day_of_week) for r in df.collect()}
    assert at(same) == at(stops)
    gone = build.replan_keep_days(o.filter("outlet_id <> 10"), stops, PlanSettings(band=Band(0, 50)), compare=False)
    assert at(gone) == {x for x in at(stops) if x[0] != 10}


def test_pins_keep_visit_count(spark):
    stops = td.stops(spark, SF)
    o = stops.filter("vf = 4").first()
    pins = spark.createDataFrame([(o.rep_id, o.outlet_id, 2, o.day_of_week % 5 + 1), (-5, 1, 1, 1)], "rep_id long, outlet_id long, week int, day_of_week int")
    live = stops.filter((F.col("rep_id") == o.rep_id) & (F.col("week") == 2) & (F.col("day_of_week") == o.day_of_week % 5 + 1)).count()
    done = keep_days.place_pins(stops, pins, td.outlets(spark, SF))
    assert done.count() == stops.count()
    if live:
        assert done.filter((F.col("outlet_id") == o.outlet_id) & (F.col("day_of_week") == o.day_of_week % 5 + 1)).count() >= 1
    cells = done.groupBy("rep_id", "week", "day_of_week").agg(F.max("seq").alias("m"), F.count("*").alias("n"))
    assert cells.filter("m <> n").count() == 0


def test_single_rounds_reach_over_the_whole_route(spark):
    line = lambda at: spark.createDataFrame([(0, i, p, 33.5, 35.5 + 0.001 * x) for p, (i, x) in enumerate(at, 1)],
                                            "market_id int, outlet_id long, seq int, latitude double, longitude double")
    row = [(i, float(i)) for i in range(100)]
    turned = line(row[:39] + row[39:90][::-1] + row[90:])
    assert [r.outlet_id for r in rt.two_opt_round(turned, M).orderBy("seq").collect()] == list(range(100))
    strayed = line(row[:10] + row[11:80] + [row[10]] + row[80:])
    assert [r.outlet_id for r in rt.or_opt_round(strayed, M).orderBy("seq").collect()] == list(range(100))


def counted(df, spark):
    """The frame with a column that counts how often its rows are made."""
    made = spark.sparkContext.accumulator(0)

    def one(x):
        made.add(1)
        return x

    return df.withColumn("latitude", F.udf(one, "double").asNondeterministic()("latitude")), made


def test_rounds_read_the_points_a_fixed_number_of_times(spark):
    p = points(spark, 90)
    graph = pt.neighbour_graph(p, M)
    striped = p.withColumn("group", (F.col("outlet_id") % 3).cast("int")).select("market_id", "outlet_id", "group", "weight")
    for run in (lambda df, n: pt.balanced_kmeans(df, M, F.lit(4), below=0.5, above=0.5, rounds=n), lambda df, n: pt.compact_swaps(striped, df, graph, M, n)):
        reads = []
        for n in (1, 3):
            df, made = counted(p, spark)
            assert run(df, n).count() == 90
            reads.append(made.value)
        assert reads[0] == reads[1]


def test_a_round_swaps_all_that_gain(spark):
    # Two towns, each with ten outlets of the other's group.
    rows = [(0, i, 33.5 + 0.05 * (i // 40) + 0.001 * (i % 8), 35.5 + 0.001 * (i // 8 % 5), 1.0) for i in range(80)]
    p = spark.createDataFrame(rows, "market_id int, outlet_id long, latitude double, longitude double, weight double")
    home = F.floor(F.col("outlet_id") / 40).cast("int")
    start = p.withColumn("group", F.when(F.col("outlet_id") % 4 == 0, 1 - home).otherwise(home)).select("market_id", "outlet_id", "group", "weight")
    out = pt.compact_swaps(start, p, pt.neighbour_graph(p, M), M, rounds=1).withColumn("home", home)
    assert out.filter("group = home").count() == 80


def test_joins_of_outlets_in_rounds_are_shuffled(spark, monkeypatch):
    from beatwise.operators import neighbours as nb
    p = points(spark, 90)
    graph = pt.neighbour_graph(p, M)
    state = p.withColumn("group", F.lit(1)).select("market_id", "outlet_id", "group", "weight")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(pt._touching(state, graph, M))
    plans, cut = [], nb.cut
    monkeypatch.setattr(nb, "cut", lambda df: plans.append(plan(df)) or cut(df))
    assert nb.nearest(p, p, M, 2).count() == 180
    assert len(plans) > 2 and not any("Broadcast" in x for x in plans)


def test_arrivals_read_the_points_a_fixed_number_of_times(spark):
    from beatwise.params import PlanSettings
    from beatwise.plans import keep_days
    rows = [(0, 1, i, 33.5 + 0.001 * i, 35.5, 4, i % 5, 0) for i in range(40)]
    every = spark.createDataFrame(rows, "market_id int, rep_id long, outlet_id long, latitude double, longitude double, visits int, day_group int, bucket int")
    reads = []
    for new in (1, 4):
        df, made = counted(every, spark)
        arrive = every.filter(F.col("outlet_id") >= 40 - new).select("market_id", "rep_id", "outlet_id", "visits")
        placed = keep_days.place_arrivals(every.filter(F.col("outlet_id") < 40 - new), arrive, df, PlanSettings(band=Band(1, 2)))
        assert placed.count() == 40
        reads.append(made.value)
    assert reads[0] == reads[1]
