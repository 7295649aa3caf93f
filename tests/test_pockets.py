"""Pockets go to the nearer core, are paid with outlets beside the giver's core, and loads are evened out."""
import random

from pyspark.sql import functions as F

from beatwise.operators import partition as pt

M = ["market_id"]
ROW = "market_id int, outlet_id long, latitude double, longitude double, weight double, group int"


def block(start, n, lat, lng, group, step=0.004):
    return [(0, start + i, lat + (i % 6) * step, lng + (i // 6) * step, 2.0, group) for i in range(n)]


def exchanged(spark, rows, band=0.1, hop=4.0):
    p = spark.createDataFrame(rows, ROW)
    out = pt.pocket_exchange(p.select(*M, "outlet_id", "group", "weight"), p, M, hop, below=band, above=band)
    return {r.outlet_id: r.group for r in out.collect()}


def test_pocket_is_paid_with_the_border_of_the_giver(spark):
    # A: 55 in the west and 10 inside B's area. B: 55 in the east and 10 beside A's core.
    rows = block(0, 55, 33.5, 36.2, 0) + block(100, 10, 33.503, 36.305, 0, 0.002) + block(200, 55, 33.5, 36.265, 1) + block(300, 10, 33.5, 36.24, 1, 0.002)
    got = exchanged(spark, rows, 0.05)
    assert len(got) == 130 and all(got[100 + i] == 1 for i in range(10)) and all(got[300 + i] == 0 for i in range(10))
    assert sum(g == 0 for g in got.values()) == 65


def test_payment_does_not_cut_the_receiver_apart(spark):
    # B hangs together by its outlets beside A's core: a line of three that leads to a village of its own.
    line = [(0, 400 + i, 33.5 + 0.03 * i, 36.265, 2.0, 1) for i in range(4)]
    village = block(500, 12, 33.61, 36.262, 1, 0.002)
    rows = block(0, 55, 33.5, 36.2, 0) + block(100, 3, 33.503, 36.345, 0, 0.002) + block(200, 55, 33.5, 36.29, 1) + line + village
    p = spark.createDataFrame(rows, ROW)
    comp = pt.components(p, [*M, "group"], 4.0)
    assert comp.filter("group = 1").select("component").distinct().count() == 1
    got = exchanged(spark, rows, 0.9)
    out = p.drop("group").join(spark.createDataFrame(list(got.items()), "outlet_id long, group int"), "outlet_id")
    assert all(got[100 + i] == 1 for i in range(3))
    assert pt.components(out, [*M, "group"], 4.0).filter("group = 1").select("component").distinct().count() == 1


def test_loads_are_evened_out_without_a_list_of_neighbours(spark):
    # East owns eight inside the west, and nothing of west's adjoins east: the middle passes load on.
    rows = block(0, 62, 33.5, 36.2, 0) + block(100, 60, 33.5, 36.248, 1) + block(200, 58, 33.5, 36.292, 2) + block(300, 8, 33.503, 36.205, 2, 0.002)
    got = exchanged(spark, rows, 0.05)
    size = [sum(g == k for g in got.values()) for k in range(3)]
    assert len(got) == 188 and all(got[300 + i] != 2 for i in range(8)) and max(size) <= 188 / 3 * 1.05 + 1e-9 and min(size) >= 188 / 3 * 0.95 - 1e-9


def test_gaps_to_cores_are_those_of_all_pairs(spark):
    r = random.Random(7)
    rows = [(i % 2, i, 33 + r.random() * 2, 35 + r.random() * 2, 1.0, i % 4) for i in range(240)]
    p = spark.createDataFrame(rows, ROW).withColumn("component", (F.col("outlet_id") % 5).cast("long"))
    pockets, cores = p.filter("component > 0"), p.filter("component = 0").drop("component")
    got = {(x.market_id, x.group, x.component): (x._own, x._b.other_km, x._b.h) for x in pt._core_gaps(pockets, cores, M).collect()}
    both = pockets.alias("a").join(cores.alias("b"), F.col("a.market_id") == F.col("b.market_id"))
    km = pt.haversine_km(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude"))
    want = both.withColumn("km", km).groupBy("a.market_id", "a.group", "component").agg(
        F.min(F.when(F.col("a.group") == F.col("b.group"), F.col("km"))).alias("own"), F.min(F.when(F.col("a.group") != F.col("b.group"), F.struct("km", "b.group"))).alias("b")).collect()
    assert got == {(x.market_id, x["group"], x.component): (x.own, x.b.km, x.b.group) for x in want}
