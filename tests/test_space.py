"""Spatial operators against brute force on small random fixtures."""
import math
import random

import pytest
from pyspark.sql import functions as F

from beatwise.operators import hulls, neighbours as nb, prefix, spots


def km(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (a[0], a[1], b[0], b[1]))
    x = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 12742 * math.asin(min(1, math.sqrt(x)))


def cloud(seed, n=90, keys=2):
    """Dense knots, co-located outlets, loose points and a few far ones."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.5:
            at = (33.5 + r.gauss(0, 0.01), 35.5 + r.gauss(0, 0.01))
        elif kind < 0.7:
            at = (33.6, 35.6)
        elif kind < 0.95:
            at = (33.5 + r.uniform(-0.4, 0.4), 35.5 + r.uniform(-0.4, 0.4))
        else:
            at = (r.uniform(-60, 60), r.uniform(-170, 170))
        rows.append((i % keys, i, i % 5, at[0], at[1]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "market_id int, outlet_id long, rep_id int, latitude double, longitude double")


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest(spark, seed):
    rows = cloud(seed)
    got = {}
    for r in nb.nearest(frame(spark, rows), frame(spark, rows), ["market_id"], 3).collect():
        got.setdefault(r.outlet_id, []).append((r["rank"], r.nbr_id, round(r.km, 6)))
    for m, i, _, la, lo in rows:
        want = sorted((round(km((la, lo), (b, c)), 6), j) for mm, j, _, b, c in rows if mm == m and j != i)[:3]
        assert [x[2] for x in sorted(got[i])] == pytest.approx([w[0] for w in want], abs=2e-6)


def test_nearest_of_another_group(spark):
    rows = cloud(3)
    got = {r.outlet_id: r.km for r in nb.nearest(frame(spark, rows), frame(spark, rows), ["market_id"], 1, differing="rep_id").collect()}
    for m, i, g, la, lo in rows:
        assert got[i] == pytest.approx(min(km((la, lo), (b, c)) for mm, j, gg, b, c in rows if mm == m and gg != g), abs=1e-6)


@pytest.mark.parametrize("seed,reach", [(4, 1.0), (5, 5.0), (6, 30.0)])
def test_components(spark, seed, reach):
    rows = cloud(seed, 120)
    parent = {i: i for _, i, *_ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and km(a[3:], b[3:]) <= reach:
                x, y = find(a[1]), find(b[1])
                parent[max(x, y)] = min(x, y)
    got = {r.outlet_id: r.component for r in nb.components(frame(spark, rows), ["market_id"], reach).collect()}
    assert got == {i: find(i) for _, i, *_ in rows}


def test_long_chain_is_one_component(spark):
    rows = [(0, i, 0, 33.0 + i * 0.0085, 35.5) for i in range(300)]
    got = {r.component for r in nb.components(frame(spark, rows), ["market_id"], 1.0).collect()}
    assert got == {0}


def test_outliers(spark):
    grid = [(0, r * 20 + c, 0, 33.80 + r * 0.0047, 35.48 + c * 0.005) for r in range(20) for c in range(20)]
    village = [(0, 1000 + i, 0, 34.05 + i * 0.001, 35.6) for i in range(6)]            # 18 km north: anchored
    chain = [(0, 1100 + k * 10 + i, 0, 34.24 + 0.2 * k + i * 0.0005, 35.6) for k in range(3) for i in range(6)]  # 22 km steps
    rome = [(0, 2000 + i, 0, 41.9, 12.5) for i in range(5)]
    libya = [(0, 3000, 0, 32.9, 13.2)]
    got = {r.outlet_id: r.gap_km for r in spots.geo_outliers(frame(spark, grid + village + chain + rome + libya), ["market_id"]).collect()}
    assert set(got) == {2000 + i for i in range(5)} | {3000}
    near = min(km((41.9, 12.5), g[3:]) for g in grid)
    assert got[2000] == pytest.approx(near, abs=0.06)
    assert spots.geo_outliers(frame(spark, rome + libya), ["market_id"]).count() == 0


def inside(ring, x, y):
    if len(ring) < 3:
        return False
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[-1:] + ring[:-1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            hit = not hit
    return hit


def test_overlap_share(spark):
    r = random.Random(9)
    rows = []
    for g in range(4):
        for i in range(25):
            rows.append((0, g * 100 + i, g, 33.5 + 0.02 * g + r.uniform(0, 0.05), 35.5 + r.uniform(0, 0.05)))
    rows += [(0, x[1], (x[2] + 1) % 4, x[3], x[4]) for x in rows[::9]]   # outlets on two routes
    groups = {g: {x[1]: (x[4], x[3]) for x in rows if x[2] == g} for g in range(4)}
    n = tot = 0
    for a, mine in groups.items():
        for o, (x, y) in mine.items():
            tot += 1
            for b, other in groups.items():
                if b == a or o in other:
                    continue
                own = [p for q, p in other.items() if not (set(mine) & set(other)) or q not in mine]
                if inside(hulls._chain(own), x, y):
                    n += 1
                    break
    for grid in (None, 0.01):
        got = hulls.overlap_share(frame(spark, rows), ["market_id"], "rep_id", grid).first()
        assert (got.inside, got.members) == (n, tot)


def test_order_statistics_and_running_total(spark):
    r = random.Random(3)
    rows = [(k, i, float(r.choice([1, 1, 1, 5, 1e6, r.random() * 100]))) for k in (1, 2) for i in range(101)]
    df = spark.createDataFrame(rows, "k int, i long, x double")
    got = prefix.order_statistics(df, ["k"], "x", {"q9": F.floor((F.col("n") - 1) * 0.9), **prefix.median_ranks("m")}, bins=16)
    for row in got.collect():
        xs = sorted(x for k, _, x in rows if k == row.k)
        assert (row.q9, row.m_low, row.m_high, row.n) == (xs[90], xs[50], xs[50], 101)
    run = prefix.running_total(df, ["k"], F.floor(F.col("i") / 7), ["i"], F.lit(1), "c", total="t")
    assert all(x.c == x.i + 1 and x.t == 101 for x in run.collect())


def test_previous_row_over_chunk_seams(spark):
    df = spark.range(1, 24).select(F.lit(1).alias("k"), F.col("id").alias("seq"), (F.col("id") * 10).alias("v"))
    got = {r.seq: r.p for r in prefix.with_previous(df, ["k"], "seq", {"p": "v"}, chunk=5).collect()}
    assert got == {i: (i - 1) * 10 if i > 1 else None for i in range(1, 24)}


def test_duplicate_groups(spark):
    rows = [(0, 1, "Shadi Market", 2, 33.5, 35.5), (0, 2, "shadi", 4, 33.5, 35.5), (0, 3, "Nut House", 1, 33.50004, 35.5), (0, 4, "بيت المكسرات", 1, 33.50004, 35.5),
            (0, 5, "Far Away", 1, 33.9, 35.9), (0, 6, "Cedar Shop", 2, 33.7, 35.7), (0, 7, "Cedar", 1, 33.7010, 35.7)]
    df = spark.createDataFrame(rows, "market_id int, outlet_id long, name string, vf int, latitude double, longitude double")
    got = {r.outlet_id: r for r in spots.duplicate_clusters(df, ["market_id"]).collect()}
    assert set(got) == {1, 2, 3, 4, 6, 7}
    assert got[1].group_id == got[2].group_id and got[1].confidence == "high" and got[2].keep and not got[1].keep
    assert got[3].kind == got[4].kind == "spot" and got[3].confidence == "high"
    assert got[6].group_id == got[7].group_id and got[6].confidence == "medium" and got[6].keep


def first_fit(names, alike):
    groups = []
    for n in names:
        g = next((g for g in groups if alike(g[0], n)), None)
        g.append(n) if g else groups.append([n])
    return {n: g[0] for g in groups for n in g}


def test_first_fit_groups_by_walk(spark):
    rng, nodes, edges, want = random.Random(8), [], [], {}
    for key, n, share in ((0, 60, 0.05), (1, 60, 0.3), (2, 40, 0.9), (3, 30, 0.0)):
        near = {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < share}
        want |= {(key, i): l for i, l in first_fit(range(n), lambda a, b: (a, b) in near).items()}
        nodes += [(key, i) for i in range(n)]
        edges += [(key, i, j) for i, j in near]
    # A chain: every second node leads, however long it is.
    nodes += [(4, i) for i in range(50)]
    edges += [(4, i, i + 1) for i in range(49)]
    want |= {(4, i): i - i % 2 for i in range(50)}
    got = spots.first_fit_groups(spark.createDataFrame(nodes, "market_id int, node long"), spark.createDataFrame(edges, "market_id int, src long, dst long"), ["market_id"])
    assert {(r.market_id, r.node): r.leader for r in got.collect()} == want


def test_names_group_with_the_first_alike(spark):
    # Middle name alike both ends, the ends not alike: the last stays out of the group of the first.
    names = ["alpha beta", "beta alpha gamm", "gamm delta epsi"]
    df = spark.createDataFrame([(0, i, n, 1, 33.5 + i * 1e-6, 35.5) for i, n in enumerate(names)], "market_id int, outlet_id long, name string, vf int, latitude double, longitude double")
    from beatwise.functions import text
    score = df.alias("a").join(df.alias("b"), F.expr("a.outlet_id < b.outlet_id")).select(F.col("a.outlet_id"), F.col("b.outlet_id"), text.name_similarity(F.col("a.name"), F.col("b.name"))).collect()
    alike = {(r[0], r[1]): r[2] >= 0.6 for r in score}
    want = first_fit(range(3), lambda a, b: alike[(a, b)])
    got = {r.outlet_id: r.group_id for r in spots.duplicate_clusters(df, ["market_id"]).filter("kind = 'name'").collect()}
    assert got == {i: l for i, l in want.items() if list(want.values()).count(l) > 1}


def test_hot_spot_stays_linear(spark):
    """Thousands of outlets on one position are one row each in the result, and never paired with each other."""
    df = spark.range(4000).select(F.lit(0).alias("market_id"), F.col("id").alias("outlet_id"), F.lit(0).alias("rep_id"), F.lit(33.5).alias("latitude"), F.lit(35.5).alias("longitude"))
    df = df.union(spark.range(1).select(F.lit(0), F.lit(9999).cast("long"), F.lit(0), F.lit(33.50005), F.lit(35.5)))
    assert nb.within_km_join(df, ["market_id"], 0.05).count() == 1
    near = nb.nearest(df, df, ["market_id"], 2)
    assert near.count() == 2 * 4001 and near.filter("outlet_id < 4000 and km > 0").count() == 0
    assert {r.component for r in nb.components(df, ["market_id"], 0.05).collect()} == {0}


def test_group_gaps(spark):
    rows = cloud(11, 150, 1)
    got = {(r.a, r.b): r.gap_km for r in spots.group_gap_km(frame(spark, rows), ["market_id"], "rep_id", 5.0).collect()}
    want = {}
    for x in rows:
        for y in rows:
            if x[2] < y[2]:
                d = km(x[3:], y[3:])
                want[x[2], y[2]] = min(d, want.get((x[2], y[2]), 1e9))
    want = {k: v for k, v in want.items() if v <= 5.0}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    apart = [(0, i, i % 3, 33.5 + 0.03 * (i % 3) + 0.0007 * (i % 11), 35.5 + 0.0009 * (i % 7)) for i in range(90)]
    got = {(r.a, r.b): r.gap_km for r in spots.group_gap_km(frame(spark, apart), ["market_id"], "rep_id", 5.0).collect()}
    for a, b in ((0, 1), (1, 2), (0, 2)):
        d = min(km(x[3:], y[3:]) for x in apart for y in apart if x[2] == a and y[2] == b)
        assert got.get((a, b)) == (pytest.approx(d, abs=1e-6) if d <= 5 else None)


def test_cells_in_reach_spread_nine_times_and_shuffled(spark):
    cells = [(y, x) for y in range(-6, 7) for x in range(-9, 10, 2)]
    cell = lambda e: spark.createDataFrame([(0, y, x) for y, x in cells], f"market_id long, y{e} long, x{e} long")
    met = spots._cells_in_reach(cell("a"), cell("b"), ["market_id"], 5, 7)
    got = sorted((r.ya, r.xa, r.yb, r.xb) for r in met.collect())
    assert got == sorted((*a, *b) for a in cells for b in cells if abs(a[0] - b[0]) <= 5 and abs(a[1] - b[1]) <= 7)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
