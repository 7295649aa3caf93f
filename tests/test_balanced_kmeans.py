"""Balanced k-means: seeds, cheapest assignment inside the band, moved centres."""
import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from beatwise.operators import partition as pt

M = ["market_id"]
ROW = "market_id int, outlet_id long, latitude double, longitude double, weight double"


def km(a, b):
    (la, lo), (lb, lob) = a, b
    h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(lob - lo) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(h))


def test_prices_give_the_cheapest_assignment():
    r = random.Random(4)
    for low, high in ((2, 4), (3, 3), (0, 9), (2, 5)):
        d = np.array([[r.random() + (0.8 if g else 0.0) for g in range(3)] for _ in range(9)])
        price = pt._prices(d, np.ones(9), low, high, np.zeros(3))
        own = (d + price).argmin(axis=1)
        cost = lambda to: sum(d[i, g] for i, g in enumerate(to))
        fits = lambda to: all(low <= to.count(g) <= high for g in range(3))
        assert fits(own.tolist())
        assert cost(own) <= min(cost(to) for to in itertools.product(range(3), repeat=9) if fits(list(to))) + 1e-9


def test_groups_are_towns_where_the_band_allows(spark):
    # Towns of unequal size.
    r = random.Random(2)
    towns = [(33.5, 35.5, 60), (33.56, 35.9, 30), (33.9, 35.5, 30), (33.8, 35.95, 36)]
    rows, i = [], 0
    for m in (0, 1):
        for t, (la, lo, n) in enumerate(towns):
            for _ in range(n):
                rows.append((m, 10 * i + t, la + r.random() * 0.02, lo + m + r.random() * 0.02, 1.0))
                i += 1
    p = spark.createDataFrame(rows, ROW)
    out = pt.balanced_kmeans(p, M, F.lit(4), below=0.6, above=0.6).collect()
    assert len(out) == len(rows) and {(x.market_id, x.group, x.outlet_id % 10) for x in out} == {
        (m, g, t) for m in (0, 1) for g, t in {(x.group, x.outlet_id % 10) for x in out if x.market_id == m}}
    assert all(len({x.outlet_id % 10 for x in out if (x.market_id, x.group) == (m, g)}) == 1 for m in (0, 1) for g in range(4))


def test_assignment_is_cheapest_for_its_centres_and_in_the_band(spark, monkeypatch):
    # No two outlets of equal weight gain by a swap, and nearly all are settled outside the task that finds prices.
    monkeypatch.setattr(pt, "START_CELLS", 64, raising=False)
    r = random.Random(3)
    rows = [(0, i, 33.5 + r.random() ** 2 * 0.4, 35.5 + r.random() ** 3 * 0.4, float(r.choice([1, 2]))) for i in range(700)]
    rows += [(0, 1000 + i, 33.6, 35.6, 1.0) for i in range(60)]
    at = {x[1]: x[2:4] for x in rows}
    out = pt.balanced_kmeans(spark.createDataFrame(rows, ROW), M, F.lit(5), below=0.05, above=0.05).collect()
    load, mean = {}, sum(x[4] for x in rows) / 5
    for x in out:
        load[x.group] = load.get(x.group, 0) + x.weight
    assert len(out) == 760 and set(load) == set(range(5)) and all(0.95 * mean - 1e-9 <= v <= 1.05 * mean + 1e-9 for v in load.values())
    mid = {g: tuple(np.mean([at[x.outlet_id] for x in out if x.group == g], axis=0)) for g in load}
    gain = 0.0
    for a, b in itertools.combinations(range(5), 2):
        lead = lambda g, h: max(km(at[x.outlet_id], mid[g]) - km(at[x.outlet_id], mid[h]) for x in out if x.group == g)
        gain = max(gain, lead(a, b) + lead(b, a))
    # Centres are those before the last move, 5 m off at most unless distances stopped falling.
    assert gain < 0.5


def test_a_null_weight_and_rows_of_one_id_keep_their_rows(spark):
    rows = [(0, i // 2, 33.5 + 0.001 * (i // 2), 35.5, None if i < 4 else 1.0) for i in range(40)] + [(0, 99, None, 35.5, 1.0), (None, 98, 33.5, 35.5, 1.0)]
    out = pt.balanced_kmeans(spark.createDataFrame(rows, ROW), M, F.lit(3)).collect()
    assert sorted(x.outlet_id for x in out) == sorted(i // 2 for i in range(40)) and {x.group for x in out} == {0, 1, 2}
