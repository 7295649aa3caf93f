"""Transfers between reps against a walk along the line of work."""
import math

from beatwise.operators.forecast import imbalance, transfer_recommendations

SCHEMA = "market_id int, rep_id bigint, outlet_id bigint, predicted double, confidence double, growth double"


def walk(rows, high, low, target, cap):
    out = set()
    for market in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == market and r[3] is not None]
        load = {}
        for r in mine:
            load[r[1]] = load.get(r[1], 0) + r[3] / 4
        offers = []
        for rep in load:
            if load[rep] > high:
                best = sorted((-((r[5] or 0) + r[3] / 4), r[2], r[3] / 4, rep) for r in mine if r[1] == rep)
                offers += best[:math.ceil((load[rep] - target) / 3)]
        line, at = [], 0.0
        for rep in sorted((r for r in load if load[r] < min(low, cap)), key=lambda r: (load[r], r)):
            line.append((at, at + cap - load[rep], rep))
            at += cap - load[rep]
        at = 0.0
        for _, outlet, work, rep in sorted(offers):
            held = [s for s in line if s[0] <= at]
            if held and at + work <= held[-1][1]:
                out.add((market, outlet, rep, held[-1][2]))
            at += work
    return out


def test_transfers_equal_a_walk(spark):
    # Work comes in eighths, so sums are exact. Market 1 holds most rows; 2 has no receiver, 3 no giver.
    rows = [(1, rep, rep * 1000 + i, ((rep * 7 + i * 13) % 40) / 2 + (18 if rep % 3 else 0), 0.5, ((i * 5) % 8) / 8 if i % 4 else None)
            for rep in range(60) for i in range(9 if rep % 3 else 3)]
    rows += [(2, 100, 100_000 + i, 40.0, 0.5, None) for i in range(6)] + [(3, 200 + i, 200_000 + i, 4.0, 0.5, 0.0) for i in range(3)]
    rows += [(1, 1, 999_999, None, 0.5, None), (1, 300, 300_000, 0.0, 0.5, None)]
    forecast = spark.createDataFrame(rows, SCHEMA)
    got = transfer_recommendations(forecast, 25.0, 12.0, 20.0, 23.0)
    found = {(r["market_id"], r["outlet_id"], r["from_rep_id"], r["to_rep_id"]) for r in got.collect()}
    assert len(found) > 10 and found == walk(rows, 25.0, 12.0, 20.0, 23.0)
    spread = {r["market_id"]: r for r in imbalance(forecast, got).collect()}
    assert spread[1]["after"] < spread[1]["before"] and spread[3]["after"] == spread[3]["before"]


def test_no_receiver_has_room_under_a_low_cap(spark):
    rows = [(1, 1, i, 40.0, 0.5, None) for i in range(9)] + [(1, 2, 50, 4 * 11.0, 0.5, None)]
    forecast = spark.createDataFrame(rows, SCHEMA)
    assert transfer_recommendations(forecast, 25.0, 12.0, 20.0, 10.0).count() == 0
    assert transfer_recommendations(forecast.filter("false")).count() == 0
