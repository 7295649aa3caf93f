"""Day figures with known roads."""
import pytest

from beatwise.operators.roads import road_pairs_from_matrix
from beatwise.operators.route_metrics import road_legs, route_legs, scorecard_days
from beatwise.params import Workday


def test_known_roads_change_km_and_minutes_of_their_legs_only(spark):
    wd = Workday()
    stops = spark.createDataFrame([(1, 1, 1, d, i + 1, 24.0 + i / 100, 46.0, 10) for d in (1, 2) for i in range(3)],
                                  "market_id int, rep_id int, week int, day_of_week int, seq int, latitude double, longitude double, call_minutes int")
    stops = stops.union(stops.filter("seq = 1 and day_of_week = 1").selectExpr("market_id", "rep_id", "week", "3", "seq", "latitude", "longitude", "call_minutes"))
    matrix = spark.createDataFrame([(24.01, 46.0, 24.0, 46.0, 7.0, 9.0), (24.0, 46.0, 24.01, 46.0, 8.0, 5.0)], "lat1 double, lng1 double, lat2 double, lng2 double, km double, minutes double")
    pairs = road_pairs_from_matrix(matrix)
    legs = road_legs(stops, pairs)
    assert legs.count() == stops.count() and legs.filter("road_km is not null").count() == 2
    leg = route_legs(stops).filter("day_of_week = 1 and seq = 3").first()["leg_km"]
    days = {r["day_of_week"]: r for r in scorecard_days(legs, wd).collect()}
    assert days[1]["km"] == pytest.approx(7.0 + leg * wd.detour) and days[2]["km"] == days[1]["km"]
    assert days[1]["drive_min"] == pytest.approx(9.0 * wd.road_time_factor + leg * wd.detour / wd.speed_kmh * 60)
    assert days[1]["total_min"] == pytest.approx(days[1]["drive_min"] + 30 + wd.commute + wd.pause)
    assert days[3]["km"] == 0 and days[3]["drive_min"] == 0
    plain = {r["day_of_week"]: r for r in scorecard_days(route_legs(stops), wd).collect()}
    assert plain[1]["km"] < days[1]["km"] and plain[1]["longest_km"] == days[1]["longest_km"]
    none = {r["day_of_week"]: r for r in scorecard_days(road_legs(stops, pairs.filter("false")), wd).collect()}
    assert none[1]["drive_min"] == pytest.approx(plain[1]["drive_min"])
