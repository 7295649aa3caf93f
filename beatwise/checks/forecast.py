"""Forecasts on the order history and their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from beatwise.checks.sql import HISTORY, OUTLETS
from beatwise.functions.numbers import six
from beatwise.operators import forecast as fc
from beatwise.sources import testdata as td

QUERIES, SQL = {}, {}
c = F.col


def rounded(df, *names):
    for n in names:
        df = df.withColumn(n, six(c(n)))
    return df


POINTS = f"""{HISTORY}, pts AS (SELECT *, row_number() OVER (PARTITION BY outlet_id ORDER BY day, visit_id) - 1 AS x, count(*) OVER (PARTITION BY outlet_id) AS n FROM history),
reg AS (SELECT outlet_id, max(n) AS n, CASE WHEN var_pop(n_visits) > 0 THEN regr_slope(n_visits, x) END AS slope, CASE WHEN var_pop(n_visits) > 0 THEN regr_intercept(n_visits, x) END AS intercept,
  CASE WHEN var_pop(n_visits) > 0 THEN greatest(0, regr_r2(n_visits, x)) END AS r2 FROM pts WHERE n >= 10 GROUP BY 1)"""
QUERIES["demand_regression"] = lambda spark, sf: rounded(fc.demand_regression(fc.indexed(td.history(spark, sf))), "slope", "intercept", "r2")
SQL["demand_regression"] = f"WITH {POINTS} SELECT outlet_id, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2 FROM reg"
QUERIES["seasonal_profile"] = lambda spark, sf: rounded(fc.seasonal_profile(td.history(spark, sf)), "season")
SQL["seasonal_profile"] = f"WITH {HISTORY} SELECT outlet_id, CAST(month(day) AS INTEGER) AS month, round(avg(n_visits), 6) AS season FROM history GROUP BY ALL"
TREND = """tr AS (SELECT outlet_id, (avg(n_visits) FILTER (x >= n // 2) - avg(n_visits) FILTER (x < n // 2)) / avg(n_visits) FILTER (x < n // 2) AS growth, stddev_pop(n_visits) / avg(n_visits) AS volatility FROM pts WHERE n >= 12 GROUP BY 1)"""
QUERIES["trend_volatility"] = lambda spark, sf: rounded(fc.trend_volatility(fc.indexed(td.history(spark, sf)), 12), "growth", "volatility")
SQL["trend_volatility"] = f"WITH {POINTS}, {TREND} SELECT outlet_id, round(growth, 6) AS growth, round(volatility, 6) AS volatility FROM tr"


def _forecast(spark, sf):
    return fc.demand_forecast(td.outlets(spark, sf).filter("not excluded"), td.history(spark, sf), 3, 30, 10, 12)


FORECAST = f"""{OUTLETS}, {POINTS}, {TREND}, se AS (SELECT outlet_id, avg(n_visits) AS season FROM history WHERE month(day) = 3 GROUP BY 1),
fo AS (SELECT market_id, rep_id, outlet_id, vf, slope IS NOT NULL AND growth IS NOT NULL AS modelled,
  CASE WHEN slope IS NOT NULL AND growth IS NOT NULL THEN floor(greatest(0, (slope * (n + 30) + intercept) * coalesce(season, 1) * (1 + growth * 30 / 365)) + 0.5) ELSE vf * 30 / 7 END AS predicted,
  CASE WHEN slope IS NOT NULL AND growth IS NOT NULL THEN least(0.95, r2 * (1 - volatility)) ELSE 0.5 END AS confidence, growth
  FROM outlets LEFT JOIN reg USING (outlet_id) LEFT JOIN se USING (outlet_id) LEFT JOIN tr USING (outlet_id) WHERE NOT excluded)"""
QUERIES["demand_forecast"] = lambda spark, sf: rounded(_forecast(spark, sf), "predicted", "confidence").select("outlet_id", "predicted", "confidence", "modelled")
SQL["demand_forecast"] = f"WITH {FORECAST} SELECT outlet_id, round(predicted, 6) AS predicted, round(confidence, 6) AS confidence, modelled FROM fo"
QUERIES["forecast_buckets"] = lambda spark, sf: fc.forecast_buckets(_forecast(spark, sf))
SQL["forecast_buckets"] = f"WITH {FORECAST} SELECT market_id, count(*) FILTER (predicted > 12) AS high, count(*) FILTER (predicted BETWEEN 6 AND 12) AS medium, count(*) FILTER (predicted < 6) AS low FROM fo GROUP BY 1"
QUERIES["model_metrics"] = lambda spark, sf: rounded(fc.model_metrics(fc.demand_regression(fc.indexed(td.history(spark, sf)))), "mean_r2")
SQL["model_metrics"] = f"WITH {POINTS} SELECT count(*) AS models, round(avg(r2), 6) AS mean_r2 FROM reg WHERE slope IS NOT NULL"

# Loads of the fixture's reps are far apart from a real day's; limits are set where some give and some take.
_transfers = lambda spark, sf: fc.transfer_recommendations(_forecast(spark, sf).withColumn("predicted", c("predicted") * F.when(c("rep_id") % 3 == 0, 0.3).otherwise(1.0)), 90.0, 60.0, 80.0, 75.0)
QUERIES["transfer_recommendations"] = lambda spark, sf: rounded(_transfers(spark, sf), "work", "expected_gain")
QUERIES["transfer_imbalance"] = lambda spark, sf: rounded(fc.imbalance(_forecast(spark, sf).withColumn("predicted", c("predicted") * F.when(c("rep_id") % 3 == 0, 0.3).otherwise(1.0)), _transfers(spark, sf)), "before", "after")
TRANSFERS = f"""{FORECAST}, w AS (SELECT *, predicted * CASE WHEN rep_id % 3 = 0 THEN 0.3::DOUBLE ELSE 1 END / 4 AS work FROM fo),
ld AS (SELECT market_id, rep_id, sum(work) AS load FROM w GROUP BY ALL),
g0 AS (SELECT w.*, load, coalesce(CASE WHEN modelled THEN growth END, 0) + work AS score FROM w JOIN ld USING (market_id, rep_id) WHERE load > 90),
g1 AS (SELECT * FROM g0 QUALIFY row_number() OVER (PARTITION BY market_id, rep_id ORDER BY score DESC, outlet_id) <= ceil((load - 80) / 3)),
g AS (SELECT *, sum(work) OVER (PARTITION BY market_id ORDER BY score DESC, outlet_id) AS e FROM g1),
t AS (SELECT *, sum(75 - load) OVER (PARTITION BY market_id ORDER BY load, rep_id) AS stop FROM ld WHERE load < 60),
m AS (SELECT g.market_id, g.outlet_id, g.rep_id AS from_rep_id, t.rep_id AS to_rep_id, work, work * confidence AS gain, g.e, t.stop FROM g JOIN t ON g.market_id = t.market_id AND t.stop - (75 - t.load) <= g.e - g.work
  QUALIFY row_number() OVER (PARTITION BY g.outlet_id ORDER BY t.stop DESC) = 1)"""
SQL["transfer_recommendations"] = f"WITH {TRANSFERS} SELECT market_id, outlet_id, from_rep_id, to_rep_id, round(work, 6) AS work, round(gain, 6) AS expected_gain FROM m WHERE e <= stop + 1e-9"
SQL["transfer_imbalance"] = f"""WITH {TRANSFERS}, moved AS (SELECT w.market_id, w.rep_id, coalesce(m.to_rep_id, w.rep_id) AS now_id, w.work FROM w LEFT JOIN m ON m.outlet_id = w.outlet_id AND m.e <= m.stop + 1e-9),
b AS (SELECT market_id, stddev_pop(x) / avg(x) AS v FROM (SELECT market_id, rep_id, sum(work) AS x FROM moved GROUP BY ALL) GROUP BY 1),
a AS (SELECT market_id, stddev_pop(x) / avg(x) AS v FROM (SELECT market_id, now_id, sum(work) AS x FROM moved GROUP BY ALL) GROUP BY 1)
SELECT market_id, round(b.v, 6) AS "before", round(a.v, 6) AS "after" FROM b JOIN a USING (market_id)"""
