"""Demand forecasts from a visit history (outlet_id, visit_id, day, n_visits)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beatwise.operators.prefix import running_total
from beatwise.session import cut

c = F.col


def indexed(history: DataFrame) -> DataFrame:
    """History points numbered from 0 per outlet in time order, with the number of points (``n``)."""
    month = F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / 32)
    out = running_total(history, ["outlet_id"], month, ["day", "visit_id"], F.lit(1), "_i", total="n")
    return out.withColumn("x", c("_i") - 1).drop("_i")


def demand_regression(points: DataFrame, min_points: int = 10) -> DataFrame:
    """Least squares of visits on the point index per outlet; R2 floored at 0, null for a constant series."""
    y = c("n_visits").cast("bigint")
    s = points.filter(c("n") >= min_points).groupBy("outlet_id").agg(
        F.max("n").alias("n"), F.sum("x").alias("sx"), F.sum(y).alias("sy"), F.sum(c("x") * c("x")).alias("sxx"),
        F.sum(c("x") * y).alias("sxy"), F.sum(y * y).alias("syy"))
    dx = c("n") * c("sxx") - c("sx") * c("sx")
    cov = c("n") * c("sxy") - c("sx") * c("sy")
    dy = c("n") * c("syy") - c("sy") * c("sy")
    return s.withColumn("slope", F.when((dx > 0) & (dy > 0), cov / dx)).withColumn(
        "intercept", (c("sy") - c("slope") * c("sx")) / c("n")).withColumn(
        "r2", F.when((dx > 0) & (dy > 0), F.greatest(F.lit(0.0), cov / dx * (cov / dy)))).select("outlet_id", "n", "slope", "intercept", "r2")


def seasonal_profile(history: DataFrame) -> DataFrame:
    """Mean visits of each outlet and calendar month."""
    return history.groupBy("outlet_id", F.month("day").alias("month")).agg(F.avg("n_visits").alias("season"))


def trend_volatility(points: DataFrame, min_points: int = 20) -> DataFrame:
    """Growth of the second half of an outlet's history against the first, and its coefficient of variation."""
    first = c("x") < F.floor(c("n") / 2)
    t = points.filter(c("n") >= min_points).groupBy("outlet_id").agg(
        F.avg(F.when(first, c("n_visits"))).alias("_a"), F.avg(F.when(~first, c("n_visits"))).alias("_b"),
        F.stddev_pop("n_visits").alias("_sd"), F.avg("n_visits").alias("_m"))
    return t.select("outlet_id", ((c("_b") - c("_a")) / c("_a")).alias("growth"), (c("_sd") / c("_m")).alias("volatility"))


def demand_forecast(outlets: DataFrame, history: DataFrame, month: int, days: int = 30, min_points: int = 10,
                    min_trend: int = 20) -> DataFrame:
    """Predicted visits of each outlet over the next ``days``: trend line x season x growth, else its frequency."""
    p = indexed(history)
    model = demand_regression(p, min_points).filter("slope is not null")
    season = seasonal_profile(history).filter(c("month") == month).select("outlet_id", "season")
    j = (outlets.join(model, "outlet_id", "left").join(season, "outlet_id", "left")
         .join(trend_volatility(p, min_trend), "outlet_id", "left"))
    known = c("slope").isNotNull() & c("growth").isNotNull()
    factor = F.coalesce(F.when(c("season") != 0, c("season")), F.lit(1.0))
    trend = 1 + c("growth") * days / 365
    raw = F.greatest(F.lit(0.0), (c("slope") * (c("n") + days) + c("intercept")) * factor * trend)
    return j.select("market_id", "rep_id", "outlet_id", "vf",
                    F.when(known, F.floor(raw + 0.5).cast("double")).otherwise(c("vf") * days / 7).alias("predicted"),
                    F.when(known, F.least(F.lit(0.95), c("r2") * (1 - c("volatility")))).otherwise(0.5).alias("confidence"),
                    F.when(known, c("growth")).alias("growth"), known.alias("modelled"))


def transfer_recommendations(forecast: DataFrame, high: float = 25.0, low: float = 12.0, target: float = 20.0,
                             cap: float = 23.0, keys: list[str] = ["market_id"]) -> DataFrame:
    """Outlets overloaded reps should pass to underloaded ones: keys, outlet, from, to, work, expected gain.

    Givers offer their highest growth + work outlets, one per three visits of excess; receivers
    stand in order of load, each with room up to the cap. Both are laid along a line of work, and an
    outlet goes to the receiver whose stretch holds it whole, so no receiver passes the cap and no
    giver meets every receiver. The line is cut into pieces as long as the cap; outlets and stretches
    meet by piece, so neither a market nor its line is ever one task's work. Reps without room, and
    outlets whose work is null, take no part.
    """
    w = cut(forecast.withColumn("work", c("predicted") / 4).filter("work is not null"))
    load = w.groupBy(*keys, "rep_id").agg(F.sum("work").alias("load"))
    give = w.join(load.filter(c("load") > high), [*keys, "rep_id"]).withColumn("score", F.coalesce("growth", F.lit(0.0)) + c("work"))
    by_rep = Window.partitionBy(*keys, "rep_id").orderBy(F.desc("score"), "outlet_id")
    give = give.withColumn("_r", F.row_number().over(by_rep)).filter(c("_r") <= F.ceil((c("load") - target) / 3))
    give = running_total(give, keys, -F.floor(c("score") * 4), [F.desc("score"), "outlet_id"], "work", "_end").withColumn("_start", c("_end") - c("work"))
    room = F.lit(cap) - c("load")
    take = running_total(load.filter((c("load") < low) & (room > 0)), keys, F.floor("load"), ["load", "rep_id"], room, "_stop").withColumn("_from", c("_stop") - room)
    # Borders are rounded when computed, so a stretch also meets what starts a hair beyond it; the fit is tested below.
    piece = lambda at: F.floor(at / cap).cast("bigint")
    take = take.select(*keys, c("rep_id").alias("to_rep_id"), "_from", "_stop", F.explode(F.sequence(piece(c("_from") - 1e-6), piece(c("_stop") + 1e-6))).alias("_piece"))
    met = give.withColumn("_piece", piece(c("_start"))).join(take, [*keys, "_piece"]).filter(c("_from") <= c("_start"))
    last = met.groupBy(*keys, "outlet_id", c("rep_id").alias("from_rep_id"), "work", "confidence", "_end").agg(F.max(F.struct("_from", "_stop", "to_rep_id")).alias("_t"))
    return last.filter(c("_end") <= c("_t._stop") + 1e-9).select(
        *keys, "outlet_id", "from_rep_id", c("_t.to_rep_id").alias("to_rep_id"), "work", (c("work") * c("confidence")).alias("expected_gain"))


def imbalance(forecast: DataFrame, transfers: DataFrame, keys: list[str] = ["market_id"]) -> DataFrame:
    """Coefficient of variation of the reps' predicted work before and after the transfers."""
    t = transfers.select(*keys, "outlet_id", "to_rep_id")
    j = forecast.withColumn("work", c("predicted") / 4).join(t, [*keys, "outlet_id"], "left")
    cv = lambda rep, name: (j.groupBy(*keys, rep.alias("_r")).agg(F.sum("work").alias("_w")).groupBy(*keys)
                            .agg((F.stddev_pop("_w") / F.avg("_w")).alias(name)))
    return cv(c("rep_id"), "before").join(cv(F.coalesce("to_rep_id", "rep_id"), "after"), keys)


def model_metrics(regression: DataFrame) -> DataFrame:
    r = regression.filter("slope is not null")
    return r.agg(F.count(F.lit(1)).alias("models"), F.avg("r2").alias("mean_r2"))


def forecast_buckets(forecast: DataFrame, keys: list[str] = ["market_id"]) -> DataFrame:
    """Outlets of high (over 12), medium (6 to 12) and low (under 6) predicted visits."""
    p = c("predicted")
    return forecast.groupBy(*keys).agg(F.count_if(p > 12).alias("high"), F.count_if((p >= 6) & (p <= 12)).alias("medium"), F.count_if(p < 6).alias("low"))
