"""Kept plans side by side: the previous one, retention, comparison, capture and restore."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beatwise.operators.prefix import running_total, with_previous


def previous_scenario(scenarios: DataFrame, kpis: list[str]) -> DataFrame:
    """Each scored scenario with the latest earlier scored one of the same upload and KPI deltas."""
    scored = scenarios.filter("score is not null")
    day = F.datediff(F.to_date("created_at"), F.lit("1970-01-01").cast("date"))
    numbered = running_total(scored, ["upload"], day, ["created_at", "scenario_id"], F.lit(1), "_seq")
    before = with_previous(numbered, ["upload"], "_seq", {"previous_id": "scenario_id", **{f"_was_{k}": k for k in kpis}})
    for k in kpis:
        before = before.withColumn(f"{k}_delta", F.col(k) - F.col(f"_was_{k}")).drop(f"_was_{k}")
    return before.drop("_seq")


def keep_last(scenarios: DataFrame, n: int = 10, keys: list[str] = ["upload"]) -> DataFrame:
    """The n newest scenarios of each key; the row limit reaches the map side before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("scenario_id"))
    return scenarios.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def compare_scenarios(scenarios: DataFrame, kpis: dict[str, str], keys: list[str] = ["upload"]) -> DataFrame:
    """One row per scenario and KPI with whether it is the best: ``kpis`` maps a name to 'high' or 'low'."""
    rows = F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(k).cast("double").alias("value"), F.lit(d == "high").alias("high")) for k, d in kpis.items()])
    long = scenarios.select(*keys, "scenario_id", F.inline(rows))
    best = long.groupBy(*keys, "kpi").agg(F.when(F.first("high"), F.max("value")).otherwise(F.min("value")).alias("best"))
    return long.join(best, [*keys, "kpi"]).select(*keys, "scenario_id", "kpi", "value", (F.col("value") == F.col("best")).alias("is_best"))


def capture(plan: dict[str, DataFrame], folder: str, scenario_id: str) -> None:
    """Write a plan's tables (outlets, reps, stops, ...) as one scenario."""
    for name, df in plan.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/scenario_id={scenario_id}")


def apply_scenario(outlets: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Outlets with rep and exclusion as the snapshot had them; outlets it does not know keep theirs."""
    s = snapshot.select("outlet_id", F.col("rep_id").alias("_rep"), F.col("excluded").alias("_ex"), F.lit(True).alias("_known"))
    return (outlets.join(s, "outlet_id", "left")
            .withColumn("rep_id", F.when(F.col("_known"), F.col("_rep")).otherwise(F.col("rep_id")))
            .withColumn("excluded", F.when(F.col("_known"), F.col("_ex")).otherwise(F.col("excluded"))).drop("_rep", "_ex", "_known"))
