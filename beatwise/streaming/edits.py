"""Edits of the outlet list as a stream: which reps they touch, and re-planning those reps."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatwise.functions import cycle
from beatwise.operators.spots import affected_reps
from beatwise.operators.status import apply_edits, edit_counts, last_edits
from beatwise.params import PlanSettings
from beatwise.plans.build import replan_keep_days
from beatwise.plans.keep_days import place_pins
from beatwise.sources.tables import PLAN_TABLES, manifest, publish, read_version, write_version
from beatwise.session import cut

EDIT_SCHEMA = "edit_id bigint, ts timestamp, kind string, outlet_id bigint, to_rep_id bigint, week int, day_of_week int"


def read_edits(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """New edit files (JSON lines) as a stream."""
    return spark.readStream.schema(EDIT_SCHEMA).option("maxFilesPerTrigger", per_trigger).json(folder)


def _run(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str):
    return (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def track_affected(stream: DataFrame, outlets: DataFrame, stops: DataFrame, target: str, checkpoint: str):
    """For every batch of edits the reps that own or drive an edited outlet, and the edits per kind.

    A batch is written under its own id with overwrite, so one that is run again after a failure
    leaves one copy.
    """
    def batch(edits: DataFrame, batch_id: int) -> None:
        edits = cut(edits)
        affected_reps(edits, outlets, stops).write.mode("overwrite").parquet(f"{target}/affected/batch={batch_id}")
        edits.groupBy("kind").agg(F.count(F.lit(1)).alias("edits")).write.mode("overwrite").parquet(f"{target}/counts/batch={batch_id}")
    return _run(stream, batch, checkpoint)


def _pinned(old: DataFrame, edits: DataFrame, owned: DataFrame) -> DataFrame:
    """Pins after a batch: the latest per outlet, while its rep keeps it."""
    new = edits.filter("kind = 'pin' and week is not null and day_of_week is not null").groupBy("outlet_id").agg(F.max(F.struct("ts", "edit_id", "week", "day_of_week")).alias("e"))
    new = new.select("outlet_id", F.col("e.week").alias("week"), F.col("e.day_of_week").alias("day_of_week"))
    kept = old.select("outlet_id", "week", "day_of_week").join(new, "outlet_id", "left_anti")
    own = owned.select(F.col("rep_id").cast("bigint").alias("rep_id"), "outlet_id")
    was = old.select("rep_id", "outlet_id")
    # A pin is a place in one rep's month: it goes when the outlet does.
    still = kept.join(was.join(own, ["rep_id", "outlet_id"]), "outlet_id")
    return still.unionByName(new.join(own, "outlet_id")).select("rep_id", "outlet_id", "week", "day_of_week")


def _with_pins(month: DataFrame, pins: DataFrame, owned: DataFrame, settings: PlanSettings) -> DataFrame:
    """A month with its pinned outlets in their cells."""
    at = cycle.cycle_cell_of(F.col("week"), F.col("day_of_week"), settings.week, settings.day_groups, settings.cycle_days, settings.start_slot)
    placed = place_pins(month, pins, owned).withColumn("_at", at)
    figures = owned.select("outlet_id", *[x for x in ("latitude", "longitude", "vf", "call_minutes") if x in owned.columns])
    markets = month.select("market_id", "rep_id").distinct()
    return placed.withColumn("run", F.col("_at.run")).withColumn("day_group", F.col("_at.day_group")).drop("_at").join(figures, "outlet_id").join(markets, "rep_id")


def replan_on_edits(stream: DataFrame, folder: str, settings: PlanSettings, target: str, checkpoint: str):
    """Apply every batch of edits to a versioned plan and re-plan the touched reps, days and pins kept.

    The plan folder is that of ``tables.start_plan``. A batch reads the plan as it was before it, writes the touched
    markets and reps as its own version and then one manifest, so readers never see half a batch, a batch that is
    run again ends in the same plan, and a rep or market that has lost everything is in no manifest. Only the
    partitions of touched markets and reps are read whole, of the others just the ids. Counts before / deleted /
    moved / after go to ``target``.
    """
    def batch(edits: DataFrame, batch_id: int) -> None:
        apply_batch(edits, batch_id, folder, settings, target)
    return _run(stream, batch, checkpoint)


def apply_batch(edits: DataFrame, batch_id: int, folder: str, settings: PlanSettings, target: str) -> None:
    spark = edits.sparkSession
    edits = cut(edits)
    if edits.isEmpty():
        return
    was = cut(manifest(spark, folder, batch_id))
    table = lambda name, parts=None: read_version(spark, folder, name, was, parts)
    ids = edits.select("outlet_id").distinct()
    touched = affected_reps(edits, table("outlets"), table("stops"))
    sent = last_edits(edits).filter("kind = 'move'").select(F.col("to_rep_id").alias("rep_id"))
    touched = cut(touched.union(sent).filter("rep_id is not null").distinct())
    whole = table("outlets").select("market_id", "rep_id", "outlet_id")
    markets = whole.join(ids, "outlet_id", "left_semi").select("market_id").union(whole.join(touched, "rep_id", "left_semi").select("market_id"))
    markets = cut(markets.distinct())
    outlets = cut(table("outlets", markets))
    edit_counts(outlets, edits, ["market_id"]).write.mode("overwrite").parquet(f"{target}/counts/batch={batch_id}")
    after = cut(apply_edits(outlets, edits).drop("edited"))
    owned = cut(after.filter("not excluded and not offset").join(touched, "rep_id", "left_semi"))
    stops = cut(table("stops", touched))
    pins = cut(_pinned(table("pins", touched), edits, owned))
    month = replan_keep_days(owned, stops, settings, compare=False, pinned=pins)
    if not pins.isEmpty():
        month = _with_pins(cut(month), pins, owned, settings)
    fresh = cut(month.select(*[x for x in stops.columns if x in month.columns]))
    new = {"outlets": after, "stops": fresh, "pins": pins}
    for name, df in new.items():
        write_version(df, folder, name, batch_id)
    # What was touched counts as this batch has it, or not at all.
    reps = touched.select(F.col("rep_id").cast("bigint").alias("part"))
    gone = (markets.select(F.col("market_id").cast("bigint").alias("part")).withColumn("name", F.lit("outlets"))
            .unionByName(reps.withColumn("name", F.explode(F.array(F.lit("stops"), F.lit("pins"))))))
    entries = was.join(gone, ["name", "part"], "left_anti").select("name", "part", "version")
    for name, df in new.items():
        entries = entries.unionByName(df.select(F.lit(name).alias("name"), F.col(PLAN_TABLES[name]).cast("bigint").alias("part")).distinct().withColumn("version", F.lit(batch_id).cast("bigint")))
    publish(entries, folder, batch_id)
