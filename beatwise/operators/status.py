"""Which outlets take part: exclusions, review flags, status and edits of the list."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwise.functions.text import spot_key
from beatwise.operators.prefix import running_total


PIN = "STRUCT<repId: STRING, week: INT, dayOfWeek: INT>"


def parse_pin(pin: Column) -> Column:
    """rep_id, week and day_of_week of a pin's JSON text; all null where it can't be read."""
    p = F.from_json(pin, PIN)
    return F.struct(p["repId"].try_cast("bigint").alias("rep_id"), p["week"].alias("week"), p["dayOfWeek"].alias("day_of_week"))


def exclude_outlets(outlets: DataFrame, requested: DataFrame, include_excluded: bool = False) -> DataFrame:
    """Outlets of a run: without the requested ids and, unless wanted back, those already excluded."""
    left = outlets.join(requested.select("outlet_id").distinct(), "outlet_id", "left_anti")
    return left if include_excluded else left.filter(~F.col("excluded"))


def carry_over_exclusions(new: DataFrame, held: DataFrame) -> DataFrame:
    """Add ``carried``: whether a row of a new upload is held out because an earlier row was.

    Rows match by code, or by name and 5-decimal position when they have none, and by count per
    key: one held row of two identical ones holds one of the two new rows.
    """
    key = F.when(F.coalesce(F.trim("code"), F.lit("")) != "", F.concat(F.lit("c|"), F.trim("code"))).otherwise(
        F.concat(F.lit("s|"), spot_key(F.col("name"), F.col("latitude"), F.col("longitude"))))
    counts = held.withColumn("_key", key).groupBy("_key").agg(F.count(F.lit(1)).alias("_held"))
    keyed = new.withColumn("_key", key).join(counts, "_key", "left")
    open_ = keyed.filter(F.col("_held").isNotNull())
    ranked = running_total(open_, ["_key"], F.floor(F.col("outlet_id") / 100000), ["outlet_id"], F.lit(1), "_n")
    taken = ranked.filter(F.col("_n") <= F.col("_held")).select("outlet_id", F.lit(True).alias("carried"))
    return new.join(taken, "outlet_id", "left").withColumn("carried", F.coalesce("carried", F.lit(False)))


def restore_excluded(outlets: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Put all excluded outlets back, or only the chosen ids; ``restored`` tells which changed."""
    if chosen is None:
        return outlets.withColumn("restored", F.col("excluded")).withColumn("excluded", F.lit(False))
    ids = chosen.select("outlet_id").distinct().withColumn("_pick", F.lit(True))
    return (outlets.join(ids, "outlet_id", "left")
            .withColumn("restored", F.col("excluded") & F.coalesce("_pick", F.lit(False)))
            .withColumn("excluded", F.col("excluded") & ~F.col("restored")).drop("_pick"))


def outlet_status(excluded: Column, offset: Column, planned: Column | None = None) -> Column:
    """Excluded, Held for review, then Planned / Not planned (or Active where no plan is asked for)."""
    head = F.when(excluded, "Excluded").when(offset, "Held for review")
    return head.otherwise("Active") if planned is None else head.when(planned, "Planned").otherwise("Not planned")


def refresh_geo_flags(outlets: DataFrame, far: DataFrame) -> DataFrame:
    """``offset`` set for outlets in ``far`` and cleared for the rest; ``flag_change`` says which way."""
    ids = far.select("outlet_id").distinct().withColumn("_far", F.lit(True))
    now = F.coalesce("_far", F.lit(False))
    return (outlets.join(ids, "outlet_id", "left")
            .withColumn("flag_change", F.when(now & ~F.col("offset"), "flagged").when(~now & F.col("offset"), "cleared")
                        .otherwise("same"))
            .withColumn("offset", now).drop("_far"))


def last_edits(edits: DataFrame) -> DataFrame:
    """The edit that counts for each outlet: the latest, by time then id. An aggregate, not a sort."""
    latest = F.max(F.struct("ts", "edit_id", "kind", "to_rep_id"))
    return edits.groupBy("outlet_id").agg(latest.alias("e"), F.count(F.lit(1)).alias("edits")).select(
        "outlet_id", F.col("e.kind").alias("kind"), F.col("e.to_rep_id").alias("to_rep_id"), "edits")


def apply_edits(outlets: DataFrame, edits: DataFrame) -> DataFrame:
    """The list after its edits: deleted outlets gone, moved ones with their new rep, exclusions set."""
    last = last_edits(edits)
    kind = F.coalesce("kind", F.lit("none"))
    return (outlets.join(last, "outlet_id", "left").filter(kind != "delete")
            .withColumn("rep_id", F.when(kind == "move", F.col("to_rep_id")).otherwise(F.col("rep_id")))
            .withColumn("excluded", F.when(kind == "exclude", True).when(kind == "restore", False)
                        .otherwise(F.col("excluded")))
            .withColumn("edited", kind != "none").drop("kind", "to_rep_id", "edits"))


def edit_counts(outlets: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Before / deleted / moved / after per key, and edits since the last save."""
    last = last_edits(edits)
    joined = outlets.join(last, "outlet_id", "left")
    is_ = lambda k: F.count_if(F.col("kind") == k)
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("before"), is_("delete").alias("deleted"), is_("move").alias("moved"),
        F.count_if(F.coalesce("kind", F.lit("")) != "delete").alias("after"),
        F.coalesce(F.sum("edits"), F.lit(0)).alias("unsaved_edits"))


def edited_cells(stops: DataFrame, edits: DataFrame) -> DataFrame:
    """Cells without deleted outlets, stops renumbered; cached distance is void where a stop went."""
    gone = last_edits(edits).filter("kind = 'delete'").select("outlet_id", F.lit(1).alias("_gone"))
    marked = stops.join(gone, "outlet_id", "left")
    per_cell = ["rep_id", "week", "day_of_week"]
    touched = marked.groupBy(*per_cell).agg(F.max(F.coalesce("_gone", F.lit(0))).alias("_t"))
    kept = running_total(marked.filter("_gone is null"), per_cell, F.floor(F.col("seq") / 4096), ["seq"], F.lit(1), "new_seq")
    return kept.join(touched, per_cell).select(*per_cell, "outlet_id", F.col("new_seq").cast("int").alias("seq"),
                                               (F.col("_t") == 1).alias("distance_void"))
