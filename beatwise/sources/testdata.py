"""Outlets, reps, plan cells and edits derived from the TPC-H-like test tables.

Everything is integer arithmetic on keys, so another engine derives the same rows. Reps are
blocks of at most 60 outlets: a rep is a person, so their number grows with the data while
the five markets grow without bound.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beatwise.functions import cycle, text

CHANNELS = ["Super Market", "KIOSK", "GROCERY", "Mini Market", "Petrol Station", "Wholesale - جملة", "كشك", ""]
NAMES = ["Al Noor Market", "Cedar Shop", "سوبر ماركت الأمل", "Corner Store", "دكان السلام", "Green Grocery"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    pick = lambda items, i: F.element_at(F.array(*[F.lit(x) for x in items]), (i + 1).cast("int"))
    keyed = table(spark, sf_dir, "customer").select(
        c("c_custkey").alias("k"), c("c_nationkey").cast("bigint").alias("own_ns"), c("c_acctbal").alias("value"))
    # A planted duplicate (k % 50 = 1) takes everything but its id from its twin k - 1.
    twin = keyed.filter("k % 50 = 0").select((c("k") + 1).alias("k"), c("own_ns").alias("twin_ns"))
    base = (keyed.join(twin, "k", "left")
            .withColumn("s", F.when((c("k") % 50 == 1) & c("twin_ns").isNotNull(), c("k") - 1).otherwise(c("k")))
            .withColumn("ns", F.coalesce("twin_ns", "own_ns")))
    block = F.expr("s DIV 1500")
    market = F.expr("ns DIV 5")
    town = (c("ns") % 5 + F.when(c("k") % 61 == 60, 1).otherwise(0)) % 5
    away = c("k") % 97 == 96
    lat = (F.lit(33500000) + town * 60000 + (block % 40) * 300000 + ((c("s") * 7919) % 9973 - 4986) * 5)
    lng = (F.lit(35500000) + market * 900000 + ((F.expr("(s DIV 1500) DIV 40")) % 20) * 4500000
           + ((c("s") * 104729) % 9967 - 4983) * 5)
    vf = F.when(c("k") % 29 == 0, 3).otherwise(pick([1, 2, 2, 4], c("k") % 4))
    renamed = (c("k") % 100) == 51
    return base.select(
        c("k").alias("outlet_id"), market.alias("market_id"), (c("ns") + 25 * block).alias("rep_id"),
        F.when(renamed, F.concat(F.lit("دكان "), c("k").cast("string")))
         .otherwise(F.concat(pick(NAMES, c("s") % 6), F.lit(" "), F.expr("s DIV 6").cast("string"))).alias("name"),
        F.when(c("k") % 7 == 3, F.lit(None).cast("string")).otherwise(F.concat(F.lit("C"), c("k").cast("string"))).alias("code"),
        F.when(away, 41844300).otherwise(lat).cast("bigint").alias("lat_e6"),
        F.when(away, 12463500).otherwise(lng).cast("bigint").alias("lng_e6"),
        vf.cast("int").alias("vf"), pick(CHANNELS, c("k") % 8).alias("channel"),
        F.when(c("k") % 3 != 0, 8 + c("k") % 30).cast("int").alias("time_per_visit"), c("value"),
        (c("k") % 101 == 0).alias("excluded"), away.alias("offset"),
        (c("k") % 5).cast("int").alias("day_group"),
    ).withColumn("latitude", c("lat_e6") / 1e6).withColumn("longitude", c("lng_e6") / 1e6).withColumn(
        "bucket", (F.expr("outlet_id DIV 5") % cycle.buckets_for_frequency(c("vf"), F.lit(4))).cast("int")).withColumn(
        "call_minutes", text.call_minutes(c("time_per_visit"), c("channel")))


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlets on a day-group and bucket: those in the plan, but for the few left without a route."""
    return outlets(spark, sf_dir).filter("not excluded and not offset and outlet_id % 89 <> 5")


def visits(members: DataFrame) -> DataFrame:
    """One row per visit of a membership: run, week and weekday of a five-day week in four runs."""
    return (members.withColumn("run", F.explode(cycle.runs_of_bucket(F.col("vf"), F.lit(4), F.col("bucket"))))
            .withColumn("at", cycle.calendar_cell(F.col("run"), F.col("day_group") + 1, F.lit(5), (1, 2, 3, 4, 5)))
            .withColumn("week", F.col("at.week")).withColumn("day_of_week", F.col("at.day_of_week")).drop("at"))


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored plan: stops of every cell (rep, week, weekday) in driving order, seq from 1."""
    cell = Window.partitionBy("rep_id", "week", "day_of_week").orderBy("lat_e6", "lng_e6", "outlet_id")
    return visits(memberships(spark, sf_dir)).select(
        "market_id", "rep_id", "week", "day_of_week", "run", "day_group", F.row_number().over(cell).alias("seq"),
        "outlet_id", "latitude", "longitude", "vf", "call_minutes")


def reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per rep that owns outlets, with its band of visits a day."""
    own = outlets(spark, sf_dir).groupBy("rep_id").agg(F.min("market_id").alias("market_id"))
    return own.select("rep_id", "market_id", F.concat(F.lit("Rep "), F.col("rep_id").cast("string")).alias("rep_name"),
                      F.lit(4).alias("min_daily_visits"), F.lit(6).alias("max_daily_visits"),
                      F.lit(5).alias("working_days"), (F.col("rep_id") % 11 != 10).alias("is_active"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of the outlet list from the event stream: delete, move to another rep, pin, exclude, restore."""
    kind = (F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "move")
            .when(F.col("event_type") == "signup", "pin").when(F.col("event_type") == "purchase", "exclude")
            .otherwise("restore"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("edit_id"), "ts", F.col("user_id").alias("outlet_id"), kind.alias("kind"),
        ((F.col("user_id") * 7 + F.col("event_id")) % 25).alias("to_rep_id"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visit history: one point per order of an outlet, one to five visits by its value."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("outlet_id"), F.col("o_orderkey").alias("visit_id"),
        F.to_date("o_orderdate").alias("day"),
        (F.floor("o_totalprice").cast("bigint") % 5 + 1).cast("int").alias("n_visits"))
