"""Plan tables (outlets, reps, stops, roles, runs) as parquet partitioned by market."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatwise.session import cut


def write_table(df: DataFrame, folder: str, name: str, by: str = "market_id") -> None:
    """Write a plan table; only the partitions present in ``df`` are replaced.

    No shuffle by market comes before the write, so a market of any size is written by many tasks.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{folder}/{name}")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


# ------------------------------------------------------------------ versioned plans
#
# A plan folder holds tables partitioned by a key and a version, and manifests that say which version of each
# partition counts. A change writes new versions beside the old ones and then one manifest; readers see all of it or
# nothing. A version is written by overwrite, so the same change made twice leaves the same tables.

PLAN_TABLES = {"outlets": "market_id", "stops": "rep_id", "pins": "rep_id"}


def write_version(df: DataFrame, folder: str, name: str, version: int) -> None:
    """Write the rows of ``df`` as that version of their partitions."""
    df.withColumn("version", F.lit(version).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        PLAN_TABLES[name], "version").parquet(f"{folder}/{name}")


def publish(entries: DataFrame, folder: str, version: int) -> None:
    """Make ``entries`` (name, part, version) what counts from ``version`` on. A manifest counts once it is whole."""
    whole = cut(entries.select("name", F.col("part").cast("bigint").alias("part"), F.col("version").cast("bigint").alias("version")).distinct())
    whole.withColumn("entries", F.lit(whole.count()).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/manifest/made={version}")


def manifest(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The entries that count now, or counted before a version: name, part, version."""
    made = spark.read.schema("name string, part bigint, version bigint, entries bigint, made bigint").parquet(f"{folder}/manifest")
    made = made if before is None else made.filter(F.col("made") < before)
    whole = made.groupBy("made").agg(F.count(F.lit(1)).alias("n"), F.max("entries").alias("entries")).filter("n = entries")
    last = whole.agg(F.max("made").alias("made"))
    return made.join(F.broadcast(last), "made").select("name", "part", "version")


def read_version(spark: SparkSession, folder: str, name: str, entries: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Rows of a plan table as the entries have it, of some partitions only where ``parts`` names them. The
    join prunes the partitions that are scanned."""
    by = PLAN_TABLES[name]
    wanted = entries.filter(F.col("name") == name).select(F.col("part").alias(by), "version")
    wanted = wanted if parts is None else wanted.join(parts.select(F.col(by).cast("bigint").alias(by)).distinct(), by, "left_semi")
    table = spark.read.parquet(f"{folder}/{name}")
    kind = table.schema[by].dataType
    return table.withColumn(by, F.col(by).cast("bigint")).join(wanted, [by, "version"], "left_semi").withColumn(by, F.col(by).cast(kind)).drop("version")


def start_plan(outlets: DataFrame, stops: DataFrame, folder: str) -> None:
    """The first version (-1) of a plan: its outlets and stops, no pins yet."""
    spark = outlets.sparkSession
    for name, df in (("outlets", outlets), ("stops", stops)):
        write_version(df, folder, name, -1)
    # A file of the schema, in no manifest, so that the table can be read while there is no pin.
    write_version(spark.createDataFrame([(-1, -1, 1, 1)], PINS), folder, "pins", -1)
    parts = [df.select(F.lit(name).alias("name"), F.col(PLAN_TABLES[name]).cast("bigint").alias("part")).distinct() for name, df in (("outlets", outlets), ("stops", stops))]
    publish(parts[0].union(parts[1]).withColumn("version", F.lit(-1)), folder, -1)


PINS = "rep_id bigint, outlet_id bigint, week int, day_of_week int"


def cells_of(stops: DataFrame) -> DataFrame:
    """Cells with their stops as an array in driving order (a day's route, bounded by a working day)."""
    return stops.groupBy("market_id", "rep_id", "week", "day_of_week").agg(
        F.array_sort(F.collect_list(F.struct("seq", "outlet_id"))).alias("_s")).select(
        "market_id", "rep_id", "week", "day_of_week", F.transform("_s", lambda s: s["outlet_id"]).alias("route_order"))


def stops_of(cells: DataFrame) -> DataFrame:
    """The long form of cells: one row per stop, seq from 1."""
    e = cells.select("market_id", "rep_id", "week", "day_of_week", F.posexplode("route_order").alias("seq", "outlet_id"))
    return e.withColumn("seq", F.col("seq") + 1)
