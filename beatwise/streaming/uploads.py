"""Outlet files as a stream: each new file is mapped, validated, completed and checked against its market."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatwise.operators.ingest import complete, file_report, map_columns
from beatwise.operators.spots import geo_outliers
from beatwise.operators.status import carry_over_exclusions
from beatwise.session import cut
from beatwise.sources.uploads import normalise_headers


def read_uploads(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """New CSV files with the given header as a stream of texts, with the file each row came from."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.readStream.schema(schema).option("header", True).csv(folder)
    return raw.withColumn("file", F.col("_metadata.file_name"))


def ingest_uploads(stream: DataFrame, held: DataFrame, target: str, checkpoint: str):
    """Outlets, rejected rows and a report for every batch of files.

    Rows get ids from their file and content, so a repeated batch yields the same rows; held-out
    decisions (``held``: name, code, latitude, longitude) carry over, outlets far from their file's
    mass are flagged.
    """
    def batch(rows: DataFrame, batch_id: int) -> None:
        files = rows.select("file", *[c for c in rows.columns if c != "file"])
        headed = normalise_headers(files)
        ids = headed.withColumn("row", F.xxhash64(*headed.columns))
        done = cut(complete(map_columns(ids, ("row", "file"))))
        file_report(done, ["file"]).write.mode("overwrite").parquet(f"{target}/reports/batch={batch_id}")
        done.filter(F.coalesce("reject_reason", F.lit("")) != "").write.mode("overwrite").parquet(f"{target}/rejected/batch={batch_id}")
        valid = done.filter(F.coalesce("reject_reason", F.lit("")) == "").select(
            F.col("row").alias("outlet_id"), F.col("file").alias("market_id"), F.col("name_text").alias("name"), F.col("code_text").alias("code"),
            "latitude", "longitude", "vf", F.col("channel_text").alias("channel"), "time_per_visit", "value")
        kept = cut(carry_over_exclusions(valid, held).withColumnRenamed("carried", "excluded"))
        far = geo_outliers(kept.filter("not excluded"), ["market_id"]).select("outlet_id", "gap_km")
        kept.join(far, "outlet_id", "left").withColumn("offset", F.col("gap_km").isNotNull()).write.mode("overwrite").parquet(f"{target}/outlets/batch={batch_id}")
    return (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
