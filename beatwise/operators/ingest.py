"""Mapping, validating and completing uploaded outlet rows."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatwise.functions import text
from beatwise.functions.numbers import float_prefix, int_prefix
from beatwise.params import HEADER_SYNONYMS


def present(c: Column) -> Column:
    """The trimmed text, null when blank; one regular expression, so it is evaluated once wherever it is used."""
    return F.regexp_substr(c, F.lit(r"(?s)\S(?:.*\S)?"))


def first_present(columns: list[str], wanted: list[str]) -> Column:
    found = [present(F.col(w)) for w in wanted if w in columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def coordinate_fallback(columns: list[str], kind: str) -> Column:
    """The first column that is named like a coordinate and holds one: it parses, is not 0 and is in range."""
    looks, wrong, limit = (r"lat", r"long|lng", 90) if kind == "lat" else (r"long|lng|lon", r"lat", 180)
    named = [F.col(c) for c in columns if re.search(looks, c) and not re.search(wrong, c)]
    if not named:
        return F.lit(None).cast("string")
    usable = lambda v: (float_prefix(v) != 0) & (F.abs(float_prefix(v)) <= limit)
    return F.get(F.filter(F.array(*named), usable), 0)


def map_columns(df: DataFrame, keep: tuple[str, ...] = ("row",)) -> DataFrame:
    """One text column per target field, from the header spellings of the (normalised) frame."""
    cols = df.columns
    pick = {f: first_present(cols, names) for f, names in HEADER_SYNONYMS.items()}
    pick["latitude"] = F.coalesce(pick["latitude"], coordinate_fallback(cols, "lat"))
    pick["longitude"] = F.coalesce(pick["longitude"], coordinate_fallback(cols, "lng"))
    return df.select(*[c for c in keep if c in cols], *[v.alias(f"{k}_text") for k, v in pick.items()])


def validate_rows(mapped: DataFrame) -> DataFrame:
    """Add parsed ``latitude``/``longitude`` and ``reject_reason`` (null for a usable row)."""
    lat, lng = float_prefix(F.col("latitude_text")), float_prefix(F.col("longitude_text"))
    none = lambda t, n: F.col(t).isNull() | (F.col(t) == "0") | n.isNull()
    reason = (F.when(F.col("name_text").isNull(), "missing name")
              .when(none("latitude_text", lat), "missing latitude")
              .when(none("longitude_text", lng), "missing longitude")
              .when((lat < -90) | (lat > 90), "latitude out of range")
              .when((lng < -180) | (lng > 180), "longitude out of range"))
    return mapped.withColumn("latitude", lat).withColumn("longitude", lng).withColumn("reject_reason", reason)


def default_frequency(vf_text: Column, policy: int = 2, accepted: tuple[int, ...] = (1, 2, 4)) -> Column:
    """Visit frequency of a row: the policy where the file has none, 2 where the number is not accepted."""
    n = F.coalesce(int_prefix(vf_text), F.when(vf_text.isNull(), F.lit(policy)), F.lit(2))
    return F.when(n.isin(*accepted), n).otherwise(2).cast("int")


def call_time_source(call_text: Column, channel: Column) -> Column:
    own = int_prefix(call_text)
    return F.when(own > 0, "file").when(text.classify_channel(channel).isNotNull(), "channel").otherwise("assumed")


def call_time(call_text: Column, channel: Column) -> Column:
    """Call minutes of a row, from the file, its channel, or 15; kept within 3 to 180."""
    own = int_prefix(call_text)
    minutes = F.coalesce(F.when(own > 0, own), text.channel_minutes(text.classify_channel(channel)), F.lit(15))
    return F.least(F.lit(180), F.greatest(F.lit(3), minutes)).cast("int")


def complete(mapped: DataFrame, policy: int = 2) -> DataFrame:
    """Validated rows with every outlet field typed and defaulted."""
    c = F.col
    return (validate_rows(mapped)
            .withColumn("vf", default_frequency(c("vf_text"), policy))
            .withColumn("vf_assumed", c("vf_text").isNull())
            .withColumn("channel_key", text.classify_channel(c("channel_text")))
            .withColumn("call_source", call_time_source(c("call_time_text"), c("channel_text")))
            .withColumn("time_per_visit", call_time(c("call_time_text"), c("channel_text")))
            .withColumn("value", float_prefix(c("value_text"))))


def reject_counts(validated: DataFrame, keys: list[str]) -> DataFrame:
    # coalesce keeps the optimizer from propagating a not-null constraint through every parsing rule.
    return validated.filter(F.coalesce("reject_reason", F.lit("")) != "").groupBy(*keys, "reject_reason").agg(F.count(F.lit(1)).alias("rows"))


def file_report(completed: DataFrame, keys: list[str], reasons: int = 5, working_days: int = 5,
                max_daily: int = 27) -> DataFrame:
    """One row per upload: how many rows are usable, what was assumed, and the team a month needs."""
    ok = F.col("reject_reason").isNull()
    n = lambda cond: F.count_if(cond)
    base = completed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), n(ok).alias("valid"), n(~ok).alias("skipped"),
        *[n(ok & (F.col("vf") == v)).alias(f"vf{v}") for v in (1, 2, 4)],
        n(ok & F.col("vf_assumed")).alias("assumed_vf"),
        *[n(ok & (F.col("call_source") == s)).alias(f"call_{s}") for s in ("file", "channel", "assumed")],
        F.count_distinct(F.when(ok, F.col("channel_key"))).alias("channels"))
    monthly = F.col("vf1") + 2 * F.col("vf2") + 4 * F.col("vf4")
    base = base.withColumn("monthly_visits", monthly).withColumn(
        "recommended_reps", F.ceil(monthly / F.lit(working_days * 4 * max_daily)).cast("bigint"))
    first = Window.partitionBy(*keys).orderBy("row")
    top = (completed.filter(F.coalesce("reject_reason", F.lit("")) != "").withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= reasons)
           .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", "reject_reason"))).alias("_l"))
           .select(*keys, F.array_join(F.transform("_l", lambda x: x["reject_reason"]), "; ").alias("first_reasons")))
    return base.join(top, keys, "left")
