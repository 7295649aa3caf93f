"""Ordered computations that survive one key holding a large share of all rows.

A plain window sorts a whole key in one task. Here a key is first split into chunks that follow
the order, chunk totals are added up over the few chunks, and only rows of one chunk meet in a task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST = Window.unboundedPreceding


def running_total(df: DataFrame, keys: list[str], chunk: Column, order: list, value: Column | str, name: str,
                  total: str | None = None) -> DataFrame:
    """Add ``name``: the sum of ``value`` up to and including each row, in ``order`` within ``keys``.

    ``chunk`` must not decrease along the order. ``total`` optionally names the sum over the key.
    """
    value = F.col(value) if isinstance(value, str) else value
    parts = df.withColumn("_chunk", chunk).withColumn("_value", value)
    sums = parts.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_sum"))
    over = Window.partitionBy(*keys).orderBy("_chunk")
    offsets = sums.select(*keys, "_chunk",
                          F.coalesce(F.sum("_sum").over(over.rowsBetween(FIRST, -1)), F.lit(0)).alias("_before"),
                          F.sum("_sum").over(Window.partitionBy(*keys)).alias("_total"))
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(FIRST, 0)
    out = parts.join(offsets, [*keys, "_chunk"]).withColumn(name, F.col("_before") + F.sum("_value").over(inner))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_chunk", "_value", "_before", "_total")


def with_previous(df: DataFrame, keys: list[str], seq: str, columns: dict[str, str], chunk: int = 4096) -> DataFrame:
    """Add columns of the row before (``new name -> column``) for rows numbered densely by ``seq``.

    The last row of a chunk is copied into the next one, so no task holds more than a chunk.
    """
    home = F.floor(F.col(seq) / chunk)
    copies = df.withColumn("_chunk", F.explode(
        F.when(F.col(seq) % chunk == chunk - 1, F.array(home, home + 1)).otherwise(F.array(home))))
    w = Window.partitionBy(*keys, "_chunk").orderBy(seq)
    for new, old in columns.items():
        copies = copies.withColumn(new, F.lag(old).over(w))
    return copies.filter(F.col("_chunk") == home).drop("_chunk")


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], bins: int = 4096) -> DataFrame:
    """Exact values at given 0-based ranks of each key: ``ranks`` maps a name to a Column over ``n``.

    Rows are counted per equal-width bin and distinct value, then only the bins that hold a wanted
    rank are ranked; equal values are one row however often they occur.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    span = counts.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_c").alias("n"))
    width = F.col("_hi") - F.col("_lo")
    binned = counts.join(span, keys).withColumn(
        "_bin", F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / width * bins))).otherwise(0))
    per_bin = binned.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_s"), F.first("n").alias("n"))
    w = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(FIRST, 0)
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), v.cast("bigint").alias("rank")) for k, v in ranks.items()])
    hits = (per_bin.withColumn("_upto", F.sum("_s").over(w)).withColumn("_want", F.explode(wanted))
            .filter((F.col("_want.rank") < F.col("_upto")) & (F.col("_want.rank") >= F.col("_upto") - F.col("_s")))
            .select(*keys, "_bin", F.col("_want.name").alias("_name"),
                    (F.col("_want.rank") - (F.col("_upto") - F.col("_s"))).alias("_rank")))
    inner = Window.partitionBy(*keys, "_name").orderBy(value).rowsBetween(FIRST, 0)
    found = (binned.select(*keys, "_bin", value, "_c").join(hits, [*keys, "_bin"])
             .withColumn("_upto", F.sum("_c").over(inner))
             .filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c"))))
    picked = [F.max(F.when(F.col("_name") == k, F.col(value))).alias(k) for k in ranks]
    return found.groupBy(*keys).agg(*picked).join(span.select(*keys, "n"), keys)


def median_ranks(name: str) -> dict[str, Column]:
    """The two middle ranks; their mean is the median."""
    n = F.col("n")
    return {f"{name}_low": F.floor((n - 1) / 2), f"{name}_high": F.floor(n / 2)}


def median_of(name: str) -> Column:
    return (F.col(f"{name}_low") + F.col(f"{name}_high")) / 2
