"""Reading outlet lists as text tables."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def header_key(name: str) -> str:
    """Header without case, underscores, spaces or a byte-order mark."""
    return re.sub(r"[_\s]+", "", name.replace("﻿", "").strip().lower())


def normalise_headers(df: DataFrame) -> DataFrame:
    """Rename columns to header keys; a repeated header keeps its first column under the key."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        key = header_key(c)
        seen[key] = seen.get(key, 0) + 1
        names.append(key if seen[key] == 1 else f"{key}__{seen[key]}")
    return df.toDF(*names)


def read_outlets_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header row, every value kept as text; blank lines are skipped."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("encoding", "UTF-8").csv(path)
    return normalise_headers(raw)


def has_coordinates(columns: list[str]) -> bool:
    keys = [header_key(c) for c in columns]
    return any("lat" in k for k in keys) and any("lng" in k or "lon" in k for k in keys)


def pick_table(tables: dict[str, DataFrame]) -> tuple[str, list[str]]:
    """Of several tables the first with a latitude and a longitude column, else the first; and the others."""
    names = list(tables)
    used = next((n for n in names if has_coordinates(tables[n].columns)), names[0])
    return used, [n for n in names if n != used]


def row_numbers(df: DataFrame, order: str, first: int = 2) -> DataFrame:
    """File row numbers from an increasing column (``first`` is the line after the header)."""
    return df.withColumn("row", F.col(order) + F.lit(first))
