"""Shared helpers: reading tables, row order of Arrow batches, groups of sorted batches."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of this many characters are worked on at a time; a longer text makes a chunk alone.
CHUNK_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, divisor: int):
    """crc32 of the id as text, modulo the divisor; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Pieces of the batches with their texts as Python strings, so that memory follows the characters, not the rows."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        start = chars = 0
        out: list = []
        for row in range(batch.num_rows):
            text = texts[row].as_py()
            if out and chars + len(text or "") > CHUNK_CHARS:
                yield batch.slice(start, len(out)), out
                start, chars, out = row, 0, []
            out.append(text)
            chars += len(text or "")
        if out:
            yield batch.slice(start, len(out)), out


def sorted_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of frames that come sorted by ``keys``; a group may span frames."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        same = frame[keys].fillna("\0null").astype(str).agg("\0".join, axis=1)
        starts = [0, *[i for i in range(1, len(frame)) if same.iat[i] != same.iat[i - 1]], len(frame)]
        for a, b in zip(starts, starts[1:]):
            part = frame.iloc[a:b]
            name = same.iat[a]
            if held and held[0].attrs["name"] != name:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            part.attrs["name"] = name
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]
