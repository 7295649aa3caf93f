"""Exact top-k search by inner product on a bit-sliced index.

Vectors are held in blocks; every component of a block is a set of bitmaps, one per binary digit. A query adds the
bitmaps of all components with carry-save bitmap arithmetic, which gives the score of all rows of the block as bit
slices. The k best are taken from the most significant slice downward; rows that tie at the boundary are decided by id.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block of the index, and queries of a block of queries.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 128
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)

FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
BLOCK = T.StructType([T.StructField("block", T.LongType()), T.StructField("dims", T.IntegerType()), T.StructField("ids", T.BinaryType()),
                      T.StructField("values", T.BinaryType())])


def quantised(embeddings: DataFrame, levels: int = 256) -> DataFrame:
    """vec_id and values, floor(levels * x) of every component; vectors that are null, empty or hold a null or a
    non-finite component, and rows without id, take no part. A product that a long can't hold is an error."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    whole = lambda v: F.when(F.abs(v * levels) < 2.0 ** 63, F.floor(v * levels)).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))
    return (embeddings.filter(fine & (F.size("embedding") > 0) & F.col("vec_id").isNotNull())
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("values")))


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """One row per block of about ``rows`` vectors of one length, dealt by hash."""
    n = max(1, -(-vectors.count() // rows))
    dealt = vectors.withColumns({"dims": F.size("values"), "block": F.pmod(F.xxhash64("vec_id", "values"), F.lit(n))})

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        return pd.DataFrame({"block": [frame["block"].iat[0]], "dims": [frame["dims"].iat[0]], "ids": [frame["vec_id"].to_numpy("int64").tobytes()],
                             "values": [np.stack(frame["values"].to_numpy()).astype("int64").tobytes()]})

    return dealt.groupBy("block", "dims").applyInPandas(gather, BLOCK)


class SlicedBlock:
    """Bit slices of a block: ``slices[d, b]`` is the bitmap of digit b of component d, counted from ``low``."""

    def __init__(self, values: np.ndarray):
        self.rows = len(values)
        self.low, self.high = int(values.min()), int(values.max())
        self.bits = max(1, (self.high - self.low).bit_length())
        padded = np.zeros((values.shape[1], -(-self.rows // 64) * 64), "uint64")
        # Differences of longs fit 64 bits without sign.
        padded[:, :self.rows] = values.T.astype("uint64") - np.uint64(self.low % (1 << 64))
        self.slices = np.stack([np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype("uint8"), axis=1, bitorder="little").view("uint64")
                                for b in range(self.bits)], 1)

    def score_slices(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bit slices of the score less a constant, lowest first, and that constant."""
        by_weight: dict[int, list[np.ndarray]] = {}
        size = np.abs(query)
        most = sum(map(abs, query.tolist()))
        if most * max(abs(self.low), abs(self.high), 1 << self.bits) >= 1 << 63:
            raise OverflowError("a score may be beyond 64 bits")
        # -q u = q (m - u) - q m, with m - u the complement of u's digits.
        top = (1 << self.bits) - 1
        constant = self.low * int(query.sum()) - top * int(size[query < 0].sum())
        turned = np.where((query < 0)[:, None, None], ~self.slices, self.slices)
        for j in range(int(size.max()).bit_length()):
            picked = turned[((size >> j) & 1) == 1]
            for b in range(self.bits if len(picked) else 0):
                by_weight.setdefault(j + b, []).append(picked[:, b])
        out, weight = [], 0
        while by_weight:
            parts = by_weight.pop(weight, None)
            column = np.concatenate(parts) if parts else np.zeros((1, self.slices.shape[2]), "uint64")
            while len(column) > 2:
                n = len(column) // 3
                a, b, c = column[:n], column[n:2 * n], column[2 * n:3 * n]
                half = a ^ b
                by_weight.setdefault(weight + 1, []).append((a & b) | (half & c))
                column = np.concatenate([half ^ c, column[3 * n:]])
            if len(column) == 2:
                by_weight.setdefault(weight + 1, []).append((column[0] & column[1])[None])
                column = (column[0] ^ column[1])[None]
            out.append(column[0])
            weight += 1
        return out, constant

    def top(self, query: np.ndarray, among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best rows of the bitmap ``among``, and all that tie with the last of them."""
        slices, constant = self.score_slices(query)
        sure, even = np.zeros_like(among), among.copy()
        held = 0
        for s in reversed(slices):
            ones = even & s
            n = int(np.bitwise_count(ones).sum())
            if held + n >= k:
                even = ones
            else:
                sure, even, held = sure | ones, even & ~s, held + n
        rows = np.flatnonzero(np.unpackbits((sure | even).view("uint8"), bitorder="little"))
        score = np.full(len(rows), constant, "int64")
        for w, s in enumerate(slices):
            score += (((s[rows >> 6] >> (rows & 63).astype("uint64")) & np.uint64(1)).astype("int64") << w)
        return rows, score


def _search(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for dims, ids, values, q_ids, q_values in zip(frame["dims"], frame["ids"], frame["values"], frame["q_ids"], frame["q_values"]):
            ids = np.frombuffer(ids, "int64")
            index = SlicedBlock(np.frombuffer(values, "int64").reshape(-1, dims))
            everyone = np.zeros(index.slices.shape[2] * 64, "uint8")
            everyone[:index.rows] = 1
            found: list[tuple] = []
            for q, query in zip(np.frombuffer(q_ids, "int64"), np.frombuffer(q_values, "int64").reshape(-1, dims)):
                among = everyone.copy()
                among[np.searchsorted(ids, q):np.searchsorted(ids, q, "right")] = 0
                rows, score = index.top(query, np.packbits(among, bitorder="little").view("uint64"), k)
                # Equal scores go to the smaller id; ids are in order.
                best = np.lexsort((ids[rows], -score))[:k]
                found += [(int(q), int(ids[r]), int(s)) for r, s in zip(rows[best], score[best])]
            yield pd.DataFrame(found, columns=FOUND.names)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` with the highest integer inner product for each row of
    ``queries`` (both vec_id, values), its own id left out; all rows if there are fewer. Ties go to the smaller vec_id.

    Only vectors of the query's length are compared. Rows of ``vectors`` that share an id are candidates each; rows of
    ``queries`` that do share one list, the best of all their answers. Scores are longs; vectors whose scores could be
    beyond that are an error. Empty tables give an empty table.
    """
    index, asked = blocks(vectors, BLOCK_ROWS), blocks(queries, BLOCK_QUERIES)
    asked = asked.select(F.col("dims"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values"))
    pairs = index.join(asked, "dims").repartition(F.xxhash64("ids"), F.xxhash64("q_ids"))
    found = pairs.mapInPandas(lambda batches: _search(batches, k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
