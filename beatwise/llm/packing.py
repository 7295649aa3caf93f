"""Best-fit packing by the sum-of-squares rule.

Documents become token pieces of at most ``capacity`` tokens; a piece goes into the open sequence after which the sum
over all residual gaps of (number of open sequences with that gap) squared is smallest.
"""
from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatwise.session import cut

#: Words whose ids a worker keeps, in two generations of this size.
CACHE_WORDS = 300_000
#: Pieces that one task packs.
SHARD_PIECES = 16_384

PIECE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType(), False),
                      T.StructField("start", T.LongType(), False), T.StructField("length", T.LongType(), False),
                      T.StructField("ids_crc32", T.LongType(), False)])
PLACE = T.StructType(PIECE.fields + [T.StructField("sequence_id", T.LongType(), False),
                                     T.StructField("offset", T.LongType(), False)])


class WordIds:
    """Little-endian 32-bit ids of space-separated words, equal to those of the whole text.

    Holds for a tokenizer that drops white space and splits letters from marks before merging, so blanks are
    boundaries. A word of Latin letters goes straight to the merges; anything unusual takes the full tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        plain = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]
        rest = [b for b in range(256) if b not in plain]
        self.byte_chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        core = word.rstrip(".,;:!?*#$%&|")
        if core and core.isalpha() and max(core) < "Ā":
            letters = core.lower()
            # Forms of one word share its ids.
            if letters != word:
                return self[letters] if core == word else self[letters] + self[word[len(core):]]
            if not letters.isascii():
                letters = "".join([self.byte_chars[b] for b in letters.encode()])
            return array("I", [t.id for t in self.full.model.tokenize(letters)]).tobytes()
        return self.encode(word)

    def __getitem__(self, word: str) -> bytes:
        found = self.young.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                found = self.word(word) if word else b""
            if len(self.young) >= CACHE_WORDS:
                self.young, self.old = {}, self.young
            self.young[word] = found
        return found

    def text(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        get = self.young.get
        ids = [get(w) for w in words]
        if None in ids:
            ids = [self[w] if b is None else b for w, b in zip(words, ids)]
        return b"".join(ids)


_loaded: dict[str, WordIds] = {}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Pieces of the documents (doc_id, text): doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids and ``end_id``. Only documents over ``capacity`` tokens are cut. A null or empty text is the
    end id alone; repeated rows are packed each; other columns are ignored.
    """
    schema = T.StructType(PIECE.fields + ([T.StructField("ids", T.ArrayType(T.LongType()), False)] if keep_ids else []))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _loaded:
            _loaded[tokenizer] = WordIds(tokenizer)
        words, end = _loaded[tokenizer], np.array([end_id], "<u4").tobytes()
        for batch in batches:
            docs_of, out, ids_of = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.text(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    docs_of.append(doc)
                    out.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    if keep_ids:
                        ids_of.append(np.frombuffer(part, "<u4").astype("int64"))
            cols = np.array(out, "int64").reshape(-1, 4)
            arrays = [pa.array(docs_of, pa.int64()), pa.array(cols[:, 0].astype("int32")), *[pa.array(cols[:, i]) for i in (1, 2, 3)]]
            if keep_ids:
                arrays.append(pa.array(ids_of, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_up, schema)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, in the given order.

    Among open sequences with room, and a new one only if there is none, the one that leaves the least sum of squared
    counts: moving a sequence from gap g to g - l changes it by 2 (N[g - l] - N[g]) + 2, and by 1 - 2 N[g] if it closes.
    Ties go to the smaller gap, and the sequence that got that gap first.
    """
    count = np.zeros(capacity + 1, "int64")
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    heads = [0] * (capacity + 1)
    number, offset, made = np.empty(len(lengths), "int64"), np.empty(len(lengths), "int64"), 0
    none = np.int64(1) << 60
    for i, size in enumerate(lengths.tolist()):
        have = count[size:]
        change = 2 * (count[:capacity + 1 - size] - have) + 2
        change[0] = 1 - 2 * have[0]
        change[have == 0] = none
        left = int(change.argmin())
        if change[left] < none:
            gap = left + size
            bin_ = open_at[gap][heads[gap]]
            heads[gap] += 1
            if heads[gap] == len(open_at[gap]):
                open_at[gap], heads[gap] = [], 0
            count[gap] -= 1
        else:
            gap, left, bin_, made = capacity, capacity - size, made, made + 1
        number[i], offset[i] = bin_, capacity - gap
        if left:
            count[left] += 1
            open_at[left].append(bin_)
    return number, offset


def pack(pieces: DataFrame, capacity: int = 4096, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pieces with sequence_id and offset, gapless from 0 in each sequence.

    Pieces are dealt by hash into shards of about ``shard_pieces`` that are packed apart, longest first, so no task or
    driver sees all of them; a shard wastes about one sequence. An empty table gives an empty table.
    """
    pieces = cut(pieces)
    shards = max(1, -(-pieces.count() // shard_pieces))
    names = [f.name for f in PIECE.fields]

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        number, offset = place(frame["length"].to_numpy(), capacity)
        shard = int(frame["_shard"].iat[0])
        return frame[names].assign(sequence_id=number + (shard << 40), offset=offset)

    dealt = pieces.select(*names, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).alias("_shard"))
    return dealt.groupBy("_shard").applyInPandas(fill, PLACE)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    return pack(token_pieces(docs, tokenizer, capacity, end_id), capacity)
