"""Near-duplicate documents by b-bit MinHash.

Each distinct shingle set is one node, known by 128 bits of hash. Of its MINIMA minimum hashes, five at a time make band
keys, and the low two bits of each are packed into a few longs. Sets with a common band key are candidates; the share of
equal bit pairs, less what chance makes equal, estimates their similarity, and what may reach the bound is confirmed on
the full sets. Two sets at a similarity of 0.8 miss each other in all 50 bands once in 4e8.

A band key may be common to very many sets. First every set is compared with one centre of its keys; what is linked is
one component, and keys whose sets are one component are done. The sets of keys that are left are dealt to blocks of
bounded size; a call takes two blocks, compares packed bits, and confirms on the full sets what is not yet one component.
Some of the keys go first, since they leave little to the others.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatwise.llm.jaccard_join import WordHashes, shingle_set
from beatwise.llm.tables import text_chunks
from beatwise.operators.neighbours import min_labels
from beatwise.session import cut

#: Words of a shingle; a link needs SHARE hundredths of the union.
SHINGLE, SHARE = 2, 80
BANDS, ROWS = 50, 5
MINIMA = BANDS * ROWS
#: Two bits of each minimum are kept; unequal minima agree in them once in four.
BITS, CHANCE = 2, 0.25
LONGS = -(-MINIMA * BITS // 64)
#: Standard errors by which an estimate may fall short of the bound.
ERRORS = 6
#: Shingles that are hashed at a time; sets, and shingles, in a block.
HASHED, BLOCK, BLOCK_SHINGLES = 400_000, 2048, 4_000_000
#: One in so many open keys goes first.
FIRST_KEYS = 8
EVEN = 0x5555555555555555

_random = np.random.Generator(np.random.PCG64(13))
FACTORS = _random.integers(0, 2 ** 31, MINIMA, "uint32") * np.uint32(2) + np.uint32(1)
MASKS = _random.integers(0, 2 ** 32, MINIMA, "uint32")
FINAL = _random.integers(0, 2 ** 31, MINIMA, "uint32") * np.uint32(2) + np.uint32(1)
MIX = np.uint64(0x9E3779B97F4A7C15)

SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType(), False), T.StructField("sig", T.BinaryType()),
                       T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType()))])
SETS = T.StructType([T.StructField("sig", T.BinaryType()), T.StructField("shingles", T.BinaryType())])


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least of each of MINIMA hashes over each (non-empty) set: sets x MINIMA."""
    x = np.concatenate(sets)
    x = (x >> np.uint64(32)).astype("uint32")
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((MINIMA, len(sets)), "uint32")
    for i in range(MINIMA):
        out[i] = np.minimum.reduceat((x ^ MASKS[i]) * FACTORS[i], starts)
    return out.T


def band_keys(least: np.ndarray) -> np.ndarray:
    """Sets x BANDS keys; keys of different bands differ."""
    parts = least.reshape(len(least), BANDS, ROWS).astype("uint64")
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype="uint64") * MIX, parts.shape[:2])
    for r in range(ROWS):
        key = (key ^ parts[:, :, r]) * MIX
        key = key ^ (key >> np.uint64(29))
    return key.view("int64")


def packed_bits(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, after a last mix, in LONGS longs a set; unused bits are 0."""
    low = (least * FINAL) >> np.uint32(32 - BITS)
    wide = np.zeros((len(least), LONGS * 64 // BITS), "uint64")
    wide[:, :MINIMA] = low
    shifts = np.arange(0, 64, BITS, dtype="uint64")
    return (wide.reshape(len(least), LONGS, -1) << shifts).sum(2, dtype="uint64").view("int64")


def signature(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (shingles), and for texts with words the set's signature, band keys and packed bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch, texts in text_chunks(batches):
            start = 0
            while start < len(texts):
                sets, held = [], 0
                while start + len(sets) < len(texts) and (not sets or held < HASHED):
                    sets.append(shingle_set(texts[start + len(sets)], size, cache))
                    held += len(sets[-1])
                full = [i for i, s in enumerate(sets) if len(s)]
                sig, bands, bits = ([None] * len(sets) for _ in range(3))
                if full:
                    least = minima([sets[i] for i in full])
                    for i, keys, low in zip(full, band_keys(least), packed_bits(least)):
                        sig[i], bands[i], bits[i] = signature(sets[i]), keys, low
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=SIGNED.names)
                start += len(sets)

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """Signature and shingles of every text with words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for _, texts in text_chunks(batches, "text"):
            sets = [s for s in (shingle_set(t, size, cache) for t in texts) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             names=SETS.names)

    return docs.select("text").mapInArrow(run, SETS)


def least_equal(share: int) -> int:
    """Equal bit pairs that a pair at the bound has but for a deviation of ERRORS standard errors."""
    p = share / 100 + (1 - share / 100) * CHANCE
    return int(np.floor(MINIMA * p - ERRORS * np.sqrt(MINIMA * p * (1 - p))))


def _equal_pairs(a: str, b: str) -> Column:
    """Minima whose packed bits agree."""
    unequal = F.lit(0)
    for i in range(LONGS):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        unequal = unequal + F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(EVEN)))
    return MINIMA - unequal


def estimate(equal: Column) -> Column:
    """Similarity from equal bit pairs, corrected for those that agree by chance."""
    return (equal / MINIMA - CHANCE) / (1 - CHANCE)


def _may_link(pairs: DataFrame, reps: DataFrame, share: int) -> DataFrame:
    """Those of the pairs (sig, other) whose sizes and estimate allow a link."""
    one = reps.select("sig", "n", "bits")
    two = reps.select(F.col("sig").alias("other"), F.col("n").alias("m"), F.col("bits").alias("other_bits"))
    met = pairs.join(one, "sig").join(two, "other").filter(100 * F.least("n", "m") >= share * F.greatest("n", "m"))
    bound = (least_equal(share) / MINIMA - CHANCE) / (1 - CHANCE) - 1e-9
    return met.filter(estimate(_equal_pairs("bits", "other_bits")) >= bound).select("sig", "other")


def links(a: bytes, b: bytes, share: int) -> bool:
    x, y = np.frombuffer(a, "uint64"), np.frombuffer(b, "uint64")
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= share * (len(x) + len(y) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Those of the pairs (sig, other) that link by their full sets."""
    both = pairs.join(sets, "sig").join(sets.select(F.col("sig").alias("other"), F.col("shingles").alias("others")), "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("shingles"), batch.column("others")
            yield batch.select(["sig", "other"]).filter(pa.array([links(x.as_py(), y.as_py(), share) for x, y in zip(a, b)], pa.bool_()))

    return both.select("sig", "other", "shingles", "others").mapInArrow(run, "sig binary, other binary")


def _block_links(open_: DataFrame, reps: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links (sig, other) that tie together what is linked among the sets of each key (band, sig, label). The sets of a
    key are dealt to blocks; a call holds two blocks and returns a link only where it joins two components."""
    rows = open_.select("band", "sig", "label").join(reps.select("sig", "n", "bits"), "sig")
    sizes = rows.groupBy("band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    rows = rows.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("block")).alias("i"), F.greatest(b, F.col("block")).alias("j")))
    rows = rows.select("band", "sig", "label", "n", "bits", "block", F.explode(pair).alias("p")).select("band", "p.i", "p.j", "sig", "label", "n", "bits", "block").join(sets, "sig")
    least = least_equal(share)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("sig", ignore_index=True)
        whole = frame["i"].iat[0] == frame["j"].iat[0]
        bits = np.array(frame["bits"].tolist(), "int64").view("uint64")
        n, names, sets_ = frame["n"].to_numpy(), frame["sig"].tolist(), frame["shingles"].tolist()
        part = pd.factorize(frame["label"])[0]
        left = np.arange(len(frame)) if whole else np.flatnonzero(frame["block"] == frame["i"])
        right = left if whole else np.flatnonzero(frame["block"] == frame["j"])
        out = []
        for p in left:
            other = right[(right > p) & (part[right] != part[p])] if whole else right[part[right] != part[p]]
            if not len(other):
                continue
            x = bits[other] ^ bits[p]
            equal = MINIMA - np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(EVEN)).sum(1, dtype="int64")
            fit = (equal >= least) & (100 * np.minimum(n[other], n[p]) >= share * np.maximum(n[other], n[p]))
            other, equal = other[fit], equal[fit]
            for q in other[np.argsort(-equal, kind="stable")]:
                if part[q] != part[p] and links(sets_[p], sets_[q], share):
                    out.append((names[p], names[q]))
                    part[part == part[q]] = part[p]
        return pd.DataFrame(out, columns=["sig", "other"])

    return rows.groupBy("band", "i", "j").applyInPandas(compare, "sig binary, other binary")


def classes(documents: DataFrame, size: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``documents`` (doc_id, text).

    Two documents link if ``share`` hundredths of the union of their shingles are common; component_id is the smallest
    doc_id reachable by links, and a document is kept if that is its own. A text of fewer words is one shingle; null and
    empty texts, and those without words, are linked with nothing. Rows that repeat are copies; the texts of a repeated
    doc_id are linked. A row without doc_id has a null component, links nothing and is kept. Other columns are ignored.
    Shingles are compared by 64 bits of hash, whole sets by 128.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    heads = cut(signed(docs, size))
    named = heads.filter("sig is not null and doc_id is not null")
    reps = cut(named.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "bits", "bands")]))
    keys = reps.select("sig", F.explode("bands").alias("band"))
    # Keys of the same sets are one: two order-free hashes of the sets tell.
    of = [F.bit_xor(F.xxhash64("sig", F.lit(seed))).alias(f"of{seed}") for seed in (1, 2)]
    shared = keys.groupBy("band").agg(F.count(F.lit(1)).alias("sets"), F.min("sig").alias("centre"), *of).filter("sets > 1")
    shared = shared.groupBy("sets", "centre", "of1", "of2").agg(F.min("band").alias("band")).select("band", "centre")
    open_ = cut(keys.join(shared, "band").withColumn("label", F.col("sig")))
    tie = lambda links: links.select(F.lit(0).alias("all"), F.col("sig").alias("src"), F.col("other").alias("dst"))
    # The texts of one doc_id are linked whatever they hold.
    own = named.groupBy("doc_id").agg(F.min("sig").alias("other"), F.max("sig").alias("last")).filter("other <> last").select("doc_id", "other")
    found = cut(tie(named.join(own, "doc_id").filter("sig <> other").select("sig", "other").distinct()))

    near = open_.select("sig").distinct()
    holders = reps.join(near, "sig", "left_semi").select("doc_id").distinct()
    sets = sets_of(docs.join(holders, "doc_id", "left_semi"), size).join(near, "sig", "left_semi")
    sets = cut(sets.groupBy("sig").agg(F.first("shingles").alias("shingles")))

    def labelled(rows: DataFrame) -> DataFrame:
        """The rows of keys with more than one component, by what is linked so far."""
        ends = found.select("all", F.col("src").alias("node")).union(found.select("all", F.col("dst").alias("node"))).distinct()
        label = min_labels(ends, found, ["all"]).select(F.col("node").alias("sig"), F.col("label").alias("_label"))
        rows = rows.join(label, "sig", "left").withColumn("label", F.coalesce("_label", "sig")).drop("_label")
        several = rows.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("band")
        return cut(rows.join(several, "band", "left_semi"))

    # Of each set's centres the first that may link.
    pairs = _may_link(open_.filter("sig <> centre").select("sig", F.col("centre").alias("other")).distinct(), reps, share)
    found = cut(found.union(tie(_confirmed(pairs.groupBy("sig").agg(F.min("other").alias("other")), sets, share))))
    open_ = labelled(open_)
    early = F.pmod(F.xxhash64("band"), F.lit(FIRST_KEYS)) == 0
    found = cut(found.union(tie(_block_links(open_.filter(early), reps, sets, share))))
    open_ = labelled(open_.filter(~early))
    found = cut(found.union(tie(_block_links(open_, reps, sets, share))))

    ends = found.select("all", F.col("src").alias("node")).union(found.select("all", F.col("dst").alias("node"))).distinct()
    label = min_labels(ends, found, ["all"]).select(F.col("node").alias("sig"), "label")
    at = cut(reps.select("sig", "doc_id").join(label, "sig", "left").withColumn("label", F.coalesce("label", "sig")))
    best = at.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_sig = at.join(best, "label").select("sig", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = heads.select("doc_id", "n", "sig").join(of_sig, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
