"""Benchmark decontamination by winnowing.

The fingerprints of a text are the smallest ``GRAM``-word hash of every sliding window of hashes; two texts that share
``SPAN`` words in a row share a fingerprint inside that span. Fingerprints of documents and items are joined and every
hit is extended, word by word, to the windows around it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwise.session import cut

#: Words of a window, and of a fingerprint. Windows of SPAN - GRAM + 1 fingerprints make every shared SPAN words meet.
SPAN, GRAM = 13, 7
#: Item fingerprints that are broadcast at most (about 40 bytes each); more of them are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Copies of an item fingerprint in the shuffled join, so that a passage in a third of all documents spreads.
SALTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _pairs(array: Column, step: int, both) -> Column:
    """``both`` of every value and the one ``step`` places on."""
    return F.transform(F.slice(array, F.lit(1), F.greatest(F.size(array) - step, F.lit(0))), lambda v, i: both(v, F.get(array, i + step)))


def _exploded(df: DataFrame, array: Column | str, name: str, *keep: str) -> DataFrame:
    """One row per value. Not an inner explode: its inferred filter would be pushed below and repeat the whole chain of
    array expressions."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def _with_grams(df: DataFrame) -> DataFrame:
    """Adds ``grams``, the hash of the GRAM words from every position on: of 2, of 4, then two overlapping fours."""
    df = df.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    for name, of, step in (("h2", "h1", 1), ("h4", "h2", 2), ("grams", "h4", GRAM - 4)):
        df = df.withColumn(name, _pairs(F.col(of), step, F.xxhash64))
    return df.drop("h1", "h2", "h4")


def _with_prints(df: DataFrame) -> DataFrame:
    """Adds ``prints``: the distinct smallest hashes of all windows of SPAN - GRAM + 1 = 7 grams. Empty below SPAN words."""
    df = _with_grams(df)
    for name, of, step in (("m2", "grams", 1), ("m4", "m2", 2), ("m7", "m4", SPAN - GRAM - 3)):
        df = df.withColumn(name, _pairs(F.col(of), step, F.least))
    return df.withColumn("prints", F.array_distinct("m7")).drop("m2", "m4", "m7", "grams")


def _meet(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Join on ``print``: items broadcast if few enough, else salted copies of them."""
    items = cut(items)
    if items.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(items), "print")
    salted = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SALTS)).cast("int")).join(salted, ["print", "salt"]).drop("salt")


def _hit_documents(documents: DataFrame, hits: DataFrame) -> DataFrame:
    """Words of the documents with ``hits`` (doc_id, mark, print), and their hit prints."""
    found = cut(hits.groupBy(F.col("doc_id").alias("_d"), F.col("mark").alias("_m")).agg(F.collect_set("print").alias("hit_prints")))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("mark").eqNullSafe(F.col("_m"))
    # The texts of other documents never leave their task: ids of the hit ones go to them, if few enough (24 bytes each).
    ids = found.select("_d", "_m")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    texts = documents.select("doc_id", _mark(), "text").join(ids, same, "left_semi").dropDuplicates(["doc_id", "mark"])
    both = texts.join(found, same)
    return both.select("doc_id", "mark", words(F.col("text")).alias("words"), "hit_prints")


def spans(documents: DataFrame, prepared: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct doc_id, mark, item_id, start, length of every window of an item that occurs in a document.

    ``documents`` has doc_id and text, ``prepared`` doc_id, mark and prints, ``items`` item_id and words.
    """
    width = SPAN - GRAM
    known = cut(_exploded(_with_prints(items), "prints", "print").distinct())
    hits = _meet(_exploded(prepared, "prints", "print", "doc_id", "mark"), known)
    # All places of the hit fingerprints in hit documents and items, each with the words around it.
    around = lambda i: F.struct(i.alias("at"), F.get(F.col("grams"), i).alias("print"), F.least(i, F.lit(width)).alias("before"),
                                F.slice("words", F.greatest(i - width, F.lit(0)) + 1, SPAN + width).alias("words"))
    index = F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    places = F.transform(F.filter(index, lambda p: F.array_contains("hit_prints", p["g"])), lambda p: around(p["i"]))
    docs = _exploded(_with_grams(_hit_documents(documents, hits)), places, "d", "doc_id", "mark")
    docs = docs.select("doc_id", "mark", F.col("d.print").alias("print"), "d")
    own = _with_prints(items).withColumnRenamed("prints", "hit_prints")
    sides = _exploded(_with_grams(own), places, "e", "item_id").select("item_id", F.col("e.print").alias("print"), "e").distinct()
    # A window that starts b words before the fingerprint lies in both texts or it is no candidate.
    shifts = F.explode(F.sequence(F.lit(0), F.least("d.before", "e.before"))).alias("b")
    window = lambda side: F.slice(F.col(f"{side}.words"), F.col(f"{side}.before") - F.col("b") + 1, SPAN)
    found = (_meet(docs, sides).select("doc_id", "mark", "item_id", "d", "e", shifts).filter((F.size(window("d")) == SPAN) & (window("d") == window("e")))
             .select("doc_id", "mark", "item_id", (F.col("d.at") - F.col("b")).alias("start"), F.lit(SPAN).alias("length")))
    # Items of fewer words are one window each: at most SPAN - 1 lengths, each a gram of its own.
    short = items.filter(F.size("words").between(1, SPAN - 1)).select("item_id", "words").distinct()
    for n in sorted(r[0] for r in short.select(F.size("words")).distinct().collect()):
        few = short.filter(F.size("words") == n).select("item_id", F.col("words").alias("item_words"), F.xxhash64("words").alias("print"))
        texts = documents.select("doc_id", _mark(), words(F.col("text")).alias("words")).filter(F.size("words") >= n)
        gram = F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.struct(i.alias("at"), F.slice("words", i + 1, n).alias("doc_words")))
        every = _exploded(texts, gram, "g", "doc_id", "mark").select("doc_id", "mark", "g.*").withColumn("print", F.xxhash64("doc_words"))
        found = found.union(_meet(every, few).filter("doc_words = item_words").select("doc_id", "mark", "item_id", F.col("at").alias("start"), F.lit(n).alias("length")))
    return found.distinct()


def _mark() -> Column:
    return F.struct(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b")).alias("mark")


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``documents`` (doc_id, text).

    A word is hit if a window of an item of ``benchmark`` (item_id, text) that covers it occurs in the document; a
    document is contaminated if at least one word in 20 is hit. Null and empty texts have no words and no hits; rows
    that repeat get the same result each; an item without id hits words but is not listed; other columns are ignored.
    """
    docs = documents.select("doc_id", _mark(), words(F.col("text")).alias("words"))
    docs = cut(_with_prints(docs).select("doc_id", "mark", F.size("words").cast("long").alias("n_words"), "prints"))
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    found = cut(spans(documents.select("doc_id", "text"), docs, items))
    key = ["doc_id", "mark"]
    starts = found.groupBy(*key, "start").agg(F.max("length").alias("length"))
    hit = (starts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("runs"))
           .select(*key, F.aggregate("runs", F.struct(F.lit(0).alias("n"), F.lit(0).alias("till")),
                                     lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], s["till"]))).alias("n"),
                                                           F.greatest(s["till"], r["end"]).alias("till")), lambda s: s["n"]).alias("n_hit")))
    named = (found.select(*key, F.col("item_id").cast("string").alias("item")).distinct().groupBy(*key)
             .agg(F.sort_array(F.collect_set("item")).alias("items")))
    both = hit.withColumnRenamed("doc_id", "d").withColumnRenamed("mark", "m").alias("h").join(
        named.select(F.col("doc_id").alias("d2"), F.col("mark").alias("m2"), "items"), F.col("d").eqNullSafe(F.col("d2")) & F.col("m").eqNullSafe(F.col("m2")))
    sized = docs.select(*key, "n_words")
    out = sized.join(both, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("mark").eqNullSafe(F.col("m")), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"),
                      ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
