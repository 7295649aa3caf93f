"""Line dedup: repeated runs of lines by prefix doubling over line ids.

The id of the 2k lines from a position is made of the ids of its two halves, as in the construction of a suffix array
by doubling. Two overlapping ids of a power of two name any run, so the suffixes that share a run, an interval of the
suffix array with that common prefix, are one group, and all but its first position are later copies.

Groups are formed for the shortest run of enough words from each position on, and for the shortest one up to each
position. Every line of a maximal repeated run lies in one of those that is itself inside the run, and how long they
are depends on the lines alone, so the union of the later copies among them is the union of all maximal ones.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwise.session import cut

#: Words of the shortest run that is deleted.
MIN_WORDS = 50
BLANK = r"[\x20\x09-\x0D]+"


def _mark() -> Column:
    return F.struct(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b")).alias("mark")


def _shortest(before: Column, lines: Column, least: int, bits: int, backward: bool) -> Column:
    """For every line the number of lines of the shortest run of ``least`` words that starts (or ends) there, null if
    there is none. ``before`` has the words before each line and after the last; lengths that fall short are added up
    from the highest power of two."""
    def run(i: Column, n: Column) -> Column:
        return F.get(before, i + 1) - F.get(before, i + 1 - n) if backward else F.get(before, i + n) - F.get(before, i)

    def length(_, i: Column) -> Column:
        short = F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(bits))]), F.lit(0),
                            lambda n, step: F.when(((i + 1 - n - step >= 0) if backward else (i + n + step <= F.size(lines))) & (run(i, n + step) < least), n + step).otherwise(n))
        room = (i - short >= 0) if backward else (i + short < F.size(lines))
        return F.when(room, short + 1)

    return F.transform(lines, length)


def _summed(sums: Column, step: int) -> Column:
    return F.transform(sums, lambda v, i: v + F.when(i >= step, F.get(sums, i - step)).otherwise(0))


def _doubled(half: Column, step: int) -> Column:
    def both(v: Column, i: Column) -> Column:
        w = F.get(half, i + step)
        return F.struct(F.xxhash64(v["x"], w["x"]).alias("x"), F.xxhash64(w["y"], v["y"], F.lit(1)).alias("y"))

    return F.transform(half, both)


def _groups(table: DataFrame, levels: int, lengths: str, backward: bool) -> DataFrame:
    """place, n, id of the run that starts or ends at each line."""
    def run(n: Column, i: Column) -> Column:
        start = (i + 1 - n) if backward else i
        level = F.length(F.bin(n)) - 1
        half = F.get(F.array(*[F.col(f"l{k}") for k in range(levels)]), level)
        a, b = F.get(half, start), F.get(half, start + n - F.element_at(powers, level + 1))
        return F.when(n.isNotNull(), F.struct(start.alias("at"), n.alias("n"), a["x"].alias("x"), b["x"].alias("y"), F.xxhash64(a["y"], b["y"]).alias("z")))

    powers = F.array(*[F.lit(1 << k) for k in range(levels)])
    # Not an inner explode: its inferred filter would be pushed below and repeat the whole chain of array expressions.
    rows = table.select("doc_id", "mark", F.explode_outer(F.transform(lengths, run)).alias("r")).filter("r is not null")
    return rows.select(F.struct("doc_id", "mark", "r.at").alias("place"), "r.n", F.struct("r.n", "r.x", "r.y", "r.z").alias("id"))


def later_copies(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, mark, at, n: runs of ``n`` lines from line ``at`` on that have at least ``min_words`` words and an
    earlier copy, by doc_id and place. Their union covers all such runs."""
    lines = F.split("text", "\n", -1)
    base = documents.filter("text is not null").select("doc_id", _mark(), lines.alias("lines"))
    count = F.transform("lines", lambda v: F.size(F.array_remove(F.split(v, BLANK), "")))
    base = cut(base.select("doc_id", "mark", F.transform("lines", lambda v: F.struct(F.xxhash64(v).alias("x"), F.xxhash64(v, F.lit(7)).alias("y"))).alias("l0"),
                           count.alias("words")))
    # Words before each line, by sums over powers of two: as many steps as the longest document's number of lines has bits.
    most = base.agg(F.max(F.size("l0"))).first()[0] or 0
    bits = max(1, most.bit_length())
    table = base.withColumn("sums", F.col("words"))
    for k in range(bits):
        table = table.withColumn("sums", _summed(F.col("sums"), 1 << k))
    table = table.withColumn("before", F.concat(F.array(F.lit(0)), "sums"))
    table = cut(table.select("doc_id", "mark", "l0", _shortest(F.col("before"), F.col("l0"), min_words, bits, False).alias("ahead"),
                             _shortest(F.col("before"), F.col("l0"), min_words, bits, True).alias("behind")))
    longest = table.agg(F.max(F.greatest(F.array_max("ahead"), F.array_max("behind")))).first()[0] or 0
    levels = max(1, int(longest).bit_length())
    for k in range(1, levels):
        table = table.withColumn(f"l{k}", _doubled(F.col(f"l{k - 1}"), 1 << (k - 1)))
    runs = cut(_groups(table, levels, "ahead", False).union(_groups(table, levels, "behind", True)).distinct())
    # A group is reduced to its first place before the join, so a run in a third of all documents is one row there.
    first = runs.groupBy("id").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first < last").drop("last")
    return runs.join(first, "id").filter("place > first").select("place.doc_id", "place.mark", "place.at", "n")


def dedup(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``documents`` (doc_id, text) with the text less the lines of later copies, and ``line_count``,
    ``lines_deleted``.

    The first copy, by doc_id and line, stays. Lines end at \\n and are compared whole; words are what white space
    parts. Null texts stay null with no lines; an empty text is one empty line; rows equal in doc_id and text are one
    document and come out alike. Input columns named line_count or lines_deleted are replaced.
    """
    gone = later_copies(documents, min_words)
    gone = gone.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    gone = gone.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"),
                       F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["at"], r["at"] + r["n"] - 1)))).alias("_gone"))
    names = [n for n in documents.columns if n not in ("line_count", "lines_deleted")]
    both = documents.select(*names, _mark().alias("_own"), F.split("text", "\n", -1).alias("_lines"))
    both = both.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_mark")), "left")
    n = F.coalesce(F.size("_lines"), F.lit(0))
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"))
    return both.select(*[text.alias("text") if c == "text" else F.col(c) for c in names],
                       F.when(F.col("text").isNull(), F.lit(0)).otherwise(n).cast("long").alias("line_count"),
                       F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("lines_deleted"))
