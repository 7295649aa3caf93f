"""N-gram Jaccard join in metric space.

The Jaccard distance of two shingle sets obeys the triangle inequality. Documents are compared with pivots of their
region; the nearest pivot gives the Voronoi cell, and a document whose distance to another pivot exceeds that by at most
twice the reach is replicated into that pivot's cell too, so no link crosses a border. Cells are joined recursively.

Unrelated texts are at distance 1 from every pivot, where no inequality prunes. So the first regions are laid by
shingles: two sets that link share one of the first few shingles in any common order, and all documents with one
leading shingle are a region. The first pivot of a region is its document with the smallest id. Regions that this pivot
does not tie into one component go on, those with the same documents once.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatwise.llm.tables import text_chunks
from beatwise.operators.neighbours import min_labels
from beatwise.session import cut

#: Words of a shingle; a link needs SHARE hundredths of the union.
SHINGLE, SHARE = 4, 85
#: A shingle in the leading part of more documents than this goes last in the order of the next round. Any order gives
#: the same links, so the bound on the list decides speed alone.
FREQUENT, FREQUENT_LIST, ORDER_ROUNDS = 16, 200_000, 2
#: Documents that one task compares, and pivots of a region that has more.
REGION_DOCS, PIVOTS = 256, 32
#: Rows, and bytes of shingles, that are dealt to one call.
CALL_ROWS, CALL_BYTES = 1024, 16 << 20
#: Mean cells of a document up to which a region is split.
COPIES = 1.25
#: Shingles that two blocks are compared by at a time.
COLUMNS = 1 << 14
#: Words whose hashes a worker keeps.
CACHE_WORDS = 500_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ODD = np.uint64(0x9E3779B97F4A7C15)

LEADING = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType(), False), T.StructField("sig", T.StringType(), False),
                        T.StructField("leading", T.ArrayType(T.LongType()), False), T.StructField("spare", T.ArrayType(T.LongType()), False)])
ORDERED = T.StructType([*LEADING[:2], T.StructField("leading", T.ArrayType(T.LongType()))])
SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("shingles", T.BinaryType(), False)])
JOINED = T.StructType([T.StructField("region", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("other", T.LongType()),
                       T.StructField("distances", T.ArrayType(T.DoubleType()))])


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, size: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, "uint64")
    if len(cache) > CACHE_WORDS:
        cache.clear()
    ids = np.fromiter(map(cache.__getitem__, words), "uint64", len(words))
    width = min(size, len(ids))
    mixed = np.full(len(ids) - width + 1, width, "uint64")
    for j in range(width):
        mixed = (mixed ^ ids[j:len(ids) - width + 1 + j]) * ODD
        mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return mixed[np.concatenate([[True], mixed[1:] != mixed[:-1]])]


def links(n: int, m: int, common: int, share: int) -> bool:
    return 100 * common >= share * (n + m - common)


def lead_length(n: int, share: int) -> int:
    return n + share * n // -100 + 1 if n else 0


def is_frequent(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(shingles), bool)
    return frequent[np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)] == shingles


def leading(docs: DataFrame, frequent: np.ndarray, size: int, share: int) -> DataFrame:
    """doc_id, n, signature of the set, its first n - ceil(share n) + 1 shingles (frequent ones last, then by hash), and
    as many that follow them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch, texts in text_chunks(batches):
            sizes, sigs, firsts, spares = [], [], [], []
            for text in texts:
                s = shingle_set(text, size, cache)
                sizes.append(len(s))
                sigs.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                late, lead = is_frequent(s, frequent), lead_length(len(s), share)
                s = np.concatenate([s[~late], s[late]]).view("int64")
                firsts.append(s[:lead])
                spares.append(s[lead:2 * lead])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.string()), pa.array(firsts, pa.list_(pa.int64())),
                                              pa.array(spares, pa.list_(pa.int64()))], names=LEADING.names)

    return docs.select("doc_id", "text").mapInArrow(run, LEADING)


def _ordered(heads: DataFrame, frequent: np.ndarray, share: int) -> DataFrame:
    """doc_id, n, leading of ``heads`` (in the plain order) with the frequent shingles last; null where the leading and
    spare shingles don't tell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, first, spare in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                s = np.concatenate([x.values.to_numpy() for x in (first, spare)]).view("uint64")
                late, lead = is_frequent(s, frequent), lead_length(n, share)
                rare = s[~late]
                whole = len(s) == n
                out.append(np.concatenate([rare, s[late]])[:lead].view("int64") if whole else rare[:lead].view("int64") if len(rare) >= lead else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=ORDERED.names)

    return heads.select("doc_id", "n", "leading", "spare").mapInArrow(run, ORDERED)


def _reordered(docs: DataFrame, heads: DataFrame, same: DataFrame, frequent: np.ndarray, size: int, share: int) -> DataFrame:
    """doc_id, n, leading of the documents of ``heads`` that are in ``same``, with the frequent shingles last; only texts
    whose spare shingles don't tell are read again."""
    if not len(frequent):
        return heads.select("doc_id", "n", "leading").join(same, "doc_id", "left_semi")
    rows = cut(_ordered(heads, frequent, share).join(same, "doc_id", "left_semi"))
    short = rows.filter("leading is null").select("doc_id")
    again = cut(leading(docs.join(short, "doc_id", "left_semi"), frequent, size, share).select("doc_id", "n", "leading"))
    return rows.filter("leading is not null").union(again)


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, size, cache).tobytes() for t in texts], pa.binary())], names=SETS.names)

    return docs.select("doc_id", "text").mapInArrow(run, SETS)


def distance(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 1 - common / (len(a) + len(b) - common), common


def numbered(shingles: list[bytes]) -> tuple[list[np.ndarray], int]:
    """The sets with their shingles numbered from 0, and how many numbers there are."""
    sets = [np.frombuffer(s, "uint64") for s in shingles]
    values, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    return np.split(numbers, np.cumsum([len(s) for s in sets])[:-1]), len(values)


def _region_links(frame: pd.DataFrame, share: int) -> list[tuple[int, int]]:
    """Links that hold a small region's components together (doc_id, known, shingles)."""
    sets, count = numbered(frame["shingles"].tolist())
    return _numbered_links(frame["doc_id"].to_numpy(), frame["known"].to_numpy(), sets, share, np.zeros(count, "int8"))


def _numbered_links(ids: np.ndarray, known: np.ndarray, sets: list[np.ndarray], share: int, seen: np.ndarray) -> list[tuple[int, int]]:
    """Each pivot is compared with all that its distances to earlier pivots and the components leave open, all at once.
    ``seen`` has a zero for each number of a shingle and is left so."""
    reach = 1 - share / 100 + 1e-9
    known, sizes = known.copy(), np.array([len(s) for s in sets])
    numbers, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    low = np.zeros((len(ids), 0))
    out = []
    for p in range(len(ids)):
        open_ = (known != known[p]) & (100 * np.minimum(sizes, sizes[p]) >= share * np.maximum(sizes, sizes[p]))
        if low.shape[1]:
            # A distance that either of the two lacks leaves the pair open.
            apart = np.abs(low - low[p])
            open_ &= ((apart <= reach) | np.isnan(apart)).all(axis=1)
        open_[:p] = False
        column = np.full(len(ids), np.nan)
        column[p] = 0.0
        if open_.any():
            first = int(open_.argmax())
            seen[sets[p]] = 1
            common = np.zeros(len(ids), "int64")
            common[first:] = np.add.reduceat(seen[numbers[starts[first]:]], starts[first:] - starts[first], dtype="int64")
            seen[sets[p]] = 0
            column[open_] = (1 - common / (sizes + sizes[p] - common))[open_]
            for q in np.flatnonzero(open_ & (100 * common >= share * (sizes + sizes[p] - common))):
                if known[q] != known[p]:
                    out.append((int(ids[p]), int(ids[q])))
                    known[known == known[q]] = known[p]
        if low.shape[1] < PIVOTS:
            low = np.column_stack([low, column])
    return out


def _calls(rows: int, shingles: int) -> int:
    return max(1, -(-rows // CALL_ROWS), -(-8 * shingles // CALL_BYTES))


def _pivot_links(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """doc_id, other: the distinct pairs (doc_id, n, pivot) that link. A pivot's set is sent once for many documents."""
    size = pairs.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).first()
    calls = _calls(size["rows"], 2 * (size["n"] or 0))
    many = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / REGION_DOCS).alias("chunks"))
    dealt = pairs.join(many, "pivot").select("doc_id", "pivot", F.pmod(F.xxhash64("pivot", F.pmod(F.xxhash64("doc_id"), F.col("chunks"))), F.lit(calls)).alias("call"))
    rows = dealt.join(sets, "doc_id").select("call", "pivot", "doc_id", "shingles")
    pivots = dealt.select("call", "pivot").distinct().join(sets.withColumnRenamed("doc_id", "pivot"), "pivot")
    pivots = pivots.select("call", "pivot", F.lit(None).cast("long").alias("doc_id"), "shingles")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame["doc_id"].isna().to_numpy()
        pivot_sets = {p: np.frombuffer(s, "uint64") for p, s in zip(frame["pivot"][own], frame["shingles"][own])}
        out = []
        for doc, pivot, s in zip(frame["doc_id"][~own], frame["pivot"][~own], frame["shingles"][~own]):
            s, p = np.frombuffer(s, "uint64"), pivot_sets[pivot]
            if links(len(s), len(p), distance(s, p)[1], share):
                out.append((int(doc), int(pivot)))
        return pd.DataFrame(out, columns=["doc_id", "other"])

    return rows.union(pivots).groupBy("call").applyInPandas(compare, "doc_id long, other long")


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Shingles that each set of ``a`` has in common with each of ``b``."""
    codes = [np.concatenate(x) for x in (a, b)]
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    both = np.intersect1d(*map(np.unique, codes), assume_unique=True)
    out = np.zeros((len(a), len(b)), "float32")
    if a is b:
        both, times = np.unique(codes[0], return_counts=True)
        both = both[times > 1]
    if not len(both):
        return out.astype("int64")
    for k in (0, 1):
        at = np.minimum(np.searchsorted(both, codes[k]), len(both) - 1)
        hit = both[at] == codes[k]
        at, row = at[hit], rows[k][hit]
        order = np.argsort(at, kind="stable")
        codes[k], rows[k] = at[order], row[order]
    for start in range(0, len(both), COLUMNS):
        held = []
        for k, sets in enumerate((a, b)):
            i, j = np.searchsorted(codes[k], [start, start + COLUMNS])
            held.append(np.zeros((len(sets), min(COLUMNS, len(both) - start)), "float32"))
            held[-1][rows[k][i:j], codes[k][i:j] - start] = 1
        out += held[0] @ held[1].T
    return out.astype("int64")


def _block_links(open_: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """doc_id, other: links that hold the components of each region (region, doc_id, known) together. The documents of a
    region are dealt to blocks; a call compares two blocks and returns a link only where it joins two parts."""
    sized = open_.join(sets.select("doc_id", F.length("shingles").alias("bytes")), "doc_id")
    work = sized.groupBy("region").agg(F.count(F.lit(1)).alias("docs"), F.sum("bytes").alias("bytes"), F.min("known").alias("a"), F.max("known").alias("b")).filter("a < b")
    work = work.select("region", F.greatest(F.ceil(F.col("docs") / REGION_DOCS), F.ceil(2 * F.col("bytes") / CALL_BYTES)).alias("blocks"))
    rows = open_.join(work, "region").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("block")).alias("i"), F.greatest(b, F.col("block")).alias("j")))
    rows = rows.select("region", "doc_id", "known", "block", F.explode(pair).alias("p")).select("region", "p.i", "p.j", "doc_id", "known", "block")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        whole = frame["i"].iat[0] == frame["j"].iat[0]
        left = frame if whole else frame[frame["block"] == frame["i"]]
        right = left if whole else frame[frame["block"] == frame["j"]]
        part = pd.factorize(pd.concat([left["known"], right["known"]]))[0]
        x = [np.frombuffer(s, "uint64") for s in left["shingles"]]
        y = x if whole else [np.frombuffer(s, "uint64") for s in right["shingles"]]
        if not x or not y or not part.any():
            return pd.DataFrame([], columns=["doc_id", "other"])
        common = common_counts(x, y)
        n, m = np.array([len(s) for s in x]), np.array([len(s) for s in y])
        linked = (100 * common >= share * (n[:, None] + m - common)) & (part[:len(x), None] != part[len(x):])
        out = []
        ids, others = left["doc_id"].to_numpy(), right["doc_id"].to_numpy()
        for p, q in zip(*np.nonzero(linked)):
            if part[p] != part[len(x) + q]:
                out.append((int(ids[p]), int(others[q])))
                part[part == part[len(x) + q]] = part[p]
        return pd.DataFrame(out, columns=["doc_id", "other"])

    return cut(rows.join(sets, "doc_id").groupBy("region", "i", "j").applyInPandas(compare, "doc_id long, other long"))


def _join_regions(regions: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """doc_id, other: enough links within regions (region, doc_id, known; rows of equal ``known`` are linked already)."""
    reach = 1 - share / 100 + 1e-9
    found = None
    bytes_ = sets.select("doc_id", F.length("shingles").alias("bytes"))

    def compare_small(frame: pd.DataFrame) -> pd.DataFrame:
        sent = frame["region"].isna()
        own = frame[~sent].sort_values("doc_id")
        sets_, count = numbered(frame["shingles"][sent].tolist())
        sets_, seen = dict(zip(frame["doc_id"][sent], sets_)), np.zeros(count, "int8")
        links_ = (_numbered_links(g["doc_id"].to_numpy(), g["known"].to_numpy(), [sets_[d] for d in g["doc_id"]], share, seen) for _, g in own.groupby("region"))
        return pd.DataFrame([x for found_ in links_ for x in found_], columns=["doc_id", "other"])

    while not regions.isEmpty():
        sized = regions.groupBy("region").agg(F.count(F.lit(1)).alias("docs"), F.min("known").alias("a"), F.max("known").alias("b"), F.min("doc_id").alias("head"))
        at = cut(regions.join(sized.filter("a < b").drop("a", "b"), "region").join(bytes_, "doc_id"))
        few = at.filter(F.col("docs") <= REGION_DOCS)
        # Regions with one smallest document share most others: they go to one call, or several if they are many, and a
        # set is sent to a call once.
        work = few.agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes")).first()
        calls = _calls(work["rows"], (work["bytes"] or 0) // 8)
        heads = few.groupBy("head").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CALL_ROWS), F.ceil(F.sum("bytes") / CALL_BYTES)).alias("parts"))
        part = F.pmod(F.xxhash64("region"), F.col("parts"))
        dealt = cut(few.join(heads, "head").select(F.pmod(F.xxhash64("head", part), F.lit(calls)).alias("call"), "region", "doc_id", "known"))
        sent = dealt.select("call", "doc_id").distinct().join(sets, "doc_id")
        sent = sent.select("call", F.lit(None).cast("string").alias("region"), "doc_id", F.lit(0).cast("long").alias("known"), "shingles")
        small = dealt.withColumn("shingles", F.lit(None).cast("binary")).union(sent).groupBy("call").applyInPandas(compare_small, "doc_id long, other long")
        large = at.filter(F.col("docs") > REGION_DOCS)
        if large.isEmpty():
            new = cut(small)
            return new if found is None else found.union(new)
        # Pivots: of each region the lowest hashes, found by partial aggregation.
        h = F.struct(F.xxhash64("doc_id", "region").alias("h"), "doc_id")
        chosen = (large.groupBy("region", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(PIVOTS)).alias("i")).agg(F.min(h).alias("p"), F.max("docs").alias("docs"))
                  .select("region", F.col("p.doc_id").alias("pivot"), "docs"))
        chunks = F.ceil(F.col("docs") / REGION_DOCS)
        pivots = (chosen.join(sets.withColumnRenamed("doc_id", "pivot"), "pivot")
                  .select("region", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), F.lit(None).cast("long").alias("doc_id"), "pivot", "shingles"))
        rows = large.join(sets, "doc_id").select("region", F.pmod(F.xxhash64("doc_id", F.lit(2)), chunks).alias("chunk"), "doc_id", F.lit(None).cast("long").alias("pivot"), "shingles")

        def compare(frame: pd.DataFrame) -> pd.DataFrame:
            mine = frame[frame["pivot"].notna()].sort_values("pivot")
            pivot_sets = [np.frombuffer(s, "uint64") for s in mine["shingles"]]
            names = mine["pivot"].astype("int64").tolist()
            out = []
            for doc, s in zip(frame["doc_id"], frame["shingles"]):
                if pd.notna(doc):
                    s = np.frombuffer(s, "uint64")
                    got = [distance(s, p) for p in pivot_sets]
                    linked = [n for n, p, (_, c) in zip(names, pivot_sets, got) if n != doc and links(len(s), len(p), c, share)]
                    out += [(frame["region"].iat[0], int(doc), other, [d for d, _ in got]) for other in linked or [None]]
            return pd.DataFrame(out, columns=JOINED.names).astype({"other": "Int64"})

        far = cut(rows.union(pivots).groupBy("region", "chunk").applyInPandas(compare, JOINED))
        new = cut(small.union(far.filter("other is not null").select("doc_id", "other")))
        found = new if found is None else found.union(new)
        # What is linked now counts as one; a region with one part left is done.
        ids = large.select("region", F.col("doc_id").alias("node"), "known")
        ties = far.filter("other is not null").select("region", F.col("doc_id").alias("src"), F.col("other").alias("dst"))
        first = ids.groupBy("region", "known").agg(F.min("node").alias("dst"))
        ties = ties.union(ids.join(first, ["region", "known"]).select("region", F.col("node").alias("src"), "dst"))
        label = min_labels(ids.select("region", "node"), ties, ["region"]).select("region", F.col("node").alias("doc_id"), F.col("label").alias("known"))
        apart = F.transform("distances", lambda d: d <= F.array_min("distances") + 2 * reach)
        left = far.select("region", "doc_id", "distances").distinct().join(chosen.select("region", F.col("pivot").alias("doc_id")), ["region", "doc_id"], "left_anti")
        left = cut(left.select("region", "doc_id", F.filter(F.transform(apart, lambda x, i: F.when(x, i)), lambda i: i.isNotNull()).alias("cells")))
        # Where the windows would copy most documents into several cells, what is open is settled by blocks.
        copies = cut(left.groupBy("region").agg((F.avg(F.size("cells")) <= COPIES).alias("split")))
        left = cut(left.join(copies, "region").join(label, ["region", "doc_id"]))
        whole = left.filter("not split").select("region", "doc_id", "known")
        if not whole.isEmpty():
            found = found.union(_block_links(whole, sets, share))
        cells = left.filter("split").select("region", "doc_id", "known", F.explode("cells").alias("cell"))
        regions = cut(cells.select(F.concat_ws(".", "region", "cell").alias("region"), "doc_id", "known"))
    return found if found is not None else sets.sparkSession.createDataFrame([], "doc_id long, other long")


def classes(documents: DataFrame, size: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``documents`` (doc_id, text).

    Two documents link if ``share`` hundredths of the union of their shingles, taken as 64-bit hashes, are common;
    component_id is the smallest doc_id reachable by links. Texts without words are linked with nothing; a text of fewer
    words is one shingle; rows that repeat are copies. Rows of one doc_id with different texts are one document, which
    has the links of each text. A row without doc_id has a null component and links nothing. Other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    heads = cut(leading(docs, np.empty(0, "uint64"), size, share))
    if heads.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        of_sig = _components(docs, heads, size, share)
    else:
        # The texts are joined under numbers of their own; a doc_id ties the components of its texts.
        texts = cut(docs.filter("doc_id is not null").distinct().withColumn("row", F.monotonically_increasing_id()))
        rows = texts.select(F.col("row").alias("doc_id"), "text")
        own = cut(leading(rows, np.empty(0, "uint64"), size, share))
        of_text = own.join(_components(rows, own, size, share), "sig").select(F.col("doc_id").alias("row"), "sig", "component_id")
        of_text = cut(of_text.join(texts.select("row", F.col("doc_id").alias("node")), "row"))
        first = of_text.groupBy("component_id").agg(F.min("node").alias("dst"))
        ties = of_text.join(first, "component_id").select(F.lit(0).alias("all"), F.col("node").alias("src"), "dst").distinct()
        nodes = of_text.select(F.lit(0).alias("all"), "node").distinct()
        label = min_labels(nodes, ties, ["all"])
        least = label.groupBy("label").agg(F.min("node").alias("component_id"))
        of_sig = of_text.select("sig", "node").join(label.join(least, "label").select("node", "component_id"), "node").groupBy("sig").agg(F.min("component_id").alias("component_id"))
    return heads.join(of_sig, "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _could_link(shared: DataFrame, share: int) -> DataFrame:
    """Rows (shingle, doc_id, n) of ``shared`` less those of documents whose leading shingles rule out every link.

    In the common order two sets show all their shingles up to the end of the lead that ends first, so what they have in
    common there is common to their leads; of the rest of that set no more can be common than it holds. Leads are counted by pairs
    where a shingle is in at most FREQUENT of them; documents that lead with a more frequent one stay.
    """
    kinds = shared.groupBy("shingle").agg(F.count(F.lit(1)).alias("docs"), *_same_docs())
    kinds = kinds.groupBy("docs", "of1", "of2").agg(F.min("shingle").alias("shingle"), F.count(F.lit(1)).alias("times")).select("shingle", "docs", "times")
    rows = cut(shared.join(kinds, "shingle"))
    few = rows.filter(F.col("docs") <= FREQUENT).select("shingle", "doc_id", "n", "times")
    other = few.select("shingle", F.col("doc_id").alias("other"), F.col("n").alias("m"))
    pairs = few.join(other, "shingle").filter("doc_id < other").filter(100 * F.least("n", "m") >= share * F.greatest("n", "m"))
    unseen = lambda n: F.expr(f"({share} * {n} + 99) div 100 - 1")
    pairs = pairs.groupBy("doc_id", "n", "other", "m").agg(F.sum("times").alias("common"))
    most = F.col("common") + F.greatest(unseen("n"), unseen("m"))
    pairs = cut(pairs.filter(100 * most >= share * (F.col("n") + F.col("m") - most)).select("doc_id", "other"))
    stay = pairs.select("doc_id").union(pairs.select("other")).union(rows.filter(F.col("docs") > FREQUENT).select("doc_id")).distinct()
    return cut(rows.select("shingle", "doc_id", "n").join(stay, "doc_id", "left_semi"))


def _same_docs() -> list[Column]:
    """Two order-free hashes that tell regions of the same documents."""
    return [F.bit_xor(F.xxhash64("doc_id", F.lit(seed))).alias(f"of{seed}") for seed in (1, 2)]


def _components(docs: DataFrame, heads: DataFrame, size: int, share: int) -> DataFrame:
    """sig, component_id of the sets of ``docs`` (unique doc_id, text) with words; ``heads`` is their ``leading``
    in the plain order. Texts stay where they are read; what is taken from them is thinned to one document of each set."""
    frequent = np.empty(0, "uint64")
    same = cut(heads.filter("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id")))
    rows = _reordered(docs, heads, same.select("doc_id"), frequent, size, share)
    for _ in range(ORDER_ROUNDS):
        many = rows.select(F.explode("leading").alias("shingle")).groupBy("shingle").count()
        many = many.filter(F.col("count") > FREQUENT).orderBy(F.desc("count"), "shingle").limit(FREQUENT_LIST)
        more = many.select("shingle").toPandas()["shingle"].to_numpy("int64").view("uint64")
        if not len(more):
            break
        frequent = np.union1d(frequent, more)
        rows = _reordered(docs, heads, same.select("doc_id"), frequent, size, share)
    firsts = rows.select("doc_id", "n", F.explode("leading").alias("shingle"))
    # Regions of one document are done. Those with the same documents are one.
    of = _same_docs()
    shared = cut(firsts.join(firsts.groupBy("shingle").count().filter("count > 1").select("shingle"), "shingle", "left_semi"))
    shared = _could_link(shared, share)
    heart = shared.groupBy("shingle").agg(F.min(F.struct("doc_id", "n")).alias("p"), F.count(F.lit(1)).alias("docs"), *of)
    heart = heart.groupBy("docs", "of1", "of2", "p").agg(F.min("shingle").alias("shingle")).select("shingle", F.col("p.doc_id").alias("pivot"), F.col("p.n").alias("m"))
    members = cut(shared.join(heart, "shingle").filter("doc_id <> pivot"))
    pairs = cut(members.filter(100 * F.least("n", "m") >= share * F.greatest("n", "m")).select("doc_id", "n", "pivot").distinct())
    near = members.select("doc_id").union(members.select("pivot")).distinct()
    sets = cut(sets_of(docs.join(near, "doc_id", "left_semi"), size))
    edge = lambda found: found.select(F.lit(0).alias("all"), F.col("doc_id").alias("src"), F.col("other").alias("dst"))
    tied = cut(edge(_pivot_links(pairs, sets, share)))
    ends = tied.select("all", F.col("src").alias("node")).union(tied.select("all", F.col("dst").alias("node"))).distinct()
    known = min_labels(ends, tied, ["all"]).select(F.col("node").alias("doc_id"), "label")
    rest = members.join(known, "doc_id", "left").select("shingle", "doc_id", "n", F.coalesce("label", "doc_id").alias("known"))
    rest = cut(rest)
    left = rest.groupBy("shingle").agg(F.min("known").alias("a"), F.max("known").alias("b"), F.count(F.lit(1)).alias("docs"), *of).filter("a < b")
    left = left.groupBy("docs", "of1", "of2").agg(F.min("shingle").alias("shingle"))
    open_ = rest.join(left.select("shingle", "docs"), "shingle")
    # In a small region a document stays only if one next to it in size could link.
    by_size = Window.partitionBy("shingle").orderBy("n", "doc_id")
    few = open_.filter(F.col("docs") <= REGION_DOCS).withColumns({"less": F.lag("n").over(by_size), "more": F.lead("n").over(by_size)})
    few = few.filter((100 * F.col("less") >= share * F.col("n")) | (100 * F.col("n") >= share * F.col("more"))).drop("less", "more")
    open_ = few.unionByName(open_.filter(F.col("docs") > REGION_DOCS))
    regions = cut(open_.select(F.col("shingle").cast("string").alias("region"), "doc_id", "known"))
    found = tied.union(edge(cut(_join_regions(regions, sets, share))))
    nodes = same.select(F.lit(0).alias("all"), F.col("doc_id").alias("node"))
    label = min_labels(nodes, found, ["all"])
    best = label.groupBy("label").agg(F.min("node").alias("component_id"))
    return label.join(best, "label").select(F.col("node").alias("doc_id"), "component_id").join(same, "doc_id").select("sig", "component_id")


def keep_one(documents: DataFrame, size: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """One row of each component: of the document with the smallest doc_id, that with the first text where it has several,
    and of rows that repeat any one. Texts without words and rows without id stay."""
    extra = classes(documents, size, share).filter("component_id < doc_id").select("doc_id")
    left = documents.join(extra.distinct(), "doc_id", "left_anti")
    # Only rows of a doc_id that occurs more than once can be in one component yet.
    ids = left.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if ids.isEmpty():
        return left
    wordless = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    many = left.join(ids, "doc_id", "left_semi")
    first = many.filter(~wordless).groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in documents.columns if c != "doc_id"]), "text").alias("first"))
    first = first.select("doc_id", "first.*").select(*documents.columns)
    return left.join(ids, "doc_id", "left_anti").select(*documents.columns).union(many.filter(wordless).select(*documents.columns)).union(first)
