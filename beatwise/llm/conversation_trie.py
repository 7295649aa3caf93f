"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A prefix of d turns is known by two 64-bit hashes: the exclusive or of the hashes of its turns, each mixed with its
position. So the prefixes of a conversation are a running aggregate, also over a conversation that is dealt out over many
tasks. Totals of all subtrees come from contraction: in turns, every unary chain is compressed onto its lower end
(pointers double each join round) and every leaf is raked into its parent. A tree without unary nodes has more leaves
than other nodes, so few rounds leave the root alone. Expanding in reverse order gives the compressed nodes their totals.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatwise.session import cut

#: Conversations whose first turns are shared, and one more than the largest number of turns taken from the first of them.
FAMILY, HEADS = 100, 6
#: Span of conv_ids that are listed in one piece of a digest.
PIECE_IDS = 4096
FIRST = Window.unboundedPreceding
DIGESTS = "depth long, f1 long, f2 long, ends_sha256 string"


def head_turns(conv_id: Column) -> Column:
    """Turns of a conversation that come from the first conversation of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, part, pos (from 1), the turn's hashes t1 and t2, its text's code points, and per conversation head
    (turns to take over), k (those there are) and length (rebuilt turns).

    Rows are dealt out by ranges of (conversation, turn), so a conversation of any length is spread over parts.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(text, role, F.lit(2)).alias("t2"),
        F.char_length(text).cast("long").alias("chars"))
    # Equal rows are one with a count: no key is too frequent for a range.
    rows = rows.groupBy("conv_id", "turn", "t1", "t2", "chars").agg(F.count(F.lit(1)).alias("times"))
    order = [F.asc_nulls_first("turn"), "t1", "t2"]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, "conv_id", *order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("conv_id", "part").agg(F.sum("times").alias("n"))
    whole = totals.groupBy("conv_id").agg(F.sum("n").alias("turns"))
    first = whole.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    of_conv = (whole.withColumn("base", base).join(first, "base", "left").withColumn("head", head_turns(F.col("conv_id")))
               .withColumn("k", F.least("head", F.coalesce("base_turns", F.lit(0))))
               .select("conv_id", "head", "k", (F.col("k") + F.greatest(F.lit(0), F.col("turns") - F.col("head"))).alias("length")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(FIRST, -1)), F.lit(0))
    offsets = totals.withColumn("before", before).drop("n").join(of_conv, "conv_id")
    upto = F.col("before") + F.sum("times").over(Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(FIRST, 0))
    out = ranged.join(offsets, ["conv_id", "part"]).withColumn("upto", upto)
    return out.select("conv_id", "part", F.explode(F.sequence(F.col("upto") - F.col("times") + 1, "upto")).alias("pos"), "t1", "t2", "chars", "head", "k", "length")


def prefixes(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every prefix of every rebuilt conversation: conv_id, depth, its hashes f1 and f2, those of its parent p1 and p2,
    code points of its last text, and whether it is the whole conversation. And the conversations: conv_id, length."""
    turns = cut(numbered(conversations))
    convs = cut(turns.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in ("head", "k", "length")]))
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).select(F.col("conv_id").alias("base"), "pos", "t1", "t2", "chars")
    taken = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base").filter("pos <= head")
    taken = taken.select("conv_id", F.lit(-1).alias("part"), F.col("pos").alias("depth"), "t1", "t2", "chars", "length")
    own = turns.filter("pos > head").select("conv_id", "part", (F.col("pos") - F.col("head") + F.col("k")).alias("depth"), "t1", "t2", "chars", "length")
    rows = taken.union(own).withColumns({"t1": F.xxhash64("t1", "depth"), "t2": F.xxhash64("depth", "t2")})
    sums = rows.groupBy("conv_id", "part").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(FIRST, -1)
    offsets = sums.select("conv_id", "part", *[F.coalesce(F.bit_xor(f"s{i}").over(earlier), F.lit(0)).alias(f"o{i}") for i in (1, 2)])
    within = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(FIRST, 0)
    xor = lambda a, b: F.col(a).bitwiseXOR(F.col(b))
    out = rows.join(offsets, ["conv_id", "part"]).withColumns({f"r{i}": F.bit_xor(f"t{i}").over(within) for i in (1, 2)})
    out = out.withColumns({f"f{i}": xor(f"o{i}", f"r{i}") for i in (1, 2)}).withColumns({f"p{i}": xor(f"f{i}", f"t{i}") for i in (1, 2)})
    return out.select("conv_id", "depth", "f1", "f2", "p1", "p2", "chars", (F.col("depth") == F.col("length")).alias("end")), convs.select("conv_id", "length")


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, f1, f2, SHA-256 of the ascending conv_ids that end there. A piece lists the ids of one span; pieces are
    hashed one after the other as they come, so a node where very many conversations end is never held in memory."""
    listed = F.concat_ws(",", F.array_sort(F.collect_list("conv_id")).cast("array<string>"))
    pieces = ends.groupBy("depth", "f1", "f2", F.floor(F.col("conv_id") / PIECE_IDS).alias("piece")).agg(listed.alias("ids"))
    key = ["depth", "f1", "f2"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for batch in batches:
            out = []
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids"))):
                if node != at:
                    if at is not None:
                        out.append((*at, sha.hexdigest()))
                    at, sha = node, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*key, "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*at, sha.hexdigest())], names=[*key, "ends_sha256"])

    return pieces.repartition(*key).sortWithinPartitions(*key, "piece").drop("piece").mapInArrow(digest, DIGESTS)


def _chains(tree: DataFrame, values: list[str]) -> DataFrame:
    """Nodes with one child, below the root: id, parent, next (the lower end of their chain), what their total has
    beyond next's, and what reaches their parent beyond their total."""
    unary = tree.filter("kids = 1 and parent is not null")
    step = unary.select(F.col("id").alias("next"), F.lit(True).alias("more"))
    chain = unary.select("id", "parent", F.col("kid.id").alias("next"), *[f"over_{v}" for v in values], *[(F.col(v) + F.col(f"kid.over_{v}")).alias(v) for v in values])
    chain = cut(chain.join(step, "next", "left").withColumn("more", F.coalesce("more", F.lit(False))))
    while not (open_ := chain.filter("more")).isEmpty():
        # Open pointers all differ, so this join has no frequent key.
        step = chain.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("more").alias("_more"), *[F.col(v).alias(f"_{v}") for v in values])
        jumped = open_.join(step, "next").withColumns({"next": F.col("_next"), "more": F.col("_more")} | {v: F.col(v) + F.col(f"_{v}") for v in values})
        chain = cut(jumped.select(*chain.columns).union(chain.filter("not more")))
    return chain


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``nodes`` (id, parent, values; parent null at roots) with each value summed over the node's subtree: id, values."""
    over = [f"over_{v}" for v in values]
    tree = nodes.select("id", "parent", *values, *[F.lit(0).cast("long").alias(o) for o in over])
    raked, chains = [], []
    while True:
        kids = tree.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("kids"), F.min(F.struct("id", *over)).alias("kid"))
        tree = cut(tree.join(kids, "id", "left").withColumn("kids", F.coalesce("kids", F.lit(0))))
        if tree.isEmpty():
            break
        # Compress: the lower end of a chain takes the place of its top.
        chain = _chains(tree, values)
        chains.append(chain.select("id", "next", *values))
        inside = chain.select(F.col("id").alias("parent"))
        tops = chain.join(inside, "parent", "left_anti").select(F.col("next").alias("id"), F.col("parent").alias("_parent"), *[
            (F.col(v) + F.col(o)).alias(f"_{o}") for v, o in zip(values, over)])
        left = tree.filter("kids <> 1 or parent is null").join(tops, "id", "left")
        tree = cut(left.select("id", F.coalesce("_parent", "parent").alias("parent"), "kids", *values, *[F.coalesce(f"_{o}", o).alias(o) for o in over]))
        # Rake: leaves add to their parents.
        leaves = tree.filter("kids = 0")
        raked.append(leaves.select("id", *values))
        adds = leaves.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(*[F.sum(F.col(v) + F.col(o)).alias(f"_{v}") for v, o in zip(values, over)])
        rest = tree.filter("kids > 0").join(adds, "id", "left")
        tree = rest.select("id", "parent", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values], *over)
    known = nodes.select("id", *values).limit(0)
    for more in raked:
        known = known.union(more)
    for chain in reversed(chains):
        if not chain.isEmpty():
            below = known.select(F.col("id").alias("next"), *[F.col(v).alias(f"_{v}") for v in values])
            known = known.union(cut(chain.join(below, "next").select("id", *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values])))
    return known


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role, text; other columns are ignored. Rows without conv_id take no part. A null
    role or text is empty, a null turn comes first; rows with equal conv_id and turn follow one another in the order of
    their hashes, repeated rows are repeated turns. An empty table has no nodes. Turns are compared by 128 bits of hash.
    """
    rows, convs = prefixes(conversations)
    rows = cut(rows)
    fp = ["depth", "f1", "f2"]
    ends = rows.filter("end").select("conv_id", *fp).union(convs.filter("length = 0").select("conv_id", *[F.lit(0).cast("long") for _ in fp]))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    zero = [F.lit(0).cast("long").alias(c) for c in (*fp, "chars", "p1", "p2")]
    merged = rows.groupBy(*fp).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.min(c).alias(c) for c in ("chars", "p1", "p2")])
    nodes = cut(root.select("conv_id", "n_convs", *zero).union(merged.select("conv_id", "n_convs", *fp, "chars", "p1", "p2")))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    # A node is its smallest member and its depth.
    parent = F.when(F.col("depth") > 0, F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")))
    nodes = cut(nodes.join(above, ["depth", "p1", "p2"], "left").select(F.struct("conv_id", "depth").alias("id"), parent.alias("parent"), *fp, "n_convs", "chars"))
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut(nodes.join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    tree = nodes.select("id", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    out = nodes.join(subtree_sums(tree, ["n_leaves", "saved_tokens"]), "id").join(end_digests(ends), fp, "left")
    return out.select("id.conv_id", "id.depth", F.col("parent.conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
