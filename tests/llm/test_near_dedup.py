"""Near duplicates by b-bit MinHash against all pairs of full sets."""
import random
import re

import numpy as np
import pytest

from beatwise.llm import near_dedup, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, sig string, n int, label string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "s", 7, "l") for i, t in rows], DOCS)


def by_definition(rows):
    rows = [(i, t) for i, t in rows if i is not None]
    sets, up = [], {i: i for i, _ in rows}
    for i, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, {tuple(w[k:k + 2]) for k in range(max(1, len(w) - 1))} if w else set()))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def found(frame):
    return sorted(tuple(r) for r in frame.collect() if r["doc_id"] is not None)


def family(rng, name, copies, words, edits):
    base = [f"{name}{rng.randint(0, 400)}" for _ in range(words)]
    out = [base]
    for _ in range(copies):
        text = list(rng.choice(out))
        for at in rng.sample(range(words), edits):
            text[at] = f"{name}e{rng.randint(0, 10 ** 6)}"
        out.append(text)
    return [" ".join(t) for t in out]


def test_near_dedup_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op13_near_dedup(spark, SF)) == by_definition(rows)


@pytest.mark.parametrize("block", [3, 512])
def test_near_dedup_by_definition(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(13)
    texts = [t for f in range(12) for t in family(rng, f"f{f}w", 12, rng.choice([30, 80, 200]), rng.choice([1, 2, 5]))]
    # Half of every text is one passage: many common minima, no links.
    shared = " ".join(f"s{i}" for i in range(100))
    texts += [shared + " " + " ".join(f"o{k}x{i}" for i in range(60)) for k in range(40)]
    texts += ["a b c d e", "a b c d e f", "a b c d", "One", "one", "one two", None, "", " \t", "a b c d e"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert found(near_dedup.classes(documents(spark, rows))) == by_definition(rows)


def test_near_dedup_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "x y z"), (2, "p q r"), (2, "X y  z"), (3, "p Q r"), (None, "p q r"), (None, None), (4, None), (5, long), (6, long + " end"), (7, "x y z"), (7, "x y z")]
    got = near_dedup.classes(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: (r["component_id"], r["kept"]) for r in got}
    assert by[2] == (1, False) and by[3] == (1, False) and by[7] == (1, False) and by[1] == (1, True) and by[6] == (5, False) and by[4] == (4, True)
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)] * 2
    assert near_dedup.classes(documents(spark, [])).count() == 0


def test_packed_bits_estimate_the_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8, 0.95):
        pool = rng.integers(0, 2 ** 63, 4000, "uint64")
        both = int(share * 2000)
        a, b = pool[:2000], np.concatenate([pool[:2 * both * 1000 // 2000][:both], pool[2000:]])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        bits = near_dedup.packed_bits(near_dedup.minima([a, b])).view("uint64")
        x = bits[0] ^ bits[1]
        equal = near_dedup.MINIMA - int(np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(near_dedup.EVEN)).sum())
        assert abs((equal / near_dedup.MINIMA - 0.25) / 0.75 - true) < 5 * np.sqrt(0.25 / near_dedup.MINIMA) / 0.75
