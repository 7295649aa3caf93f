"""The conversation trie against a trie of dictionaries, and on small cases worked out by hand."""
import hashlib
import random
import zlib

import pytest

from beatwise.llm import conversation_trie

CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, parent string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_definition(rows):
    convs = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs.setdefault(conv, []).append((role or "", text or ""))
    whole = {}
    for conv, own in convs.items():
        h = zlib.crc32(str(conv).encode()) % 6
        whole[conv] = convs.get(conv - conv % 100, [])[:h] + own[h:]
    members = {}
    for conv, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[:len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(m[:-1] == n and m != n for m in below) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(str(c) for c in sorted(c for c in own if len(whole[c]) == len(node)))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def found(spark, rows):
    table = spark.createDataFrame([(*r, 3, "x") for r in rows], CONVERSATIONS)
    return sorted((tuple(r) for r in conversation_trie.trie(table).select(*COLUMNS).collect()), key=lambda r: (r[1], r[0]))


def test_trie_by_definition(spark):
    rng, rows = random.Random(11), []
    for conv in [*range(40), *range(100, 130), 205, 317]:
        for turn in range(rng.choice([1, 2, 3, 5, 8, 8])):
            rows.append((conv, turn, rng.choice(["user", "assistant"]), "t" * rng.randint(0, 2)))
    assert found(spark, rows) == by_definition(rows)


def test_trie_of_copies_and_a_long_chain(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 6000, 150) for t in range(4)]
    rows += [(7, t, "user", f"turn {t}") for t in range(150)] + [(9, t, "user", f"turn {t}" + "!" * (t > 60)) for t in range(130)]
    assert found(spark, rows) == by_definition(rows)


def test_trie_edges(spark):
    # Turns are to come from a conversation that isn't there, and no more are its own: a conversation without turns.
    alone = next(c for c in range(500, 600) if c % 100 and zlib.crc32(str(c).encode()) % 6 >= 1)
    rows = [(alone, 0, "user", "a"), (None, 0, "user", "lost"), (100, None, None, None), (100, 3, "", None), (100, 4, "user", "é𝄞" * 3000)]
    rows += [(200, 1, "user", "same")] * 3
    assert found(spark, rows) == by_definition(rows)
    assert found(spark, []) == []


def test_subtree_sums_over_a_forest(spark):
    edges = [("r", None, 1), *[(f"c{i}", f"c{i - 1}" if i else "r", 2) for i in range(70)], *[(f"k{i}", "c33", 5) for i in range(20)], ("s", None, 4)]
    got = {r["id"]: r["v"] for r in conversation_trie.subtree_sums(spark.createDataFrame(edges, "id string, parent string, v long"), ["v"]).collect()}
    assert len(got) == len(edges) and got["r"] == 1 + 140 + 100 and got["c33"] == 2 * 37 + 100 and got["c34"] == 72 and got["k3"] == 5 and got["s"] == 4


@pytest.mark.parametrize("piece", [1, 7])
def test_digest_of_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(conversation_trie, "PIECE_IDS", piece)
    rows = [(c, 9, "user", "one") for c in range(0, 9000, 300)]
    assert found(spark, rows) == by_definition(rows)
