"""Language ID and quality scores: nulls, empty and repeated rows, no labels."""
import itertools
import os
import zlib

import numpy as np
from pyspark.sql import functions as F

from beatwise.llm import language_id, quality

ROWS = [(1, "the house and the garden " * 9), (2, "das haus und der garten " * 9), (3, None), (4, "12 -- 7"), (5, ""), (1, "the house and the garden " * 9)]


def test_language_edges(spark):
    model = language_id.fit([ROWS[0][1], ROWS[1][1]], ["en", "de"])
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.predict(docs, model, F.lit(False)).collect()]
    assert sorted(got) == [(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und")]
    none = language_id.fit([], [])
    assert {r["lang_pred"] for r in language_id.predict(docs, none, F.lit(False)).collect()} == {"und"}
    assert language_id.keep(docs, model, 0.5).count() == 3


def test_quality_without_labels_is_even(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = quality.score(docs, quality.train(docs, spark.createDataFrame([], "doc_id long, quality int")), F.lit(False)).collect()
    assert len(got) == 6 and {(r["score"], r["predicted"]) for r in got} == {(0.5, 1)}


def test_features_of_many_words_are_those_of_each():
    def plain(word, salt):
        mixed = salt
        for char in word:
            mixed = ((mixed ^ ord(char)) * int(language_id.ODD)) % (1 << 64)
            mixed ^= mixed >> 29
        return mixed % language_id.SLOTS

    words = ["a", "das", "straße", "été", "ab", "x" * 300, "中文", "a"]
    lexicon = frozenset(["das", "a"])
    flat, sizes = language_id.features(words, lexicon)
    parts, at = [], 0
    for word, size in zip(words, sizes):
        marked = f"<{word}>"
        want = [plain(marked[i:i + n], n) for n in (2, 3) for i in range(len(marked) - n + 1)]
        want += [plain(word[:n], 10 + n) for n in (1, 2, 3, 4) if n <= len(word)] + [plain(word[-n:], 20 + n) for n in (1, 2, 3, 4) if n <= len(word)]
        want += [zlib.crc32(word.encode()) % language_id.SLOTS] if word in lexicon else []
        assert sorted(flat[at:at + size]) == sorted(want)
        at += size
    assert at == len(flat)


def test_language_on_an_empty_table_and_clashing_columns(spark):
    model = language_id.fit([ROWS[0][1], ROWS[1][1]], ["en", "de"])
    docs = spark.createDataFrame([r + ("x", 7) for r in ROWS], "doc_id long, text string, lang_pred string, score int")
    assert language_id.predict(docs, model, F.lit(False)).count() == 6
    assert language_id.keep(docs, model, 0.5).columns == docs.columns
    assert language_id.predict(docs.filter("false"), model, F.lit(False)).count() == 0
    assert language_id.keep(docs.filter("false"), model, 0.5).count() == 0


def test_posteriors_are_those_of_all_labellings():
    rng = np.random.default_rng(1)
    emissions, transitions = rng.normal(0, 3, (7, 3)), rng.normal(0, 2, (3, 3))
    sizes = np.array([2, 5, 1, 5])
    index = rng.integers(0, 7, sizes.sum())
    got, at = language_id.forward_backward(emissions, index, sizes, transitions), 0
    for size in sizes:
        own = index[at:at + size]
        want = np.zeros((size, 3))
        for labels in itertools.product(range(3), repeat=int(size)):
            score = sum(emissions[w, y] for w, y in zip(own, labels)) + sum(transitions[a, b] for a, b in itertools.pairwise(labels))
            want[np.arange(size), labels] += np.exp(score)
        assert np.allclose(got[at:at + size], want / want.sum(axis=1, keepdims=True), atol=1e-9)
        at += size


def test_posteriors_of_long_unlikely_sequences_are_finite():
    emissions = np.array([[0.0, 900.0], [900.0, 0.0]])
    got = language_id.forward_backward(emissions, np.tile([0, 1], 20_000), np.array([40_000]), np.array([[0.0, -40.0], [-40.0, 0.0]]))
    assert np.isfinite(got).all() and np.allclose(got.sum(axis=1), 1)


def test_language_model_is_fitted_in_a_task(spark, monkeypatch):
    rows = [(w * 9 + f" {w[0]}{i}", lang) for i in range(40) for w, lang in (("the house ", "en"), ("das haus ", "de"))] + [(None, "en"), ("und", None)]
    docs = spark.createDataFrame(rows * 2, "text string, lang string")
    kept = sorted((r["lang"], r["h"], r["text"]) for r in docs.dropna().distinct().selectExpr("*", "xxhash64(text, 3) as h").collect())
    kept = [r for lang in ("de", "en") for r in [x for x in kept if x[0] == lang][:7]]
    fit, driver = language_id.fit, os.getpid()
    whole = fit([r[2] for r in kept], [r[0] for r in kept])

    def away(texts, langs):
        assert os.getpid() != driver
        return fit(texts, langs)

    monkeypatch.setattr(language_id, "fit", away)
    got = language_id.train(docs, 7)
    assert got.languages == ["de", "en"] and got.lexicon == whole.lexicon
    assert np.array_equal(got.weights, whole.weights) and np.array_equal(got.transitions, whole.transitions)
    monkeypatch.setattr(language_id, "fit", fit)
    assert language_id.train(docs.filter("false")).languages == []
