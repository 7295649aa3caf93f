"""Language of every word, and of a text, by a linear-chain conditional random field.

A word's features are its affixes, character n-grams and, if the training texts have it often enough, the word itself
(the lexicon). Feature weights and the transitions between languages are learned together on texts that switch between
languages; forward-backward gives the posterior of each language for each word.
"""
from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatwise.llm.tables import text_chunks

SLOTS = 1 << 16
#: Bound of the training sample: rows of each language, lowest hash first.
SAMPLE_PER_LANGUAGE = 150
#: A word of the sample is in the lexicon from this count on.
LEXICON_COUNT = 3
#: Words from one language before a training sequence switches.
SWITCH_WORDS = 24
STEPS, RATE = 25, 0.5
#: Words whose scores a worker keeps.
CACHE_WORDS = 200_000
#: Words whose features are made at a time.
BLOCK_WORDS = 20_000
#: Steps between two scalings; a word's smallest factor is 1e-12.
SCALED = 8
UNKNOWN = "und"
ODD = np.uint64(0x9E3779B97F4A7C15)

WORDS = re.compile(r"[^\W\d_]+")
PREDICTED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()),
                          T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False),
                          T.StructField("n_words", T.LongType(), False)])


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray       # slots x languages
    transitions: np.ndarray   # languages x languages, logarithms
    lexicon: frozenset[str]


def words_of(text: str | None) -> list[str]:
    words = WORDS.findall(text.lower()) if text else []
    return words if not words or "".join(words).isalpha() else [w for w in words if any(c.isalpha() for c in w)]


def _slots(codes: np.ndarray, first: np.ndarray, width: int, salt: int) -> np.ndarray:
    """Slots of the ``width`` characters from each of ``first`` on."""
    mixed = np.full(len(first), salt, "uint64")
    for j in range(width):
        mixed = (mixed ^ codes[first + j]) * ODD
        mixed ^= mixed >> np.uint64(29)
    return (mixed & np.uint64(SLOTS - 1)).astype("int32")


def features(words: list[str], lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all features of all words one after another, and the number of each word's: n-grams of 2 and 3 characters
    of the word between marks, its first and last 1 to 4 characters, the word if it is in the lexicon."""
    length = np.fromiter(map(len, words), "int64", len(words))
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "uint32").astype("uint64")
    known = np.fromiter((w in lexicon for w in words), bool, len(words))
    sizes = 2 * length + 1 + 2 * np.minimum(length, 4) + known
    start, out = np.cumsum(length + 2) - length - 2, np.empty(sizes.sum(), "int32")
    place = np.cumsum(sizes) - sizes
    for n in (2, 3):
        grams = length + 3 - n
        inside = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
        out[np.repeat(place, grams) + inside] = _slots(codes, np.repeat(start, grams) + inside, n, n)
        place = place + grams
    for n in (1, 2, 3, 4):
        long = np.flatnonzero(length >= n)
        out[place[long]] = _slots(codes, start[long] + 1, n, 10 + n)
        out[place[long] + 1] = _slots(codes, start[long] + 1 + length[long] - n, n, 20 + n)
        place[long] += 2
    out[place[known]] = [zlib.crc32(w.encode("utf-8", "surrogatepass")) & (SLOTS - 1) for w in words if w in lexicon]
    return out, sizes


def emissions(words: list[str], model: Field) -> np.ndarray:
    """Scores of the languages for each word."""
    flat, sizes = features(words, model.lexicon)
    return np.add.reduceat(model.weights[flat], np.cumsum(sizes) - sizes) / np.sqrt(sizes)[:, None].astype("float32")


def forward_backward(emissions: np.ndarray, index: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Posterior of each label at each word; ``index`` has the emission rows of all sequences one after another.

    All sequences advance together, longest first, and words are laid out by their place in the sequence, so a step is one
    small matrix product over neighbouring rows. Rows are scaled every ``SCALED`` steps, before a double can run out.
    """
    first = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(sizes), "int64")
    rank[order] = np.arange(len(sizes))
    top = int(sizes.max()) if len(sizes) else 0
    running = np.searchsorted(-sizes[order], -np.arange(1, top + 1), side="right")
    offset = np.cumsum(running) - running
    place = offset[np.arange(len(index)) - np.repeat(first, sizes)] + np.repeat(rank, sizes)
    words = np.empty(len(index), "int64")
    words[place] = index
    local = (np.exp(emissions - emissions.max(axis=1, keepdims=True)).astype("float64") + 1e-12)[words]
    step = np.exp(transitions - transitions.max()).astype("float64")
    forward, backward, turned = local.copy(), np.ones_like(local), step.T.copy()
    running, offset = running.tolist(), offset.tolist()
    for t in range(1, top):
        n, a, b = running[t], offset[t - 1], offset[t]
        state = forward[b:b + n]
        state *= forward[a:a + n] @ step
        if t % SCALED == 0:
            state /= state.sum(axis=1, keepdims=True)
    for t in range(top - 2, -1, -1):
        n, a, b = running[t + 1], offset[t], offset[t + 1]
        state = (local[b:b + n] * backward[b:b + n]) @ turned
        if t % SCALED == 0:
            state /= state.sum(axis=1, keepdims=True)
        backward[a:a + n] = state
    forward *= backward
    forward /= forward.sum(axis=1, keepdims=True)
    return forward[place]


def code_switched(texts: list[list[str]], labels: list[int], seed: int = 5) -> tuple[list[list[str]], list[np.ndarray]]:
    """Training sequences: pieces of the labelled texts, dealt at random so that about half of them follow a piece in
    another language."""
    rng = np.random.default_rng(seed)
    pieces = [(w[i:i + SWITCH_WORDS], y) for w, y in zip(texts, labels) for i in range(0, len(w), SWITCH_WORDS)]
    order = rng.permutation(len(pieces))
    out, tags = [], []
    for i in range(0, len(order), 4):
        part = [pieces[j] for j in order[i:i + 4]]
        part = sorted(part, key=lambda p: p[1]) if i % 8 else part
        out.append([w for p, _ in part for w in p])
        tags.append(np.concatenate([np.full(len(p), y) for p, y in part]))
    return out, tags


def fit(texts: list[str], langs: list[str]) -> Field:
    """Gradient ascent (Adagrad) on the conditional likelihood of the labels of all words of the sequences.

    Without labelled words there are no languages and every text is unknown.
    """
    rows = [(words_of(t), l) for t, l in zip(texts, langs)]
    rows = [(w, l) for w, l in rows if w]
    names = sorted({l for _, l in rows})
    n = len(names)
    if not n:
        return Field([], np.zeros((SLOTS, 0), "float32"), np.zeros((0, 0), "float32"), frozenset())
    sequences, tags = code_switched([w for w, _ in rows], [names.index(l) for _, l in rows])
    counts: dict[str, int] = {}
    for s in sequences:
        for w in s:
            counts[w] = counts.get(w, 0) + 1
    lexicon = frozenset(w for w, c in counts.items() if c >= LEXICON_COUNT)
    number = {w: i for i, w in enumerate(counts)}
    flat, widths = features(list(counts), lexicon)
    of_word = np.repeat(np.arange(len(widths)), widths)
    scale = (1 / np.sqrt(widths))[of_word].astype("float32")
    starts = np.cumsum(widths) - widths
    index = np.concatenate([np.array([number[w] for w in s]) for s in sequences])
    tag = np.concatenate(tags)
    sizes = np.array([len(s) for s in sequences])
    inside = np.ones(len(index), bool)
    inside[np.cumsum(sizes) - sizes] = False
    second = np.flatnonzero(inside)
    truth = np.stack([np.bincount(index[tag == y], minlength=len(widths)) for y in range(n)], 1)
    moves = np.bincount(tag[second - 1] * n + tag[second], minlength=n * n).reshape(n, n)
    weights, transitions = np.zeros((SLOTS, n), "float32"), np.zeros((n, n), "float32")
    sum_w, sum_t = np.full_like(weights, 1e-4), np.full_like(transitions, 1e-4)
    for _ in range(STEPS):
        local = np.add.reduceat(weights[flat] * scale[:, None], starts)
        post = forward_backward(local, index, sizes, transitions)
        expected = np.stack([np.bincount(index, post[:, y], len(widths)) for y in range(n)], 1)
        gap = (truth - expected)[of_word] * scale[:, None]
        grad = np.stack([np.bincount(flat, gap[:, y], SLOTS) for y in range(n)], 1) / len(index) * 1000 - 0.01 * weights
        # Expected moves: posterior of neighbouring words under the current transitions.
        step = np.exp(transitions)[None] * post[second - 1][:, :, None] * post[second][:, None, :]
        step /= step.sum(axis=(1, 2), keepdims=True)
        grad_t = (moves - step.sum(axis=0)) / len(index) * 10 - 0.01 * transitions
        sum_w += grad ** 2
        sum_t += grad_t ** 2
        weights += (RATE * grad / np.sqrt(sum_w)).astype("float32")
        transitions += (RATE * grad_t / np.sqrt(sum_t)).astype("float32")
    return Field(names, weights, transitions, lexicon)


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Field:
    """Fit on at most ``per_language`` rows of each language of ``docs`` (text, lang), rows allowed for learning only."""
    known = docs.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64("text", F.lit(3)).alias("h"))
    per = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # A range of the hash that holds about twice the wanted rows keeps what is sorted small at any size.
    share = F.least(F.lit(1.0), (2.0 * per_language + 20.0) / F.col("n"))
    high = F.when(share < 1, (F.lit(-2.0 ** 63) + share * 2.0 ** 64).cast("long")).otherwise(F.lit((1 << 63) - 1))
    near = known.join(F.broadcast(per.select("lang", high.alias("high"))), "lang").filter("h <= high").select("lang", "h", "text").distinct()
    first = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("place") <= per_language)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"lang": [], "h": [], "text": []})]).sort_values(["lang", "h", "text"])
        yield pd.DataFrame({"model": [pickle.dumps(fit(rows["text"].tolist(), rows["lang"].tolist()))]})

    # One task fits the bounded sample, so the driver holds the model alone.
    made = first.select("lang", "h", "text").repartition(1).mapInPandas(learn, "model binary").first()
    return pickle.loads(made["model"]) if made else fit([], [])


def predict_texts(texts: list, model: Field, cache: dict[str, int], table: list[np.ndarray]) -> list[tuple[str, float, int]]:
    """Language, mean posterior of it and number of words for each text."""
    if len(cache) > CACHE_WORDS:
        cache.clear()
        table.clear()
    index, sizes, fresh = [], [], []
    for text in texts:
        words = words_of(text) if model.languages else []
        new = set(words).difference(cache)
        cache.update(zip(new, range(len(cache), len(cache) + len(new))))
        fresh.extend(new)
        index.append(np.fromiter(map(cache.__getitem__, words), "int64", len(words)))
        sizes.append(len(words))
    table.extend(emissions(fresh[i:i + BLOCK_WORDS], model) for i in range(0, len(fresh), BLOCK_WORDS))
    sizes = np.array(sizes)
    full = np.flatnonzero(sizes)
    out: list[tuple[str, float, int]] = [(UNKNOWN, 0.0, 0)] * len(texts)
    if len(full):
        post = forward_backward(np.concatenate(table), np.concatenate([index[i] for i in full]), sizes[full], model.transitions)
        mean = np.add.reduceat(post, np.cumsum(sizes[full]) - sizes[full]) / sizes[full][:, None]
        for i, row in zip(full, mean):
            best = int(row.argmax())
            out[i] = (model.languages[best], min(1.0, float(row[best])), int(sizes[i]))
    return out


def predict(docs: DataFrame, model: Field, held_out) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words of every row of ``docs`` (doc_id, text), from the whole text alone.

    The language with the largest mean posterior over all words, ties to the first in order of name; ``und`` with score
    0 for a null text or one without a letter. Repeated rows are predicted each; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        table: list[np.ndarray] = []
        for batch, texts in text_chunks(batches):
            got = predict_texts(texts, model, cache, table)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[2] for g in got], pa.int64())], names=PREDICTED.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(run, PREDICTED)


def keep(docs: DataFrame, model: Field, least: float) -> DataFrame:
    """The rows of ``docs`` (text and any columns) whose text has a language with a mean posterior of at least
    ``least``; null texts and those without a letter go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        table: list[np.ndarray] = []
        for batch, texts in text_chunks(batches):
            got = predict_texts(texts, model, cache, table)
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score, _ in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
