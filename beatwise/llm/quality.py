"""Quality classifier: a factorisation machine over hashed words, structure statistics and text length.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), linear in the number of features.
"""
from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatwise.llm.tables import text_chunks

WORD_SLOTS, STAT_SLOTS, RANK = 1 << 16, 1 << 10, 8
#: Bound of the sample the model is fitted on: labelled rows of each class, lowest hash first.
SAMPLE_PER_CLASS = 3000
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.05, 1e-4
THRESHOLD = 0.3

SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()),
                       T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)])


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def statistics(text: str, counts: Counter) -> list[tuple[str, float]]:
    """Structure of the whole text, each figure on a scale of about 0 to 12."""
    n, chars = sum(counts.values()), len(text)
    if not n:
        return [("empty", 1.0)]
    lines = text.split("\n")
    share = lambda x, of: 12.0 * x / max(1, of)
    top = max(counts.values())
    words = list(counts.items())
    marked = sum(c for w, c in words if not w[-1].isalnum())
    loud = sum(c for w, c in words if w.isupper() and len(w) > 1)
    odd = sum(c for w, c in words if not w[-1].isalnum() and w[-1] not in ".,;:?")
    runs = sum(c * c for c in counts.values())
    return [("words", math.log2(1 + n)), ("chars", math.log2(1 + chars)), ("word length", chars / n), ("distinct", share(len(counts), n)),
            ("most frequent", share(top, n)), ("repeats", 12 * math.sqrt(runs) / n), ("marked", share(marked, n)),
            ("loud", share(loud, n)), ("odd ends", share(odd, n)), ("bars", share(counts.get("|", 0), n)),
            ("digits", share(sum(c for w, c in words if w.isdigit()), n)),
            ("full stops", share(sum(c for w, c in words if w[-1] == "."), n)), ("words a line", math.log2(1 + n / len(lines))),
            ("repeated lines", share(len(lines) - len(set(lines)), len(lines))), ("lines", math.log2(len(lines)))]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text; nothing outside the text enters."""
    counts = Counter((text or "").split())
    slots: dict[int, float] = {}
    norm = 1 / math.sqrt(sum(c * c for c in counts.values()) or 1)
    for word, c in counts.items():
        slot = zlib.crc32(word.encode("utf-8", "surrogatepass")) & (WORD_SLOTS - 1)
        slots[slot] = slots.get(slot, 0.0) + c * norm
    for name, value in statistics(text or "", counts):
        low = int(value)
        for step, part in ((low, 1 - (value - low)), (low + 1, value - low)):
            slot = WORD_SLOTS + (zlib.crc32(f"{name} {step}".encode()) & (STAT_SLOTS - 1))
            slots[slot] = slots.get(slot, 0.0) + part
    return np.fromiter(slots, "int32", len(slots)), np.fromiter(slots.values(), "float32", len(slots))


def raw_scores(model: Machine, slots: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(s) for s in slots])
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    i, x = np.concatenate(slots), np.concatenate(values)
    vx = model.factors[i] * x[:, None]
    total = np.add.reduceat(vx, at)
    return (model.bias + np.add.reduceat(model.weights[i] * x, at)
            + 0.5 * (total ** 2 - np.add.reduceat(vx ** 2, at)).sum(axis=1))


def fit(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray) -> Machine:
    """Weighted logistic loss by Adagrad over batches; without rows every score is 1/2."""
    rng = np.random.default_rng(7)
    model = Machine(0.0, np.zeros(WORD_SLOTS + STAT_SLOTS, "float32"),
                    rng.normal(0, 0.02, (WORD_SLOTS + STAT_SLOTS, RANK)).astype("float32"))
    if not len(samples):
        model.factors[:] = 0
        return model
    good = float((labels * weights).sum() / weights.sum())
    model.bias = math.log((good + 1e-3) / (1 - good + 1e-3))
    sum_w, sum_v = np.full_like(model.weights, 1e-6), np.full_like(model.factors, 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(samples))
        for start in range(0, len(order), BATCH):
            rows = order[start:start + BATCH]
            slots, values = [samples[r][0] for r in rows], [samples[r][1] for r in rows]
            error = (1 / (1 + np.exp(-raw_scores(model, slots, values))) - labels[rows]) * weights[rows]
            sizes = [len(s) for s in slots]
            i, x = np.concatenate(slots), np.concatenate(values)
            row = np.repeat(np.arange(len(rows)), sizes)
            vx = model.factors[i] * x[:, None]
            total = np.add.reduceat(vx, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            e = (error[row] * x).astype("float32")
            touched, inverse = np.unique(i, return_inverse=True)
            grad_w = np.bincount(inverse, e, len(touched)) / len(rows) + DECAY * model.weights[touched]
            each = e[:, None] * (total[row] - vx)
            grad_v = np.stack([np.bincount(inverse, each[:, f], len(touched)) for f in range(RANK)], 1) / len(rows) + DECAY * model.factors[touched]
            sum_w[touched] += grad_w ** 2
            sum_v[touched] += grad_v ** 2
            model.weights[touched] -= RATE * grad_w / np.sqrt(sum_w[touched])
            model.factors[touched] -= 0.4 * RATE * grad_v / np.sqrt(sum_v[touched])
            model.bias -= 0.02 * float(error.mean())
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Machine:
    """Fit on at most ``per_class`` rows of each label. ``docs`` (doc_id, text) and ``labels`` (doc_id, quality) hold
    the rows allowed for learning. Classes are weighted back to their shares among all labelled rows."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    order = F.xxhash64("doc_id", F.lit(11))
    chosen = [known.filter(F.col("quality") == q).orderBy(order, "doc_id").limit(per_class) for q in (0, 1)]
    schema = T.StructType([T.StructField("quality", T.IntegerType()), T.StructField("doc_id", T.LongType()),
                           T.StructField("slots", T.BinaryType()), T.StructField("values", T.BinaryType())])

    def featurise(batches):
        for batch, texts in ((b, t) for batch in batches for b, t in text_chunks(iter([batch]))):
            got = [features(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int32()), batch.column(1).cast(pa.int64()), pa.array([g[0].tobytes() for g in got], pa.binary()),
                 pa.array([g[1].tobytes() for g in got], pa.binary())], names=schema.names)

    rows = (docs.select("doc_id", "text").join(chosen[0].union(chosen[1]), "doc_id").select("quality", "doc_id", "text")
            .mapInArrow(featurise, schema).toPandas().sort_values(["doc_id", "slots"]).drop_duplicates("doc_id"))
    samples = [(np.frombuffer(s, "int32"), np.frombuffer(v, "float32")) for s, v in zip(rows["slots"], rows["values"])]
    y = rows["quality"].to_numpy("float32")
    took = {q: max(1, int((y == q).sum())) for q in (0, 1)}
    scale = np.array([counts.get(int(q), 0) / took[int(q)] for q in y], "float32")
    return fit(samples, y, scale / scale.mean() if len(scale) else scale)


def score(docs: DataFrame, model: Machine, held_out, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text); a null text counts as empty.

    The model has a fixed size and goes with the tasks. Repeated rows are scored each; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            got = [features(t) for t in texts]
            s = 1 / (1 + np.exp(-raw_scores(model, [g[0] for g in got], [g[1] for g in got]).astype("float64")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype("int32"))],
                                             names=SCORED.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(run, SCORED)
