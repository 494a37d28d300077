"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

A text's features are its words and runs of words in lower case, hashed to a fixed number
of slots, plus the shapes of words (which kinds of characters they hold, whether a word is
the one before it), and runs of shapes. Each slot counts as the square root of its share of
the text's features, and the features have length one. The weights come from
follow-the-regularised-leader updates, whose L1 part leaves most slots at zero, and a text's
score is a sparse dot product with them.

Features are made in the tasks that hold the texts, for training as for scoring. FTRL takes
examples one after the other, so training is one task over a bounded number of labelled
rows: the ``max_rows`` with the smallest hash of their id, a sample that every rerun draws
again. The sample is settled before a text is read; its features come to the task batch by
batch, once for each epoch, so their size doesn't matter. Scoring covers all rows; the model is
``SLOTS`` numbers.

Defined results
    null or empty text: no features, the score is that of the bias.
    null label: not learned from. No labelled row at all: every score 0.5.
    An id with several labels or texts: each pair is an example.
    Empty table: empty result. Repeated rows are scored each.
    Other columns are kept; those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pulsewarden.llm.language import held_out
from pulsewarden.llm.tokens import Words, groups, hashes, mix, ngram_hashes, pair, utf8, words
from pulsewarden.session import drop, materialize

SLOTS = 1 << 18
ORDER = 2
SHAPE_ORDER = 3

#: Labelled rows that are learned from, at most.
MAX_ROWS = 20_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1

_KIND = np.zeros(256, np.uint64)
_KIND[ord("0"): ord("9") + 1] = 1
_KIND[ord("A"): ord("Z") + 1] = 2
_KIND[ord("a"): ord("z") + 1] = 4
_KIND[128:] = 8
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 16
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 32


def _shapes(data: np.ndarray, w: Words, h: np.ndarray) -> np.ndarray:
    """Per word: which kinds of bytes, how long (in doublings), first byte's kind, and whether it repeats the last."""
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    kinds = _KIND[data]
    cuts = np.stack([w.starts, w.ends], 1).ravel()
    cuts[-1] = min(cuts[-1], len(data) - 1) if cuts[-1] >= len(data) else cuts[-1]
    inside = np.bitwise_or.reduceat(kinds, cuts)[::2]
    inside[-1] |= kinds[w.ends[-1] - 1]
    length = np.log2(w.ends - w.starts).astype(np.uint64)
    again = np.zeros(len(h), np.uint64)
    again[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    return mix(inside | (length << np.uint64(8)) | (kinds[w.starts] << np.uint64(16)) | (again << np.uint64(24)))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, slot and value of every feature, in order of texts."""
    w = words(data, offsets)
    h = hashes(data, w)
    doc, slot = [], []
    for salt, base, order in ((1, h, ORDER), (2, _shapes(data, w, h), SHAPE_ORDER)):
        for n in range(1, order + 1):
            g, at = ngram_hashes(base, w, n)
            doc.append(w.doc[at])
            slot.append(pair(np.full(len(g), salt * 16 + n, np.uint64), g) % np.uint64(SLOTS))
    cells = np.concatenate(doc).astype(np.uint64) * np.uint64(SLOTS) + np.concatenate(slot)
    cells, n = np.unique(cells, return_counts=True)
    rows = (cells // np.uint64(SLOTS)).astype(np.int64)
    value = np.sqrt(n)
    texts = len(offsets) - 1
    value /= np.sqrt(np.bincount(rows, value * value, texts))[rows]
    return rows, (cells % np.uint64(SLOTS)).astype(np.int32), value.astype(np.float32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        data, offsets = utf8(column)
        out = np.empty(len(offsets) - 1)
        for i, j in groups(data, offsets):
            base = offsets[i]
            rows, slots, values = features(data[base: offsets[j]], offsets[i: j + 1] - base)
            out[i:j] = np.bincount(rows, self.weights[slots] * values, j - i)
        return 1 / (1 + np.exp(-(out + self.bias)))


class Ftrl:
    """Follow-the-regularised-leader, an example (slots, values, label) at a time.

    The bias is one more slot, so a text with few features gets about the share of label 1.
    """

    def __init__(self) -> None:
        self.z, self.n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def leader(self, s: np.ndarray) -> np.ndarray:
        shrunk = np.sign(self.z[s]) * np.maximum(np.abs(self.z[s]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(self.n[s])) / ALPHA + L2)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        s, x = np.append(slots, SLOTS), np.append(values, 0.2)
        w = self.leader(s)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - label) * x
        self.z[s] += g - (np.sqrt(self.n[s] + g * g) - np.sqrt(self.n[s])) / ALPHA * w
        self.n[s] += g * g

    def model(self) -> Model:
        w = self.leader(np.arange(SLOTS + 1))
        return Model(w[:-1], float(w[-1] * 0.2))


def ftrl(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Weights after ``epochs`` passes over the examples (slots, values) in the order given."""
    learner = Ftrl()
    for _ in range(epochs):
        for (slots, values), y in zip(examples, labels):
            learner.learn(slots, values, y)
    return learner.model()


def train(rows: DataFrame, max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> Model:
    """A model from ``rows`` (doc_id, text, label 0 or 1)."""
    ready = rows.filter("label IN (0, 1)").select(
        F.xxhash64("doc_id", "text").alias("order"), F.col("label").cast("int").alias("label"), "text")
    # the sample is settled by two numbers of a row
    last = ready.select("order", "label").orderBy("order", "label").limit(max_rows).agg(F.max(F.struct("order", "label")).alias("m")).first()["m"]
    if last is None:
        return Model(np.zeros(SLOTS, np.float32), 0.0)
    ready = ready.filter(F.struct("order", "label") <= F.struct(F.lit(last["order"]), F.lit(last["label"])))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for i, j in groups(data, offsets):
                base = offsets[i]
                r, s, v = features(data[base: offsets[j]], offsets[i: j + 1] - base)
                at = np.searchsorted(r, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                    pa.ListArray.from_arrays(at, pa.array(s)), pa.ListArray.from_arrays(at, pa.array(v))],
                    ["order", "label", "slots", "vals"])

    examples = materialize(ready.mapInArrow(extract, "order long, label int, slots array<int>, vals array<float>"))
    passes = examples.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Ftrl()
        for batch in batches:
            for slots, values, y in zip(batch.column("slots"), batch.column("vals"), batch.column("label").to_pylist()):
                learner.learn(slots.values.to_numpy(), values.values.to_numpy(), y)
        model = learner.model()
        used = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, SLOTS), pa.int32()), pa.array(np.append(model.weights[used], model.bias))], ["slot", "w"])

    weights, bias = np.zeros(SLOTS), 0.0
    for r in passes.repartition(1).sortWithinPartitions("epoch", "order", "label").mapInArrow(fit, "slot int, w double").collect():
        if r["slot"] == SLOTS:
            bias = r["w"]
        else:
            weights[r["slot"]] = r["w"]
    drop(examples)
    return Model(weights.astype(np.float32), bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on)."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(batch.column(at))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, label: str = "quality",
             doc_id: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """``docs`` with held_out, score and predicted; learned from labelled rows not held out."""
    docs = docs.drop("held_out").withColumn("held_out", held_out(F.col(doc_id), parts, held))
    # which labels to learn from is settled among ids, before any text is read
    own = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label"))
    own = own.filter(f"label IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"), parts, held))
    own = own.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    texts = docs.filter("NOT held_out").select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model = train(texts.join(F.broadcast(own), "doc_id"), max_rows)
    return score(docs, model, text=text)
