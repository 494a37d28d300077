"""Updates against the plain recurrence, and ranks on held-out labels."""

import math
import zlib

import numpy as np
import pyarrow as pa

from pulsewarden.llm import classifier
from pulsewarden.llm.tokens import utf8


def plain_ftrl(examples, labels, epochs):
    z, n = {}, {}

    def weight(s):
        if abs(z.get(s, 0)) <= classifier.L1:
            return 0.0
        return -(z[s] - math.copysign(classifier.L1, z[s])) / ((classifier.BETA + math.sqrt(n[s])) / classifier.ALPHA + classifier.L2)

    for _ in range(epochs):
        for (slots, values), y in zip(examples, labels):
            x = [*zip(slots, values), (classifier.SLOTS, 0.2)]
            p = 1 / (1 + math.exp(-sum(weight(s) * v for s, v in x)))
            step = [(s, (p - y) * v, weight(s)) for s, v in x]
            for s, g, w in step:
                old = n.get(s, 0.0)
                z[s] = z.get(s, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / classifier.ALPHA * w
                n[s] = old + g * g
    return {s: weight(s) for s in z}


def test_ftrl_equals_the_recurrence():
    r = np.random.default_rng(1)
    examples = [(np.unique(r.integers(0, 30, 8)), None) for _ in range(60)]
    examples = [(s.astype(np.int32), r.random(len(s)).astype(np.float32)) for s, _ in examples]
    labels = np.array([int(3 in s) for s, _ in examples])
    model = classifier.ftrl(examples, labels, 2)
    want = plain_ftrl(examples, labels, 2)
    assert np.isclose(model.bias, want[classifier.SLOTS] * 0.2, atol=1e-5)
    assert all(np.isclose(model.weights[s], w, atol=1e-4) for s, w in want.items() if s < classifier.SLOTS)


def test_features_have_length_one_and_know_no_other_text():
    texts = ["a b a b.", "", "x", "| a | b |", "a b a b."]
    data, offsets = utf8(pa.array(texts))
    rows, slots, values = classifier.features(data, offsets)
    for i, t in enumerate(texts):
        own = rows == i
        assert own.any() == bool(t) and (not t or np.isclose((values[own] ** 2).sum(), 1))
        alone = classifier.features(*utf8(pa.array([t])))
        assert (alone[1] == slots[own]).all() and np.allclose(alone[2], values[own])


def test_sparse_score_is_a_dot_product():
    model = classifier.Model(np.random.default_rng(0).normal(size=classifier.SLOTS).astype(np.float32), 0.3)
    texts = pa.array(["some words here", None, "", "one"])
    rows, slots, values = classifier.features(*utf8(texts))
    want = [1 / (1 + math.exp(-(0.3 + sum(model.weights[s] * v for r, s, v in zip(rows, slots, values) if r == i)))) for i in range(4)]
    assert np.allclose(model.score(texts), want, atol=1e-5)


def rank(labels, scores):
    order = np.argsort(np.argsort(scores)) + 1
    one = labels == 1
    return (order[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())


def test_held_out_ranks(spark, sf):
    base = sf.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    got = classifier.classify(docs.select("doc_id", "text"), labels)
    rows = got.filter("held_out").join(labels, "doc_id").select("quality", "score", "predicted").toPandas()
    assert rank(rows["quality"].to_numpy(), rows["score"].to_numpy()) > 0.97
    assert (rows["predicted"] == (rows["score"] >= 0.7)).all()


def test_odd_rows_and_labels(spark, make_docs, odd):
    rows = odd + [(i, "good clean prose of words" if i % 2 else "junk | junk | ###") for i in range(20, 60)]
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(20, 60)] + [(20, 0), (21, None), (None, 1), (5, 1), (5, 0), (4, 7)], "doc_id long, quality int")
    docs = make_docs(rows)
    got = classifier.classify(docs, labels)
    found = got.collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2) for r in found)
    by = {r["doc_id"]: r["score"] for r in found}
    assert min(by[i] for i in range(21, 60, 2)) > max(by[i] for i in range(20, 60, 2))
    again = {r["doc_id"]: r["score"] for r in classifier.classify(docs, labels.repartition(3)).collect()}
    assert by == again


def test_no_labels_empty_table_and_clashing_columns(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = make_docs([(1, "a b"), (2, None)]).selectExpr("*", "1 AS score", "2 AS predicted", "3 AS held_out", "4 AS label", "5 AS `order`")
    got = classifier.classify(docs, none)
    assert len(set(got.columns)) == len(got.columns) and [r["score"] for r in got.collect()] == [0.5, 0.5]
    assert classifier.classify(make_docs([]), none).count() == 0


def test_sample_is_bounded(spark, make_docs):
    rows = [(i, f"w{i % 2} x y") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = classifier.classify(make_docs(rows), labels, max_rows=40).collect()
    assert rank(np.array([r["doc_id"] % 2 for r in got]), np.array([r["score"] for r in got])) == 1
