"""Katz scores against a direct recursion over dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pulsewarden.llm import katz, queries
from pulsewarden.session import WIDE_BATCH, materialize, wide_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {65 + i: 97 + i for i in range(26)}


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), "</s>"]


class Brute:
    def __init__(self, texts, order, cutoffs, k=5):
        self.order, self.k = order, k
        self.counts = [Counter() for _ in range(order)]
        for text in texts:
            t = ["<s>"] * (order - 1) + tokens(text)
            for i in range(order - 1, len(t)):
                for n in range(order):
                    self.counts[n][tuple(t[i - n: i + 1])] += 1
        self.total = sum(self.counts[0].values())
        self.d = [self.discounts(c.values()) for c in self.counts]
        self.kept = [{g: c for g, c in self.counts[n].items() if c >= cutoffs[n]} for n in range(order)]
        self.after = [defaultdict(list) for _ in range(order)]
        for n in range(order):
            for g in self.kept[n]:
                self.after[n][g[:-1]].append(g)
        self.all = [Counter() for _ in range(order)]
        for n in range(order):
            for g, c in self.counts[n].items():
                self.all[n][g[:-1]] += c
        self.alphas = {}

    def discounts(self, counts):
        seen = Counter(counts)
        common = (self.k + 1) * seen[self.k + 1] / seen[1] if seen[1] else 1
        out = {}
        for r in range(1, self.k + 1):
            d = ((r + 1) * seen[r + 1] / (r * seen[r]) - common) / (1 - common) if seen[r] and common < 1 else 1
            out[r] = d if 0 < d < 1 else 1
        return out

    def star(self, g):
        n, h = len(g) - 1, g[:-1]
        mass = sum(self.d[n].get(self.kept[n][x], 1) * self.kept[n][x] for x in self.after[n][h])
        total = self.all[n][h]
        total += mass >= total * (1 - 1e-12)
        c = self.kept[n][g]
        return self.d[n].get(c, 1) * c / total

    def alpha(self, h):
        if h not in self.alphas:
            n = len(h)
            grams = self.after[n].get(h, [])
            self.alphas[h] = (1 - sum(map(self.star, grams))) / (1 - sum(self.p(g[1:]) for g in grams) if n else 1)
        return self.alphas[h]

    def p(self, g):
        if g in self.kept[len(g) - 1]:
            return self.star(g)
        return self.alpha(()) if len(g) == 1 else self.alpha(g[:-1]) * self.p(g[1:])

    def score(self, text):
        t = ["<s>"] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(tuple(t[i - self.order + 1: i + 1]))) for i in range(self.order - 1, len(t)))


def corpus(seed, n=60):
    r = random.Random(seed)
    return [(i, " ".join(r.choice("a B c d e f g the The of x1 x2".split()) + ("" if r.random() < 0.8 else str(r.randrange(40)))
                         for _ in range(r.randint(0, 30)))) for i in range(n)]


@pytest.mark.parametrize("order, cutoffs", [(1, (1,)), (2, (1, 2)), (2, (1, 1)), (3, (1, 1, 2)), (2, (2, 2))])
def test_scores_equal_the_recursion(make_docs, odd, order, cutoffs):
    rows = corpus(order) + odd
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    model = Brute([t for (_, t), h in zip(rows, held) if not h], order, cutoffs)
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["n_tokens"], round(r["score"], 6), r["held_out"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
                  for r in katz.lm_scores(make_docs(rows), order, cutoffs).collect()), key=str)
    size = model.total + len(model.counts[0]) + 1
    want = []
    for (i, text), h in zip(rows, held):
        t = tokens(text)
        known = [model.counts[0][(w,)] for w in t]
        base = sum(math.log10((c + 1) / size) for c in known)
        want.append((i is None, i, len(t), round(model.score(text), 6), h, sum(c > 0 for c in known), model.total, round(base, 6)))
    assert got == sorted(want, key=str)


def test_distributions_sum_to_one():
    model = Brute([t for _, t in corpus(9)], 3, (1, 1, 2))
    words = [g[0] for g in model.counts[0]] + ["never seen"]
    for h in [(), ("a",), ("a", "the"), ("of", "of"), ("<s>", "<s>")]:
        assert abs(sum(model.p((*h, w)) for w in words) - 1) < 1e-9


def test_nothing_to_learn_from(make_docs):
    docs = make_docs([(2, "a b"), (None, None)])  # held out or not: one of them has no word
    assert katz.lm_scores(docs).count() == 2
    assert katz.lm_scores(make_docs([])).count() == 0


def test_clashing_columns(make_docs):
    docs = make_docs([(1, "a b"), (3, "a c")]).selectExpr("*", "1 AS score", "2 AS n_known", "3 AS held_out")
    got = katz.lm_scores(docs)
    assert len(set(got.columns)) == len(got.columns) and got.count() == 2


def test_beats_single_words_on_texts_not_seen(spark, sf):
    got = katz.lm_scores(spark.read.parquet(f"{sf}/documents.parquet")).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_query_keeps_pairs_seen_once(spark, make_docs, tmp_path):
    rows = corpus(4)
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    model = Brute([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], 2, (1, 1))
    assert any(c == 1 for c in model.counts[1].values())
    got = {r["doc_id"]: round(r["score"], 6) for r in queries.op1_lm_scores(spark, str(tmp_path)).collect()}
    assert got == {i: round(model.score(t), 6) for i, t in rows}


def test_a_frequent_word_is_sent_once_by_each_block(spark, make_docs, monkeypatch):
    rows = [(i, "the " * 2000 + f"x{i}") for i in range(30)]
    docs = make_docs(rows, 1).selectExpr("text", "monotonically_increasing_id() AS rid", "true AS train")
    blocks = docs.mapInArrow(katz.read_blocks(2), katz.BLOCK)
    moved = blocks.mapInArrow(katz.ask_words(2), katz.WORD_REQUEST).toPandas()
    assert moved["block"].nunique() == 1
    assert moved["key"].map(len).sum() == 32  # the, the end, x0 to x29
    # a block has bounded occurrences, whatever its words
    monkeypatch.setattr(katz, "TOKENS", 10_000)
    places = docs.mapInArrow(katz.read_blocks(2), katz.BLOCK).toPandas()
    assert len(places) > 3 and places["seq"].map(len).max() <= 2 * 10_000 + 2002 and places["seq"].map(len).sum() == 30 * 2002


@pytest.mark.parametrize("shards, hot, order, cutoffs", [(1, 0.25, 2, (1, 1)), (5, 0.02, 2, (1, 1)), (3, 0.05, 3, (1, 2, 2)), (4, 0.25, 2, (2, 2))])
def test_scores_of_many_blocks_and_shards(make_docs, odd, monkeypatch, shards, hot, order, cutoffs):
    """Also with contexts split over shards, and words that are not in the model."""
    monkeypatch.setattr(katz, "TOKENS", 50)
    monkeypatch.setattr(katz, "HOT", hot)
    rows = corpus(6) + odd
    docs = make_docs(rows).selectExpr("text", "monotonically_increasing_id() AS rid", "coalesce(doc_id, 0) % 5 <> 4 AS train")
    texts = docs.collect()
    sums, fitted = katz.evaluate(docs, order, cutoffs, shards=shards)
    model = Brute([r["text"] for r in texts if r["train"]], order, cutoffs)
    got = {r["rid"]: (r["n_tokens"], round(r["score"], 6), r["n_known"]) for r in sums.collect()}
    assert got == {r["rid"]: (len(t := tokens(r["text"])), round(model.score(r["text"]), 6), sum(model.counts[0][(w,)] > 0 for w in t)) for r in texts}
    assert fitted.totals.tokens == model.total and fitted.totals.vocabulary == len(model.counts[0])
    assert hot > 0.1 or fitted.known[2].split


def test_the_stored_model_is_normalised(make_docs):
    """Probabilities and backoff weights of the table, against the recursion."""
    rows = [(i, t) for i, t in corpus(3)]
    docs = make_docs(rows).selectExpr("text", "monotonically_increasing_id() AS rid", "true AS train")
    _, fitted = katz.evaluate(docs, 2, (1, 1), shards=3)
    model = Brute([t for _, t in rows], 2, (1, 1))
    table = katz.model_rows(fitted, 2).toPandas()
    assert len(table) == len(model.kept[1]) and table["p"].sum() == pytest.approx(sum(map(model.star, model.kept[1])))
    firsts = table.groupby("ctx").agg(p=("p", "sum"), alpha=("alpha", "first"))
    want = sorted((sum(map(model.star, gs)), math.log10(model.alpha(h))) for h, gs in model.after[1].items() if gs)
    assert sorted(firsts["p"]) == pytest.approx([p for p, _ in want]) and sorted(firsts["alpha"]) == pytest.approx(sorted(a for _, a in want))


def test_very_long_text(make_docs):
    r = random.Random(2)
    rows = [(0, " ".join(f"w{r.randrange(50)}" for _ in range(60_000))), (2, "w1 w2 unheard"), (3, "x" * 200_000)]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    model = Brute([t for (_, t), h in zip(rows, held) if not h], 2, (1, 1))
    got = {r["doc_id"]: r["score"] for r in katz.lm_scores(make_docs(rows)).collect()}
    assert got == pytest.approx({i: model.score(t) for i, t in rows}, rel=1e-9)


def test_arrays_come_back_and_lie_packed():
    r = np.random.default_rng(1)
    arrays = [r.integers(0, 3, 50_000).astype(np.int32), np.zeros(0, np.int64), r.random(7), np.array([True, False]), np.array([-5, 1 << 62])]
    data = katz.pack(*arrays)
    back = katz.unpack(data)
    assert all(a.dtype == b.dtype and np.array_equal(a, b) for a, b in zip(arrays, back)) and len(back) == len(arrays)
    assert len(data) < 50_000  # a quarter of the bytes of the counts alone


def test_wide_rows_go_to_workers_one_by_one(spark, tmp_path):
    """Not all rows of a file at once, which a worker then holds together."""
    spark.range(12, numPartitions=1).selectExpr("id", "repeat('x', 3000000) AS wide").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    with wide_rows(spark):
        rows = [r["n"] for r in table.mapInArrow(held, "n long").collect()]
    assert sum(rows) == 12 and max(rows) <= 2
    assert spark.conf.get(key, None) == before


def test_the_model_is_fitted_on_wide_rows(make_docs, monkeypatch):
    seen = []
    monkeypatch.setattr(katz, "materialize", lambda df, *by: (seen.append(df.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)), materialize(df, *by))[1])
    docs = make_docs(corpus(5)).selectExpr("text", "monotonically_increasing_id() AS rid", "true AS train")
    katz.evaluate(docs, 2, (1, 1), shards=3)
    assert len(seen) > 4 and set(seen[1:]) == {str(WIDE_BATCH)}
