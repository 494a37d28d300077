"""Targets and cuts against a walk over sorted rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pulsewarden.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def goals(totals, weights, share, epochs):
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(totals.values()), set(names), {}
    while open_:
        each = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if each[s] > epochs * totals[s]}
        if not full:
            out.update(each)
            break
        for s in full:
            out[s] = epochs * totals[s]
            left -= out[s]
        open_ -= full
    return out


def rows_of(seed):
    r = random.Random(seed)
    sources = ["a", "b", "B", "é", None, "zz", "tiny", ""]
    text = lambda s: " ".join("w" * r.randint(1, 3) + str(r.random()) for _ in range(r.randint(0, 40 if s != "tiny" else 2)))
    return [(i, text(s), None, s) for i in range(300) for s in [r.choice(sources + ["a"] * 4)]]


@pytest.mark.parametrize("weights, share, epochs", [((5, 2, 1), 1.0, 3), ((1,), 0.4, 3), ((100, 1), 1.0, 2), ((1, 2), 5.0, 3)])
def test_mix(make_docs, odd, weights, share, epochs):
    rows = rows_of(1) + [(i, t, None, "odd") for i, t in odd]
    docs = make_docs(rows)
    got = mixing.mix(docs, weights, share, epochs).withColumn("place", mixing.place(F.col("doc_id"), F.col("text"), 17)).collect()
    assert len(got) == len(rows)
    totals = {}
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"] or ""))
        totals[r["source"]] = totals.get(r["source"], 0) + r["size"]
    want = goals(totals, weights, share, epochs)
    for s, total in totals.items():
        own = sorted((r for r in got if r["source"] == s), key=lambda r: r["place"])
        assert all(r["source_size"] == total and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) for r in own)
        budget = int(want[s] + 0.5)
        times, rest = divmod(budget, total) if total else (0, 0)
        copies = {p: sum(r["place"] == p for r in own) for p in {r["place"] for r in own}}
        before = 0
        for r in own:
            taken = min(r["size"], max(0, rest - before))
            exact = taken + times * r["size"]
            assert r["taken"] == exact or (copies[r["place"]] > 1 and abs(r["taken"] - exact) <= r["size"])
            assert r["taken"] <= epochs * r["size"]
            before += r["size"]
        assert abs(sum(r["taken"] for r in own) - budget) <= max(0, max(copies.values()) - 1)


def test_reruns_agree(make_docs):
    rows = rows_of(2)
    one, two = (sorted(map(tuple, mixing.mix(make_docs(rows, p)).collect()), key=str) for p in (1, 5))
    assert one == two


def test_empty_table_words_and_columns(make_docs):
    assert mixing.mix(make_docs([])).count() == 0
    none = mixing.mix(make_docs([(1, None), (2, " ")])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in none] == [(0, 0, 0.0)] * 2
    docs = make_docs([(1, "a b", None, "s")]).selectExpr("*", "1 AS taken", "2 AS size", "'x' AS target")
    got = mixing.mix(docs)
    assert len(set(got.columns)) == len(got.columns) and got.first()["taken"] == 2
