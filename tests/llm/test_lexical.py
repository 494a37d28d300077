"""Ranked search against plain scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pulsewarden.llm import lexical

TERM = re.compile(lexical.TERM)
LOWER = {65 + i: 97 + i for i in range(26)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    texts = [(d[0], terms(d[1])) for d in docs]
    texts = [(i, Counter(t), len(t)) for i, t in texts if t]
    total, n_docs = sum(n for _, _, n in texts), len(texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in texts:
            m = 10 + 90 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(docs, items, **limits):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.rank_documents(docs, items, **limits).collect()), key=str)


def corpus(seed, n, vocabulary=300):
    r = random.Random(seed)
    word = lambda: f"w{int(vocabulary * r.random() ** 3)}"
    return [(i, r.choice([" ", "-", "\n"]).join(word() for _ in range(r.choice([0, 1, 3, 20, 20, 20, 200])))) for i in range(n)]


@pytest.mark.parametrize("limits", [{}, {"shard": 50, "row": 30, "block": 25}, {"k": 3, "row": 1}])
def test_equals_plain_scores(spark, make_docs, odd, limits):
    docs = corpus(1, 400) + [(i and i + 10_000, t) for i, t in odd] + [(500, "w1 " * 30_000), (501, "Z" * 100_000)]
    items = [(i, " ".join(f"w{k}," for k in range(i, 3 * i, 2))) for i in range(30)]
    items += [(40, None), (41, ""), (42, "?!"), (43, "W1 w1 W2"), (43, "W1 w1 W2"), (None, "ñandú WORD"), (44, "北京"), (45, "unheard")]
    got = found(make_docs(docs), spark.createDataFrame(items, "item_id long, text string").repartition(3), **limits)
    assert got == brute(docs, items, limits.get("k", 10))
    assert {r[0] for r in got} >= {None, 1, 20, 43, 44}


def test_empty_tables_and_clashing_columns(spark, make_docs):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS score", "3 AS id", "4 AS block")
    docs = make_docs([(1, "a"), (2, "b c")]).selectExpr("*", "1 AS m", "2 AS n", "3 AS id", "4 AS terms")
    assert found(docs, items) == brute([(1, "a"), (2, "b c")], [(1, "a b")])
    assert found(make_docs([]), items) == [] and found(docs, items.limit(0)) == []
    assert found(make_docs([(1, None)]), items) == []


def test_rows_of_the_index(make_docs):
    rows = corpus(3, 300)
    index, n = lexical.build_index(make_docs(rows), shard=500, row=100)
    seen = []
    for r in index.collect():
        starts, tf, slot = (np.frombuffer(r[c], np.int32) for c in ("starts", "tf", "slot"))
        held = np.frombuffer(r["terms"], np.uint64)
        assert (np.diff(held) > 0).all() and starts[-1] == len(tf) == len(slot)
        assert all((np.diff(tf[a:b]) <= 0).all() for a, b in zip(starts, starts[1:]))
        seen += [(i, r["m"]) for i in r["ids"]]
    kept = [(i, len(terms(t))) for i, t in rows if terms(t)]
    total = sum(c for _, c in kept)
    assert n == len(kept) and sorted(seen) == sorted((i, 10 + 90 * c * n // total) for i, c in kept)


def test_bounds_save_visits():
    r = np.random.default_rng(1)
    rows = []
    for b in range(40):
        terms_, tfs = [], []
        for _ in range(30):
            t = np.unique(r.integers(0, 500, 20).astype(np.uint64))
            if b == 30:
                t = np.union1d(t, np.array([900, 901], np.uint64))
            terms_.append(t)
            tfs.append(np.ones(len(t), np.int32))
        m, ids, *parts = lexical._index_row(100, list(range(b * 30, b * 30 + 30)), terms_, tfs)
        rows.append((m, lexical.pa.array(ids), *[np.frombuffer(x, k) for x, k in zip(parts, (np.uint64, np.int32, np.int32, np.int32))]))
    queries = lexical.Queries([1], [np.array([3, 900, 901], np.uint64)])
    queries.weights[:] = [10, 5000, 5000]
    search = lexical.Search(queries, 10)
    search.show(rows)
    assert search.visits == 1 and set(search.best[0][2]) <= set(range(900, 930))
