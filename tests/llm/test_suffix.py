"""Repeated byte strings against a table of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np

from pulsewarden.llm import suffix

L = suffix.LENGTH


def brute(rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p: p + L] for _, b in raw for p in range(len(b) - L + 1))
    out = []
    for i, b in raw:
        edge = np.zeros(len(b) + 1, int)
        for p in range(len(b) - L + 1):
            if seen[b[p: p + L]] > 1:
                edge[p] += 1
                edge[p + L] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def found(docs):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"]))
                   for r in suffix.remove_repeats(docs).collect()), key=str)


def prose(r, n):
    return "".join(r.choice("abcdéfg hij\nklß北") for _ in range(n))


def test_equals_brute_force(make_docs, odd):
    r = random.Random(3)
    passages = [prose(r, n) for n in (120, 150, 199, 200, 201, 260, 400, 900)]
    rows = list(odd)
    for i in range(40):
        parts = [prose(r, r.randint(0, 150))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.choice([0, 0, 1, 7, 30])
            parts += [p[a:], prose(r, r.choice([0, 0, 1, 50]))]
        rows.append((100 + i, "".join(parts)))
    rows += [rows[-1], rows[-2], (900, "x" * 199), (901, "y" * 200), (902, "z" * 1000), (903, "ab" * 300), (904, "ab" * 120)]
    assert found(make_docs(rows)) == brute(rows)


def test_long_texts_in_pieces(make_docs):
    r = random.Random(4)
    passage = prose(r, 500)
    long = prose(r, 70_000) + passage + prose(r, 30_000) + passage[:300] + prose(r, 3000) + "a" * 3000
    rows = [(1, long), (2, passage[100:] + prose(r, 100)), (3, prose(r, 66_000) + passage)]
    assert found(make_docs(rows)) == brute(rows)


def test_long_copies_go_whole(make_docs):
    long = prose(random.Random(5), 90_000)
    got = suffix.remove_repeats(make_docs([(1, long), (2, long), (2, long)])).collect()
    assert all(x["n_removed"] == x["n_bytes"] and x["n_spans"] == 1 for x in got)


def test_empty_table_and_clashing_columns(make_docs):
    assert suffix.remove_repeats(make_docs([])).count() == 0
    docs = make_docs([(1, "a" * 300)]).selectExpr("*", "1 AS rid", "2 AS runs", "3 AS n_bytes")
    assert [r["n_removed"] for r in suffix.remove_repeats(docs).collect()] == [300]


def test_identifiers_are_those_of_content():
    r = np.random.default_rng(1)
    data = r.integers(97, 100, 3000).astype(np.uint8)
    data[1500:1900] = data[100:500]
    at_q, whole = suffix.buckets(data)
    assert (whole[1500: 1900 - L + 1] == whole[100: 500 - L + 1]).all()
    assert len(np.unique(whole)) == len({data[p: p + L].tobytes() for p in range(len(data) - L + 1)})
    assert len(np.unique(at_q[: 3000 - suffix.Q + 1])) == len({data[p: p + suffix.Q].tobytes() for p in range(3000 - suffix.Q + 1)})
