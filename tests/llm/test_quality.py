"""Counts and distances against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pulsewarden.llm import quality
from pulsewarden.llm.tokens import hashes, utf8, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[k: k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k: k + 5])] > 1 for j in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def classes(text):
    def kind(c):
        if c in " \t\n\x0b\x0c\r":
            return 0
        if "a" <= c <= "z":
            return 1
        if "A" <= c <= "Z":
            return 2
        if "0" <= c <= "9":
            return 3
        return 4 if c in quality.MARKS else 5 if c in quality.SYMBOLS else 6 if ord(c) > 127 else 7
    return Counter(map(kind, text))


def number(word):
    data, offsets = utf8(pa.array([word]))
    return int(hashes(data, words(data, offsets)).view(np.int64)[0])


def lower(text):
    return text.translate({65 + i: 97 + i for i in range(26)})


def distance(p, q):
    a, b = sum(p.values()) or 1, sum(q.values()) or 1
    total = 0.0
    for k in set(p) | set(q):
        x, y = p[k] / a, q[k] / b
        m = (x + y) / 2
        total += sum(z * math.log2(z / m) for z in (x, y) if z) / 2
    return math.sqrt(min(1, max(0, total)))


@pytest.fixture(scope="module")
def rows(spark, sf):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def test_counts_and_distances(make_docs, odd, rows):
    rows = rows + [(1000 + i, t, None) for i, (_, t) in enumerate(odd)] + [
        (2000, "a b c d e " * 30, "en"), (2001, "x\nx\n\nx \nx\n", None), (2002, "# $ " * 100, None), (2003, "a b c d e f g h i j", "en"),
        (2004, "w " * 50_000 + "\n" + "long" * 100_000, "de")]
    reference = {}
    for _, text, lang in rows:
        w = WORD.findall(lower(text or ""))
        if lang is not None and len(w) >= quality.MIN_WORDS:
            c, v = reference.setdefault(lang, (Counter(), Counter()))
            c.update(classes(text))
            v.update(w)
    # of equally common words those with the smaller hash
    common = {lang: set(sorted(v, key=lambda x: (-v[x], number(x)))[: quality.COMMON]) for lang, (_, v) in reference.items()}
    for r in quality.judge(make_docs(rows)).collect():
        text = r["text"] or ""
        n = counts(text)
        assert tuple(r[c] for c in quality.COUNTS) == n
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        assert r["base_failed"] == failed
        odd_one = n[0] >= quality.MIN_WORDS and (r["class_distance"] >= quality.MAX_DISTANCE[0] or r["word_distance"] >= quality.MAX_DISTANCE[1])
        assert r["kept"] == (not failed and not odd_one)
        best = []
        for lang, (c, v) in reference.items():
            usual = common[lang]
            fold = lambda counter: Counter({x: k for x, k in counter.items() if x in usual}) + Counter(
                {None: sum(k for x, k in counter.items() if x not in usual)})
            best.append((distance(classes(text), c), distance(fold(Counter(WORD.findall(lower(text)))), fold(v)), lang))
        a, b, lang = min(best, key=lambda x: x[0] + x[1])
        assert math.isclose(r["class_distance"], a, abs_tol=1e-9) and math.isclose(r["word_distance"], b, abs_tol=1e-9)


def test_clean_documents_stay(spark, sf):
    base = sf.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(docs).join(labels, "doc_id").filter("NOT base_failed").groupBy("quality").agg({"kept": "count_if"}).collect()
    n = {r["quality"]: r[1] for r in got}
    all_ = {r["quality"]: r["count"] for r in quality.judge(docs).join(labels, "doc_id").filter("NOT base_failed").groupBy("quality").count().collect()}
    assert n[1] == all_[1] and n[0] < 0.8 * all_[0]


def test_no_language_empty_table_and_clashing_columns(make_docs):
    got = quality.judge(make_docs([(1, "one two three four five six seven eight nine ten")])).first()
    assert got["kept"] and got["class_distance"] is None
    assert quality.judge(make_docs([])).count() == 0
    docs = make_docs([(1, "a")]).selectExpr("*", "1 AS kept", "2 AS n_words", "3 AS word")
    got = quality.judge(docs)
    assert len(set(got.columns)) == len(got.columns) and got.first()["n_words"] == 1
