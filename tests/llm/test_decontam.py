"""Leaks against the whole edit matrix."""

import random
import re

import numpy as np
import pytest

from pulsewarden.llm import decontam


def least(pattern, text):
    """Least edits between the pattern and a part of the text, row by row."""
    points = np.array([ord(c) for c in text])
    row, step = np.zeros(len(text) + 1, int), np.arange(len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (points != ord(c)))])
        row = np.minimum.accumulate(new - step) + step
    return int(row.min())


def test_bit_parallel_distance():
    r = random.Random(1)
    for _ in range(300):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 140)))
        t = "".join(r.choice("abcd") for _ in range(r.randint(0, 60))) + p[r.randint(0, 9):] * r.randint(0, 1)
        assert decontam.myers(p, t) == least(p, t)


def test_pieces_cover_the_item():
    for n in range(1, 60):
        for e in range(0, 8):
            assert "".join(x for _, x in decontam.pieces("x" * n, e)) == "x" * n


def harmed(r, text, edits):
    t = list(text)
    for _ in range(edits):
        k = r.randrange(len(t))
        t[k: k + 1] = r.choice([[], [r.choice("abc ")], [t[k], r.choice("abc ")]])
    return "".join(t)


@pytest.mark.parametrize("block", [1 << 20, 500])
def test_equals_the_edit_matrix(spark, make_docs, odd, block):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: r.choice([" ", "\n", "  "]).join(word() for _ in range(n))
    items = [(i, prose(r.randint(4, 40)).title()) for i in range(25)]
    items += [(25, items[3][1]), (26, None), (27, ""), (28, "short"), (29, items[4][1].upper()), (None, items[5][1]), (30, "ab" * 100)]
    rows = odd + [(90, "ab" * 300), (91, "word " * 40_000), (92, "a short text"), (93, "shorter"), (94, "(SHORT)"), (95, "un short"),
                  (96, prose(9_000) + " " + decontam.normal(items[7][1]) + " " + prose(4_000))]
    for i in range(60):
        text = decontam.normal(r.choice(items)[1])
        rows.append((100 + i, prose(r.randint(0, 30)) + " " + (harmed(r, text, r.randint(0, int(0.08 * len(text)) + 1)) if text else "") + " " + prose(r.randint(0, 9))))
    got = decontam.find_leaks(make_docs(rows), spark.createDataFrame(items, "item_id long, text string"), block=block).collect()
    assert len(got) == len(rows)
    leaks = 0
    for g in got:
        text, want = decontam.normal(g["text"]), []
        for i, item in items:
            item = decontam.normal(item)
            if 0 < len(item) < decontam.MIN_CHARS:
                if re.search(rf"(?<![^\W_]){re.escape(item)}(?![^\W_])", text):
                    want.append((i, 0))
            elif item:
                d = least(item, text)
                if d <= int(decontam.RATE * len(item)):
                    want.append((i, d))
        assert sorted(((x["item_id"], x["distance"]) for x in g["leaks"]), key=str) == sorted(want, key=str)
        leaks += len(want)
    assert leaks > 30
    assert {g["doc_id"]: len(g["leaks"]) for g in got if g["doc_id"] in (92, 93, 94, 95)} == {92: 1, 93: 0, 94: 1, 95: 1}


def test_empty_tables_and_clashing_columns(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "some words that are long enough")], "item_id long, text string")
    docs = make_docs([(1, "x some  words\nthat are LONG enough y"), (2, None)]).selectExpr("*", "1 AS leaks", "2 AS item_id")
    assert [r["leaks"] for r in decontam.find_leaks(docs, none).collect()] == [[], []]
    assert sorted(len(r["leaks"]) for r in decontam.find_leaks(docs, one).collect()) == [0, 1]
    assert decontam.find_leaks(make_docs([]), one).count() == 0
