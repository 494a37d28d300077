"""Deleted lines against all runs of lines that occur earlier."""

import random
import re

import pytest

from pulsewarden.llm import winnow

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, least):
    """``rows`` in document order."""
    docs = []
    for _, text in rows:
        lines = (text or "").split("\n")
        docs.append((lines, [(k, x.strip(" \t\n\x0b\x0c\r"), len(WORD.findall(x))) for k, x in enumerate(lines) if WORD.search(x)]))
    seen, out = set(), []
    for (i, text), (lines, full) in zip(rows, docs):
        cut = set()
        runs = [(a, b) for a in range(len(full)) for b in range(a, len(full)) if sum(w for *_, w in full[a: b + 1]) >= least]
        for a, b in sorted(runs, key=lambda r: r):
            key = tuple(x for _, x, _ in full[a: b + 1])
            if (key in seen) or any(key == tuple(x for _, x, _ in full[c: c + b - a + 1]) for c in range(a)):
                cut |= {k for k, *_ in full[a: b + 1]}
        seen |= {tuple(x for _, x, _ in full[a: b + 1]) for a, b in runs}
        gone = [k in cut for k, *_ in full]
        for (a, *_), (b, *_), g, h in zip(full, full[1:], gone, gone[1:]):
            cut |= set(range(a, b)) if g and h else set()
        kept = "\n".join(x for k, x in enumerate(lines) if k not in cut)
        out.append((i, 0 if text is None else len(lines), len(cut), None if text is None else kept))
    return out


@pytest.mark.parametrize("seed, least", [(1, 6), (2, 10), (3, 1), (4, 15)])
def test_equals_brute_force(make_docs, seed, least):
    r = random.Random(seed)
    line = lambda: r.choice(["", "  ", " ".join(r.choice("abcdefgh") for _ in range(r.choice([1, 2, 3, 8])))])
    passages = [[line() for _ in range(r.randint(1, 7))] for _ in range(8)]
    rows = [(1, None), (2, ""), (3, "\n\n")]
    for i in range(40):
        lines = []
        for _ in range(r.randint(1, 4)):
            lines += r.choice(passages) if r.random() < 0.6 else [line() for _ in range(r.randint(1, 5))]
        rows.append((10 + i, "\n".join(x + r.choice(["", " ", "\r"]) for x in lines)))
    shuffled = rows[:]
    r.shuffle(shuffled)
    got = winnow.dedup_lines(make_docs(shuffled), least).orderBy("doc_id").collect()
    assert [(g["doc_id"], g["n_lines"], g["n_removed"], g["text"]) for g in got] == brute(rows, least)


def test_one_of_several_copies_stays(make_docs, odd):
    long = "\n".join(" ".join(f"w{k}{j}" for j in range(20)) for k in range(5))
    rows = odd + [(50, long), (50, long), (None, long), (49, "head\n" + long)]
    got = winnow.dedup_lines(make_docs(rows)).collect()
    assert len(got) == len(rows)
    kept = [g for g in got if (g["text"] or "").count("\n") >= 4]
    assert len(kept) == 1 and kept[0]["doc_id"] == 49
    assert sorted(str(g["text"]) for g in got if g["doc_id"] == 50) == ["", ""]


def test_empty_table_and_clashing_columns(make_docs):
    assert winnow.dedup_lines(make_docs([])).count() == 0
    docs = make_docs([(1, "a")]).selectExpr("*", "1 AS place", "2 AS runs0", "3 AS n_lines", "4 AS a", "5 AS pos")
    got = winnow.dedup_lines(docs)
    assert len(set(got.columns)) == len(got.columns) and got.first()["n_lines"] == 1


def test_a_text_stays_behind_when_its_lines_are_dealt(make_docs):
    """Lines are cut, and their words counted, once; what a text has once isn't worked out for each line."""
    docs = make_docs([(1, "a b\nc d")]).selectExpr("doc_id AS _row", "doc_id AS _id", "text AS _text")
    plan = winnow.line_table(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    dealt = next(x for x in plan.splitlines() if "Generate posexplode" in x)
    assert "_text" not in dealt
    assert len(winnow.line_table(docs).collect()) == 2
