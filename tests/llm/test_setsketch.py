"""Groups by SetSketch registers against brute force."""

import random

import numpy as np
import pytest

from pulsewarden.llm import setsketch
from .test_ngramjoin import brute, near_copies


def found(docs, *args, **limits):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in setsketch.near_duplicates(docs, *args, **limits).collect()), key=str)


@pytest.mark.parametrize("seed, words, percent, limits", [
    (1, 4, 80, {}),
    (2, 4, 80, {"cover": 3, "block": 4, "split": 2}),
    (3, 5, 80, {"cover": 2, "block": 3, "split": 1}),
    (4, 3, 90, {"cover": 8, "block": 2}),
])
def test_groups_equal_brute_force(make_docs, odd, seed, words, percent, limits):
    rows = near_copies(seed, 14, 14) + [(10_000 + (i or 0) if i is not None else None, t) for i, t in odd]
    assert found(make_docs(rows), words, percent, **limits) == brute(rows, words, percent)


def test_many_unlike_sets_of_one_template(make_docs):
    """Most pairs share half of their words, some link, and links form chains."""
    r = random.Random(9)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for i in range(160):
        w = list(base)
        for k in range(r.choice([2, 4, 6, 9, 13])):
            w[r.randrange(120)] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    want = brute(rows, 4, 80)
    assert 10 < len({g for _, _, g in want}) < 150
    assert found(make_docs(rows)) == want
    assert found(make_docs(rows), cover=16, block=8, split=4) == want


def test_kept_rows_empty_table_and_clashing_columns(make_docs):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (1, "A b c d e"), (2, ""), (None, "x y"), (None, "x y")]
    docs = make_docs(rows).selectExpr("*", "7 AS rid", "8 AS kept", "9 AS component_id", "1 AS size", "2 AS class", "3 AS a", "4 AS sketch")
    got = setsketch.near_duplicates(docs)
    assert sorted(got.columns) == sorted(["doc_id", "lang", "source", "n_chars", "size", "class", "a", "sketch", "n_shingles", "component_id", "kept"])
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got.collect()), key=str) == sorted(
        [(3, 1, False), (1, 1, True), (1, 1, True), (2, 2, True), (None, None, True), (None, None, True)], key=str)
    assert setsketch.near_duplicates(make_docs([])).count() == 0


def test_shuffled_and_limited_frames(make_docs):
    rows = near_copies(5, 8, 8)
    docs = make_docs(rows).repartition(7).orderBy("n_chars").limit(len(rows))
    assert found(docs) == brute(rows, 4, 80)


def test_very_long_texts(make_docs):
    r = random.Random(4)
    w = [f"w{r.randrange(5000)}" for _ in range(120_000)]
    other = list(w)
    for k in r.sample(range(len(w)), 3000):
        other[k] = "new"
    rows = [(1, " ".join(w)), (2, " ".join(other)), (3, "y" * 300_000), (4, " ".join(w[:60_000]))]
    assert found(make_docs(rows)) == brute(rows, 4, 80)


def sketch(*sets):
    cuts = np.append(0, np.cumsum([len(s) for s in sets]))
    return setsketch.registers(np.concatenate([np.sort(s) for s in sets]), cuts)


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(2)
    for n, both in ((400, 300), (60, 50), (2000, 1000), (5, 4), (300, 0)):
        errors = []
        for _ in range(30):
            t = setsketch.mix(r.integers(0, 2**63, 2 * n - both, dtype=np.uint64))
            a, b = t[:n], t[n - both:]
            x, y, z = sketch(a, b, t)
            assert (setsketch.merge(x, y) == z).all()
            j = both / (2 * n - both)
            got = setsketch.estimate((x > y).sum(), (x < y).sum(), np.float64(n), np.float64(n))
            errors.append(got - j)
            if j >= 0.8:
                assert setsketch.may_link((x > y).sum(), (x < y).sum(), np.array(n), np.array(n), 80)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08
    assert not setsketch.may_link(np.array(60), np.array(60), np.array(100), np.array(100), 80)
    assert not setsketch.may_link(np.array(0), np.array(0), np.array(100), np.array(79), 80)


def test_cover_holds_every_pair():
    r = np.random.default_rng(7)
    for share in (0.02, 0.2, 0.7, 1.0):
        may = np.triu(r.random((40, 40)) < share, 1)
        may |= may.T
        found = setsketch.cover(np.arange(40), may)
        star = {c: {c} for c, _ in found}
        for c, m in found:
            star[c].add(m)
        assert all(any(x in s and y in s for s in star.values()) for x, y in zip(*np.nonzero(may)))


def test_the_filter_keeps_every_row_with_an_id(spark, monkeypatch):
    from pulsewarden.llm import rows

    df = spark.range(5000).selectExpr("id AS k", "id * 2 AS v")
    got = {r["k"] for r in rows.maybe_in(df, df.filter("k % 50 = 0").select("k"), "k").collect()}
    assert {k for k in range(0, 5000, 50)} <= got and len(got) < 150
    monkeypatch.setattr(rows, "FILTER_BITS", 16)
    got = {r["k"] for r in rows.maybe_in(df, df.filter("k >= 10").select("k"), "k").collect()}
    assert set(range(10, 5000)) <= got
    assert rows.maybe_in(df, df.limit(0).select("k"), "k").count() == 0


def test_ids_of_rows_stay(spark, make_docs):
    from pulsewarden.llm import rows

    docs = make_docs([(i, "x") for i in range(30)])
    assert rows.is_scan(docs) and rows.is_scan(docs.selectExpr("doc_id", "upper(text) AS text"))
    assert not any(rows.is_scan(d) for d in (docs.limit(5), docs.repartition(2), docs.distinct(), docs.selectExpr("rand() AS r"),
                                             docs.join(docs.select("doc_id"), "doc_id"), spark.range(3)))
    mixed = rows.with_rid(docs.repartition(5).orderBy("lang").limit(25))
    assert {tuple(r) for r in mixed.select("rid", "doc_id").collect()} == {tuple(r) for r in mixed.select("rid", "doc_id").collect()}
    assert rows.is_scan(mixed.drop("rid")) and mixed.select("rid").distinct().count() == 25
