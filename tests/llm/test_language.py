"""Profiles against bundles made letter by letter, and languages on held-out texts."""

import tracemalloc
import zlib

import numpy as np

from pulsewarden.llm import language


def bundle(text):
    """The sum over n-grams of products of rotated letter vectors."""
    clean, total, lettered = [], np.zeros(language.DIMENSIONS), False
    for c in f"\n{text.lower()}\n":
        if c.isalpha():
            clean.append(ord(c))
        elif not clean or clean[-1] != 0:
            clean.append(0)
    for k in range(len(clean) - language.N + 1):
        v = np.ones(language.DIMENSIONS)
        for i, c in enumerate(clean[k: k + language.N]):
            v *= np.roll(language.letter_vectors(np.array([c]))[0], language.N - 1 - i)
        total += v
        lettered |= any(clean[k: k + language.N])
    return total if lettered else total * 0


def test_profiles_are_bundles():
    texts = ["Hello, World!", "", "1 2 3", "ñandú ñandú", "a", "北京 x-y", "\ud800 lone"]
    got = language.profiles(texts)
    assert np.allclose(got, [bundle(t) for t in texts])


def test_letter_vectors_are_nearly_orthogonal():
    v = language.letter_vectors(np.arange(97, 123))
    dots = v @ v.T / language.DIMENSIONS
    assert np.allclose(np.diag(dots), 1) and np.abs(dots - np.eye(26)).max() < 0.2


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    rows = language.identify(docs).collect()
    unseen = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in unseen]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(make_docs, odd):
    rows = [(*r, "xx" if i % 2 else None) for i, r in enumerate(odd)] + [(i, "the cat and the dog", "en") for i in range(20, 40)]
    got = {(r["doc_id"], r["text"]): r for r in language.identify(make_docs(rows)).collect()}
    for i, t in odd:
        r = got[i, t]
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))
        assert r["score"] == 0 if r["lang_pred"] == "und" else 0 <= r["score"] <= 1
    assert got[20, "the cat and the dog"]["lang_pred"] == "en"


def test_no_language_known_empty_table_and_clashing_columns(make_docs):
    assert [r["lang_pred"] for r in language.identify(make_docs([(1, "abc")])).collect()] == ["und"]
    assert language.identify(make_docs([])).count() == 0
    docs = make_docs([(1, "abc", "en"), (0, "abc", "en"), (3, "abc", "en")]).selectExpr("*", "1 AS score", "2 AS held_out", "3 AS v")
    got = language.identify(docs)
    assert len(set(got.columns)) == len(got.columns) and {r["lang_pred"] for r in got.collect()} == {"en"}


def test_very_long_text(make_docs):
    got = language.identify(make_docs([(i, "der die das und " * n, "de") for i, n in enumerate([100_000, 1, 2, 3])]))
    assert {r["lang_pred"] for r in got.collect()} == {"de"}


def test_many_distinct_letters_stay_within_bounds():
    """Vectors are made of a bounded number of n-grams, of which this text has 60 000."""
    r = np.random.default_rng(1)
    text = "".join(map(chr, r.integers(0x4E00, 0x9000, 60_000)))
    language.profiles(["warm up"])
    tracemalloc.start()
    got = language.profiles([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 << 20  # all vectors at once take 240 MB for each copy
    assert np.allclose(language.profiles([text[:3000]]), [bundle(text[:3000])])
    assert got.any()


def test_any_number_of_languages(make_docs, monkeypatch):
    rows = [(3 * i + j, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * (5 + j), f"l{i:03d}") for i in range(60) for j in range(3)]
    rows += [(1000, None), (1001, "12"), (1002, "aa aa aa")]
    whole = sorted(tuple(r) for r in language.identify(make_docs(rows)).select("doc_id", "lang_pred", "score").collect())
    monkeypatch.setattr(language, "BLOCK", 11)  # tasks hand on what they have
    blocks = sorted(tuple(r) for r in language.identify(make_docs(rows), block=7).select("doc_id", "lang_pred", "score").collect())
    assert [r[:2] for r in whole] == [r[:2] for r in blocks] and np.allclose([r[2] for r in whole], [r[2] for r in blocks])
    assert dict(r[:2] for r in whole)[1000] == "und" and dict(r[:2] for r in whole)[1002] == "l000"


def test_ngrams_are_counted_alike_by_tables_and_by_sorting(monkeypatch):
    texts = ["Hello, World!", "", "1 2 3", "ñandú ñandú", "a", "北京 x-y \U0001f600", "the other text " * 40]
    # few n-grams need neither sorting nor products of rows of floats
    sizes, slices = language.count_ngrams(texts)
    by_table = [[np.asarray(x).tolist() for x in s] for s in slices]
    monkeypatch.setattr(language, "TABLE", 0)
    again, slices = language.count_ngrams(texts)
    assert [[np.asarray(x).tolist() for x in s] for s in slices] == by_table
    assert sizes.tolist() == again.tolist()
    assert np.array_equal(language.profiles(texts), np.stack([bundle(t) for t in texts]))
