"""Every stage of the pipeline against its brute-force version, each on what the one before kept."""

import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulsewarden.llm import decontam, language, mixing, winnow

from .test_decontam import least
from .test_language import bundle
from .test_mixing import goals
from .test_ngramjoin import brute as groups
from .test_winnow import brute as cut_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Rows before the first stage and after each."""
    base = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = docs.columns
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, sf)
        assert name == corpus_pipeline.STAGES[-1][0] or df.columns == columns
        df.write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        out.append(docs.collect())
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: r["doc_id"])


def test_language(stages):
    before, after = stages[0], stages[1]
    bundles = {r["doc_id"]: bundle(r["text"] or "") for r in before}
    total = {}
    for r in before:
        b = bundles[r["doc_id"]]
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and b.any():
            # a text's n-grams: its letters and gaps, less two
            n = sum(1 for _ in re.finditer(r"[^\W\d_]|(?:[\W\d_])+", f"\n{r['text'].lower()}\n")) - language.N + 1
            total[r["lang"]] = total.get(r["lang"], 0) + b / n
    prototypes = np.array([total[x] / np.linalg.norm(total[x]) for x in sorted(total)])
    want = []
    for r in before:
        b = bundles[r["doc_id"]]
        if b.any() and (prototypes @ b / np.linalg.norm(b)).max() > corpus_pipeline.CHANCE:
            want.append(tuple(r))
    assert sorted(map(tuple, after)) == sorted(want)


def test_lines(stages):
    before, after = by_id(stages[1]), by_id(stages[2])
    want = []
    for r, (i, _, removed, text) in zip(before, cut_lines([(r["doc_id"], r["text"]) for r in before], winnow.MIN_WORDS)):
        if not (removed and not WORD.search(text)):
            want.append((i, text, r["lang"], r["source"], len(text)))
    assert [tuple(r) for r in after] == want


def test_groups(stages):
    before, after = stages[2], stages[3]
    first = {i for i, _, least_id in groups([(r["doc_id"], r["text"]) for r in before], 5, 80) if i == least_id}
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in before if r["doc_id"] in first)


def test_leaks(spark, sf, stages):
    before, after = stages[3], stages[4]
    items = [decontam.normal(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = []
    for r in before:
        text = decontam.normal(r["text"])
        if not any(least(x, text) <= int(decontam.RATE * len(x)) for x in items if len(x) >= decontam.MIN_CHARS):
            want.append(tuple(r))
    assert sorted(map(tuple, after)) == sorted(want)


def test_mix(spark, stages):
    before, after = stages[4], by_id(stages[5])
    assert [tuple(r)[:5] for r in after] == [tuple(r) for r in by_id(before)]
    rows = spark.createDataFrame([(r["doc_id"], r["text"]) for r in before], "doc_id long, text string")
    place = {r[0]: r[1] for r in rows.select("doc_id", mixing.place(F.col("doc_id"), F.col("text"), 17)).collect()}
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in before}
    totals = {}
    for r in before:
        totals[r["source"]] = totals.get(r["source"], 0) + size[r["doc_id"]]
    want, ahead = goals(totals, (5, 2, 1), 1.0, 3), {}
    for r in sorted(after, key=lambda r: place[r["doc_id"]]):
        total, n = totals[r["source"]], size[r["doc_id"]]
        times, rest = divmod(int(want[r["source"]] + 0.5), total)
        before_it = ahead.get(r["source"], 0)
        assert (r["size"], r["source_size"], r["taken"]) == (n, total, times * n + min(n, max(0, rest - before_it)))
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * want[r["source"]]
        ahead[r["source"]] = before_it + n


def test_run_is_the_stages(spark, sf, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, stages[-1]))


def test_odd_rows_and_empty_table(spark, make_docs, odd, sf):
    for rows in ([], [(i, t, "en", None) for i, t in odd]):
        docs = make_docs(rows)
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, docs, sf)
            docs = spark.createDataFrame(kept.collect(), kept.schema)
        assert docs.count() <= len(rows)


def test_random_letters_go_and_clean_texts_stay(spark, sf):
    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choices(string.ascii_lowercase, k=r.randint(2, 9))) for _ in range(n))
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    rows = [(-1 - i, text(n), None, "x", 0) for i, n in enumerate([25, 50, 100, 200] * 25)]
    got = corpus_pipeline.identified(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), sf)
    assert got.filter("doc_id < 0").count() <= 10
    assert got.filter("doc_id >= 0").count() == docs.count()  # the shortest has three letters
