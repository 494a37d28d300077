"""Quality rules: plain counts, and distance of histograms from those of a language.

The counts (words, their characters, symbols, repeated lines, repeated five-word windows)
give the first verdict. The second compares two histograms of a document with those of each
language: classes of characters, and the language's common words (and all others). Each
pair is compared by the Jensen-Shannon distance (root of the divergence in bits, 0 to 1);
the document's distance is that to the language where the mean of both is least. Histograms
of few words are mostly chance, so documents under ``min_words`` words are not judged by
them.

The references are sums over all documents of a language with enough words. Word counts
are added up per task before they are shuffled by word; what is kept is a histogram of
classes and ``COMMON`` words for each language. Texts meet the languages in blocks of
``BLOCK``, one broadcast each, so any number of languages will do.

Defined results
    null or empty text: no words, hence ``base_failed``.
    No document with a language: no reference, so the counts alone decide.
    Null languages don't count for a reference; their documents are judged like others.
    Empty table: empty result. Repeated rows count and are judged each.
    Other columns are kept; those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pulsewarden.llm.language import BLOCK
from pulsewarden.llm.rows import with_rid
from pulsewarden.llm.tokens import Words, groups, hashes, ngram_hashes, pair, utf8, words
from pulsewarden.operators.ordering import first_per_key
from pulsewarden.session import materialize

#: Words of a language that its histogram tells apart.
COMMON = 100
MIN_WORDS = 50
#: Distances from here on, of classes and of words, are another kind of text.
MAX_DISTANCE = (0.32, 0.53)

SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?'\"()-"
CLASSES = 9
#: Class of a byte; bytes inside a character have none (the last, left out).
_CLASS = np.full(256, 7, np.int64)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[ord("a"): ord("z") + 1] = 1
_CLASS[ord("A"): ord("Z") + 1] = 2
_CLASS[ord("0"): ord("9") + 1] = 3
_CLASS[[ord(c) for c in MARKS]] = 4
_CLASS[[ord(c) for c in SYMBOLS]] = 5
_CLASS[0xC0:] = 6
_CLASS[0x80:0xC0] = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _line_spans(data: np.ndarray, offsets: np.ndarray, w: Words) -> Words:
    """The lines that hold a word."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    full = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[full], ends[full]
    doc = np.searchsorted(offsets, starts, "right") - 1
    return Words(starts, ends, doc, np.bincount(doc, minlength=len(offsets) - 1))


def count_text(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, dict[str, np.ndarray]]:
    texts = len(offsets) - 1
    w = words(data, offsets)
    kinds = _CLASS[data]
    lines = _line_spans(data, offsets, w)
    keys = pair(hashes(data, lines, lower=False), lines.doc.astype(np.uint64))
    _, first = np.unique(keys, return_index=True)
    distinct = np.bincount(lines.doc[first], minlength=texts)
    grams, at = ngram_hashes(hashes(data, w, lower=False), w, 5)
    _, place, n = np.unique(pair(grams, w.doc[at].astype(np.uint64)), return_inverse=True, return_counts=True)
    again = at[n[place] > 1] if len(at) else at
    edge = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + 5, -1)
    covered = w.doc[np.cumsum(edge[:-1]) > 0]
    return w, {
        "n_words": w.counts,
        "word_chars": _per_text((kinds != 0) & (kinds != 8), offsets),
        "n_symbols": _per_text(kinds == 5, offsets),
        "n_dup_lines": lines.counts - distinct,
        "n_repeat_words": np.bincount(covered, minlength=texts),
    }


def class_histograms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    texts = len(offsets) - 1
    whose = np.repeat(np.arange(texts), np.diff(offsets))
    return np.bincount(whose * CLASSES + _CLASS[data], minlength=texts * CLASSES).reshape(texts, CLASSES)[:, :-1]


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts ``p`` from the counts ``q``."""
    p = p / np.maximum(p.sum(-1, keepdims=True), 1e-300)
    q = q / max(q.sum(), 1e-300)
    m = (p + q) / 2

    def part(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(-1)

    return np.sqrt(np.clip((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0, 1))


@dataclass(frozen=True)
class Reference:
    lang: str
    classes: np.ndarray
    #: Hashes of the common words, sorted; their counts, and at the end that of all others.
    common: np.ndarray
    counts: np.ndarray

    def distance(self, classes: np.ndarray, h: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
        texts, size = len(w.counts), len(self.common) + 1
        at = np.searchsorted(self.common, h)
        found = self.common[np.minimum(at, size - 2)] == h if size > 1 else np.zeros(len(h), bool)
        slot = np.where(found, at, size - 1)
        histogram = np.bincount(w.doc * size + slot, minlength=texts * size).reshape(texts, size)
        return js_distance(classes, self.classes), js_distance(histogram, self.counts)


def references(docs: DataFrame, min_words: int = MIN_WORDS, common: int = COMMON, block: int = BLOCK) -> Iterator[list[Reference]]:
    """One for each language of ``docs`` (text, lang), in blocks; one block is on the driver at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            data, offsets = utf8(batch.column(0))
            for i, j in groups(data, offsets):
                base = offsets[i]
                d, o = data[base: offsets[j]], offsets[i: j + 1] - base
                w = words(d, o)
                h, kinds, own = hashes(d, w), class_histograms(d, o), langs[i:j]
                enough = w.counts >= min_words
                for lang in sorted({x for x in own[enough]}):
                    pick = enough & (own == lang)
                    classes[lang] = classes.get(lang, 0) + kinds[pick].sum(0)
                    u, n = np.unique(h[pick[w.doc]], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(n)], ["lang", "word", "n"])
        for lang, n in classes.items():  # the word -1-k stands for class k here
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n), pa.string()), pa.array([None] * len(n), pa.int64()),
                 pa.array(n * 16 + np.arange(len(n)))], ["lang", "word", "n"])

    rows = docs.select("text", "lang").filter("lang IS NOT NULL").mapInArrow(count, "lang string, word long, n long")
    kind = F.when(F.col("word").isNull(), F.col("n") % 16)
    n = F.when(F.col("word").isNull(), F.floor(F.col("n") / 16)).otherwise(F.col("n"))
    totals = materialize(rows.groupBy("lang", "word", kind.alias("kind")).agg(F.sum(n).alias("n")))
    vocabulary = totals.filter("word IS NOT NULL")
    # each task ranks its own words first, so no language's vocabulary meets in one
    best = first_per_key(vocabulary, common, ["lang"], [F.col("n").desc(), F.col("word")])
    best = best.join(vocabulary.groupBy("lang").agg(F.sum("n").alias("all")), "lang")
    top = best.unionByName(totals.filter("word IS NULL").withColumn("all", F.lit(0).cast("long")))
    rows = materialize(top).orderBy("lang").toLocalIterator()
    for _, own in groupby(enumerate(groupby(rows, key=lambda r: r["lang"])), key=lambda x: x[0] // block):
        yield [_reference(lang, list(held)) for _, (lang, held) in own]


def _reference(lang: str, rows: list) -> Reference:
    classes = np.zeros(CLASSES - 1)
    for r in rows:
        if r["word"] is None:
            classes[r["kind"]] = r["n"]
    ranked = sorted((np.int64(r["word"]).astype(np.uint64), r["n"], r["all"]) for r in rows if r["word"] is not None)
    n = np.array([x[1] for x in ranked], float)
    return Reference(lang, classes, np.array([x[0] for x in ranked], np.uint64),
                     np.append(n, ranked[0][2] - n.sum() if ranked else 0))


def judge(docs: DataFrame, min_words: int = MIN_WORDS, max_distance: tuple[float, float] = MAX_DISTANCE,
          text: str = "text", lang: str = "lang", block: int = BLOCK) -> DataFrame:
    """``docs`` with the counts, base_failed, class_distance, word_distance, kept."""
    results = [*COUNTS, "base_failed", "class_distance", "word_distance", "kept"]
    docs = docs.drop(*results)
    every = references(docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")), min_words, block=block)
    first, second = next(every, []), next(every, None)
    if second is None:
        found = _measured(docs, first, text)
    else:
        rows = with_rid(docs, "_rid")
        slim, best = rows.select("_rid", F.col(text).alias("text")), None
        far = F.struct((F.col("class_distance") + F.col("word_distance")).alias("sum"), "class_distance", "word_distance")
        for own in chain((first, second), every):
            found = _measured(slim, own, "text").select("_rid", *COUNTS, far.alias("_far"))
            if best is not None:
                found = found.unionByName(best).groupBy("_rid").agg(*[F.first(c).alias(c) for c in COUNTS], F.min("_far").alias("_far"))
            best = materialize(found)
        found = rows.join(best, "_rid").select(*docs.columns, *COUNTS, "_far.class_distance", "_far.word_distance")
    n = F.col("n_words")
    failed = (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)
    a, b = (F.col(c) for c in ("class_distance", "word_distance"))
    odd = (n >= min_words) & F.coalesce((a >= max_distance[0]) | (b >= max_distance[1]), F.lit(False))
    return found.withColumns({"base_failed": failed, "kept": ~failed & ~odd}).select(*docs.columns, *results)


def _measured(docs: DataFrame, known: list[Reference], text: str) -> DataFrame:
    """``docs`` with the counts, and the distances from the closest of ``known`` (null without one)."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    at = docs.columns.index(text)
    schema = T.StructType([
        *docs.schema.fields, *[T.StructField(c, T.LongType()) for c in COUNTS],
        T.StructField("class_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            for i, j in groups(data, offsets):
                base = offsets[i]
                d, o = data[base: offsets[j]], offsets[i: j + 1] - base
                w, n = count_text(d, o)
                chars, others = np.full((2, j - i), np.inf)
                if shared.value:
                    h, kinds = hashes(d, w), class_histograms(d, o)
                    for ref in shared.value:
                        a, b = ref.distance(kinds, h, w)
                        closer = a + b < chars + others
                        chars, others = np.where(closer, a, chars), np.where(closer, b, others)
                shown = [pa.array(x, mask=~np.isfinite(x)) for x in (chars, others)]
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(i, j - i) for c in batch.columns], *[pa.array(n[c].astype(np.int64)) for c in COUNTS], *shown],
                    [*batch.schema.names, *COUNTS, "class_distance", "word_distance"])

    return docs.mapInArrow(run, schema)
