"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. An n-gram is bound
by multiplying its letters' vectors, each permuted (rotated) by the number of letters that
follow; a text is the bundle (sum) of its n-grams, and a language the bundle of its texts,
each scaled to length one. A text is given the language with the closest prototype by
cosine.

Since a bundle is a sum, n-grams are counted, the vectors of the distinct ones made once, and
counts multiplied by vectors: a bounded number of n-grams at a time, however long a text and
however many letters it has. Prototypes are sums per language that every task adds up
itself. They are a table; texts meet them in blocks of ``BLOCK`` languages, one broadcast each,
so any number of languages will do.

Defined results
    null text, and text without a letter: ``und``, score 0.
    No row to learn from: every text ``und``. Ties: the language first by code point.
    Null languages are not learned. Any other value is a language, however many there are.
    Empty table: empty result. Repeated rows count and are judged each.
    Other columns are kept; those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pulsewarden.llm.rows import with_rid
from pulsewarden.llm.tokens import mix
from pulsewarden.session import drop, materialize

DIMENSIONS = 1024
N = 3
UND = "und"
#: Languages whose prototypes are held at once: 4 KiB each.
BLOCK = 1000
#: Code points whose n-grams are counted at once, and n-grams that vectors are made of at once.
GROUP, SLICE = 1 << 19, 1 << 12
#: Texts in a counting matrix.
TEXTS = 256
#: Values that are told apart by a table of all possible ones, not by sorting.
TABLE = 1 << 21

_GAP = 0  # stands for everything that is not a letter


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each code point."""
    words = np.arange(DIMENSIONS // 64, dtype=np.uint64)[None, :]
    bits = mix(mix(letters.astype(np.uint64) + np.uint64(1))[:, None] + words * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def ngram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bind the letters of each n-gram, given as one row of code points."""
    letters, place = np.unique(grams, return_inverse=True)
    base, place = letter_vectors(letters), place.reshape(grams.shape)
    minus = np.zeros((len(grams), DIMENSIONS // 8), np.uint8)  # products of +1 and -1 are sums of bits
    for i in range(N):
        minus ^= np.packbits(np.roll(base, N - 1 - i, axis=1) < 0, axis=1)[place[:, i]]
    return _signs().take(minus, axis=0).reshape(len(grams), DIMENSIONS)


@cache
def _signs() -> np.ndarray:
    """Eight numbers of +1 and -1 for each byte of bits."""
    return 1 - 2 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and gaps of the texts, and whose each is. A gap stands at both ends."""
    raw = ["\n" + t.lower() + "\n" for t in texts]
    points = np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), np.uint32)
    whose = np.repeat(np.arange(len(raw)), [len(t) for t in raw])
    points = np.where(_letters()[points], points, _GAP)
    keep = np.ones(len(points), bool)  # one gap for any run of other characters
    keep[1:] = (points[1:] != _GAP) | (points[:-1] != _GAP) | (whose[1:] != whose[:-1])
    return points[keep], whose[keep]


def _distinct(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``values`` (below ``size``) in order, and the place of each among them; by a table where one is small."""
    if size > TABLE:
        return np.unique(values, return_inverse=True)
    table = np.zeros(size, np.int32)
    table[values] = 1
    own = np.flatnonzero(table)
    table[own] = np.arange(len(own), dtype=np.int32)
    return own, table[values]


def _tally(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``values`` (below ``size``) in order, and how often each comes."""
    if size > TABLE:
        return np.unique(values, return_counts=True)
    n = np.bincount(values, minlength=size)
    own = np.flatnonzero(n)
    return own, n[own]


def count_ngrams(texts: list[str]) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """N-grams per text, and slices of: distinct n-grams as rows of code points; text, n-gram and count of pairs."""
    points, whose = _code_points(texts)
    m = max(0, len(points) - N + 1)
    inside = whose[:m] == whose[N - 1:]

    def slices() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for start in range(0, m, GROUP):
            end = min(m, start + GROUP)
            letters, rank = _distinct(points[start: end + N - 1], 0x110000)
            code = np.zeros(end - start, np.int64)
            for i in range(N):
                code = code * len(letters) + rank[i: i + end - start]
            same = inside[start:end]
            grams, place = _distinct(code[same], len(letters) ** N)
            if not len(grams):
                continue
            # by n-gram, so that a slice of them is a slice of the pairs
            cells, n = _tally(place.astype(np.int64) * len(texts) + whose[start:end][same], len(grams) * len(texts))
            cols, rows = np.divmod(cells, len(texts))
            for a in range(0, len(grams), SLICE):
                i, j = np.searchsorted(cols, (a, a + SLICE))
                own = grams[a: a + SLICE]
                split = np.stack([letters[own // len(letters) ** (N - 1 - k) % len(letters)] for k in range(N)], 1)
                yield split, rows[i:j], cols[i:j] - a, n[i:j]

    return np.bincount(whose[:m][inside], minlength=len(texts)), slices()


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts to count together."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and j - i < TEXTS and (j == i or size + len(texts[j]) <= GROUP):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def profiles(texts: list[str]) -> np.ndarray:
    """The bundle of each text, one row each; zero for a text without letters."""
    out, lettered = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros(len(texts), bool)
    for grams, rows, cols, n in count_ngrams(texts)[1]:
        lettered[rows[(grams[cols] != _GAP).any(1)]] = True
        counts = np.zeros((len(texts), len(grams)), np.float32)
        counts[rows, cols] = n
        out += counts @ ngram_vectors(grams)
    out[~lettered] = 0
    return out


@dataclass(frozen=True)
class Prototypes:
    languages: tuple[str, ...]
    vectors: np.ndarray  # a row of length one for each language

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The closest language of each text and its cosine; -1 for a text without letters."""
        names, scores = [], np.full(len(texts), -1.0)
        for i, j in _batches(texts):
            if not self.languages:
                names += [UND] * (j - i)
                continue
            p = profiles(texts[i:j])
            norm = np.linalg.norm(p, axis=1)
            cosine = (p @ self.vectors.T.astype(np.float32)) / np.maximum(norm, 1e-30)[:, None]
            best = cosine.argmax(1)
            names += [self.languages[b] if s else UND for b, s in zip(best, norm > 0)]
            scores[i:j] = np.where(norm > 0, cosine.max(1), -1.0)
        return names, scores


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def learn(rows: DataFrame) -> DataFrame:
    """Prototypes (lang, v) from ``rows`` (text, lang); null languages don't count. A written table."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()),
                 pa.array([v.astype(float).tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "v"])
            total.clear()
            return rows

        for batch in batches:
            texts, langs = _texts(batch.column(0)), batch.column(1).to_pylist()
            for i, j in _batches(texts):
                names = list(dict.fromkeys(langs[i:j]))
                number = {lang: k for k, lang in enumerate(names)}
                own = np.array([number[lang] for lang in langs[i:j]])
                sizes, slices = count_ngrams(texts[i:j])
                for grams, r, c, n in slices:
                    # scale each text by its number of n-grams, so that long ones don't drown the others
                    counts = np.bincount(own[r] * len(grams) + c, n / sizes[r], len(names) * len(grams))
                    sums = counts.reshape(len(names), -1).astype(np.float32) @ ngram_vectors(grams)
                    for lang, v in zip(names, sums):
                        total[lang] = total.get(lang, 0) + v
                if len(total) > BLOCK:
                    yield out()
        yield out()

    parts = rows.select("text", "lang").filter("lang IS NOT NULL").mapInArrow(bundle, "lang string, v array<double>")
    return materialize(
        parts.select("lang", F.posexplode("v").alias("i", "x"))
        .groupBy("lang", "i").agg(F.sum("x").alias("x"))
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
        .select("lang", F.col("v.x").alias("v"))
    )


def prototypes(table: DataFrame, block: int = BLOCK) -> Iterator[Prototypes]:
    """Blocks of languages, in order; one is on the driver at a time. At least one, maybe without languages."""
    rows, seen = table.orderBy("lang").toLocalIterator(), False
    while own := list(islice(rows, block)):
        vectors = np.array([r["v"] for r in own])
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)
        seen = True
        yield Prototypes(tuple(r["lang"] for r in own), vectors)
    if not seen:
        yield Prototypes((), np.zeros((0, DIMENSIONS)))


def _closest(docs: DataFrame, model: Prototypes, text: str) -> DataFrame:
    """``docs`` with lang_pred and score (the cosine, -1 for a text without letters) by one block of languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(_texts(batch.column(at)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores)], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, table: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` with lang_pred and score (the cosine, 0 to 1)."""
    docs = docs.drop("lang_pred", "score")
    models = prototypes(table, block)
    first, second = next(models), next(models, None)
    if second is None:
        found = _closest(docs, first, text)
    else:
        rows = with_rid(docs, "_rid")
        slim, tables = rows.select("_rid", F.col(text).alias("text")), []
        for number, model in enumerate(chain((first, second), models)):
            own = _closest(slim, model, "text").select("_rid", F.struct("score", F.lit(-number).alias("block"), "lang_pred").alias("_best"))
            own = own if not tables else own.unionByName(tables[-1]).groupBy("_rid").agg(F.max("_best").alias("_best"))
            tables.append(materialize(own))
            drop(*tables[-2:-1])
        found = rows.join(tables[-1], "_rid").select(*docs.columns, "_best.lang_pred", "_best.score")
    return found.withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))


def held_out(doc_id: Column, parts: int, held: int) -> Column:
    """Rows never learned from: by the checksum of the id as text (null: as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == held


def identify(docs: DataFrame, parts: int = 3, held: int = 1, doc_id: str = "doc_id", text: str = "text",
             lang: str = "lang", block: int = BLOCK) -> DataFrame:
    """``docs`` with held_out, lang_pred and score; learned from the rows not held out."""
    docs = docs.drop("held_out").withColumn("held_out", held_out(F.col(doc_id), parts, held))
    table = learn(docs.filter("NOT held_out").select(F.col(text).alias("text"), F.col(lang).alias("lang")))
    return predict(docs, table, text, block)
