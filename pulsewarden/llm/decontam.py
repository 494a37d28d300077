"""Benchmark decontamination: pigeonhole pieces, then Myers' bit-parallel distance.

Texts are compared in lower case with every run of white space as one blank. An item of m
characters is found where a part of a document lies within ``rate * m`` edits of it. Of an
item cut into one piece more than it may have edits, at least one piece is unharmed
wherever the item is found. So documents are searched for all pieces at once (an
Aho-Corasick automaton), and only the surroundings of a hit, the item's length plus the
error budget to both sides, are verified: Myers' algorithm keeps a column of the edit
matrix in the bits of one integer, a few operations for each character.

Items under ``MIN_CHARS`` characters have no edits to spare and lie in many texts by chance;
they are found verbatim only, between word borders.

Documents are not shuffled. Items come in blocks of bounded size, each broadcast and
searched for in one pass, so the benchmark may be of any size; equal items are searched
for once. With several blocks each pass writes what it has found, and the documents get their
lists in the end.

Defined results
    null or empty text: no leaks. null or empty items: never found. Empty tables: no leaks,
    or no rows.
    Repeated documents are searched each; repeated items are all reported.
    Ties: an item found several times is reported once, with its least distance.
    Other columns are kept; one named ``leaks`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from pulsewarden.llm.rows import with_rid
from pulsewarden.session import materialize

#: Edits for each character of an item.
RATE = 0.05
MIN_CHARS = 20
#: Characters of items in a block.
BLOCK = 1 << 20

#: Text of an item, and the ids that have it.
Item = tuple[str, list]

LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType())]))


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(text: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 parts of nearly equal length, with their places."""
    n = edits + 1
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(pattern: str, text: str) -> int:
    """Least number of edits between ``pattern`` and any part of ``text``."""
    m = len(pattern)
    ones, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score = ones, 0, m  # bits where the column rises and falls
    best = m
    for c in text:
        eq = where.get(c, 0)
        same = eq | down
        diagonal = ((((eq & up) + up) ^ up) | eq) & ones
        rise, fall = down | (ones & ~(diagonal | up)), up & diagonal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            best = min(best, score)
        rise, fall = (rise << 1) & ones, (fall << 1) & ones  # a match may begin anywhere
        up, down = fall | (ones & ~(same | rise)), rise & same
    return best


class Finder:
    """All items of a block."""

    def __init__(self, items: list[Item], rate: float):
        self.items = items
        self.edits = [int(rate * len(t)) if len(t) >= MIN_CHARS else 0 for t, _ in items]
        self.short = [len(t) < MIN_CHARS for t, _ in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (text, _) in enumerate(items):
            for at, piece in pieces(text, self.edits[k]):
                found.setdefault(piece, []).append((k, at))
        self.search = ahocorasick.Automaton()
        for piece, places in found.items():
            self.search.add_word(piece, (len(piece), places))
        if found:
            self.search.make_automaton()

    def leaks(self, raw: str | None) -> list[tuple[int, int]]:
        """Item and least distance of all that are found."""
        text = normal(raw)
        if not text or not self.items:
            return []
        near: dict[int, list[tuple[int, int]]] = {}
        best: dict[int, int] = {}
        for end, (n, places) in self.search.iter(text):
            for k, at in places:
                if best.get(k) == 0:
                    continue
                item, edits = self.items[k][0], self.edits[k]
                start = end + 1 - n - at
                if self.short[k]:
                    if not (text[start - 1: start].isalnum() or text[end + 1: end + 2].isalnum()):
                        best[k] = 0
                    continue
                if start >= 0 and text.startswith(item, start):
                    best[k] = 0
                    continue
                a, b = max(0, start - edits), start + len(item) + edits
                spans = near.setdefault(k, [])
                if spans and a <= spans[-1][1] and spans[-1][0] <= b:
                    spans[-1] = (min(a, spans[-1][0]), max(b, spans[-1][1]))
                else:
                    spans.append((a, b))
        for k, spans in near.items():
            for a, b in spans:
                if best.get(k) == 0:
                    break
                d = myers(self.items[k][0], text[a:b])
                if d <= self.edits[k]:
                    best[k] = min(d, best.get(k, d))
        return sorted(best.items())


@lru_cache(maxsize=2)
def _finder(block: int, shared: Broadcast, rate: float) -> Finder:
    return Finder(shared.value, rate)


def blocks(items: DataFrame, item_id: str, text: str, size: int = BLOCK) -> Iterator[list[Item]]:
    """Items in blocks of about ``size`` characters; one block at a time is on the driver."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+", " "))
    rows = (
        items.select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text"), clean.alias("key"))
        .filter(F.length("key") > 0).orderBy("key", "text", "id")
    )
    block: dict[str, list] = {}
    held = 0
    for r in rows.toLocalIterator():
        key = normal(r["text"])
        if key not in block and held + len(key) > size and block:
            yield list(block.items())
            block, held = {}, 0
        held += 0 if key in block else len(key)
        block.setdefault(key, []).append(r["id"])
    if block:
        yield list(block.items())


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, text: str = "text",
               item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` with ``leaks``: array of item_id and distance, in order."""
    docs = docs.drop("leaks")
    every = blocks(items, item_id, item_text, block)
    first, second = next(every, None), next(every, None)
    if first is None:
        return docs.withColumn("leaks", F.array().cast(LEAK))
    if second is None:
        return _searched(docs, text, 0, first, rate)
    rows = with_rid(docs, "_rid")
    slim = rows.select("_rid", F.col(text).alias("text"))
    tables = []
    for number, found in enumerate(chain((first, second), every)):
        hits = _searched(slim, "text", number, found, rate).select("_rid", F.inline("leaks"))
        tables.append(materialize(hits))
    folders = sorted({f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()})
    hits = docs.sparkSession.read.schema(tables[0].schema).parquet(*folders) if folders else tables[0]
    leaks = hits.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("item_id", "distance"))).alias("leaks"))
    return rows.join(leaks, "_rid", "left").withColumn("leaks", F.coalesce("leaks", F.array().cast(LEAK))).drop("_rid")


def _searched(docs: DataFrame, text: str, number: int, found: list[Item], rate: float) -> DataFrame:
    """``docs`` with the leaks of one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(found)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("leaks", LEAK)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(number, shared, rate)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
        for batch in batches:
            leaks = [[{"item_id": i, "distance": d} for k, d in finder.leaks(t.as_py()) for i in finder.items[k][1]] for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaks, kind)], [*batch.schema.names, "leaks"])

    return docs.mapInArrow(run, schema).withColumn("leaks", F.array_sort("leaks"))
