"""Ranked lexical search over a length-stratified index.

Terms are maximal runs of letters and digits (ASCII ones, and all characters beyond ASCII), A-Z
in lower case. N documents have at least one, L is the number of all terms, n of one document's.
A term that df documents hold weighs w = floor(1000 * ln((2N + 2) / (2df + 1))), and a document
scores the sum over the query's distinct terms of w * ((10^9 * tf) div (1000 * tf + 8 * m)),
with the normaliser m = 10 + (90 * n * N) div L, all but w in 64-bit integers.

Index. Documents of equal m are a stratum. Within a stratum what a term adds depends on its
count alone, so postings are ordered by count (tf), the highest first, and the impact of each
count is computed once. A row of the index is a stratum, or a part of one that holds many
terms: its documents, the distinct terms, and for each term its postings. Every document is
indexed, whole. Strata are laid side by side by length and cut into shards of equal numbers of
terms before the texts are read, so a stratum with a third of all documents is many shards.

Search. The first posting of each term bounds what any document of the row can score. A query
visits rows in the order of their bounds and stops where the bound falls below the score that
it holds last. Queries are taken in blocks of a bounded number of terms, one broadcast for
each; a task reads its rows of the index once for a block and keeps the best documents of
each query. Nothing but these is shuffled.

Terms are told apart by 64-bit hashes. A query's term meets another term of the corpus by
chance with probability (terms of the query * distinct terms) / 2^64: 10^-8 for 10^3 and 10^9.

Defined results
    null or empty texts, and texts without a term: documents are not in the index and not in
    N; queries find nothing. Scores of 0 are not returned.
    Equal scores: smaller ids first, null last.
    Repeated rows: each is a document, or a query, of its own. Empty tables: empty result.
    Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from pulsewarden.llm.tokens import groups, hashes, utf8, words
from pulsewarden.operators.ordering import first_per_key
from pulsewarden.session import drop, materialize, sized

FIRST = 10
#: Terms, repeats included, in a shard; postings in a row of the index, from the document on
#: that reaches them.
SHARD, ROW = 1 << 20, 1 << 17
#: Distinct terms, summed over its queries, of a block of queries (8 bytes each).
BLOCK = 1 << 17

#: Rows of the index by terms of the block that are looked at together.
AT_ONCE = 1 << 22

#: What a term looks like.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_U = np.uint64


def _blanks() -> np.ndarray:
    """Bytes that end a term: ASCII but letters and digits."""
    t = np.zeros(256, bool)
    t[:128] = True
    for a, b in (("0", "9"), ("A", "Z"), ("a", "z")):
        t[ord(a): ord(b) + 1] = False
    return t


BLANKS = _blanks()


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each text in order, their counts, where each text's begin, and terms per text."""
    w = words(data, offsets, BLANKS)
    term = hashes(data, w)
    by = np.lexsort((term, w.doc))
    doc, term = w.doc[by], term[by]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
    tf = np.diff(np.append(new, len(term)))
    return term[new], tf, np.searchsorted(doc[new], np.arange(len(offsets))), w.counts


def lengths(docs: DataFrame) -> DataFrame:
    """n and docs: how many of ``docs`` (text) have n terms, for n > 0. One row for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in groups(data, offsets):
                base = offsets[i]
                n, docs = np.unique(words(data[base: offsets[j]], offsets[i: j + 1] - base, BLANKS).counts, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))], ["n", "docs"])

    return docs.select("text").mapInArrow(run, "n long, docs long").filter("n > 0").groupBy("n").agg(F.sum("docs").alias("docs"))


def strata(sizes: DataFrame, n_docs: int, n_terms: int, shard: int = SHARD) -> DataFrame:
    """n, m and the shards (low to high) that documents of n terms are dealt over."""
    upto = F.sum("terms").over(Window.orderBy("n"))  # a row for each length only
    return (
        sizes.withColumn("terms", F.col("n") * F.col("docs")).withColumn("upto", upto)
        .select("n", F.expr(f"10L + (90L * n * {n_docs}L) div {max(n_terms, 1)}L").alias("m"),
                F.floor((F.col("upto") - F.col("terms")) / shard).alias("low"), F.floor((F.col("upto") - 1) / shard).alias("high"))
    )


def _documents(docs: DataFrame) -> DataFrame:
    """id, n, and distinct terms with their counts of each text of ``docs`` (text, id) that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in groups(data, offsets):
                base = offsets[i]
                term, tf, cuts, n = term_counts(data[base: offsets[j]], offsets[i: j + 1] - base)
                tf = tf.astype(np.int32)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(i, j - i).take(pa.array(some)), pa.array(n[some]),
                     *[pa.array([x[cuts[k]: cuts[k + 1]].tobytes() for k in some], pa.binary()) for x in (term, tf)]],
                    ["id", "n", "terms", "tf"])

    return docs.select("text", "id").mapInArrow(run, "id long, n long, terms binary, tf binary")


INDEX = "m long, ids array<long>, terms binary, starts binary, tf binary, slot binary"


def _index_row(m: int, ids: list[int | None], terms: list[np.ndarray], tfs: list[np.ndarray]) -> tuple:
    slot = np.repeat(np.arange(len(ids), dtype=np.int32), [len(t) for t in terms])
    term, tf = np.concatenate(terms), np.concatenate(tfs)
    by = np.lexsort((slot, -tf, term))
    term = term[by]
    starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    return m, ids, term[starts].tobytes(), np.append(starts, len(term)).astype(np.int32).tobytes(), tf[by].tobytes(), slot[by].tobytes()


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD, row: int = ROW) -> tuple[DataFrame, int]:
    """The written index of ``docs``, and N."""
    slim = docs.select(F.col(text).alias("text"), F.col(doc_id).cast("long").alias("id"))
    sizes = materialize(lengths(slim))
    n_docs, n_terms = (x or 0 for x in sizes.agg(F.sum("docs"), F.sum(F.col("n") * F.col("docs"))).first())
    placed = sized(strata(sizes, n_docs, n_terms, shard))
    # a document's place follows its content, so that a task run again deals it out alike
    place = F.col("low") + F.pmod(F.xxhash64("id", "terms"), F.col("high") - F.col("low") + 1)
    dealt = _documents(slim).join(placed, "n").select("id", "m", "terms", "tf", place.alias("shard")).repartition("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, ids, terms, tfs, held = None, [], [], [], 0

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4)
            names = ["m", "ids", "terms", "starts", "tf", "slot"]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(_index_row(m, ids, terms, tfs), kinds)], names)

        for batch in batches:
            for name, own, t, f in zip(*[batch.column(c).to_pylist() for c in ("id", "m", "terms", "tf")]):
                if ids and (own != m or held >= row):
                    yield out()
                    ids, terms, tfs, held = [], [], [], 0
                m = own
                ids.append(name)
                terms.append(np.frombuffer(t, _U))
                tfs.append(np.frombuffer(f, np.int32))
                held += len(terms[-1])
        if ids:
            yield out()

    index = materialize(dealt.drop("shard").sortWithinPartitions("m").mapInArrow(run, INDEX))
    drop(sizes, placed)
    return index, n_docs


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 10**9 * tf // (1000 * tf + 8 * m)


class Queries:
    """A block of queries: their distinct terms in order, and the terms of each (places)."""

    def __init__(self, names: list, terms: list[np.ndarray]):
        self.names = names
        every = np.concatenate(terms)
        self.terms, self.place = np.unique(every, return_inverse=True)
        self.first = np.append(0, np.cumsum([len(t) for t in terms]))
        self.weights = np.zeros(len(self.terms), np.int64)

    def found(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the block's terms are among ``terms``, and where."""
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        mine = np.flatnonzero(terms[at] == self.terms)
        return mine, at[mine]


class Search:
    """The best documents of each query of a block, over the rows of the index that it is shown."""

    def __init__(self, queries: Queries, k: int):
        self.queries, self.k = queries, k
        none = np.zeros(0, np.int64)
        self.best = [(none, none.astype(bool), none) for _ in queries.names]  # score, null, id
        self.visits = 0

    def show(self, rows: list[tuple]) -> None:
        q = self.queries
        bounds = np.zeros((len(q.names), len(rows)), np.int64)
        spans = np.zeros((len(rows), 2, len(q.terms)), np.int32)
        for b, (m, _, terms, starts, tf, _) in enumerate(rows):
            mine, at = q.found(terms)
            spans[b, :, mine] = np.stack([starts[at], starts[at + 1]], 1)
            top = np.zeros(len(q.terms), np.int64)
            top[mine] = q.weights[mine] * impact(tf[starts[at]], m)  # the highest count comes first
            bounds[:, b] = np.add.reduceat(top[q.place], q.first[:-1])
        impacts: dict[int, np.ndarray] = {}
        for i in range(len(q.names)):
            own = q.place[q.first[i]: q.first[i + 1]]
            for b in np.argsort(-bounds[i], kind="stable"):
                if bounds[i, b] < self.least(i):
                    break
                m, _, _, _, tf, _ = rows[b]
                if b not in impacts:  # once for each count of the row
                    counts, which = np.unique(tf, return_inverse=True)
                    impacts[b] = impact(counts, m)[which]
                self.visit(i, own, rows[b], spans[b], impacts[b])

    def least(self, i: int) -> int:
        """Least score that can still be among the best of query ``i``."""
        score = self.best[i][0]
        return max(1, int(score[-1])) if len(score) == self.k else 1

    def visit(self, i: int, own: np.ndarray, row: tuple, spans: np.ndarray, impacts: np.ndarray) -> None:
        self.visits += 1
        ids, slot = row[1], row[5]
        start, size = spans[0, own], spans[1, own] - spans[0, own]
        at = np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, slot[at], impacts[at] * np.repeat(self.queries.weights[own], size))
        high = np.flatnonzero(total >= self.least(i))
        if len(high) > self.k:
            high = high[total[high] >= np.partition(total[high], -self.k)[-self.k]]
        new = ids.take(pa.array(high))
        null = new.is_null().to_numpy(zero_copy_only=False)
        rows = [np.concatenate(x) for x in zip(self.best[i], (total[high], null, pc.fill_null(new, 0).to_numpy()))]
        by = np.lexsort((rows[2], rows[1], -rows[0]))[: self.k]
        self.best[i] = tuple(x[by] for x in rows)


def _read(batch: pa.RecordBatch) -> list[tuple]:
    ids = batch.column("ids")
    views = [[np.frombuffer(x.as_buffer(), kind) for x in batch.column(c)]
             for c, kind in (("terms", _U), ("starts", np.int32), ("tf", np.int32), ("slot", np.int32))]
    return [(m, ids[i].values, *[v[i] for v in views]) for i, m in enumerate(batch.column("m").to_pylist())]


def _search_block(index: DataFrame, n_docs: int, queries: Queries, k: int) -> DataFrame:
    """item_id, rank, id, score for one block of queries."""
    sc = index.sparkSession.sparkContext
    shared: Broadcast = sc.broadcast(queries)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.terms), np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column("terms"), batch.column("starts")):
                mine, at = shared.value.found(np.frombuffer(terms.as_buffer(), _U))
                total[mine] += np.diff(np.frombuffer(starts.as_buffer(), np.int32))[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    counts = index.select("terms", "starts").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in counts.collect():  # as many as the block has terms
        queries.weights[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    weighed: Broadcast = sc.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(weighed.value, k)
        step = max(1, AT_ONCE // len(weighed.value.terms))
        for batch in batches:
            rows = _read(batch)
            for i in range(0, len(rows), step):
                search.show(rows[i: i + step])
        for i, (score, null, name) in enumerate(search.best):
            n = len(score)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * n, pa.int32()), pa.array([weighed.value.names[i]] * n, pa.int64()), pa.array(name, mask=null), pa.array(score)],
                ["query", "item_id", "id", "score"])

    found = index.mapInArrow(run, "query int, item_id long, id long, score long")
    ranked = first_per_key(found, k, ["query"], [F.col("score").desc(), F.col("id").asc_nulls_last()], "rank")
    return ranked.select("item_id", "rank", "id", "score")


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = FIRST, item_id: str = "item_id", text: str = "text",
           block: int = BLOCK) -> DataFrame:
    """The first ``k`` documents of each of ``items``: item_id, rank, id, score."""
    rows = _documents(items.select(F.col(text).alias("text"), F.col(item_id).cast("long").alias("id")))
    rows = materialize(rows.select("id", "terms"))
    total = rows.agg(F.sum(F.length("terms"))).first()[0] or 0
    blocks = max(1, -(-total // (8 * block)))
    if blocks > 1:
        rows = materialize(rows.withColumn("block", F.pmod(F.xxhash64("id", "terms"), F.lit(blocks))), "block")
    out = []
    for b in range(blocks):
        own = (rows.filter(F.col("block") == b) if blocks > 1 else rows).collect()
        if own:
            queries = Queries([r["id"] for r in own], [np.frombuffer(r["terms"], _U) for r in own])
            out.append(_search_block(index, n_docs, queries, k))
            if blocks > 1:
                out[-1] = materialize(out[-1])
    if not out:
        return index.sparkSession.createDataFrame([], "item_id long, rank int, id long, score long")
    if len(out) == 1:
        return out[0]
    return index.sparkSession.read.schema(out[0].schema).parquet(*sorted({f.rsplit("/", 1)[0] for x in out for f in x.inputFiles()}))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = FIRST, doc_id: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text", shard: int = SHARD, row: int = ROW, block: int = BLOCK) -> DataFrame:
    """The first ``k`` of ``docs`` for each of ``items``: item_id, rank, doc_id, score."""
    index, n_docs = build_index(docs, doc_id, text, shard, row)
    return search(index, n_docs, items, k, item_id, item_text, block).withColumnRenamed("id", "doc_id")
