"""Suffix-array dedup: repeated byte strings by bucket-pointer refinement of sampled suffixes.

Every byte covered by a string of ``length`` bytes that also starts anywhere else is removed.

Suffixes are put into buckets by their first q bytes, and buckets are refined by sorting on
the bucket identifiers of later offsets: two suffixes that agree on q bytes, and whose
suffixes q bytes later agree on q bytes, agree on 2q bytes. Identifiers are hashes of
content, so that a refinement (8, 16, 32, 64, 128 bytes, the updated identifiers reused
each time) needs nothing but the text, and a bucket is met by grouping on its identifier.

Which suffixes: of the starts in each string of ``length`` bytes, only the one with the
smallest 64-byte identifier (the first, if equal) is a sample. Equal strings have it at the
same place, so a string is repeated only if its sample's bucket is. A sample stands for a
run of strings, one after the other, whose sample it is; a text has one for some 70 bytes.

1. Samples are grouped by bucket (64 bytes) and by the identifier of all that their run
   covers, up to twice ``length``. A bucket of one sample is done: nothing in it repeats.
   Equal covers are done as well: all their strings repeat.
2. What is left are buckets with different covers: the edges of repeated passages. Only
   their samples are refined to single strings, one sample for each cover. Strings that
   meet again in their bucket repeat.

Both steps count keys where they lie before anything is shuffled, so a passage in a third
of all documents is a few rows from each task. Keys are two identifiers, 128 or 96 bits.
Documents are cut at the end, and only their runs meet them.

Defined results
    null text: as empty. Texts under ``length`` bytes: nothing removed.
    Repeated rows: copies of ``length`` bytes or more lose everything, all of them.
    Empty table: empty result. Other columns are kept; those named like a result column
    are replaced.
The rows of ``docs`` must come in the same order when read again, as a table's do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from pulsewarden.llm.tokens import groups, mix, utf8
from pulsewarden.session import drop, materialize

LENGTH = 200
#: Bytes of a sample's bucket.
Q = 64
#: Starts looked at together.
PIECE = 1 << 16
#: Parts, by their identifiers, in which strings are counted one after the other: all of
#: them, but what is shuffled for a part is gone before the next.
PARTS = 2

_U = np.uint64


def refine(ids: np.ndarray, step: int) -> np.ndarray:
    """Identifiers of strings from those of their first part and of the part ``step`` bytes later."""
    x = ids[:-step] * _U(0x9E3779B97F4A7C15)
    x += ids[step:]
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    return x


def first_ids(data: np.ndarray) -> np.ndarray:
    """Identifier of the eight bytes from each byte on."""
    n = len(data) - 7
    if n <= 0:
        return np.zeros(0, _U)
    out = np.empty(n, _U)
    for k in range(min(8, n)):
        m = (n - k + 7) // 8
        out[k::8] = np.frombuffer(data[k: k + 8 * m].tobytes(), _U)
    return mix(out)


def buckets(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the Q bytes, and of the ``length`` bytes, from each byte on."""
    ids, size, at_q = first_ids(data), 8, None
    while True:
        if size == Q:
            at_q = ids
        if 2 * size > length:
            break
        if len(ids) <= size:
            return np.zeros(0, _U), np.zeros(0, _U)
        ids = refine(ids, size)
        size *= 2
    rest = length - size
    whole = refine(ids, rest) if rest and len(ids) > rest else ids if not rest else ids[:0]
    return at_q, whole


def samples(at_q: np.ndarray, whole: np.ndarray, valid: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of strings with one sample: first and last string, bucket, cover. ``valid``: strings that count."""
    n = len(whole)
    span = length - Q + 1  # starts in a string
    low = _U((1 << 20) - 1)
    packed = (at_q[: n + span - 1] & ~low) | np.arange(n + span - 1, dtype=_U)
    size = 1
    while 2 * size <= span:
        packed = np.minimum(packed[:-size], packed[size:])
        size *= 2
    if span > size:
        packed = np.minimum(packed[: len(packed) - (span - size)], packed[span - size:])
    sample = np.where(valid, (packed & low).astype(np.int64), -1)
    first = np.flatnonzero(np.concatenate([[True], sample[1:] != sample[:-1]]))
    last = np.append(first[1:], n) - 1
    real = sample[first] >= 0
    first, last = first[real], last[real]
    at = sample[first]
    cover = mix(whole[first] + mix(whole[last] + (last - first).astype(_U) * _U(0x632BE59BD9B4E019))
                + (at - first).astype(_U) * _U(0xB5297A4D3F84D5A3))
    return first, last, mix(at_q[at]), cover


def pieces(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """Texts, and parts of long ones: text, place of its part, identifiers, and which strings count.

    Per string: the text it lies in, its place there, and whether it fits.
    """
    for i, j in groups(data, offsets, PIECE):
        a, b = offsets[i], offsets[j]
        if b - a < length:
            continue
        for s in range(a, b - length + 1, PIECE):
            e = min(b, s + PIECE + length - 1)
            at_q, whole = buckets(data[s:e], length)
            starts = np.arange(s, s + len(whole))
            text = np.searchsorted(offsets, starts, "right") - 1
            yield text, starts - offsets[text], at_q, whole, starts + length <= offsets[text + 1]


RUN = "rid long, lo int, hi int, bucket long, cover long"


def sample_table(docs: DataFrame, length: int) -> DataFrame:
    """The samples of ``docs`` (text, rid): text, first and last string, bucket and cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            rid = batch.column(1).to_numpy()
            out = []
            for text, place, at_q, whole, valid in pieces(data, offsets, length):
                first, last, bucket, cover = samples(at_q, whole, valid, length)
                out.append((rid[text[first]], place[first].astype(np.int32), place[last].astype(np.int32),
                            bucket.view(np.int64), cover.view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*out)], ["rid", "lo", "hi", "bucket", "cover"])

    return docs.mapInArrow(run, RUN)


def _edges(docs: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """Every string of the runs in ``edges`` (rid, lo, hi, bucket): rid, at, string, and half of the bucket.

    A string's bucket follows from it, so half of the bucket's bits are enough to tell
    apart strings with one identifier: 96 bits in all.
    """
    wanted = edges.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "bucket"))).alias("runs"))
    rows = docs.join(wanted, "rid").select("text", "rid", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            rid, runs = batch.column(1).to_numpy(), batch.column(2)
            for t in range(batch.num_rows):
                flat = runs[t].values
                lo, hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
                bucket = flat.field("bucket").to_numpy()
                # runs that lie near each other share the work of naming their strings
                far = np.flatnonzero((lo[1:] > hi[:-1] + length) | (lo[1:] // PIECE != lo[:-1] // PIECE)) + 1
                for i, j in zip(np.append(0, far), np.append(far, len(lo))):
                    a, b = int(lo[i]), int(hi[i:j].max())
                    start = int(offsets[t])
                    _, whole = buckets(data[start + a: start + b + length], length)
                    n = hi[i:j] - lo[i:j] + 1
                    at = np.repeat(lo[i:j] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), rid[t])), pa.array(at.astype(np.int32)), pa.array(np.repeat((bucket[i:j] >> 32).astype(np.int32), n)),
                         pa.array(whole[at - a].view(np.int64))], ["rid", "at", "bucket", "string"])

    return rows.mapInArrow(run, "rid long, at int, bucket int, string long")


def repeated_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Maximal runs of repeated bytes of ``docs`` (text, rid): rid, runs array<struct<a,b>>, b exclusive."""
    found = materialize(sample_table(docs, length))
    covers = materialize(found.groupBy("bucket", "cover").agg(
        F.count("*").alias("n"), F.min(F.struct("rid", "lo", "hi")).alias("one")))
    whole = found.join(covers.filter("n > 1").select("bucket", "cover"), ["bucket", "cover"]).select(
        "rid", F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))
    whole = materialize(whole)
    mixed = covers.groupBy("bucket").agg(F.count("*").alias("covers")).filter("covers > 1").select("bucket")
    edges = materialize(covers.join(mixed, "bucket").select(
        "bucket", "one.rid", "one.lo", "one.hi", (F.col("n") > 1).alias("done")))
    drop(found, covers)
    strings = materialize(_edges(docs, edges.select("rid", "lo", "hi", "bucket"), length))
    spans = []
    for part in range(PARTS):
        own = strings.filter(F.pmod("string", F.lit(PARTS)) == part)
        again = own.groupBy("bucket", "string").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        spans.append(materialize(own.join(again, ["bucket", "string"]).select(
            "rid", F.col("at").alias("a"), (F.col("at") + length).alias("b"))))
    drop(strings)
    w = Window.partitionBy("rid").orderBy("a", "b")
    new = F.coalesce(F.col("a") > F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    every = whole
    for part in spans:
        every = every.unionByName(part)
    runs = (
        every.withColumn("_new", new.cast("int"))
        .withColumn("_run", F.sum("_new").over(w))
        .groupBy("rid", "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
        .groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))
    )
    runs = materialize(runs)
    drop(whole, *spans, edges)
    return runs


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes as ``kept``.

    The kept bytes need not be UTF-8: a run may begin inside a character.
    """
    results = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "rid", "runs")
    rows = docs.drop(*results).withColumn("rid", F.monotonically_increasing_id())
    runs = repeated_runs(rows.select(F.col(text).alias("text"), "rid"), length)
    both = rows.join(runs, "rid", "left")
    names = [c for c in both.columns if c not in ("rid", "runs")]
    at, spans = both.columns.index(text), both.columns.index("runs")
    picked = [both.columns.index(c) for c in names]
    schema = T.StructType([*[both.schema[c] for c in names], *[T.StructField(c, T.LongType()) for c in results[:3]],
                           T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            data, offsets = utf8(batch.column(at))
            for t in range(batch.num_rows):
                raw = data[offsets[t]: offsets[t + 1]].tobytes()
                cut = batch.column(spans)[t].values
                if cut is None:
                    out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw))
                    continue
                a, b = cut.field("a").to_pylist(), cut.field("b").to_pylist()
                kept = b"".join(raw[x:y] for x, y in zip([0, *b], [*a, len(raw)]))
                out.append((len(raw), len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in picked], *columns], schema.names)

    return both.mapInArrow(run, schema)
