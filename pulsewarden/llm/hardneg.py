"""Hard negatives for contrastive training, by exact integer inner products.

Scores. A component x is the integer floor(256 * x); a score is the inner product of two rows.
Several candidates are packed into one wide integer for each component (Kronecker
substitution): their components, biased so that none is negative, lie in separate fields. A
multiplication by an anchor's component then multiplies all of them at once, and the sum over
the components holds every candidate's score in its own field, from which the bias is taken
off again. Fields are as wide as the largest possible sum, so scores are exact. Two or more
fields that fit into 53 bits are kept in doubles, whose products of matrices are exact there;
wider ones in Python's integers.

Search. Anchors are dealt into blocks of bounded size, and the rows into parts; each part
meets each block in one group of (block, part), the anchors sorted before the rows, so that a
task holds one block of anchors and streams the rows past it. A task keeps the best few rows of
each anchor only. One pass finds the positives, a second one the negatives in the window of
scores that each positive sets.

Defined results
    Rows with a null label, a null vector, or any null or non-finite component take no part.
    Vectors of different lengths never meet; empty ones score 0 with each other.
    Components are held to 2^61 and scores to the range of a 64-bit integer.
    Null ids: no anchor, last among equal scores; their label stays as it is.
    Repeated rows are rows of their own: a copy of an anchor is another row for it, and an
    anchor too. Empty table: empty result. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pulsewarden.session import drop, materialize

SCALE = 256
#: Positives of an anchor, and negatives of a positive.
POSITIVES, NEGATIVES = 5, 5
#: A negative's score in percent of the positive's, at least.
LEAST_PERCENT = 80

#: Anchors that a task holds, and rows that pass by them in one group.
ANCHORS, ROWS = 1 << 12, 1 << 22
#: Scores computed at once.
AT_ONCE = 1 << 21
#: Candidates packed into one of Python's integers.
FIELDS = 16

_HELD = 2.0**61
_MOST = np.iinfo(np.int64)
ROW = "block int, part int, kind int, rid long, id long, label int"
BEST = "anchor long, slot int, score long, id long, rid long"


def quantised(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -_HELD, _HELD).astype(np.int64)


def field_width(anchors: np.ndarray, most: int) -> int:
    """Bits of a signed sum of an anchor's components by candidates' of up to ``most``."""
    top = max(int(anchors.max(initial=0)), -int(anchors.min(initial=0)))
    return (anchors.shape[1] * top * most).bit_length() + 1


def packed(rows: np.ndarray, width: int, fields: int) -> np.ndarray:
    """``fields`` rows of non-negative integers in each row of the result; doubles or Python's integers."""
    more = -len(rows) % fields
    whole = np.vstack([rows, np.zeros((more, rows.shape[1]), rows.dtype)]) if more else rows
    parts = whole.reshape(-1, fields, rows.shape[1])
    out = parts[:, 0]
    for f in range(1, fields):
        out = out + parts[:, f] * (1 << f * width)
    return out


def unpacked(sums: np.ndarray, width: int, fields: int) -> np.ndarray:
    """The signed number of each field, a column for each candidate."""
    half, mask = 1 << (width - 1), (1 << width) - 1
    lifted = sums + sum(half << f * width for f in range(fields))
    parts = [((lifted >> f * width) & mask) - half for f in range(fields)]
    return np.stack(parts, -1).reshape(len(sums), -1)


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of all anchors (down) and rows (across), within 64 bits."""
    if not anchors.shape[1] or not len(rows):
        return np.zeros((len(anchors), len(rows)), np.int64)
    low = int(rows.min())
    biased = rows - low  # below 2^62
    width = field_width(anchors, int(biased.max()))
    if 2 * width <= 53:
        fields = 53 // width
        sums = np.rint(anchors.astype(np.float64) @ packed(biased.astype(np.float64), width, fields).T).astype(np.int64)
        return unpacked(sums, width, fields)[:, : len(rows)] + low * anchors.sum(1)[:, None]
    whole = anchors.astype(object)
    sums = whole @ packed(biased.astype(object), width, FIELDS).T
    exact = unpacked(sums, width, FIELDS)[:, : len(rows)] + low * whole.sum(1)[:, None]
    return np.clip(exact, int(_MOST.min), int(_MOST.max)).astype(np.int64)


def best_of(slot: np.ndarray, score: np.ndarray, null: np.ndarray, name: np.ndarray, rid: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each slot: high scores first, then small ids, null last."""
    by = np.lexsort((rid, name, null, ~score, slot))  # ~x falls as x rises and never overflows
    s = slot[by]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    rank = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    return by[rank < k]


class Block:
    """Anchors of one vector length, and the best rows found for each of their slots.

    A slot is a window of scores: ``low`` and ``high`` (anchors by slots).
    """

    def __init__(self, vectors: np.ndarray, rid: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray,
                 same: bool, k: int):
        self.vectors, self.rid, self.label, self.low, self.high, self.same, self.k = vectors, rid, label, low, high, same, k
        self.floor = low.copy()
        none = np.zeros(0, np.int64)
        self.held = [none, none, none.astype(bool), none, none]  # slot, score, null, id, rid

    def meet(self, vectors: np.ndarray, rid: np.ndarray, null: np.ndarray, name: np.ndarray, label: np.ndarray) -> None:
        slots, step = self.low.shape[1], max(1, AT_ONCE // max(1, len(rid)))
        found = [[x] for x in self.held]
        for i in range(0, len(self.rid), step):
            score = products(self.vectors[i: i + step], vectors)
            alike = self.label[i: i + step, None] == label[None, :]
            right = alike & (self.rid[i: i + step, None] != rid[None, :]) if self.same else ~alike
            for j in range(slots):
                inside = right & (score >= self.floor[i: i + step, j, None]) & (score <= self.high[i: i + step, j, None])
                a, r = np.nonzero(inside)
                for x, new in zip(found, ((a + i) * slots + j, score[a, r], null[r], name[r], rid[r])):
                    x.append(new)
        rows = [np.concatenate(x) for x in found]
        keep = best_of(*rows, self.k)
        self.held = [x[keep] for x in rows]
        # what a full slot holds last is the least that can still get in
        slot, n = np.unique(self.held[0], return_counts=True)
        last = np.cumsum(n) - 1
        full = n == self.k
        self.floor.ravel()[slot[full]] = self.held[1][last[full]]

    def rows(self) -> pa.RecordBatch:
        slot, score, null, name, rid = self.held
        n = self.low.shape[1]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.rid[slot // n]), pa.array((slot % n).astype(np.int32)), pa.array(score),
             pa.array(name, mask=null), pa.array(rid)], ["anchor", "slot", "score", "id", "rid"])


def window(score: np.ndarray, percent: int) -> np.ndarray:
    """Least n with 100 * n >= percent * score, without leaving 64 bits."""
    q, r = np.divmod(score, 100)
    return percent * q + -(-percent * r // 100)


def search(rows: DataFrame, anchors: DataFrame, same: bool, k: int, percent: int, blocks: int, parts: int) -> DataFrame:
    """The first ``k`` rows for each slot of each anchor, at most once for each part of the rows.

    ``rows``: rid, id, label, v. ``anchors``: the same and ``positives`` (scores; null: one
    slot without bounds). ``same``: rows of the anchor's label, not itself; else of others.
    """
    rids = F.col("rid")
    asked = anchors.withColumns({
        "block": F.pmod(F.xxhash64(rids), F.lit(blocks)).cast("int"), "kind": F.lit(0),
        "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    passing = rows.withColumns({
        "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "kind": F.lit(1),
        "part": F.pmod(F.xxhash64(rids, F.lit(1)), F.lit(parts)).cast("int"),
        "positives": F.lit(None).cast("array<long>")})
    columns = ["block", "part", "kind", "rid", "id", "label", "v", "positives"]
    dealt = asked.select(columns).unionByName(passing.select(columns)).repartition(blocks * parts, "block", "part")

    def bounds(positives: list[list[int] | None]) -> tuple[np.ndarray, np.ndarray]:
        if same:
            return tuple(np.full((len(positives), 1), x) for x in (_MOST.min, _MOST.max))
        n = max([1, *map(len, positives)])
        high = np.full((len(positives), n), _MOST.min)
        low = np.full((len(positives), n), _MOST.max)  # no row fits a slot without a positive
        for i, p in enumerate(positives):
            high[i, : len(p)] = p
            low[i, : len(p)] = window(np.array(p, np.int64), percent)
        return low, high

    def groups(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, int], pa.RecordBatch]]:
        key = np.stack([batch.column(c).to_numpy() for c in ("block", "part", "kind")])
        cuts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))
        for i, j in zip(cuts, np.append(cuts[1:], batch.num_rows)):
            yield tuple(int(x) for x in key[:, i]), batch.slice(i, j - i)

    def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        v = batch.column("v")
        size = pc.list_value_length(v).to_numpy(zero_copy_only=False)
        flat, ends = quantised(v.flatten().to_numpy(zero_copy_only=False)), np.cumsum(size)
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            yield int(n), at, flat[(ends[at] - n)[:, None] + np.arange(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, held = None, [], None
        for batch in batches:
            for (block, part, kind), rows in groups(batch):
                if (block, part) != now:
                    yield from (b.rows() for b in (held or {}).values())
                    now, waiting, held = (block, part), [], None
                if kind == 0:
                    waiting.append(rows)
                    continue
                if held is None:
                    held = {}
                    if waiting:
                        table = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                        for n, at, vectors in by_length(table):
                            low, high = bounds([table.column("positives")[int(i)].as_py() for i in at])
                            held[n] = Block(vectors, table.column("rid").to_numpy()[at], table.column("label").to_numpy()[at],
                                            low, high, same, k)
                name = rows.column("id")
                null = name.is_null().to_numpy(zero_copy_only=False)
                name = pc.fill_null(name, 0).to_numpy()
                rid, label = rows.column("rid").to_numpy(), rows.column("label").to_numpy()
                for n, at, vectors in by_length(rows):
                    if n in held:
                        held[n].meet(vectors, rid[at], null[at], name[at], label[at])
        yield from (b.rows() for b in (held or {}).values())

    return dealt.sortWithinPartitions("block", "part", "kind").mapInArrow(run, BEST)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "rid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         percent: int = LEAST_PERCENT, vec_id: str = "vec_id", embedding: str = "embedding", label: str | Column = "label",
         anchors: int = ANCHORS, rows: int = ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``vec_id``. Positives are the best rows of the anchor's
    label; a positive's negatives are the best rows of other labels that score at least
    ``percent`` of it and no more than it.
    """
    v = F.col(embedding) if dict(vectors.dtypes)[embedding] == "array<float>" else F.col(embedding).cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = materialize(
        vectors.select(F.col(vec_id).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("int").alias("label"),
                       v.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
        .filter("label IS NOT NULL AND v IS NOT NULL").filter(~odd)
        .withColumn("rid", F.monotonically_increasing_id()))
    n, m = kept.agg(F.count("*"), F.count_if("asks")).first()
    blocks = max(1, -(-m // anchors))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-4 * cores // blocks), -(-n // rows))  # enough tasks, and rows of a group bounded
    every = kept.select("rid", "id", "label", "v")
    asking = kept.filter("asks").select("rid", "id", "label", "v")
    unbounded = asking.withColumn("positives", F.lit(None).cast("array<long>"))
    best = materialize(_ranked(search(every, unbounded, True, positives, percent, blocks, parts), positives))
    scores = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    bounded = asking.join(scores, F.col("rid") == F.col("anchor")).select(
        "rid", "id", "label", "v", F.col("p.score").alias("positives"))
    found = materialize(_ranked(search(every, bounded, False, negatives, percent, blocks, parts), negatives))
    names = asking.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs = best.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"),
                        F.col("score").alias("positive_score"))
    return (
        found.join(pairs, ["anchor", "slot"]).join(names, "anchor")
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                F.col("score").alias("negative_score"))
    )
