"""MinHash near-duplicates by SetSketch registers, and groups of linked documents.

A document is the set of its word n-grams (tokens). Two link if their sets' Jaccard
similarity reaches a threshold t. Documents with equal sets are one class; everything below
is about classes.

Sketch. A register keeps the least of exponentially distributed hashes x of the set's tokens,
as its truncated logarithm floor(1 - log_b(x)) within 0 … q + 1 (Ertl, 2021). The larger the
set, the larger its registers: the sketch of a union is the larger of both in each register,
so sketches merge (``merge``). Registers of two sets are equal with a probability of t or a
little more, so they serve as signatures too.

Candidates. ``ROWS`` registers make a band, and sets that agree in a band have a common key.
Two sets at t = 0.8 have none with a probability of (1 - t^4)^32 = 5 * 10^-8. Whether two sets
of a key may link is judged by all registers jointly: how many are larger in the one, larger
in the other, and equal, has a likelihood for each Jaccard similarity, as the sizes are known.
A pair stays unless some similarity below t is e^16 times as likely as t or more: a linked
pair goes with a probability below 10^-7.

Stars. The sets of a key are tried with its first set, the centre. Those that may not link
with it, but may with others of the key, are looked at once more, in blocks of bounded size
against blocks, and get stars of their own. Keys of the same sets are looked at once.

Verification. Every set of a star is compared with its centre, and those that don't link
with it with all others of their star, on the full sets, as in the token-prefix join, whose
steps from here on are used. So links are exact, and no list of pairs within a group is made.

Defined results
    null text, or one without words: empty set, linked with nothing, a group of its own.
    Texts under ``words`` words: the whole sequence is the one token.
    Repeated rows and copies: equal sets, hence one group. Empty table: empty result.
    Null ids come after all others when the smallest of a group is sought; a group without
    an id has null, and its documents are kept.
    Other columns are kept; those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsewarden.llm.ngramjoin import CENTRES, compare_with_centre, components, link_blocks, meet, members_and_centres, parts_of, shingles
from pulsewarden.llm.rows import maybe_in, with_rid
from pulsewarden.llm.tokens import groups, mix, pair, utf8
from pulsewarden.session import drop, materialize

WORDS, PERCENT = 4, 80

#: Registers, and those that make a band.
REGISTERS, ROWS = 128, 4
#: Base of the logarithm, rate of the hashes, and the largest register: 16 bits each.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Logarithm of a ratio of likelihoods up to which a pair stays.
SLACK = 16.0

#: Sets of a key that are compared by sketch at once, and sets of a star in full.
COVER, BLOCK = 512, 1024
#: Sets of a star that meet one copy of its centre.
SPLIT = 512

_U = np.uint64
_SEEDS = mix(np.arange(1, 2 * REGISTERS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


def token_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens in order, and where each text's begin. Tokens are positive as longs."""
    doc, token = shingles(data, offsets, n)
    token = token >> _U(1)
    by = np.lexsort((token, doc))
    doc, token = doc[by], token[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    return token[new], np.searchsorted(doc[new], np.arange(len(offsets)))


def registers(token: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The sketch of each set; that of an empty one is all 0."""
    size = np.diff(cuts)
    some = np.flatnonzero(size)
    out = np.zeros((len(size), REGISTERS), np.uint16)
    if not len(some):
        return out
    least = np.empty((len(some), REGISTERS), _U)
    for i in range(REGISTERS):
        least[:, i] = np.minimum.reduceat(token * (_SEEDS[2 * i] | _U(1)) + _SEEDS[2 * i + 1], cuts[some])
    # the least of uniform hashes, as the least of exponential ones
    with np.errstate(divide="ignore"):
        x = -np.log1p(-(least + 0.5) / 2.0**64) / RATE
        out[some] = np.clip(np.floor(1.0 - np.log(x) / np.log(BASE)), 0, TOP)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A number for the registers of each band of each sketch."""
    bands = np.ascontiguousarray(sketch).view(_U).reshape(len(sketch), -1)
    return pair(bands, np.broadcast_to(np.arange(bands.shape[1], dtype=_U), bands.shape).copy()).view(np.int64)


def _share(x: np.ndarray) -> np.ndarray:
    """Probability that a register is larger in a set that has a share ``x`` of tokens to itself."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(j: np.ndarray, above: np.ndarray, below: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of a Jaccard similarity ``j``, with shares u + v = 1 of the sizes, and registers above and below."""
    p, q = _share(u - v * j), _share(v - u * j)
    tiny = 1e-300
    same = REGISTERS - above - below
    return above * np.log(np.maximum(p, tiny)) + below * np.log(np.maximum(q, tiny)) + same * np.log(np.maximum(1 - p - q, tiny))


def estimate(above: np.ndarray, below: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The most likely Jaccard similarity of sets of ``n`` and ``m`` tokens; the likelihood has one peak."""
    u, v = n / (n + m), m / (n + m)
    low, high = np.zeros(np.broadcast(above, u).shape), np.broadcast_to(np.minimum(u / v, v / u), np.broadcast(above, u).shape).copy()
    for _ in range(28):
        third = (high - low) / 3
        a, b = low + third, high - third
        up = log_likelihood(a, above, below, u, v) < log_likelihood(b, above, below, u, v)
        low, high = np.where(up, a, low), np.where(up, high, b)
    return (low + high) / 2


def may_link(above: np.ndarray, below: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int, slack: float = SLACK) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` tokens are not too unlikely to reach the threshold."""
    above, below, n, m = np.broadcast_arrays(above, below, n, m)
    fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    out = np.zeros(n.shape, bool)
    a, b, n, m = (x[fits].astype(float) for x in (above, below, n, m))
    t, u, v = percent / 100, n / (n + m), m / (n + m)
    best = estimate(a, b, n, m)
    out[fits] = (best >= t) | (log_likelihood(best, a, b, u, v) - log_likelihood(t, a, b, u, v) <= slack)
    return out


def moved(wide: DataFrame, narrow: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by key at every size: small tables are not broadcast, so a larger input has the same plan."""
    return wide.join(narrow.hint("merge"), on, how)


def set_table(docs: DataFrame, n: int) -> DataFrame:
    """rid, size, name (128 bits) and sketch of each text of ``docs`` (text, rid)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in groups(data, offsets):
                base = offsets[i]
                token, cuts = token_sets(data[base: offsets[j]], offsets[i: j + 1] - base, n)
                size = np.diff(cuts)
                names = []
                for salt in (0, 0x5DEECE66D):
                    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(token ^ _U(salt)), dtype=_U)])
                    names.append((sums[cuts[1:]] - sums[cuts[:-1]]).view(np.int64))
                sketch = registers(token, cuts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(i, j - i), pa.array(size.astype(np.int64)), *map(pa.array, names),
                     pa.array([x.tobytes() for x in sketch], pa.binary())], ["rid", "size", "a", "b", "sketch"])

    return docs.select("text", "rid").mapInArrow(run, "rid long, size long, a long, b long, sketch binary")


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def key_rows(sets: DataFrame) -> DataFrame:
    """class and key, one for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(_sketches(batch.column(1)))
            name = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(keys.ravel())], ["class", "key"])

    return sets.select("class", "sketch").mapInArrow(run, "class long, key long")


def tried_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """centre, class and ``may`` (link) of pairs with size and sketch of both (``c_…`` the centre's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _sketches(batch.column("sketch")), _sketches(batch.column("c_sketch"))
            may = may_link((x > y).sum(1), (x < y).sum(1), batch.column("size").to_numpy(), batch.column("c_size").to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column("centre"), batch.column("class"), pa.array(may)], ["centre", "class", "may"])

    return pairs.mapInArrow(run, "centre long, class long, may boolean")


def cover(name: np.ndarray, may: np.ndarray) -> list[tuple[int, int]]:
    """Centre and member of stars that hold every pair of ``may``: most partners first."""
    out, left = [], may.copy()
    while True:
        partners = left.sum(1)
        own = int(partners.argmax()) if len(partners) else 0
        if not len(partners) or not partners[own]:
            return out
        star = np.flatnonzero(left[own])
        out += [(int(name[own]), int(name[k])) for k in star]
        whole = np.append(star, own)
        left[np.ix_(whole, whole)] = False


def cover_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """centre and class of stars for sets of a key that may link, one of them not ``tied`` to the centre.

    ``rows``: key, class, tied, size, sketch, own block, and the blocks a and b that meet.
    """

    def run(table: pa.Table) -> pa.Table:
        name, size, own = (table[c].to_numpy() for c in ("class", "size", "own"))
        free = ~table["tied"].to_numpy(zero_copy_only=False).astype(bool)
        sketch = _sketches(table["sketch"])
        above = np.zeros((len(name), len(name)), np.int16)
        for i in range(REGISTERS):
            above += sketch[:, i, None] > sketch[None, :, i]
        may = free[:, None] | free[None, :]
        a, b = table["a"][0].as_py(), table["b"][0].as_py()
        if a != b:  # pairs within a block meet where the block meets itself
            may &= own[:, None] != own[None, :]
        np.fill_diagonal(may, False)
        x, y = np.nonzero(np.triu(may))
        fits = may_link(above[x, y].astype(np.int64), above[y, x].astype(np.int64), size[x], size[y], percent)
        may[:] = False
        may[x[fits], y[fits]] = may[y[fits], x[fits]] = True
        found = cover(name, may)
        return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["centre", "class"])

    return rows.groupBy("key", "a", "b").applyInArrow(run, "centre long, class long")


def stars(sets: DataFrame, percent: int, block: int = COVER) -> DataFrame:
    """Distinct centre and class: any two classes with a common key that may link are in one star.

    Each centre is in its star as well. ``sets``: class, size, sketch.
    """
    keys = key_rows(sets)
    shared = materialize(keys.groupBy("key").agg(F.min("class").alias("centre"), F.max("class").alias("last")).filter(
        "centre < last").select("key", "centre"))
    rows = materialize(maybe_in(keys, shared.select("key"), "key").join(shared, "key"))
    # keys of the same sets are one
    members = rows.groupBy("key", "centre").agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64("class", F.lit(k))).alias(f"x{k}") for k in (1, 2)])
    one = materialize(members.groupBy("centre", "n", "x1", "x2").agg(F.min("key").alias("key")).select("key", "n"))
    drop(shared)
    rows, every = materialize(rows.join(one, "key")), rows
    drop(every, one)
    # only sets that share a key are looked at from here on
    sets = materialize(moved(maybe_in(sets, rows.select("class"), "class"), rows.select("class").distinct(), "class", "left_semi"))
    of_centre = sets.select(F.col("class").alias("centre"), F.col("size").alias("c_size"), F.col("sketch").alias("c_sketch"))
    pairs = moved(moved(rows.filter("class <> centre").select("centre", "class").distinct(), sets, "class"), of_centre, "centre")
    tried = materialize(tried_pairs(pairs, percent))
    # keys of three and more where some set may not link with the centre
    left = rows.filter("n > 2 AND class <> centre").select("key", "class", "centre").join(tried, ["centre", "class"])
    again = meet(left.select("key", "class", F.col("may").alias("tied")), "key", "tied", block)
    found = cover_blocks(moved(again, sets, "class"), percent)
    star = materialize(tried.filter("may").select("centre", "class").unionByName(found).distinct())
    drop(rows, tried, sets)
    return star.unionByName(star.select("centre", F.col("centre").alias("class"))).distinct()


def _tokens(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """class, centres and tokens of the texts named by ``wanted`` (class, centres); a class is its first rid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in groups(data, offsets):
                base = offsets[i]
                token, cuts = token_sets(data[base: offsets[j]], offsets[i: j + 1] - base, n)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).slice(i, j - i) for k in (1, 2)],
                     pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(token.view(np.int64)))], ["class", "centres", "tokens"])

    near = maybe_in(docs, wanted.select("class"), "rid")  # most texts need not move
    rows = moved(near.withColumnRenamed("rid", "class"), wanted, "class").select("text", "class", "centres")
    return rows.mapInArrow(run, f"class long, centres {CENTRES}, tokens array<long>")


def linked_classes(docs: DataFrame, sets: DataFrame, n: int, percent: int, block: int = BLOCK, cover: int = COVER,
                   split: int = SPLIT) -> DataFrame:
    """class and root of all classes that link with another. ``sets``: class, size, sketch."""
    star = materialize(stars(sets, percent, cover))
    wanted = materialize(parts_of(star, split))
    tokens = materialize(_tokens(docs, wanted, n))
    compared = materialize(compare_with_centre(*members_and_centres(tokens), percent, ["centre", "part"]))
    drop(star, tokens)
    more = link_blocks(meet(compared, "centre", "linked", block), percent)
    links = compared.filter("linked AND class <> centre").select(F.col("centre").alias("x"), F.col("class").alias("y"))
    return components(materialize(links.unionByName(more)))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id",
                    text: str = "text", **limits: int) -> DataFrame:
    """``docs`` without its text, with n_shingles, component_id (the smallest id of the group) and kept (its document)."""
    rows = with_rid(docs.drop("n_shingles", "component_id", "kept", "rid"))
    slim = rows.select(F.col(text).alias("text"), "rid")
    every = materialize(set_table(slim, words))
    # a class goes by the first row that has its set
    names = every.filter("size > 0").groupBy("a", "b", "size").agg(F.min("rid").alias("class"))
    named = materialize(every.select("rid", "size", "a", "b").join(names, ["a", "b", "size"], "left").select("rid", "size", "class"))
    firsts = named.filter("rid = class").select("class")
    sets = materialize(moved(every.select(F.col("rid").alias("class"), "size", "sketch"), firsts, "class", "left_semi"))
    drop(every)
    root = linked_classes(slim, sets, words, percent, **limits)
    grouped = named.join(root, "class", "left").select(
        "rid", F.col("size").alias("n_shingles"), F.coalesce("root", "class").alias("group"))  # an empty set has none
    own = materialize(rows.select("rid", F.col(doc_id).alias("_id")).join(grouped, "rid"))
    drop(named, sets)
    least = own.filter("group IS NOT NULL").groupBy("group").agg(F.min("_id").alias("_least"))
    found = own.join(least, "group", "left").select(
        "rid", "n_shingles", F.when(F.col("group").isNull(), F.col("_id")).otherwise(F.col("_least")).alias("component_id"))
    out = rows.drop(text).join(found, "rid")
    return out.withColumn("kept", F.col(doc_id).eqNullSafe(F.col("component_id"))).drop("rid")
