"""N-gram Jaccard join: token-combination prefixes, and groups of linked documents.

A document is the set of its word n-grams (tokens). Two link if their sets' Jaccard
similarity reaches a threshold t. Documents with equal sets (by 128 bits) are one class, that
goes by its first row; everything below is about classes.

Prefixes. Tokens are put in one order for all, rare before frequent. If two sets of sizes
up to n link, they share at least t * n tokens, hence the first k of the shared ones lie
among the first n - ceil(t * n) + k of each. The order needs no exact counts, only to be
the same everywhere: it takes the doublings of a table of 2^20 counts, over all documents,
that tokens fall into by hash.

Index. Two sets that link differ in d tokens at most, of both together. Cut the smaller one's
first g * (d + 1) tokens into runs of g: each token that only one set has breaks one run at most,
so some run is whole, and its tokens are neighbours in the other set as well, at most d places
later. So combinations of g neighbouring tokens of a prefix are indexed, g + 1 for each token that
may differ: their number follows the text, and sets that don't link seldom have one in common,
however many texts there are. g is ``RUN``, or less for sets too small to hold the runs.

Where not even pairs fit (thresholds of two thirds and less), tokens that lie in few prefixes are
indexed alone. For frequent ones the prefix is
long enough for k = 2 shared tokens, and pairs of them are indexed: of two sets that link,
the first two shared tokens are either both frequent, a common pair, or one is rare, a
common token. The number of pairs of a set is bounded by indexing long sets by single
tokens, with an overlap of lengths, so that any two that may link meet either way.

Stars. The sets of a key are covered by stars, a centre and others, so that any two that may
link are in one star. Whether they may is said by their prefixes alone: up to the smaller
of their last tokens both are known, so the shared tokens so far, and the shorter of the
rests, bound what they share. Most keys hold two sets that can't link, and end here. First
the set with the smallest id is tried as the centre. Those that can't link with it, but may
with others of the key, get a star of their own or join this one all the same; for that they
are dealt by size, as sets that link lie in the same class of sizes or in neighbouring ones.

Verification. Each set of a star is compared with its centre. What it shares is kept as bits
over the centre's tokens, what else it has as a list, so that any two sets of a star can
be compared exactly from these. Those that link with the centre are one group. Only the
others need more: they are compared with all others of their star, in blocks of bounded
size against blocks, and links that join two groups are all that is emitted. So no link
between groups is lost, and no list of pairs within a group is ever made.

Defined results
    null text, or one without words: empty set, linked with nothing, a group of its own.
    Texts under ``words`` words: the whole sequence is the one token.
    Repeated rows and copies: equal sets, hence one group. Empty table: empty result.
    Null ids come after all others when the smallest of a group is sought.
    Other columns are kept; those named like a result column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from pulsewarden.llm.rows import maybe_in, only_in, with_rid
from pulsewarden.llm.tokens import groups, hashes, mix, ngram_hashes, pair, utf8, words
from pulsewarden.session import drop, materialize

WORDS, PERCENT = 3, 90

#: Neighbouring tokens that are indexed together.
RUN = 3
#: Tokens in more prefixes than this are frequent.
FREQUENT = 256
#: Prefix length up to which pairs of frequent tokens are indexed: 2 080 pairs.
PAIRED = 65
#: Sets in a block that is compared with another.
BLOCK = 1024
#: Sets of a star that meet one copy of its centre.
SPLIT = 512
#: Sets of a key that are covered by stars at once, and of all keys of a centre. Rows of the table of any two of them at once.
COVER, SETS, ROWS = 1024, 2048, 256
#: Rows of sets and keys of a centre that are covered by one task.
MEET = 1 << 18
#: Tokens that a product of sets by tokens is formed over at once.
WIDE = 1 << 13
#: Keys of runs that a task packs at once, and tokens for each shard that they are dealt to.
PACKED, SHARD = 1 << 19, 1 << 20
#: Numbers of sketches in a shard of centres, on average; a row of a key counts as eight.
HELD = 1 << 22

#: Slots that tokens are counted in, and those sent as one row.
SLOT_BITS, ROW_BITS = 20, 14

_U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All tokens and their texts, repeats included, in order of texts."""
    w = words(data, offsets)
    h = hashes(data, w)
    token, at = ngram_hashes(h, w, n)
    doc = w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        first, whole = w.first, []
        for t in short:
            x = np.array([w.counts[t]], _U)
            for k in range(first[t], first[t + 1]):
                x = pair(x, h[k: k + 1])
            whole.append(x[0])
        by = np.argsort(np.concatenate([doc, short]), kind="stable")
        doc, token = np.concatenate([doc, short])[by], np.concatenate([token, np.array(whole, _U)])[by]
    return doc, token


def _slot(token: np.ndarray) -> np.ndarray:
    return (token >> _U(64 - SLOT_BITS)).astype(np.int64)


def frequency_classes(docs: DataFrame, n: int) -> np.ndarray:
    """Doublings of the count of each slot, over all of ``docs`` (text): 2^20 small numbers."""
    size = 1 << ROW_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in groups(data, offsets):
                base = offsets[i]
                _, token = shingles(data[base: offsets[j]], offsets[i: j + 1] - base, n)
                total += np.bincount(_slot(token), minlength=len(total))
        used = np.flatnonzero(total.reshape(-1, size).any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)),
             pa.ListArray.from_arrays(np.arange(len(used) + 1, dtype=np.int32) * size, pa.array(total.reshape(-1, size)[used].ravel()))],
            ["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(c.values.to_numpy().reshape(-1, size).sum(0) for c in
                    (x for b in table.to_batches() for x in [b["counts"].slice(0)]) if len(c))
        classes = np.minimum(np.ceil(np.log2(total + 1)), 31).astype(np.int8)  # tokens stay positive longs
        return pa.table([table["part"][:1], pa.array([classes.tobytes()], pa.binary())], ["part", "classes"])

    out = np.zeros(1 << SLOT_BITS, np.int8)
    rows = docs.select("text").mapInArrow(count, "part int, counts array<long>")
    for r in rows.groupBy("part").applyInArrow(add, "part int, classes binary").collect():
        out[r["part"] * size: (r["part"] + 1) * size] = np.frombuffer(r["classes"], np.int8)
    return out


def token_sets(data: np.ndarray, offsets: np.ndarray, n: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens in the common order, and where each text's begin."""
    doc, token = shingles(data, offsets, n)
    token = (classes[_slot(token)].astype(_U) << _U(58)) | (token >> _U(6))
    at = np.searchsorted(doc, np.arange(len(offsets))).tolist()
    for i, j in zip(at, at[1:]):
        token[i:j].sort()
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    return token[new], np.searchsorted(doc[new], np.arange(len(offsets)))


def least_shared(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return (n * percent + 99) // 100


def need(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Shared tokens that two sets of these sizes need."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def differ(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a set of ``n`` and one that links with it and isn't smaller have not in common, at most."""
    return (n + 100 * n // percent) * (100 - percent) // (100 + percent)


def run_reach(n: np.ndarray, g: int, percent: int) -> np.ndarray:
    """Where the runs of ``g`` end, at the latest, by which a set of ``n`` meets smaller and larger ones."""
    out = g * (differ(n, percent) + 1)
    for m in (least_shared(n, percent), n):  # the other is the smaller: the bound is largest at one end of its sizes
        out = np.maximum(out, (n + m) * (g * (100 - percent) - percent) // (100 + percent) + g + n)
    return np.minimum(out, n)


def run_lengths(top: int, percent: int) -> np.ndarray:
    """Whether sets of each size up to ``top`` are indexed by single tokens and pairs (row 0), and by runs of 2, 3 … (row 1, …).

    Two sets meet by the runs that fit the smaller one, so a set takes part for all sizes that it may be linked with.
    """
    n = np.arange(top + 1)
    best = np.zeros(top + 1, int)
    for g in range(2, RUN + 1):
        best[g * (differ(n, percent) + 1) <= n] = g - 1
    low = np.minimum(least_shared(n, percent), n)
    sums = np.concatenate([np.zeros((RUN, 1), int), np.cumsum(best == np.arange(RUN)[:, None], 1)], 1)
    return sums[:, n + 1] > sums[:, low]


def some_by_tokens(percent: int) -> bool:
    """Whether there may be sets that runs don't fit."""
    if 3 * percent <= 200:
        return True
    n = np.arange(1001)
    return bool((run_lengths(1000, percent)[0] & (least_shared(n + 1, percent) <= n) & (n > 0)).any())


def set_table(docs: DataFrame, n: int, percent: int, classes: Broadcast) -> DataFrame:
    """rid, size, name (a, b) and prefix of each text of ``docs`` (text, rid).

    The prefix holds two shared tokens of any two sets that link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in groups(data, offsets):
                base = offsets[i]
                token, cuts = token_sets(data[base: offsets[j]], offsets[i: j + 1] - base, n, classes.value)
                size = np.diff(cuts)
                sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(token), dtype=_U)])
                other = np.concatenate([np.zeros(1, _U), np.cumsum(mix(token ^ _U(0x5DEECE66D)), dtype=_U)])
                names = [x[cuts[1:]] - x[cuts[:-1]] for x in (sums, other)]
                k = np.where(linkable(size, percent), np.minimum(size - least_shared(size, percent) + 2, size), 0)
                ends = np.cumsum(k)
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).slice(i, j - i), pa.array(size.astype(np.int32)), *[pa.array(x.view(np.int64)) for x in names],
                    pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pa.array(token[_firsts(cuts, k, ends)].view(np.int64)))],
                    ["rid", "size", "a", "b", "prefix"])

    return docs.mapInArrow(run, "rid long, size int, a long, b long, prefix array<long>")


def linkable(size: np.ndarray, percent: int) -> np.ndarray:
    """Whether a set may be linked with others than its equals."""
    return (least_shared(size + 1, percent) <= size) & (size > 0)


def _firsts(cuts: np.ndarray, k: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of the first ``k`` tokens of each set. ``ends``: sums of k."""
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(cuts[:-1] - ends + k, k)


def run_keys(docs: DataFrame, n: int, percent: int, classes: Broadcast, shards: int) -> DataFrame:
    """The runs of neighbouring tokens of each text of ``docs`` (text, rid), packed: keys and the classes that have them, by shards.

    They come from the texts: the prefixes they lie in are as large as these, and would have to be written and moved.
    A shard is a range of keys.
    """
    edges = np.array([(k << 64) // shards for k in range(1, shards)], _U)

    def pack(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, name = (np.concatenate(x) for x in zip(*held))
        by = np.argsort(key)
        key, name = key[by], name[by]
        cuts = np.concatenate([[0], np.searchsorted(key, edges), [len(key)]])
        used = np.flatnonzero(np.diff(cuts))
        at = pa.py_buffer((cuts[np.append(used, shards)] * 8).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), *[pa.Array.from_buffers(pa.binary(), len(used), [None, at, pa.py_buffer(x)]) for x in (key, name)]],
            ["shard", "keys", "names"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held = [], 0
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in groups(data, offsets):
                base = offsets[i]
                token, cuts = token_sets(data[base: offsets[j]], offsets[i: j + 1] - base, n, classes.value)
                size, name = np.diff(cuts), batch.column(1).slice(i, j - i).to_numpy()
                uses, h = run_lengths(int(size.max(initial=0)), percent)[:, size] & linkable(size, percent), token
                for g in range(2, RUN + 1):
                    h = pair(h[:-1], token[g - 1:])
                    k = np.where(uses[g - 1], np.maximum(run_reach(size, g, percent) - g + 1, 0), 0)
                    at = _firsts(cuts, k, np.cumsum(k))
                    held.append((mix(h[at] + _U(g)), np.repeat(name, k)))
                    size_held += len(at)
                if size_held >= PACKED:
                    yield pack(held)
                    held, size_held = [], 0
        if size_held:
            yield pack(held)

    return docs.select("text", "rid").mapInArrow(run, "shard int, keys binary, names binary")


def index_keys(docs: DataFrame, sets: DataFrame, n: int, percent: int, classes: Broadcast, frequent: int, paired: int) -> DataFrame:
    """key and class, for keys with more than one class. ``docs``, ``sets``: one row per class."""
    # a set has some three quarters as many keys as tokens at 80 percent, fewer above
    tokens = sets.agg(F.sum("size")).first()[0] or 0
    shards = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens // SHARD))
    runs = with_others(run_keys(docs, n, percent, classes, shards))
    return runs.unionByName(token_keys(sets, percent, frequent, paired)) if some_by_tokens(percent) else runs


def with_others(packed: DataFrame) -> DataFrame:
    """key and class of the rows of ``run_keys`` whose key another row has as well: most keys are of one class and end here."""

    def run(table: pa.Table) -> pa.Table:
        key, name = (np.frombuffer(b"".join(table[c].to_pylist()), np.int64) for c in ("keys", "names"))
        by = np.argsort(key)
        key = key[by]
        same = np.concatenate([[False], key[1:] == key[:-1], [False]])
        pick = np.flatnonzero(same[1:] | same[:-1])
        return pa.table([pa.array(key[pick]), pa.array(name[by[pick]])], ["key", "class"])

    return packed.groupBy("shard").applyInArrow(run, "key long, class long")


def token_keys(sets: DataFrame, percent: int, frequent: int, paired: int) -> DataFrame:
    """key and class of the sets that runs don't fit: rare tokens, and pairs of frequent ones."""
    runs = F.udf(lambda n: bool(run_lengths(n, percent)[0][n]), "boolean")
    sets = sets.filter(runs("size"))
    longest = max(n for n in range(1, 200 * paired) if n - least_shared(n, percent) + 2 <= paired)
    overlap = percent * longest // 100
    index = sets.select("class", "size", F.explode("prefix").alias("token"))
    common = index.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    index = index.join(common, "token").withColumn("frequent", F.col("n") > frequent).drop("n")
    single = index.filter(~F.col("frequent") | (F.col("size") > overlap)).select(
        F.xxhash64("token").alias("key"), "class")
    many = (
        index.filter(F.col("frequent") & (F.col("size") <= longest))
        .groupBy("class").agg(F.sort_array(F.collect_list("token")).alias("t"))
    )
    pairs = F.flatten(F.transform("t", lambda a, i: F.transform(
        F.slice("t", i + 2, F.size("t")), lambda b: F.xxhash64(a, b))))
    return single.unionByName(many.select(F.explode(pairs).alias("key"), "class"))


def sketches(sets: DataFrame) -> DataFrame:
    """class, size, last token and sketch (the upper halves of the tokens) of the prefixes."""
    return sets.select("class", "size", F.element_at("prefix", F.lit(-1)).alias("last"),
                       F.transform("prefix", lambda t: F.shiftright(t, 32).cast("int")).alias("sketch"))


def may_share(both: np.ndarray, size: tuple, last: tuple, length: tuple, below: tuple) -> np.ndarray:
    """Upper bound of the tokens that two sets share.

    ``both``: at least as many as their prefixes share. ``below``: at most as many of each
    prefix as lie before the other's last token; all, if it is the longer.
    """
    known = [np.where(mine <= other, n, m) for mine, other, n, m in zip(last, last[::-1], length, below)]
    return both + np.minimum(size[0] - known[0], size[1] - known[1])


def possible_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """centre, class and ``may`` (link) of pairs with size, last and sketch of both (``c_…`` the centre's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, c_size, last, c_last = (batch.column(c).to_numpy().astype(np.int64) for c in ("size", "c_size", "last", "c_last"))
            both, n, m, below, c_below = np.zeros((5, batch.num_rows), np.int64)
            for i, (x, y) in enumerate(zip(batch.column("sketch"), batch.column("c_sketch"))):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                at = np.searchsorted(y, x)
                both[i] = (y[np.minimum(at, len(y) - 1)] == x).sum()
                n[i], m[i] = len(x), len(y)
                below[i], c_below[i] = np.searchsorted(x, c_last[i] >> 32), np.searchsorted(y, last[i] >> 32)
            bound = may_share(both, (size, c_size), (last, c_last), (n, m), (below, c_below))
            yield pa.RecordBatch.from_arrays(
                [batch.column("centre"), batch.column("class"), pa.array(bound >= need(size, c_size, percent))],
                ["centre", "class", "may"])

    return pairs.mapInArrow(run, "centre long, class long, may boolean")


def _common(value: np.ndarray, whose: np.ndarray, m: int) -> np.ndarray:
    """How many values each two of ``m`` sets have in common. ``value``: numbers from 0 on, in order, and whose each is."""
    both = np.zeros((m, m), np.int32)
    length = np.bincount(value)
    first = np.cumsum(length) - length
    # values of many sets by products, others pair by pair
    many = (length > 1) & (length > m // 16)
    v, w = (np.cumsum(many) - 1)[value[many[value]]], whose[many[value]]
    wide = max(1, min(WIDE, (1 << 22) // m))
    for start in range(0, int(many.sum()), wide):
        i, j = np.searchsorted(v, (start, start + wide))
        counts = np.zeros((m, min(wide, int(v[-1]) + 1 - start)), np.float32)
        np.add.at(counts, (w[i:j], v[i:j] - start), 1)
        both += np.rint(counts @ counts.T).astype(np.int32)
    for n in np.unique(length[(length > 1) & ~many]).tolist():
        at = first[(length == n) & ~many]
        step = max(1, (1 << 20) // (n * n))
        for i in range(0, len(at), step):
            own = whose[at[i: i + step, None] + np.arange(n)]
            np.add.at(both, (own[:, :, None], own[:, None, :]), 1)
    return both


def _may_link(size: np.ndarray, last: np.ndarray, sketch: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether each two sets may link, by their prefixes."""
    length = np.array([len(x) for x in sketch])
    place = np.unique(np.concatenate(sketch), return_inverse=True)[1]
    by = np.argsort(place, kind="stable")
    both = _common(place[by], np.repeat(np.arange(len(size)), length)[by], len(size))
    below = np.stack([np.searchsorted(x, last >> 32).astype(np.int32) for x in sketch])
    may = np.empty(both.shape, bool)
    for i in range(0, len(size), ROWS):
        some = slice(i, i + ROWS)
        rows = [x[some, None] for x in (size, last, length)]
        bound = may_share(both[some], (rows[0], size[None, :]), (rows[1], last[None, :]), (rows[2], length[None, :]), (below[some], below[:, some].T))
        may[some] = bound >= need(rows[0], size[None, :], percent)
    np.fill_diagonal(may, False)
    return may


def _stars_of(centre: int, name: np.ndarray, free: np.ndarray, may: np.ndarray) -> list[tuple[int, int]]:
    """Centre and member of stars that hold every two sets, one of them ``free``, that ``may`` link.

    Those that are not free are in the star of ``centre``. Free sets get stars of their own, each with all
    free ones that may link with it; when these hold twice the free sets, whatever may link beyond joins ``centre``.
    """
    may = may & (free[:, None] | free[None, :])
    out, among = [], may & free[:, None] & free[None, :]
    degree = among.sum(1)
    while degree.any() and len(out) < 2 * free.sum():
        own = int(degree.argmax())
        star = np.append(np.flatnonzero(among[own]), own)
        may[np.ix_(star, star)] = among[np.ix_(star, star)] = False
        degree[star] = among[star].sum(1)
        out += [(int(name[own]), int(name[k])) for k in star]
    return out + [(centre, int(name[k])) for k in np.flatnonzero(may.any(1) & free)]


def _left_over(centre: int, name: np.ndarray, free: np.ndarray, size: np.ndarray, last: np.ndarray,
               sketch: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """``_stars_of`` sets by their prefixes."""
    return _stars_of(centre, name, free, _may_link(size, last, sketch, percent))


def cover_keys(rows: DataFrame, percent: int, shards: int) -> DataFrame:
    """centre and class of the stars that the free sets of ``rows`` need beyond their centre's.

    ``rows``: centre, part, key, class, ``tied`` (may link with the centre), and the blocks a and b that meet;
    and once for each set of a centre's part, without a key, its size, last and sketch. Keys of one centre
    hold the same sets over and over, so any two of these are tried once for all of them.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        marked = pc.is_null(table["key"])
        marks, table = table.filter(marked), table.filter(pc.invert(marked))
        size, last, sketch = marks["size"].to_numpy().astype(np.int64), marks["last"].to_numpy(), marks["sketch"].combine_chunks()
        mark = marks["class"].to_numpy()
        key, a, b, centre, name = (table[c].to_numpy() for c in ("key", "a", "b", "centre", "class"))
        free = ~table["tied"].to_numpy(zero_copy_only=False).astype(bool)
        # the parts of centres as numbers, for marks and rows alike
        both = [np.concatenate([marks[c].to_numpy(), table[c].to_numpy()]) for c in ("centre", "part")]
        whole = _numbers(np.lexsort(both[::-1]), *both)
        marks_by, rows_by = np.lexsort((mark, whole[:len(mark)])), np.lexsort((b, a, key, whole[len(mark):]))
        parts = range(int(whole.max(initial=-1)) + 2)
        marks_at, rows_at = np.searchsorted(whole[:len(mark)][marks_by], parts), np.searchsorted(whole[len(mark):][rows_by], parts)
        found: set[tuple[int, int]] = set()
        for k in parts[:-1]:
            held, at = marks_by[marks_at[k]: marks_at[k + 1]], rows_by[rows_at[k]: rows_at[k + 1]]
            near = np.searchsorted(mark[held], name[at])
            meeting = _numbers(np.arange(len(at)), key[at], a[at], b[at])
            for i, j in _few_sets(near, meeting, len(held)):
                own, place = np.unique(near[i:j], return_inverse=True)
                if len(own) < 2:
                    continue
                loose = np.zeros(len(own), bool)
                loose[place] = free[at[i:j]]
                may = _common(meeting[i:j] - meeting[i], place, len(own)) > 0
                own = held[own]
                may &= _may_link(size[own], last[own], [sketch[int(x)].values.to_numpy() for x in own], percent)
                found.update(_stars_of(int(centre[at[i]]), mark[own], loose, may))
        return pa.table([pa.array([f[k] for f in sorted(found)], pa.int64()) for k in (0, 1)], ["centre", "class"])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("centre", "part"), F.lit(shards)))
    # small tables can take long: as many tasks as the session has partitions, whatever their bytes
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "shard").groupBy("shard").applyInArrow(run, "centre long, class long")


def _numbers(by: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Numbers from 0 on for the distinct rows of ``columns``; ``by``: places in order."""
    new = np.zeros(len(by), np.int64)
    for c in columns:
        new[1:] |= c[by[1:]] != c[by[:-1]]
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(new)
    return out


def _few_sets(place: np.ndarray, meeting: np.ndarray, sets: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold whole meetings, and ``SETS`` sets or one meeting. ``place``: the set of each row, below ``sets``."""
    if sets <= SETS:
        yield 0, len(place)
        return
    edges = np.flatnonzero(np.diff(meeting, prepend=-1, append=-1)).tolist()
    start, held = 0, np.zeros(sets, bool)
    for i, j in zip(edges, edges[1:]):
        if i > start and held.sum() + (~held[place[i:j]]).sum() > SETS:
            yield start, i
            start, held = i, np.zeros(sets, bool)
        held[place[i:j]] = True
    yield start, len(place)


def meet(rows: DataFrame, key: str, tied: str, block: int) -> DataFrame:
    """Copies of ``rows`` for each pair (a, b) of blocks of their ``key`` that they meet in.

    Rows that are tied need not meet each other: free blocks meet all, tied ones the free.
    Keys without a free row, or with one row, are left out. ``own`` is a row's block.
    """
    counts = rows.groupBy(key).agg(F.count_if(~F.col(tied)).alias("free"), F.count_if(tied).alias("tied"))
    counts = counts.filter("free > 0 AND free + tied > 1").select(
        key, F.ceil(F.col("free") / block).cast("int").alias("nf"), F.ceil(F.col("tied") / block).cast("int").alias("nt"))
    own = F.when(F.col(tied), F.col("nf") + F.pmod(F.xxhash64("class"), F.col("nt"))).otherwise(
        F.pmod(F.xxhash64("class"), F.col("nf"))).cast("int")
    others = F.when(F.col(tied), F.sequence(F.lit(0), F.col("nf") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("nf") + F.col("nt") - 1))
    return (
        rows.join(counts, key).withColumn("own", own).withColumn("other", F.explode(others))
        .withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))
        .drop("nf", "nt", "other")
    )


def by_size(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` (key, class, size, …) twice, their keys made finer: any two of a key that may link by size still have a common one."""
    # a little more than the ratio of sizes that link, against rounding
    band = F.floor(F.log(F.col("size").cast("double")) / (math.log(100 / percent) * 1.0001))
    return rows.withColumn("_band", F.explode(F.array(band, band - 1))).withColumn("key", F.xxhash64("key", "_band")).drop("_band")


def stars(keys: DataFrame, sets: DataFrame, percent: int, cover: int = COVER) -> DataFrame:
    """Distinct centre and class: any two classes with a common key that may link are in one star.

    Each centre is in its star as well. ``keys``: key, class. ``sets``: class, size, prefix.
    """
    members = [F.bit_xor(F.xxhash64("class", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    lists = keys.groupBy("key").agg(F.min("class").alias("centre"), F.count("*").alias("n"), *members).filter("n > 1")
    # sets that are much alike share many keys: those of the same sets are one
    lists = lists.groupBy("centre", "n", "x1", "x2").agg(F.min("key").alias("key")).select("key", "centre", "n")
    rows = materialize(keys.join(lists, "key"))
    marks = materialize(sketches(maybe_in(sets, rows.select("class").distinct(), "class")))
    pairs = rows.filter("class <> centre").select("centre", "class").distinct().join(marks, "class").join(
        marks.select(F.col("class").alias("centre"), *[F.col(c).alias(f"c_{c}") for c in ("size", "last", "sketch")]), "centre")
    tried = materialize(possible_pairs(pairs, percent))
    # keys of three and more where someone can't link with the centre
    left = rows.filter("n > 2 AND class <> centre").drop("n").join(tried.withColumnRenamed("may", "tied"), ["centre", "class"])
    left = by_size(left.join(marks.select("class", "size"), "class"), percent) if percent < 100 else left
    again = meet(left.drop("size"), "key", "tied", cover)
    again = materialize(again.drop("own"))
    # a centre's sketches go to each part of its keys once, not with every key
    parts = again.groupBy("centre").agg(F.ceil(F.count("*") / MEET).cast("int").alias("parts"))
    again_in = again.join(parts, "centre").withColumn("part", F.pmod(F.xxhash64("key", "a", "b"), F.col("parts")).cast("int")).drop("parts")
    marked = materialize(again_in.select("centre", "part", "class").distinct().join(marks, "class"))
    # what meets is counted, so that a shard's doesn't grow with the rows
    held = (marked.agg(F.sum(F.size("sketch"))).first()[0] or 0) + 8 * again.count()
    shards = max(4 * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // HELD))
    found = cover_keys(again_in.unionByName(marked, allowMissingColumns=True), percent, shards)
    star = materialize(tried.filter("may").select("centre", "class").unionByName(found).distinct())
    drop(marks, rows, tried, again, marked)
    centres = star.select("centre").distinct().select("centre", F.col("centre").alias("class"))
    return star.unionByName(centres).distinct()


def _tokens(docs: DataFrame, wanted: DataFrame, n: int, classes: Broadcast) -> DataFrame:
    """class, centres and tokens of the texts named by ``wanted`` (class, centres)."""
    near = maybe_in(docs, wanted.select("class"), "rid")  # most texts need not move
    # the same plan at every size: no broadcast of a table that grows
    rows = near.join(wanted.hint("merge"), F.col("rid") == F.col("class")).select("text", "class", "centres")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in groups(data, offsets):
                base = offsets[i]
                token, cuts = token_sets(data[base: offsets[j]], offsets[i: j + 1] - base, n, classes.value)
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(k).slice(i, j - i) for k in (1, 2)],
                    pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(token.view(np.int64)))],
                    ["class", "centres", "tokens"])

    return rows.mapInArrow(run, f"class long, centres {CENTRES}, tokens array<long>")


#: The stars that a class is in, the part of each, and how many parts that has.
CENTRES = "array<struct<centre:long,part:int,parts:int>>"


def parts_of(star: DataFrame, split: int) -> DataFrame:
    """class and ``CENTRES``. A star of many sets is compared in parts, each with a copy of the centre."""
    parts = star.groupBy("centre").agg(F.ceil(F.count("*") / split).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    return star.join(parts, "centre").groupBy("class").agg(F.collect_list(F.struct("centre", part.alias("part"), "parts")).alias("centres"))


def members_and_centres(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """centre, part, class, tokens of all members, and centre, part, middle, from a row for each class."""
    members = tokens.select(F.inline("centres"), "class", "tokens")
    centres = members.filter("centre = class").select(
        "centre", F.col("tokens").alias("middle"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return members.drop("parts"), centres.hint("merge")


MEMBER = "centre long, class long, size int, shared int, linked boolean, bits binary, others array<long>"


def compare_with_centre(members: DataFrame, centres: DataFrame, percent: int, on: str | list[str] = "centre") -> DataFrame:
    """What each member (centre, class, tokens) shares with its centre (centre, middle), joined on ``on``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for centre, name, tokens, middle in zip(*[batch.column(k) for k in range(4)]):
                x, p = tokens.values.to_numpy().view(_U), middle.values.to_numpy().view(_U)
                at = np.minimum(np.searchsorted(x, p), len(x) - 1)
                both = x[at] == p
                own = np.ones(len(x), bool)
                own[at[both]] = False
                shared = int(both.sum())
                linked = shared >= need(np.int64(len(x)), np.int64(len(p)), percent)
                out.append((centre.as_py(), name.as_py(), len(x), shared, bool(linked), np.packbits(both).tobytes(), x[own].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.int64())))],
                ["centre", "class", "size", "shared", "linked", "bits", "others"])

    return members.join(centres, on).select("centre", "class", "tokens", "middle").filter(
        F.size("tokens") > 0).mapInArrow(run, MEMBER)


def _root(up: dict[int, int], x: int) -> int:
    while up.setdefault(x, x) != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def link_blocks(pairs: DataFrame, percent: int) -> DataFrame:
    """Links between sets of two blocks, as many as it takes to join their groups."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        name, size, own, linked = (table[c].to_numpy() for c in ("class", "size", "own", "linked"))
        bits = np.stack([np.frombuffer(b, np.uint8) for b in table["bits"].to_pylist()])
        others = [np.asarray(v.values.to_numpy()) for v in table["others"].chunk(0)]
        a = np.flatnonzero(own == table["a"][0].as_py())
        b = np.flatnonzero(own == table["b"][0].as_py())
        extra = np.array([len(o) for o in others])
        up: dict[int, int] = {}
        found = []
        least = need(size[a].astype(np.int64)[:, None], size[b].astype(np.int64)[None, :], percent)
        both = np.zeros((len(a), len(b)), np.int64)
        for start in range(0, bits.shape[1], WIDE // 8):
            some = np.unpackbits(bits[:, start: start + WIDE // 8], axis=1).astype(np.float32)
            both += np.rint(some[a] @ some[b].T).astype(np.int64)
        may = both + np.minimum(extra[a][:, None], extra[b][None, :]) >= least
        for i, j in zip(*np.nonzero(may)):
            x, y = a[i], b[j]
            if x == y or (linked[x] and linked[y]) or _root(up, int(name[x])) == _root(up, int(name[y])):
                continue
            total = both[i, j]
            if total < least[i, j]:
                total += len(np.intersect1d(others[x], others[y], assume_unique=True))
            if total >= least[i, j]:
                up[_root(up, int(name[x]))] = _root(up, int(name[y]))
                found.append((int(name[x]), int(name[y])))
        return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["x", "y"])

    return pairs.groupBy("centre", "a", "b").applyInArrow(run, "x long, y long")


def components(links: DataFrame) -> DataFrame:
    """class and root (the smallest class reachable) of every class in ``links`` (x, y).

    Each round takes the smallest label around, then that label's own; lengths of paths
    halve from round to round.
    """
    edges = materialize(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    label = materialize(edges.groupBy(F.col("x").alias("class")).agg(F.least(F.min("y"), F.min("x")).alias("root")))
    while True:
        near = edges.join(label.withColumnRenamed("class", "y"), "y").groupBy(F.col("x").alias("class")).agg(F.min("root").alias("near"))
        step = materialize(label.join(near, "class").select(
            "class", F.least("root", "near").alias("root"), (F.col("near") < F.col("root")).alias("moved")))
        if step.filter("moved").isEmpty():
            drop(edges, label)
            return step.select("class", "root")
        jump = step.select(F.col("class").alias("root"), F.col("root").alias("further"))
        new = materialize(step.join(jump, "root").select("class", F.least("root", "further").alias("root")))
        drop(label, step)
        label = new


def linked_classes(docs: DataFrame, sets: DataFrame, n: int, percent: int, classes: Broadcast,
                   frequent: int = FREQUENT, paired: int = PAIRED, block: int = BLOCK, cover: int = COVER) -> DataFrame:
    """class and root of all classes that link with another. ``sets``: class, size, prefix."""
    some = sets.filter(F.size("prefix") > 0).select("class", "size", "prefix")
    texts = only_in(docs, some.select("class"), "rid")
    keys = materialize(index_keys(texts, some, n, percent, classes, frequent, paired))
    star = materialize(stars(keys, some, percent, cover))
    wanted = materialize(parts_of(star, SPLIT))
    tokens = materialize(_tokens(docs, wanted, n, classes))
    compared = materialize(compare_with_centre(*members_and_centres(tokens), percent, ["centre", "part"]))
    drop(keys, star, tokens)
    more = link_blocks(meet(compared, "centre", "linked", block), percent)
    links = compared.filter("linked AND class <> centre").select(F.col("centre").alias("x"), F.col("class").alias("y"))
    return components(materialize(links.unionByName(more)))


def link_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id",
                   text: str = "text", **limits: int) -> DataFrame:
    """``docs`` without its text, with rid, n_shingles, component_id, and ``first`` for one row of each group.

    ``component_id`` is the smallest id of the group.
    """
    rows = with_rid(docs.drop("n_shingles", "component_id", "first", "rid"))
    slim = rows.select(F.col(text).alias("text"), "rid")
    classes = docs.sparkSession.sparkContext.broadcast(frequency_classes(slim, words))
    every = materialize(set_table(slim, words, percent, classes))
    names = every.filter("size > 0").groupBy("a", "b", "size").agg(F.min("rid").alias("class"))
    sets = materialize(every.select("rid", "size", "a", "b").join(names, ["a", "b", "size"], "left").select("rid", "size", "class"))
    firsts = sets.filter("rid = class").select("class")
    one = materialize(only_in(every.select(F.col("rid").alias("class"), "size", "prefix"), firsts, "class"))
    drop(every)  # the prefixes are in the classes' table now
    root = linked_classes(slim, one, words, percent, classes, **limits)
    drop(one)
    named = (
        sets.select("rid", "size", "class").join(root, "class", "left")
        .select("rid", F.col("size").cast("long").alias("n_shingles"),
                # an empty set's group is its own
                F.when(F.col("size") > 0, F.coalesce("root", "class")).alias("group"),
                F.when(F.col("size") == 0, F.col("rid")).alias("alone"))
    )
    named = materialize(rows.select("rid", F.col(doc_id).alias("id")).join(named, "rid"))
    least = named.groupBy("group", "alone").agg(
        F.min(F.struct(F.col("id").isNull().alias("n"), "id", "rid")).alias("least"))
    same = named["group"].eqNullSafe(least["group"]) & named["alone"].eqNullSafe(least["alone"])
    found = named.join(least, same).select(
        named["rid"], "n_shingles", F.col("least.id").alias("component_id"), (F.col("least.rid") == named["rid"]).alias("first"))
    return rows.drop(text).join(found, "rid")
