"""LM scoring: a Katz backoff model of words, learned and applied by Spark.

    P(w | h) = d(c) c(h, w) / c(h)          if the n-gram (h, w) is in the model
             = alpha(h) P(w | h')           else, h' being h without its first word

``d`` are Good-Turing discounts of counts up to ``k``, from the counts of counts of all
n-grams of that length. ``alpha`` makes every distribution sum to one over the training
words, the end, and one unknown word:

    alpha(h) = (1 - sum of P(w | h)) / (1 - sum of P(w | h'))     over the w in the model.

The lowest level backs off to the unknown word, which gets what the discounts leave. A
context whose counts are all too high to be discounted counts one occurrence more, so that
something is always left. n-grams seen less than ``cutoffs[n - 1]`` times are not in the
model; their share is in their context's alpha. The base model knows every word.

Blocks and shards. Texts are read once, into blocks of a few million tokens: the block's distinct
words, and the places of its tokens among them. Level by level each block sends its distinct
n-grams, packed and compressed, to shards, a shard merges the counts and packs them as one row of the level's
table, and the answers go back to the blocks: an n-gram's count, a context's alpha. So what is
shuffled is one entry for each distinct n-gram of a block, and tokens stay in their blocks,
where a text's probabilities are worked out by the recursion, from the lowest level up.

Words are numbered by the shard that counts them, and n-grams on the level below the highest
too, so an n-gram is its context's number and its word's. n-grams are sharded by context, whose
alpha then needs one shard. A context with more occurrences than a shard should hold is split by
the word instead; its sums are added up over the shards, and its alpha is answered by one of
them. Only counts of counts, totals, and the sums of such contexts go through the driver; these
are no more than a few for each shard.

Words are told apart by 64-bit hashes: of v distinct ones some v^2 / 2^65 pairs are taken for one.

Defined results
    null text: as empty, that is the end alone. Nothing to learn from: every token has
    probability 1 (the model knows the unknown word only), scores are 0.
    Repeated rows (or ids) are texts of their own, learned from and scored each.
    Empty table: empty result. Other columns are kept; those named like a result column
    are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pulsewarden.llm.language import held_out
from pulsewarden.llm.rows import with_rid
from pulsewarden.llm.tokens import GROUP, groups, hashes, mix, utf8, words
from pulsewarden.session import drop, materialize, wide_rows

ORDER = 2
#: Least count of an n-gram in the model, by level.
CUTOFFS = (1, 1)
#: Counts from here on are taken as they are.
K = 5

#: Tokens of a block.
TOKENS = 1 << 19
#: Parts, by shard, in which a level's n-grams are sent one after the other: all of them, but what is shuffled for
#: a part is gone before the next.
PARTS = 2
#: Bytes of text for each shard.
SHARD_BYTES = 24 << 20
#: A context is split if it has more than this part of the tokens of a shard.
HOT = 0.25

_U = np.uint64
END = _U(0xE7037ED1A0B428DB)
#: Numbers of the contexts at the start of a text, by level (from 2 on): beyond all others.
BEGIN = 1 << 62


def discounts(seen: dict[int, int], k: int) -> list[float]:
    """Good-Turing discounts of counts 1 to ``k``; those that make no sense are 1."""
    if not seen.get(1):
        return [1.0] * k
    common = (k + 1) * seen.get(k + 1, 0) / seen[1]
    out = []
    for r in range(1, k + 1):
        d = 1.0
        if seen.get(r) and common < 1:
            d = ((r + 1) * seen.get(r + 1, 0) / (r * seen[r]) - common) / (1 - common)
        out.append(d if 0 < d < 1 else 1.0)
    return out


@dataclass
class Level:
    """What all tasks know of a level: discounts of counts, least count, and sums of split contexts."""

    discount: list[float]
    cutoff: int
    #: For contexts split over shards: sums of discounted counts and of lower probabilities, and all their occurrences.
    split: dict[int, tuple[float, float, int]] = field(default_factory=dict)

    def discounted(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts; 0 for what is not in the model."""
        d = np.array([0.0, *self.discount, 1.0])
        return np.where(c >= max(self.cutoff, 1), d[np.minimum(c, len(d) - 1)] * c, 0.0)


@dataclass
class Totals:
    """Of the lowest level: training tokens, what their counts are divided by, and what is left for unknown words."""

    tokens: int = 0
    vocabulary: int = 0
    texts: int = 0
    whole: int = 0
    left: float = 1.0

    @property
    def size(self) -> int:
        return self.tokens + self.vocabulary + 1


# ---- blocks of texts -----------------------------------------------------------------

BLOCK = "block long, lens array<int>, train array<boolean>, key array<long>, seq array<int>"


def _lists(values: np.ndarray, cuts: Sequence[int] | None = None) -> pa.ListArray:
    values = values.view(np.int64) if values.dtype == _U else values
    cuts = np.array([0, len(values)] if cuts is None else cuts, np.int32)
    return pa.ListArray.from_arrays(cuts, pa.array(values))


#: Arrays that lie packed in a column of bytes.
PACKED = {
    "words": ("key", "id", "c"),
    "state": ("lens", "train", "base", "known", "seq", "id", "c", "gram", "gc", "s"),
    "request": ("ctx", "all", "gctx", "nw", "word", "c", "low", "q"),
    "contexts": ("ctx", "all"),
    "grams": ("gctx", "nw", "sumq", "word", "c"),
    "asked": ("blocks", "n_ctx", "n_gram", "ctx_at", "gram_at"),
    "answer": ("alpha", "all", "c", "gram"),
}
_KINDS = [np.dtype(k) for k in (bool, np.int32, np.int64, np.float64)]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: all first bytes of an array's numbers, then all second ones …, compressed."""
    head = np.array([[_KINDS.index(x.dtype), len(x)] for x in arrays], np.int64)
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays]
    whole = b"".join([np.int64(len(arrays)).tobytes(), head.tobytes(), *planes])
    return np.int64(len(whole)).tobytes() + pa.compress(whole, "zstd", asbytes=True)


def unpack(data: bytes | pa.Buffer) -> list[np.ndarray]:
    size = int(np.frombuffer(data, np.int64, 1)[0])
    whole = np.frombuffer(pa.decompress(memoryview(data)[8:], size, "zstd"), np.uint8)
    n = int(whole[:8].view(np.int64)[0])
    at, out = 8 + 16 * n, []
    for kind, length in whole[8:at].view(np.int64).reshape(n, 2):
        kind = _KINDS[kind]
        end = at + length * kind.itemsize
        out.append(np.ascontiguousarray(whole[at:end].reshape(kind.itemsize, length).T).view(kind).reshape(length))
        at = end
    return out


def _by_shard(key: np.ndarray, shards: int) -> np.ndarray:
    """Places of sorted keys in order of shard and key."""
    return np.argsort((key % _U(shards)).astype(np.int32), kind="stable")


def read_blocks(shards: int) -> Callable:
    """Texts (text, rid, train) → ``BLOCK``: distinct words by shard and hash, and the place of each token among them."""

    def block(rid: int, tokens: list[np.ndarray], lens: list[np.ndarray], train: list[np.ndarray]) -> pa.RecordBatch:
        key, seq = np.unique(np.concatenate(tokens), return_inverse=True)
        by = _by_shard(key, shards)
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(len(by), dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array([rid]), *map(_lists, (np.concatenate(lens).astype(np.int32), np.concatenate(train), key[by], place[seq]))],
            ["block", "lens", "train", "key", "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, tokens, lens, train, held = None, [], [], [], 0
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            rid, learn = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in groups(data, offsets, min(GROUP, 4 * TOKENS)):
                base = offsets[i]
                d, o = data[base: offsets[j]], offsets[i: j + 1] - base
                w = words(d, o)
                token = np.full(len(w.starts) + j - i, END)
                token[np.arange(len(w.starts)) + w.doc] = hashes(d, w)
                first = rid[i] if first is None else first
                tokens.append(token)
                lens.append(w.counts + 1)
                train.append(learn[i:j])
                held += len(token)
                if held >= TOKENS:
                    yield block(int(first), tokens, lens, train)
                    first, tokens, lens, train, held = None, [], [], [], 0
        if tokens:
            yield block(int(first), tokens, lens, train)

    return run


# ---- the lowest level ------------------------------------------------------------------

WORD_REQUEST = "shard int, block long, key array<long>, c array<long>"


def ask_words(shards: int) -> Callable:
    """``BLOCK`` → the block's words with their training counts, a row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, seq, lens, train = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("key", "seq", "lens", "train"))
                c = np.bincount(seq[np.repeat(train, lens)], minlength=len(key))
                ids, cuts = np.unique(key.view(_U) % _U(shards), return_index=True)
                cuts = np.append(cuts, len(key))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.astype(np.int32)), batch.column("block").take(pa.array(np.full(len(ids), i))), _lists(key, cuts), _lists(c, cuts)],
                    ["shard", "block", "key", "c"])

    return run


#: ``kind`` 0: a block's answers. 1: counts of counts (``key`` are counts, ``c`` how often). 2: the shard's words.
WORD_ANSWER = "kind int, shard int, block long, words binary"


def _joined(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The lists of a column end to end, and where each begins."""
    parts = table.column(column).chunks
    values = [p.flatten().to_numpy(zero_copy_only=False) for p in parts]
    sizes = [pc.list_value_length(p).to_numpy(zero_copy_only=False) for p in parts]
    at = np.append(0, np.cumsum(np.concatenate(sizes) if sizes else [])).astype(np.int64)
    return (np.concatenate(values) if len(values) != 1 else values[0]) if values else np.zeros(0, np.int64), at


def merge_words(shards: int, k: int) -> Callable:
    """All requests of a shard → numbers and counts of the words for each block; the lowest level of the model."""

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        keys, cuts = _joined(table, "key")
        counts, _ = _joined(table, "c")
        word, place = np.unique(keys.view(_U), return_inverse=True)
        total = np.bincount(place, counts, len(word)).astype(np.int64)
        number = (np.arange(len(word)) * shards + shard).astype(np.int32)
        r, seen = np.unique(total[(total > 0) & (total <= k + 1)], return_counts=True)
        end = total[word == END]
        # besides counts of counts: -1 tokens, -2 distinct words, -3 texts
        r = np.concatenate([r, [-1, -2, -3]])
        seen = np.concatenate([seen, [total.sum(), (total > 0).sum(), end.sum()]]).astype(np.int64)
        n, none, place = table.num_rows, np.zeros(0, np.int64), place.reshape(-1)
        id_, c = number[place], total[place]
        rows = [pack(none, id_[i:j], c[i:j]) for i, j in zip(cuts[:-1], cuts[1:])]
        rows += [pack(r, none, seen), pack(word.view(np.int64), number, total)]
        return pa.table([
            pa.array(np.concatenate([np.zeros(n), [1, 2]]).astype(np.int32)), pa.array(np.full(n + 2, shard, np.int32)),
            pa.array([*table["block"].to_pylist(), -1, -1], pa.int64()), pa.array(rows, pa.binary())], ["kind", "shard", "block", "words"])

    return run


# ---- blocks with numbers ----------------------------------------------------------------

#: Tokens in order. ``seq``: place of its word in ``id`` and ``c``. From level 2 on ``gram`` and ``gc`` are the number
#: and count of the highest n-gram that ends in a token (-1 and 0: not seen; a negative count: not in the model), and ``s`` its score.
STATE = "block long, state binary"
SUMS = "rid long, score double, base_score double, n_tokens long, n_known long"


def _state(block: int, *arrays: np.ndarray) -> pa.Table:
    return pa.table([pa.array([block], pa.int64()), pa.array([pack(*arrays)], pa.binary())], ["block", "state"])


def _sums(rid: int, lens: np.ndarray, s: np.ndarray, base: np.ndarray, known: np.ndarray) -> pa.Table:
    doc = np.repeat(np.arange(len(lens)), lens)
    return pa.table([pa.array(rid + np.arange(len(lens))), pa.array(np.bincount(doc, s, len(lens))), pa.array(base.astype(float)),
                     pa.array(lens.astype(np.int64)), pa.array(known.astype(np.int64))], ["rid", "score", "base_score", "n_tokens", "n_known"])


def unigram_scores(c: np.ndarray, level: Level, totals: Totals) -> np.ndarray:
    d = level.discounted(c)
    with np.errstate(divide="ignore"):
        return np.where(d > 0, np.log10(d / max(totals.whole, 1)), np.log10(totals.left) if totals.left > 0 else 0.0)


def _answers(answers: pa.Table, column: str, names: Sequence[str]) -> list[np.ndarray]:
    """The answers to a block in order of shards, end to end."""
    at = [PACKED[column].index(x) for x in names]
    rows = [unpack(answers[column][int(i)].as_buffer()) for i in np.argsort(answers["shard"].to_numpy())]
    return [np.concatenate([x[k] for x in rows]) if rows else np.zeros(0, np.int64) for k in at]


def take_words(level: Level, totals: Totals, last: bool) -> Callable:
    """A block and the answers to it → its state; or, if there is no other level, the sums of its texts."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        numbers, counts = _answers(answers, "words", ("id", "c"))
        for i in range(block.num_rows):
            rid = block["block"][i].as_py()
            lens, train, seq = (block[c].combine_chunks()[i].values.to_numpy(zero_copy_only=False) for c in ("lens", "train", "seq"))
            doc = np.repeat(np.arange(len(lens)), lens)
            c = counts[seq]
            base = np.bincount(doc, np.log10((c + 1) / totals.size), len(lens))
            known = np.bincount(doc, c > 0, len(lens)).astype(np.int32)
            if last:
                out.append(_sums(rid, lens, unigram_scores(c, level, totals), base, known))
                continue
            none, number = np.zeros(0, np.int64), np.where(counts > 0, numbers, -1).astype(np.int32)
            out.append(_state(rid, lens, train, base, known, seq, number, counts, none, none, np.zeros(0)))
        return pa.concat_tables(out)

    return run


@dataclass
class Tokens:
    """The tokens of a block on their way to level ``n``: word, context, the context's count, and lower score."""

    lens: np.ndarray
    train: np.ndarray
    word: np.ndarray
    ctx: np.ndarray
    all: np.ndarray
    lower: np.ndarray
    #: Whether the lower n-gram was seen, so that this one may have been, and whether it is in the model.
    seen: np.ndarray
    kept: np.ndarray
    #: The lower n-gram's count.
    count: np.ndarray

    @staticmethod
    def of(row: Callable[[str], np.ndarray], n: int, below: Level, totals: Totals) -> Tokens:
        lens, seq, number, c = row("lens"), row("seq"), row("id"), row("c")
        word = number[seq].astype(np.int64)
        if n == 2:
            gram, count, lower = word, np.where(c >= below.cutoff, c, -c)[seq], unigram_scores(c, below, totals)[seq]
        else:
            gram, count, lower = row("gram"), row("gc"), row("s")
        first = np.append(0, np.cumsum(lens)[:-1]).astype(np.int64)
        ctx, all_ = np.empty(len(seq), np.int64), np.empty(len(seq), np.int64)
        ctx[1:], all_[1:] = gram[:-1], np.abs(count[:-1])
        ctx[first], all_[first] = BEGIN + n, totals.texts
        return Tokens(lens, row("train").astype(bool), word, ctx, all_, lower, gram >= 0, count > 0, np.abs(count))


@dataclass
class Entries:
    """Distinct contexts (by home shard) and n-grams (by shard, context and word) of a block, and which each token has."""

    ctx: np.ndarray
    ctx_all: np.ndarray
    ctx_shard: np.ndarray
    #: Per token: place of its context, -1 without one.
    of_ctx: np.ndarray
    gram_ctx: np.ndarray
    gram_word: np.ndarray
    gram_shard: np.ndarray
    first: np.ndarray
    #: Per token: place of its n-gram, -1 if it can't be in the model.
    of_gram: np.ndarray

    @staticmethod
    def of(t: Tokens, shards: int, hot: float) -> Entries:
        def home(x: np.ndarray) -> np.ndarray:
            return (mix(x.view(_U) + _U(0x9E3779B97F4A7C15)) % _U(shards)).astype(np.int32)

        has = np.flatnonzero(t.ctx >= 0)
        ctx, at, inverse = np.unique(t.ctx[has], return_index=True, return_inverse=True)
        all_, shard = t.all[has][at], home(ctx)
        by = np.argsort(shard, kind="stable")
        place = np.empty(len(ctx), np.int64)
        place[by] = np.arange(len(ctx))
        of_ctx = np.full(len(t.ctx), -1)
        of_ctx[has] = place[inverse]
        # contexts are in order of their numbers here, words are below 2^31
        may = t.seen[has]
        pair, which = (inverse[may].astype(np.int64) << 31) | t.word[has][may], has[may]
        pair, first, back = np.unique(pair, return_index=True, return_inverse=True)
        c, w = pair >> 31, pair & ((1 << 31) - 1)
        own = shard[c]
        split = all_[c] > hot
        own[split] = home(ctx[c[split]] * 1_000_003 + w[split])
        order = np.argsort(own, kind="stable")
        spot = np.empty(len(pair), np.int64)
        spot[order] = np.arange(len(pair))
        of_gram = np.full(len(t.ctx), -1)
        of_gram[which] = spot[back]
        return Entries(ctx[by], all_[by], shard[by], of_ctx, ctx[c[order]], w[order], own[order], which[first[order]], of_gram)


# ---- a higher level ---------------------------------------------------------------------

#: ``ctx`` and ``all``: contexts at home in the shard. n-grams: runs of ``nw`` words of ``gctx``, with counts and what is in the model below
#: them: the word's count (level 2, ``low``) or a probability (``q``). Contexts go as differences.
REQUEST = "shard int, block long, request binary"


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin of each run of equal values, and lengths."""
    at = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(sorted_)))


def _row(batch: pa.RecordBatch | pa.Table, i: int) -> Callable[[str], np.ndarray]:
    """The arrays of a row, by name."""
    found: dict[str, np.ndarray] = {}
    for column in batch.schema.names:
        if column in PACKED:
            found.update(zip(PACKED[column], unpack(batch[column][i].as_buffer())))
    return found.__getitem__


def ask_grams(n: int, below: Level, totals: Totals, shards: int, hot: float, part: int = 0, parts: int = 1) -> Callable:
    """``STATE`` → ``REQUEST``: the block's contexts and n-grams of level ``n``, a row for each shard of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t = Tokens.of(_row(batch, i), n, below, totals)
                e = Entries.of(t, shards, hot)
                learn = np.repeat(t.train, t.lens) & (e.of_gram >= 0)
                c = np.bincount(e.of_gram[learn], minlength=len(e.gram_ctx)).astype(np.int32)
                held = (c > 0) & t.kept[e.first]
                low = np.where(held, t.count[e.first], 0).astype(np.int32) if n == 2 else np.zeros(0, np.int32)
                q = np.where(held, 10.0 ** t.lower[e.first], 0.0) if n > 2 else np.zeros(0)
                at, nw = _runs(np.cumsum(np.append(0, (np.diff(e.gram_ctx) != 0) | (np.diff(e.gram_shard) != 0)))[: len(e.gram_ctx)])
                ids = np.union1d(e.ctx_shard, e.gram_shard).astype(np.int32)
                ids = ids[ids % parts == part]
                cut = lambda x: np.stack([np.searchsorted(x, ids), np.searchsorted(x, ids, "right")], 1)
                ctx_cut, gram_cut, run_cut = cut(e.ctx_shard), cut(e.gram_shard), cut(e.gram_shard[at])
                runs, words_, none = e.gram_ctx[at], e.gram_word.astype(np.int32), np.zeros(0, np.int32)
                rows = []
                for (a, b), (f, g), (x, y) in zip(ctx_cut, gram_cut, run_cut):
                    rows.append(pack(_differences(e.ctx[a:b]), e.ctx_all[a:b], _differences(runs[x:y]), nw[x:y].astype(np.int32), words_[f:g], c[f:g],
                                     low[f:g] if n == 2 else none, q[f:g] if n > 2 else q))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), batch.column("block").take(pa.array(np.full(len(ids), i))), pa.array(rows, pa.binary())], ["shard", "block", "request"])

    return run


#: One row for each shard. The model: contexts with all their occurrences; runs of ``nw`` words of ``gctx`` with counts (negative where the lower
#: n-gram is not in the model), and the sum of the lower probabilities of those in the model. For the answers: what each block asked for, as differences of places.
TABLE = "n int, shard int, contexts binary, grams binary, asked binary, seen array<long>"


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0)).astype(np.int32, copy=False)


def _differences(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and the place of each of ``x`` among them in half the bytes."""
    by = np.argsort(x).astype(np.int32)
    values = x[by]
    new = np.append(True, values[1:] != values[:-1])[: len(x)]
    place = np.empty(len(x), np.int32)
    place[by] = np.cumsum(new, dtype=np.int32) - 1
    return values[new], place


def merge_grams(n: int, cutoff: int, k: int, below: Level, totals: Totals) -> Callable:
    """All requests of a shard → its row of the level's ``TABLE``."""

    def run(table: pa.Table) -> pa.Table:
        shard, block = table["shard"].combine_chunks().slice(0, 1), table["block"].to_numpy()
        rows = [unpack(x.as_buffer()) for x in table["request"]]
        ctxs, alls, gctx, nw, word, c, low, q = [
            np.concatenate([np.cumsum(r[k]) if name in ("ctx", "gctx") else r[k] for r in rows]) for k, name in enumerate(PACKED["request"])]
        n_ctx, n_gram = (np.array([len(r[k]) for r in rows], np.int32) for k in (0, 4))
        del rows
        ctx, first, ctx_place = np.unique(ctxs, return_index=True, return_inverse=True)
        alls = alls[first]
        run_ctx, run_place = np.unique(gctx, return_inverse=True)
        pair = np.repeat(run_place.astype(np.int64) << 31, nw)
        pair |= word
        del ctxs, gctx, nw, word
        gram, place = _places(pair)
        del pair
        total = np.bincount(place, c, len(gram)).astype(np.int64)
        lower = np.zeros(len(gram))
        np.maximum.at(lower, place, low if n == 2 else q)  # the same wherever it is counted
        if n == 2:
            lower = below.discounted(lower.astype(np.int64)) / max(totals.whole, 1)
        kept = (total >= max(cutoff, 1)) & (lower > 0)
        at, runs = _runs(gram >> 31)
        sumq = np.add.reduceat(np.where(kept, lower, 0.0), at) if len(at) else np.zeros(0)
        seen = np.bincount(total[(total > 0) & (total <= k + 1)], minlength=k + 2).astype(np.int64)
        grams = pack(run_ctx[gram[at] >> 31] if len(at) else run_ctx[:0], runs.astype(np.int32), sumq,
                     (gram & ((1 << 31) - 1)).astype(np.int32), np.where(lower > 0, total, -total).astype(np.int32))
        asked = pack(block, n_ctx, n_gram, _steps(ctx_place), _steps(place))
        return pa.table([pa.array([n], pa.int32()), shard, *[pa.array([x], pa.binary()) for x in (pack(ctx, alls), grams, asked)], _lists(seen)],
                        ["n", "shard", "contexts", "grams", "asked", "seen"])

    return run


def _mass(row: Callable[[str], np.ndarray], level: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of the shard's n-grams, with sums of discounted counts and of lower probabilities."""
    nw = row("nw")
    d = level.discounted(row("c").astype(np.int64))
    at = np.append(0, np.cumsum(nw)[:-1]).astype(np.int64)
    return row("gctx"), (np.add.reduceat(d, at) if len(nw) else np.zeros(0)), row("sumq")


ANSWER = "shard int, block long, answer binary"


def alphas(ctx: np.ndarray, all_: np.ndarray, gctx: np.ndarray, d: np.ndarray, q: np.ndarray, split: dict) -> tuple[np.ndarray, np.ndarray]:
    """log10 alpha and divisor of each context."""
    at = np.minimum(np.searchsorted(gctx, ctx), max(0, len(gctx) - 1))
    here = gctx[at] == ctx if len(gctx) else np.zeros(len(ctx), bool)
    d = np.where(here, d[at], 0.0) if len(gctx) else np.zeros(len(ctx))
    q = np.where(here, q[at], 0.0) if len(gctx) else np.zeros(len(ctx))
    for i in np.flatnonzero(np.isin(ctx, list(split))) if split else ():
        d[i], q[i], _ = split[int(ctx[i])]
    whole = np.where(d < all_ * (1 - 1e-12), all_, all_ + 1).astype(float)
    return np.log10((1 - d / np.maximum(whole, 1)) / np.maximum(1 - q, 1e-15)), whole


def answer_grams(level: Level, shards: int, last: bool) -> Callable:
    """``TABLE`` → ``ANSWER``: for each block the alphas and divisors of its contexts, counts of its n-grams and, if there is a next level, their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, shard = _row(batch, i), batch.column("shard")[i].as_py()
                alpha, whole = alphas(row("ctx"), row("all"), *_mass(row, level), level.split)
                c, blocks = row("c"), row("blocks")
                c = np.where(c >= max(level.cutoff, 1), c, -np.abs(c)).astype(np.int32)  # negative: seen, but not in the model
                ctx_cut = np.append(0, np.cumsum(row("n_ctx"))).astype(np.int64)
                gram_cut = np.append(0, np.cumsum(row("n_gram"))).astype(np.int64)
                ctx_at, gram_at = np.cumsum(row("ctx_at"), dtype=np.int64), np.cumsum(row("gram_at"), dtype=np.int64)
                for b, name in enumerate(blocks):
                    own, mine = ctx_at[ctx_cut[b]: ctx_cut[b + 1]], gram_at[gram_cut[b]: gram_cut[b + 1]]
                    gram = np.where(c[mine] != 0, mine * shards + shard, -1)[: 0 if last else None]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard], pa.int32()), pa.array([name], pa.int64()), pa.array([pack(alpha[own], whole[own], c[mine], gram)], pa.binary())],
                        ["shard", "block", "answer"])

    return run


def take_grams(n: int, level: Level, below: Level, totals: Totals, shards: int, hot: float, last: bool) -> Callable:
    """A block's state and the answers to it → the state for the next level, or the sums of its texts."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        alpha, whole, count, number = _answers(answers, "answer", PACKED["answer"])
        for i in range(block.num_rows):
            row, rid = _row(block, i), block["block"][i].as_py()
            t = Tokens.of(row, n, below, totals)
            e = Entries.of(t, shards, hot)
            has, may = e.of_ctx >= 0, e.of_gram >= 0
            a = np.where(has, alpha[e.of_ctx], 0.0) if len(alpha) else np.zeros(len(has))
            c = np.where(may, count[e.of_gram], 0).astype(np.int64) if len(count) else np.zeros(len(has), np.int64)
            d = level.discounted(c)
            with np.errstate(divide="ignore", invalid="ignore"):
                s = np.where(d > 0, np.log10(d / np.where(has, whole[e.of_ctx], 1.0) if len(whole) else d), a + t.lower)
            if last:
                out.append(_sums(rid, t.lens, s, row("base"), row("known")))
                continue
            gram = np.where(c != 0, number[e.of_gram], -1) if len(number) else np.full(len(has), -1)
            out.append(_state(rid, t.lens, t.train, row("base"), row("known"), row("seq"), row("id"), row("c"), gram.astype(np.int64), c, s))
        return pa.concat_tables(out)

    return run


# ---- the operator -----------------------------------------------------------------------

@dataclass
class Katz:
    """The model: ``words`` (shard, and key, id, c packed), and ``levels`` by order from 2 on (``TABLE``), with what tasks know of them."""

    words: DataFrame
    levels: dict[int, DataFrame]
    known: dict[int, Level]
    totals: Totals


def _counts_of_counts(rows: list) -> dict[int, int]:
    out: dict[int, int] = {}
    for keys, counts in rows:
        for r, c in zip(keys, counts):
            out[r] = out.get(r, 0) + c
    return out


def evaluate(rows: DataFrame, order: int = ORDER, cutoffs: Sequence[int] = CUTOFFS, k: int = K, shards: int = 1) -> tuple[DataFrame, Katz]:
    """Sums (``SUMS``) of all ``rows`` (text, rid, train), by a model of those with ``train``.

    Rids follow each other in a partition.
    """
    blocks = materialize(rows.select("text", "rid", "train").mapInArrow(read_blocks(shards), BLOCK))
    with wide_rows(rows.sparkSession):
        return _evaluate(blocks, order, cutoffs, k, shards)


def _evaluate(blocks: DataFrame, order: int, cutoffs: Sequence[int], k: int, shards: int) -> tuple[DataFrame, Katz]:
    asked = blocks.mapInArrow(ask_words(shards), WORD_REQUEST)
    merged = materialize(asked.groupBy("shard").applyInArrow(merge_words(shards, k), WORD_ANSWER), "kind")
    stats = _counts_of_counts([(keys.tolist(), c.tolist()) for r in merged.filter("kind = 1").select("words").collect() for keys, _, c in [unpack(r["words"])]])
    totals = Totals(stats.get(-1, 0), stats.get(-2, 0), stats.get(-3, 0))
    level = Level(discounts({r: c for r, c in stats.items() if r > 0}, k), cutoffs[0])
    vocabulary = merged.filter("kind = 2").select("shard", "words")
    mass = sum(r["d"] for r in vocabulary.select("words").mapInArrow(_lowest_mass(level), "d double").collect())
    if totals.tokens:
        totals.whole = totals.tokens if mass < totals.tokens * (1 - 1e-12) else totals.tokens + 1
        totals.left = 1 - mass / totals.whole
    answers = merged.filter("kind = 0").select("shard", "block", "words")
    state = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        take_words(level, totals, order == 1), SUMS if order == 1 else STATE)
    state = materialize(state)
    drop(blocks)
    model = Katz(vocabulary, {}, {1: level}, totals)
    hot = HOT * max(totals.tokens, 1) / shards
    for n in range(2, order + 1):
        below = level
        parts = min(PARTS, shards)
        tables = [
            materialize(state.mapInArrow(ask_grams(n, below, totals, shards, hot, part, parts), REQUEST)
                        .groupBy("shard").applyInArrow(merge_grams(n, cutoffs[n - 1], k, below, totals), TABLE))
            for part in range(parts)]
        table = reduce(DataFrame.unionByName, tables)
        seen = _counts_of_counts([(range(len(r["seen"])), r["seen"]) for r in table.select("seen").collect()])
        level = Level(discounts(seen, k), cutoffs[n - 1])
        level.split = _split_contexts(table, level, hot)
        last = n == order
        answers = table.mapInArrow(answer_grams(level, shards, last), ANSWER)
        new = materialize(state.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
            take_grams(n, level, below, totals, shards, hot, last), SUMS if last else STATE))
        drop(state)
        state = new
        model.levels[n], model.known[n] = table, level
    return state, model


def _lowest_mass(level: Level) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(level.discounted(unpack(x.as_buffer())[2]).sum()) for x in batch.column(0)], pa.float64())], ["d"])

    return run


def _split_contexts(table: DataFrame, level: Level, hot: float) -> dict[int, tuple[float, float, int]]:
    """Sums over all shards of the contexts that are split: each has more than a part of a shard's tokens, so they are few."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = _row(batch, i)
                pick = row("all") > hot
                yield pa.RecordBatch.from_arrays([pa.array(row(c)[pick]) for c in ("ctx", "all")], ["ctx", "all"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ctx, d, q = _mass(_row(batch, i), level)
                pick = np.isin(ctx, split)
                yield pa.RecordBatch.from_arrays([pa.array(x[pick]) for x in (ctx, d, q)], ["ctx", "d", "q"])

    alls = {r["ctx"]: r["all"] for r in table.select("contexts").mapInArrow(found, "ctx long, all long").distinct().collect()}
    split = np.array(sorted(alls), np.int64)
    if not alls:
        return {}
    rows = table.select("grams").mapInArrow(sums, "ctx long, d double, q double").groupBy("ctx").agg(F.sum("d").alias("d"), F.sum("q").alias("q"))
    known = {r["ctx"]: (r["d"], r["q"]) for r in rows.collect()}
    return {c: (*known.get(c, (0.0, 0.0)), n) for c, n in alls.items()}


def model_rows(model: Katz, n: int) -> DataFrame:
    """The n-grams of a level from 2 on as rows: ctx and word (their numbers), p, and the context's log10 alpha."""
    level = model.known[n]
    split = np.array(sorted(level.split), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = _row(batch, i)
                # a split context's n-grams lie in other shards than itself
                ctx = np.union1d(row("ctx"), split)
                all_ = np.array([level.split[int(c)][2] if int(c) in level.split else 0 for c in ctx], np.int64)
                own = np.searchsorted(ctx, row("ctx"))
                all_[own] = row("all")
                alpha, whole = alphas(ctx, all_, *_mass(row, level), level.split)
                at = np.searchsorted(ctx, np.repeat(row("gctx"), row("nw")))
                d = level.discounted(row("c").astype(np.int64))
                keep = d > 0
                yield pa.RecordBatch.from_arrays([
                    pa.array(ctx[at][keep]), pa.array(row("word")[keep]), pa.array(d[keep] / whole[at][keep]), pa.array(alpha[at][keep])],
                    ["ctx", "word", "p", "alpha"])

    return model.levels[n].mapInArrow(run, "ctx long, word int, p double, alpha double")


def lm_scores(docs: DataFrame, order: int = ORDER, cutoffs: Sequence[int] = CUTOFFS, k: int = K, parts: int = 7,
              held: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without its text, with held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learned from the rows not held out.
    """
    results = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    rows = with_rid(docs.drop(*results, "rid")).withColumn("held_out", held_out(F.col(doc_id), parts, held))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    wide = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, min(wide, size >> 16), -(-size // SHARD_BYTES)) if size else 1
    found, model = evaluate(rows.select(F.col(text).alias("text"), "rid", (~F.col("held_out")).alias("train")), order, cutoffs, k, shards)
    return (
        rows.drop(text).join(found, "rid")
        .withColumn("train_tokens", F.lit(model.totals.tokens).cast("long"))
        .drop("rid")
    )
