"""Cooldown and hourly cap of alerts, exact, without walking a key from end to end in one task.

The times of a key are cut into blocks of a bounded number of rows. What a block does depends
on little: when the next alert may be sent (free), and how many were sent in the hour of the
last one. So each block is first reduced to a table from "first alert in the block" to the
state behind it. Tables of neighbours compose to the table of the longer stretch, ``fan`` at a
time, up to one for the key; back down, every block learns the state it begins with, and all
blocks are resolved on their own.

How the count is left out of the tables. Only alerts in the hour of a block's first row can
follow others of the same hour. For them the table holds the walk by the cooldown alone and
how many of its alerts fall into that hour (w). If the count so far and w stay within the cap,
the walk is right; if not, the key falls silent until the hour ends, and what follows is the
walk from the first row behind the hour, whichever alert was the last.

Which first alerts a stretch can see: those of a cooldown (or an hour, with a cap) after its
first row, and one more. A table has as many entries and is kept in pieces of the block size.

Blocks may be tiny and many, so a task never takes them one by one: it holds the tables of many
stretches behind each other and works on all of them in step, several levels at a time.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pulsewarden.config import DEFAULTS
from pulsewarden.operators.ordering import POS, first_per_key, ordered
from pulsewarden.session import materialize, sized

ALERT_KEY = ("server_id", "metric_name", "severity")
HOUR = 3_600_000_000
#: Rows of a block, and tables composed in one task.
BLOCK_ROWS, FAN = 4096, 64
#: Entries of tables that a task works on at once, if they belong to more than one group.
IN_STEP = 1 << 17

_NEVER = -(1 << 62)
_TABLE = "_key string, block bigint, piece int, t array<bigint>, w array<bigint>, free array<bigint>, hour array<bigint>, sent array<bigint>"
_STATE = "_key string, block bigint, free bigint, hour bigint, sent bigint"


def cap_can_bind(cooldown_minutes: float, cap: int) -> bool:
    return cooldown_minutes <= 0 or ceil(60 / cooldown_minutes) > cap


@dataclass
class State:
    """For some walks: earliest time of the next alert, hour of the last one, alerts in that hour."""

    free: np.ndarray
    hour: np.ndarray
    sent: np.ndarray

    def where(self, mask: np.ndarray, other: State) -> State:
        """``other`` where ``mask`` holds."""
        return State(*[np.where(mask, getattr(other, f.name), getattr(self, f.name)) for f in fields(State)])

    def take(self, at) -> State:
        return State(*[getattr(self, f.name)[at] for f in fields(State)])

    def put(self, at, other: State) -> None:
        for f in fields(State):
            getattr(self, f.name)[at] = getattr(other, f.name)


def begin(n: int = 1) -> State:
    return State(np.full(n, _NEVER), np.full(n, _NEVER), np.zeros(n, np.int64))


@dataclass(frozen=True)
class Rule:
    cooldown: int
    #: Alerts in an hour; a number no hour reaches if there is no cap.
    cap: int
    #: How far behind a stretch's first row its first alert can lie, at most.
    reach: int

    def domain(self, t: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Which rows can be the first alert of their stretch; stretches begin at the places ``heads``."""
        first = np.repeat(t[heads], np.diff(np.append(heads, len(t))))
        out = np.append(0, t[:-1]) < first + self.reach
        out[heads] = True
        return out


def _find(t: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The first place from ``low`` to ``high`` where sorted ``t`` isn't below ``x``, or ``high``."""
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        less = t[np.where(open_, middle, 0)] < x
        low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
    return low


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes)).astype(np.int64)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    return np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))


@dataclass
class Table:
    """From the first alert ``t`` of a stretch to the state behind the stretch, for many stretches.

    Stretch ``i`` has the entries ``at[i]`` … ``at[i + 1]``. ``w`` counts the walk's alerts in the
    stretch's first hour; while a walk is still in that hour at the end (``exit.hour``), its ``sent``
    has no meaning and its ``free`` knows no cap.
    """

    at: np.ndarray
    t: np.ndarray
    w: np.ndarray
    exit: State

    @staticmethod
    def of_rows(times: np.ndarray, rule: Rule, starts: np.ndarray | None = None) -> Table:
        """Of blocks of rows that begin at ``starts``."""
        starts = np.zeros(1, np.int64) if starts is None else starts
        ends = np.append(starts[1:], len(times))
        own = np.repeat(np.arange(len(starts)), ends - starts)
        entries = np.flatnonzero(rule.domain(times, starts))
        at, end, first_hour = entries, ends[own[entries]], (times[starts] // HOUR)[own[entries]]
        sizes = np.bincount(own[entries], minlength=len(starts))
        walk, sent = np.arange(len(at)), np.ones(len(at), np.int64)
        w = (times[at] // HOUR == first_hour).astype(np.int64)
        out = begin(len(at))
        while len(at):
            hour = times[at] // HOUR
            free = times[at] + rule.cooldown
            free = np.where((hour != first_hour) & (sent >= rule.cap), np.maximum(free, (hour + 1) * HOUR), free)
            step = _find(times, at, end, free)
            ends_here = step >= end
            out.put(walk[ends_here], State(free, hour, sent).take(ends_here))
            walk, at, end, first_hour, hour, sent = (x[~ends_here] for x in (walk, step, end, first_hour, hour, sent))
            now = times[at] // HOUR
            sent = np.where(now == hour, sent + 1, 1)
            w[walk] += now == first_hour
        return Table(_offsets(sizes), times[entries], w, out)

    def advance(self, state: State, rule: Rule, i: np.ndarray | int = 0, at: np.ndarray | None = None) -> State:
        """States behind the stretches ``i``, from those before them; ``at``: their first alerts, if known."""
        i = np.broadcast_to(i, state.free.shape)
        low, high = self.at[i], self.at[i + 1]
        at = _find(self.t, low, high, state.free) if at is None else at
        hit = at < high
        at = np.minimum(at, high - 1)
        found, hour = self.exit.take(at), self.t[low] // HOUR
        end = (hour + 1) * HOUR
        inside = self.t[at] // HOUR == hour
        sent = np.where(state.hour == hour, state.sent, 0) + self.w[at]
        stays = inside & (found.hour == hour)
        found.sent = np.where(stays, sent, found.sent)
        found.free = np.where(stays & (sent >= rule.cap), np.maximum(found.free, end), found.free)
        # more than the cap: silent until the hour ends
        over = np.flatnonzero(inside & (sent > rule.cap))
        if len(over):
            low, high, end, hour = low[over], high[over], end[over], hour[over]
            k = _find(self.t, low, high, end)
            silent = State(end, hour, np.full(len(over), rule.cap))
            found.put(over, silent.where(k < high, self.exit.take(np.minimum(k, high - 1))))
        return state.where(hit, found)

    def compose(self, heads: np.ndarray, rule: Rule) -> Table:
        """The tables of longer stretches, each of the neighbours from one of ``heads`` to the next."""
        own = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        sizes = np.diff(np.append(heads, len(self.at) - 1))
        group = np.repeat(np.arange(len(heads)), sizes)
        entries = np.flatnonzero(rule.domain(self.t, self.at[heads]))
        of = group[own[entries]]
        t, place, count = self.t[entries], own[entries] - heads[of], sizes[of]
        hour = (self.t[self.at[heads]] // HOUR)[of]
        w, open_, state = np.zeros(len(t), np.int64), np.zeros(len(t), bool), begin(len(t))
        for j in range(int(sizes.max())):
            # walks still in the first hour go by the cooldown alone
            go = np.flatnonzero((place < j) & (count > j))
            i, now, still, first = heads[of[go]] + j, state.take(go), open_[go], hour[go]
            at = _find(self.t, self.at[i], self.at[i + 1], now.free)
            hit, near = at < self.at[i + 1], np.minimum(at, self.at[i + 1] - 1)
            pure = still & hit & (self.t[near] // HOUR == first)
            counted = State(now.free, now.hour, np.where(still, 0, now.sent))
            new = self.advance(counted, rule, i, at).where(pure, self.exit.take(near)).where(still & ~hit, now)
            state.put(go, new)
            w[go] += np.where(pure, self.w[near], 0)
            open_[go] = still & (new.hour == first)
            # walks that begin here
            go = np.flatnonzero(place == j)
            mine = t[go] // HOUR == hour[go]
            alone = State(t[go], np.full(len(go), _NEVER), np.zeros(len(go), np.int64))
            new = self.advance(alone, rule, own[entries[go]], entries[go]).where(mine, self.exit.take(entries[go]))
            state.put(go, new)
            w[go] = np.where(mine, self.w[entries[go]], 0)
            open_[go] = mine & (new.hour == hour[go])
        return Table(_offsets(np.bincount(of, minlength=len(heads))), t, w, state)

    def fold(self, heads: np.ndarray, before: State, rule: Rule) -> State:
        """The state before each stretch, from those before the longer ones that begin at ``heads``."""
        n = len(self.at) - 1
        sizes, now, out = np.diff(np.append(heads, n)), before, begin(n)
        for j in range(int(sizes.max())):
            go = sizes > j
            heads, sizes, now = heads[go], sizes[go], now.take(go)
            out.put(heads + j, now)
            now = self.advance(now, rule, heads + j)
        return out


def compose(tables: Sequence[Table], rule: Rule) -> Table:
    """The table of neighbouring stretches, in order."""
    state = State(*[np.concatenate([getattr(x.exit, f.name) for x in tables]) for f in fields(State)])
    every = Table(_offsets(np.concatenate([np.diff(x.at) for x in tables])), np.concatenate([x.t for x in tables]),
                  np.concatenate([x.w for x in tables]), state)
    return every.compose(np.zeros(1, np.int64), rule)


def _rows(keys: pa.Array, blocks: np.ndarray, table: Table, rows: int) -> pa.RecordBatch:
    """Tables as rows, in pieces of up to ``rows`` entries."""
    pieces = -(-np.diff(table.at) // rows)
    own = np.repeat(np.arange(len(pieces)), pieces)
    piece = np.arange(len(own)) - _offsets(pieces)[:-1][own]
    cuts = pa.array(np.append(table.at[own] + piece * rows, table.at[-1]).astype(np.int32))
    entries = (table.t, table.w, *[getattr(table.exit, f.name) for f in fields(State)])
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(own)), pa.array(blocks[own]), pa.array(piece.astype(np.int32)),
         *[pa.ListArray.from_arrays(cuts, pa.array(x, pa.int64())) for x in entries]],
        ["_key", "block", "piece", "t", "w", "free", "hour", "sent"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of tables, cut only where a group (_key, _up) ends, some ``IN_STEP`` entries at once."""
    kept, entries = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        entries += pc.sum(pc.list_value_length(batch["t"])).as_py()
        if entries >= IN_STEP and (kept[0]["_key"][0], kept[0]["_up"][0]) != (batch["_key"][-1], batch["_up"][-1]):
            rows = pa.concat_batches(kept)
            end = int(_heads(_codes(rows["_key"]), rows["_up"].to_numpy())[-1])
            yield rows.slice(0, end)
            kept = [rows.slice(end)]
            entries = pc.sum(pc.list_value_length(kept[0]["t"])).as_py()
    if kept:
        yield pa.concat_batches(kept)


def _codes(keys: pa.Array) -> np.ndarray:
    return keys.dictionary_encode().indices.to_numpy()


def _levels(rows: pa.RecordBatch, rule: Rule, fan: int, levels: int) -> tuple[np.ndarray, list[tuple[Table, np.ndarray, np.ndarray]]]:
    """Where in ``rows`` each stretch begins, and the tables level by level: with their numbers, and where groups of ``fan`` begin."""
    codes, block = _codes(rows["_key"]), rows["block"].to_numpy()
    heads = _heads(codes, block)
    sizes = pc.list_value_length(rows["t"]).to_numpy()
    t, w, *state = (rows[c].flatten().to_numpy() for c in ("t", "w", "free", "hour", "sent"))
    table = Table(_offsets(np.add.reduceat(sizes, heads)), t, w, State(*state))
    codes, block, out = codes[heads], block[heads], []
    for level in range(levels):
        up = _heads(codes, block // fan)
        out.append((table, block, up))
        codes, block = codes[up], block[up] // fan
        if level < levels - 1:
            table = table.compose(up, rule)
    return heads, out


def _block_starts(tables: DataFrame, rule: Rule, high: int, fan: int, rows: int, at_first: DataFrame | None) -> DataFrame:
    """The state that each block (0 … ``high``) of each key begins with, the first one with ``at_first``."""
    if high == 0:
        return _with_state(tables.select("_key", "block").distinct(), at_first)
    levels, width = 1, fan
    while width * fan < FAN:  # a task takes some levels at once, of as many tables as one wide level has
        levels, width = levels + 1, width * fan
    tables = materialize(tables)

    def grouped(df: DataFrame) -> DataFrame:
        # by a hash of its own: a shuffle by the columns of a join before it would be left out, and
        # Spark, not knowing of the groups, may read that join's rows with groups torn apart
        dealt = df.withColumn("_deal", F.xxhash64("_key", "_up"))
        return dealt.repartition("_deal").sortWithinPartitions("_key", "_up", "block", "piece").drop("_deal")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _groups(batches):
            heads, by_level = _levels(own, rule, fan, levels)
            table, block, up = by_level[-1]
            top = _heads(_codes(own["_key"]), own["_up"].to_numpy())
            yield _rows(own["_key"].take(pa.array(top)), block[up] // fan, table.compose(up, rule), rows)

    numbered = tables.withColumn("_up", F.floor(F.col("block") / width))
    above = _block_starts(grouped(numbered).mapInArrow(join, _TABLE), rule, high // width, fan, rows, at_first)
    state = [f.name for f in fields(State)]
    above = above.select("_key", F.col("block").alias("_up"), *[F.col(c).alias(f"s_{c}") for c in state])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _groups(batches):
            heads, by_level = _levels(own, rule, fan, levels)
            top = _heads(_codes(own["_key"]), own["_up"].to_numpy())
            now = State(*[own[f"s_{c}"].to_numpy()[top] for c in state])
            for table, _, up in reversed(by_level):
                now = table.fold(up, now, rule)
            yield pa.RecordBatch.from_arrays([own["_key"].take(pa.array(heads)), pa.array(by_level[0][1]),
                                              *[pa.array(getattr(now, c)) for c in state]], ["_key", "block", *state])

    return grouped(numbered.join(above, ["_key", "_up"])).mapInArrow(fold, _STATE)


def _with_state(rows: DataFrame, known: DataFrame | None, on: Sequence[str] = ("_key",)) -> DataFrame:
    """``rows`` with their state in ``known``; without one, that of a key without alerts."""
    default = {f.name: int(getattr(begin(), f.name)[0]) for f in fields(State)}
    if known is None:
        return rows.withColumns({c: F.lit(x) for c, x in default.items()})
    return rows.join(known, list(on), "left").withColumns({c: F.coalesce(c, F.lit(x)) for c, x in default.items()})


def _sent(times: list[int], free: int, hour: int, sent: int, rule: Rule) -> Iterator[int]:
    """Places of the alerts sent."""
    at = bisect_left(times, free)
    while at < len(times):
        yield at
        now = times[at] // HOUR
        sent = sent + 1 if now == hour else 1
        hour, free = now, times[at] + rule.cooldown
        if sent >= rule.cap:
            free = max(free, (now + 1) * HOUR)
        at = bisect_left(times, free, at)


#: What is kept of a key between batches: its last alert, and the alerts sent in that one's hour.
HISTORY = "_key string, last bigint, sent bigint"


def suppress(candidates: DataFrame, cooldown_minutes: float = DEFAULTS.cooldown_minutes,
             max_per_hour: int = DEFAULTS.max_alerts_per_hour, keys: Sequence[str] = ALERT_KEY,
             order: Sequence[str] = ("timestamp", "seq"), fan: int = FAN, block_rows: int = BLOCK_ROWS,
             history: DataFrame | None = None) -> DataFrame:
    """Candidates that pass the cooldown and the hourly cap of their key.

    An alert is held back while the last *sent* alert of its key is younger than
    the cooldown, or when the key already sent ``max_per_hour`` alerts in the hour.
    Candidates without a time are not sent; a null in the key is a key like any other.
    ``history`` (see ``updated_history``) holds what earlier batches sent.
    """
    if max_per_hour <= 0:
        return candidates.limit(0)
    ts = F.unix_micros(order[0])
    if cooldown_minutes <= 0:
        hour = candidates.withColumn("_hour", F.floor(ts / HOUR))
        if history is None:
            return first_per_key(hour, max_per_hour, [*keys, "_hour"], [F.col(c) for c in order]).drop("_hour")
        ranked = first_per_key(hour, max_per_hour, [*keys, "_hour"], [F.col(c) for c in order], "_rank").withColumn("_key", _key(keys))
        before = history.select("_key", "sent", F.floor(F.col("last") / HOUR).alias("_hour"), F.col("last").alias("_last"))
        rest = ranked.join(before.select("_key", "_hour", "sent"), ["_key", "_hour"], "left").join(before.select("_key", "_last"), "_key", "left")
        later = F.col("_last").isNull() | (ts >= F.col("_last"))
        return rest.filter((F.col("_rank") + F.coalesce("sent", F.lit(0)) <= max_per_hour) & later).select(*candidates.columns)

    cooldown = int(cooldown_minutes * 60_000_000)
    binds = cap_can_bind(cooldown_minutes, max_per_hour)
    rule = Rule(cooldown, max_per_hour if binds else 1 << 61, max(cooldown, HOUR) if binds else cooldown)
    # of several candidates at one instant the first may be sent; the others are
    # gone before the shuffle, so a run of copies costs nothing after it
    first = (
        candidates.withColumn("_us", ts).filter("_us IS NOT NULL").withColumn("_key", _key(keys))
        .groupBy("_key", "_us").agg(F.min_by(F.struct(*candidates.columns), F.struct(*order)).alias("_r"))
    )
    rows = ordered(first, ["_key"], ["_us"])
    blocks = materialize(rows.groupBy("_key", F.floor(F.col(POS) / block_rows).alias("block")).agg(
        F.sort_array(F.collect_list("_us")).alias("times"), F.min(POS).alias("head")))
    spans = sized(blocks.groupBy("_key").agg(F.min("block").alias("low"), F.max("block").alias("high")).filter("high > low"))
    high = spans.agg(F.max(F.col("high") - F.col("low"))).first()[0]
    state = [f.name for f in fields(State)]
    at_first = None
    if history is not None:
        hour = F.floor(F.col("last") / HOUR)
        free = F.col("last") + cooldown
        at_first = history.select("_key", F.when(F.col("sent") >= rule.cap, F.greatest(free, (hour + 1) * HOUR)).otherwise(free).alias("free"),
                                  hour.alias("hour"), "sent")
    if high is None:  # every key is one block
        known = _with_state(blocks, at_first)
    else:
        def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at_once = max(1, IN_STEP // block_rows)
            for batch in batches:
                for k in range(0, batch.num_rows, at_once):
                    own = batch.slice(k, at_once)
                    starts = _offsets(pc.list_value_length(own["times"]).to_numpy())[:-1]
                    table = Table.of_rows(own["times"].flatten().to_numpy(), rule, starts)
                    yield _rows(own["_key"], own["block"].to_numpy(), table, block_rows)

        near = blocks.join(spans, "_key").withColumn("block", F.col("block") - F.col("low"))
        starts = _block_starts(near.select("_key", "block", "times").mapInArrow(reduce, _TABLE), rule, high, fan, block_rows, at_first)
        placed = starts.join(spans, "_key").select("_key", (F.col("block") + F.col("low")).alias("block"), *state)
        single = blocks.join(spans, "_key", "left_anti")
        known = _with_state(single, at_first).select(*blocks.columns, *state).unionByName(
            blocks.join(placed, ["_key", "block"]).select(*blocks.columns, *state))

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sent = [h + np.fromiter(_sent(t.tolist(), *map(int, s), rule), np.int64)
                    for h, t, *s in zip(*[pdf[c] for c in ("head", "times", *state)])]
            yield pd.DataFrame({POS: np.concatenate(sent)})

    sent = known.select("times", "head", *state).mapInPandas(resolve, f"{POS} bigint")
    return rows.join(sent, POS, "left_semi").select("_r.*").select(*candidates.columns)


def _key(keys: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in keys]))


def updated_history(sent: DataFrame, history: DataFrame | None, cooldown_minutes: float = DEFAULTS.cooldown_minutes,
                    keys: Sequence[str] = ALERT_KEY, time: str = "timestamp") -> DataFrame:
    """``history`` after the alerts ``sent``: one row for each key that an earlier alert can still hold back."""
    us = F.unix_micros(time)
    rows = sent.select(_key(keys).alias("_key"), us.alias("last"), F.lit(1).cast("bigint").alias("sent"))
    if history is not None:
        rows = rows.unionByName(history)
    by_hour = rows.groupBy("_key", F.floor(F.col("last") / HOUR).alias("_hour")).agg(F.max("last").alias("last"), F.sum("sent").alias("sent"))
    newest = by_hour.groupBy("_key").agg(F.max(F.struct("_hour", "last", "sent")).alias("r")).select("_key", "r.last", "r.sent")
    reach = max(int(cooldown_minutes * 60_000_000), HOUR)
    end = rows.agg(F.max("last")).first()[0]
    return newest.filter(F.col("last") >= F.lit((end or 0) - 2 * reach))
