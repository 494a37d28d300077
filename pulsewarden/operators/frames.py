"""Statistics of many frames over ordered rows, in time linear in the rows (times a logarithm).

A frame is a range of rows. Moments of single rows are merged pairwise to those of 2, 4, 8 …
rows by the update formulas of central moments (Chan et al., Pébay), and a frame is the merge
of a few of these nodes. Nothing is subtracted, so neither long series nor large levels cost
accuracy, and constant frames have no spread at all. All frames are worked on at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pulsewarden.operators import ordering as o

#: Rows that frames are worked out for at once, whole chunks at least.
_AT_ONCE = 1 << 16
_GROUP = "_gid"

#: By name: values, and where they are null.
Features = dict[str, tuple[np.ndarray, np.ndarray]]


class Moments:
    """Count, mean and sums of powers around it (m2, m3, m4), least and greatest value, of some frames.

    Only what ``stats`` need is kept.
    """

    def __init__(self, n: np.ndarray, mean: np.ndarray, stats: frozenset[str], **rest: np.ndarray):
        self.n, self.mean, self.stats, self.rest = n, mean, stats, rest

    @staticmethod
    def fields(stats: frozenset[str]) -> list[str]:
        order = 4 if "kurtosis" in stats else 3 if "skew" in stats else 2 if "std" in stats else 1
        return [f"m{k}" for k in range(2, order + 1)] + [c for c, s in (("lo", "min"), ("hi", "max")) if s in stats]

    @staticmethod
    def of(y: np.ndarray, stats: frozenset[str]) -> Moments:
        return Moments(np.ones(len(y)), y, stats, **{f: y if f in ("lo", "hi") else np.zeros(len(y)) for f in Moments.fields(stats)})

    @staticmethod
    def none(size: int, stats: frozenset[str]) -> Moments:
        start = {"lo": np.inf, "hi": -np.inf}
        return Moments(np.zeros(size), np.zeros(size), stats, **{f: np.full(size, start.get(f, 0.0)) for f in Moments.fields(stats)})

    def take(self, at) -> Moments:
        return Moments(self.n[at], self.mean[at], self.stats, **{f: x[at] for f, x in self.rest.items()})

    def put(self, at: np.ndarray, other: Moments) -> None:
        self.n[at], self.mean[at] = other.n, other.mean
        for f, x in self.rest.items():
            x[at] = other.rest[f]

    def merge(self, other: Moments) -> Moments:
        """Frame by frame; at least one of two has rows."""
        na, nb, r, q = self.n, other.n, self.rest, other.rest
        n = na + nb
        d = np.where((na > 0) & (nb > 0), other.mean - self.mean, 0.0)
        d_n = d / np.maximum(n, 1)
        out = {"lo": np.minimum, "hi": np.maximum}
        rest = {f: out[f](r[f], q[f]) for f in ("lo", "hi") if f in r}
        if "m2" in r:
            both = d * d_n * na * nb
            rest["m2"] = r["m2"] + q["m2"] + both
        if "m3" in r:
            rest["m3"] = r["m3"] + q["m3"] + both * d_n * (na - nb) + 3.0 * d_n * (na * q["m2"] - nb * r["m2"])
        if "m4" in r:
            rest["m4"] = (r["m4"] + q["m4"] + both * d_n * d_n * (na * na - na * nb + nb * nb)
                          + 6.0 * d_n * d_n * (na * na * q["m2"] + nb * nb * r["m2"]) + 4.0 * d_n * (na * q["m3"] - nb * r["m3"]))
        mean = np.where(na > 0, self.mean + d_n * nb, other.mean)
        return Moments(n, mean, self.stats, **rest)

    def stat(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Values, and where they are undefined: no rows, or the shape of a constant frame."""
        none = self.n == 0
        n = np.maximum(self.n, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            if name == "mean":
                return self.mean, none
            if name in ("min", "max"):
                return self.rest["lo" if name == "min" else "hi"], none
            m2 = self.rest["m2"]
            if name == "std":
                return np.sqrt(m2 / n), none
            if name == "skew":
                return np.sqrt(n) * self.rest["m3"] / m2**1.5, none | (m2 <= 0)
            return n * self.rest["m4"] / (m2 * m2) - 3.0, none | (m2 <= 0)


def frame_moments(y: np.ndarray, frames: Sequence[tuple[np.ndarray, np.ndarray]], stats: Sequence[str]) -> list[Moments]:
    """Of each set of frames (first and last row; none where the last comes before the first)."""
    wanted = frozenset(stats)
    left = [a.copy() for a, _ in frames]
    right = [np.maximum(b + 1, a) for a, b in frames]
    out = [Moments.none(len(a), wanted) for a in left]
    level = Moments.of(y, wanted)
    with np.errstate(over="ignore", invalid="ignore"):
        while any((a < b).any() for a, b in zip(left, right)):
            for acc, a, b in zip(out, left, right):
                at = np.flatnonzero((a < b) & (a & 1 == 1))
                if len(at):
                    acc.put(at, acc.take(at).merge(level.take(a[at])))
                    a[at] += 1
                at = np.flatnonzero((a < b) & (b & 1 == 1))
                if len(at):
                    b[at] -= 1
                    acc.put(at, acc.take(at).merge(level.take(b[at])))
                a >>= 1
                b >>= 1
            if len(level.n) & 1:  # an odd last node has no partner, and stands in no frame above
                level = level.take(slice(0, len(level.n) - 1))
            level = level.take(slice(0, None, 2)).merge(level.take(slice(1, None, 2)))
    return out


def back_by_rows(starts: np.ndarray, size: int) -> np.ndarray:
    """First row of the frame of the last ``size`` rows of each row; ``starts``: where each row's series begins."""
    return np.maximum(np.arange(len(starts)) - size + 1, starts)


def back_by_time(starts: np.ndarray, us: np.ndarray, span: int) -> np.ndarray:
    """First row, in the series of each row, that is at most ``span`` older."""
    return _place(starts, us, us - span, "left")


def last_of_time(starts: np.ndarray, us: np.ndarray) -> np.ndarray:
    """Last row of each row's time."""
    return _place(starts, us, us, "right") - 1


def _place(starts: np.ndarray, us: np.ndarray, wanted: np.ndarray, side: str) -> np.ndarray:
    out = np.empty(len(us), np.int64)
    cuts = np.append(np.unique(starts), len(us))
    for i, j in zip(cuts, cuts[1:]):
        out[i:j] = i + np.searchsorted(us[i:j], wanted[i:j], side)
    return out


def over_chunks(chunks: DataFrame, keys: Sequence[str], keep: Sequence[str], work: Callable[[pa.Table, np.ndarray], Features],
                results: Sequence[str], inputs: Sequence[str]) -> DataFrame:
    """The ``keep`` columns of all home rows with ``results`` (doubles).

    ``work`` sees the ``inputs`` of some whole chunks, row after row, and where the chunk of
    each row begins; it gives values and where they are null.
    """
    columns = [*dict.fromkeys([*keep, *inputs])]
    types = dict((f.name, f) for f in chunks.schema.fields)
    schema = T.StructType([*[types[c] for c in keep], *[T.StructField(c, T.DoubleType()) for c in results]])

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        gid = table.column(_GROUP).to_numpy()
        first = np.flatnonzero(np.append(True, gid[1:] != gid[:-1]))
        starts = np.repeat(first, np.diff(np.append(first, len(gid))))
        found = work(table.select(list(inputs)), starts)
        home = table.column(o.HOME).combine_chunks()
        at = np.flatnonzero(home.to_numpy(zero_copy_only=False))
        kept = table.select(list(keep)).take(pa.array(at))
        arrays = [*kept.columns, *[pa.chunked_array([pa.array(found[c][0][at], mask=found[c][1][at])]) for c in results]]
        yield from pa.Table.from_arrays(arrays, [*keep, *results]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            held += batch.num_rows
            if held < _AT_ONCE:
                continue
            # all but the last chunk are whole
            gid = batch.column(_GROUP).to_numpy()
            cuts = np.flatnonzero(gid[1:] != gid[:-1])
            if len(cuts):
                cut = int(cuts[-1]) + 1
                yield from done([*waiting[:-1], batch.slice(0, cut)])
                waiting = [batch.slice(cut)]
                held = waiting[0].num_rows
            elif len(waiting) > 1 and waiting[-2].column(_GROUP)[-1].as_py() != int(gid[0]):
                yield from done(waiting[:-1])
                waiting, held = [batch], batch.num_rows
        if waiting:
            yield from done(waiting)

    rows = chunks.select(F.xxhash64(*keys, o.CHUNK).alias(_GROUP), o.POS, o.HOME, *columns)
    return rows.sortWithinPartitions(_GROUP, o.POS).mapInArrow(run, schema)
