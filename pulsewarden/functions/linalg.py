"""Second moments of sliding windows, from products at lags.

For windows of ``w`` rows by ``f`` features the matrix of second moments has (w * f)^2 entries, but
an entry for two places of the window is a sum over the series of products of rows that many
steps apart. It depends on the distance of the places alone, but for the rows at the ends. So
w sums of products are taken in one pass over the points, and the entries follow from one
another by adding a product at one end and taking one off at the other: w * f^2 operations for
each point instead of (w * f)^2, and no window is ever written down.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsewarden.functions.scalars import nan_to_num
from pulsewarden.operators import ordering as o

_GROUP = "_gid"
#: Entries of a matrix that are summed as one row.
_PART = 1 << 12


@dataclass(frozen=True)
class Stretch:
    """Rows of one series in order; windows that end at ``first`` or later belong to it."""

    x: np.ndarray
    first: int


def stretches(points: DataFrame, features: Sequence[str], window: int, keys: Sequence[str] = o.KEYS,
              order: Sequence[str] = o.ORDER, chunk_rows: int = 1 << 16) -> DataFrame:
    """The cleaned features in chunks, each with the ``window - 1`` rows ahead of it, sorted for ``read_stretches``."""
    rows = points.select(*keys, *order, *[nan_to_num(F.col(f)).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    chunks = o.chunked(rows, window - 1, 0, keys, order, chunk_rows)
    values = [f"_x{i}" for i in range(len(features))]
    return chunks.select(F.xxhash64(*keys, o.CHUNK).alias(_GROUP), o.POS, o.HOME, *values).sortWithinPartitions(_GROUP, o.POS)


def read_stretches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[Stretch]:
    """One for each chunk; a task holds one at a time."""
    def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> Stretch:
        x, home = (np.concatenate(c) for c in zip(*parts))
        if not home.any():  # only copies of rows ahead
            return Stretch(x, len(x))
        # rows of a chunk with fewer rows ahead of it than a window needs are the first of their series
        return Stretch(x, max(window - 1, int(home.argmax())))

    now, parts = None, []
    for batch in batches:
        gid = batch.column(0).to_numpy()
        home = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[3:]], 1)
        cuts = np.flatnonzero(np.append(True, gid[1:] != gid[:-1])) if len(gid) else []
        for i, j in zip(cuts, np.append(cuts[1:], len(gid))):
            if parts and gid[i] != now:
                yield joined(parts)
                parts = []
            now = gid[i]
            parts.append((x[i:j], home[i:j]))
    if parts:
        yield joined(parts)


def window_moments(s: Stretch, window: int) -> np.ndarray | None:
    """``Σ (1, v)(1, v)ᵀ`` over the windows v (oldest row first) that belong to the stretch."""
    x, n, f = s.x, len(s.x), s.x.shape[1]
    low, high = s.first, n - 1  # where windows end
    if low > high:
        return None
    out = np.zeros((1 + window * f,) * 2)
    total = np.vstack([np.zeros(f), np.cumsum(x, axis=0)])
    out[0, 0] = high - low + 1
    # blocks by how many rows their places lie behind the window's end
    block = out[1:, 1:].reshape(window, f, window, f)
    lags = np.stack([x[low - d: n - d].T @ x[low:] for d in range(window)])
    for q in range(window):
        back = window - 1 - q
        if q:  # one step further back: a product comes in ahead of the first, the last one goes
            lags = lags[: back + 1]
            for v, sign in ((low - q, 1.0), (high - q + 1, -1.0)):
                lags += sign * x[v - np.arange(back + 1)][:, :, None] * x[v][None, None, :]
        for d in range(back + 1):
            block[back - d, :, back, :] = lags[d]
            block[back, :, back - d, :] = lags[d].T
        out[0, 1 + back * f: 1 + (back + 1) * f] = total[high - q + 1] - total[low - q]
    out[1:, 0] = out[0, 1:]
    return out


def sum_matrices(parts: DataFrame) -> np.ndarray:
    """Sum of arrays sent in parts (part int, v array<double>), in two stages."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, 0.0
        for batch in batches:
            for p, v in zip(batch.column("part"), batch.column("v")):
                part, total = p.as_py(), total + v.values.to_numpy()
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["part", "v"])

    some = parts.withColumn("_task", F.pmod(F.spark_partition_id(), F.lit(32))).groupBy("part", "_task").applyInArrow(add, "part int, v array<double>")
    rows = sorted((r["part"], r["v"]) for r in some.groupBy("part").applyInArrow(add, "part int, v array<double>").collect())
    return np.concatenate([v for _, v in rows]) if rows else np.zeros(0)


def second_moments(chunks: DataFrame, window: int, pivot: Sequence[float]) -> np.ndarray:
    """``Σ (1, v−pivot)(1, v−pivot)ᵀ`` over all complete windows of ``stretches``.

    Every task reduces its chunks to one matrix; the matrices are summed on the executors,
    and one reaches the driver.
    """
    f, centre = len(pivot), np.array(pivot, float)
    size = (1 + window * f) ** 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for s in read_stretches(batches, window):
            own = window_moments(Stretch(s.x - centre, s.first), window)
            if own is not None:
                total = own if total is None else total + own
        if total is not None:
            for p, i in enumerate(range(0, size, _PART)):
                v = total.ravel()[i: i + _PART]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([v], pa.list_(pa.float64()))], ["part", "v"])

    out = sum_matrices(chunks.mapInArrow(partial, "part int, v array<double>"))
    return out.reshape(1 + window * f, -1) if len(out) else np.zeros((1 + window * f,) * 2)


def over_windows(chunks: DataFrame, window: int, function, name: str = "value", at_once: int = 1 << 12) -> DataFrame:
    """One double for each complete window: ``function`` takes windows (rows) with their values flattened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in read_stretches(batches, window):
            if s.first >= len(s.x):
                continue
            views = np.lib.stride_tricks.sliding_window_view(s.x[s.first - window + 1:], window, axis=0)
            for i in range(0, len(views), at_once):
                flat = views[i: i + at_once].transpose(0, 2, 1).reshape(-1, window * s.x.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(function(flat))], [name])

    return chunks.mapInArrow(run, f"{name} double")
