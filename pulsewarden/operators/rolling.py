"""Rolling features over the last ``w`` points of each series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsewarden.config import DEFAULTS
from pulsewarden.functions.scalars import nan_to_num
from pulsewarden.operators import ordering as o
from pulsewarden.operators.frames import Features, back_by_rows, back_by_time, frame_moments, last_of_time, over_chunks
from pulsewarden.session import sized

STATS = ("mean", "std", "min", "max", "skew", "kurtosis", "rate")


def _column_names(windows: Sequence[int], stats: Sequence[str]) -> list[str]:
    return [f"{x}_{w}m" for w in windows for x in [*[x for x in stats if x != "rate"], "rate"]]


def _frame_features(table: pa.Table, starts: np.ndarray, frames: dict[int, tuple[np.ndarray, np.ndarray]], stats: Sequence[str],
                    ready: dict[int, np.ndarray], value: str) -> Features:
    """Features of one frame per row and window, from a column with nulls; a frame without values has none."""
    column = table.column(value).combine_chunks().cast(pa.float64())
    null = column.is_null().to_numpy(zero_copy_only=False)
    y = column.fill_null(0.0).to_numpy(zero_copy_only=False)
    moments = [x for x in stats if x != "rate"]
    if null.any():  # frames over the values that there are
        seen = np.append(0, np.cumsum(~null))
        of = {w: (seen[a], seen[b + 1] - 1) for w, (a, b) in frames.items()}
        sums = frame_moments(y[~null], list(of.values()), moments) if moments else []
    else:
        sums = frame_moments(y, list(frames.values()), moments) if moments else []
    out = {}
    for k, (w, (a, _)) in enumerate(frames.items()):
        for x in moments:
            found, undefined = sums[k].stat(x)
            out[f"{x}_{w}m"] = found, undefined | ~ready[w]
        out[f"rate_{w}m"] = y - y[a], null | null[a] | ~ready[w]
    return out


def rolling_features(
    points: DataFrame,
    windows: Sequence[int] = DEFAULTS.windows,
    stats: Sequence[str] = DEFAULTS.stats,
    points_per_minute: int = DEFAULTS.points_per_minute,
    min_points: int = DEFAULTS.min_points,
    keys: Sequence[str] = o.KEYS,
    order: Sequence[str] = o.ORDER,
    value: str = "value",
    chunk_rows: int = 1 << 16,
) -> DataFrame:
    """Per point: ``{stat}_{w}m`` over the last ``w * points_per_minute`` points.

    Deviation is the population form, skew and kurtosis are biased (excess)
    forms, ``rate`` is last minus first value and always included. All are null
    until ``min_points`` points of the series were seen; skew and kurtosis are
    also null while the frame is constant. Null values are left out of the moments.

    Chunks of ordered rows go through Arrow batches, all frames of all windows at once
    (``frames``). Writes an ordered table when called; filter ``points`` and choose columns before.
    """
    sizes = {w: w * points_per_minute for w in windows}
    columns = [*dict.fromkeys([*keys, *order, value, *points.columns])]
    before = max([min_points, *sizes.values()]) - 1
    chunks = o.chunked(points.select(*columns), before, 0, keys, order, chunk_rows)

    def work(table: pa.Table, starts: np.ndarray) -> Features:
        here = np.arange(len(starts))
        frames = {w: (back_by_rows(starts, size), here) for w, size in sizes.items()}
        ready = here - starts >= min_points - 1
        return _frame_features(table, starts, frames, stats, dict.fromkeys(sizes, ready), value)

    return over_chunks(chunks, keys, columns, work, _column_names(windows, stats), [value])


def rolling_features_by_time(
    points: DataFrame,
    windows: Sequence[int] = DEFAULTS.windows,
    stats: Sequence[str] = DEFAULTS.stats,
    min_points: int = DEFAULTS.min_points,
    keys: Sequence[str] = o.KEYS,
    value: str = "value",
    order: Sequence[str] = o.ORDER,
    chunk_rows: int = 1 << 16,
) -> DataFrame:
    """Frames of the last ``w`` minutes instead of a number of points; a time's points are in one frame.

    ``rate`` is the point's value minus that of the frame's first point. Features are null in
    frames of fewer than ``min_points`` values.

    Chunks are counted in rows here too. How many rows ahead of a chunk its frames can reach is
    found first, from one row of summary for each small stretch of the order; a chunk is at least
    four times as long, so copies stay a quarter of the rows, and a frame of many rows makes
    long chunks, not large copies.
    """
    spans = {w: w * 60_000_000 for w in windows}
    columns = [*dict.fromkeys([*keys, *order, value, *points.columns])]
    us = F.coalesce(F.unix_micros(order[0]), F.lit(-(1 << 60)))  # points without a time are of one time, before all others
    rows, total = o.placed(points.select(*columns).withColumn("_us", us), keys, order)
    before, after = _reach(rows, keys, max(spans.values()), max(16, chunk_rows >> 6))
    chunks = o.chunks_of(rows, total, before, after, chunk_rows)

    def work(table: pa.Table, starts: np.ndarray) -> Features:
        times = table.column("_us").to_numpy()
        null = table.column(value).is_null().to_numpy()
        seen = np.append(0, np.cumsum(~null))
        last = last_of_time(starts, times)
        frames = {w: (back_by_time(starts, times, span), last) for w, span in spans.items()}
        ready = {w: seen[b + 1] - seen[a] >= min_points for w, (a, b) in frames.items()}
        return _frame_features(table, starts, frames, stats, ready, value)

    return over_chunks(chunks, keys, columns, work, _column_names(windows, stats), [value, "_us"])


def _reach(rows: DataFrame, keys: Sequence[str], span: int, cell: int) -> tuple[int, int]:
    """Rows that a frame can reach back over, and rows of one time that can follow, at most.

    From the first and last time of stretches of ``cell`` rows; a stretch counts whole.
    """
    cells = rows.groupBy(*keys, F.floor(F.col(o.POS) / cell).alias("_cell")).agg(
        F.min("_us").alias("first"), F.max("_us").alias("last"), F.min(o.POS).alias("low"), F.max(o.POS).alias("high"))

    def run(table: pa.Table) -> pa.Table:
        by = np.argsort(table.column("low").to_numpy())
        first, last, low, high = (table.column(c).to_numpy()[by] for c in ("first", "last", "low", "high"))
        # the oldest stretch that still holds a row of a frame, and the last one with a row of the same time
        back = high - low[np.searchsorted(last, first - span)]
        ahead = high[np.searchsorted(first, last, "right") - 1] - low
        return pa.table({"back": [int(back.max())], "ahead": [int(ahead.max())]})

    found = cells.groupBy(*keys).applyInArrow(run, "back long, ahead long").agg(F.max("back"), F.max("ahead")).first()
    return int(found[0] or 0), int(found[1] or 0)


def long_features(
    features: DataFrame, windows: Sequence[int] = DEFAULTS.windows,
    stats: Sequence[str] = DEFAULTS.stats,
) -> DataFrame:
    """One row per feature: ``feature`` is named ``{metric}_{stat}_{w}m``."""
    names = [f"{s}_{w}m" for w in windows for s in [*[x for x in stats if x != "rate"], "rate"]]
    pairs = F.array(*[
        F.struct(F.format_string(f"%s_{n}", "name").alias("feature"), F.col(n).alias("x"))
        for n in names
    ])
    keep = [c for c in features.columns if c not in names]
    return features.select(*keep, F.inline(pairs)).withColumnRenamed("x", "feature_value")


def latest_features(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """All features of each server at its newest points, one row per feature.

    Undefined features are left out, as a dictionary without the key would.
    """
    last = features.groupBy("server_id", "name").agg(
        F.max_by(F.struct(*names), F.struct("timestamp", "seq")).alias("f")
    )
    pairs = F.array(*[
        F.struct(F.format_string(f"%s_{n}", "name").alias("feature"), F.col(f"f.{n}").alias("feature_value"))
        for n in names
    ])
    return last.select("server_id", F.inline(pairs)).filter(F.col("feature_value").isNotNull())


def feature_names(
    metrics: Sequence[str], windows: Sequence[int] = DEFAULTS.windows,
    stats: Sequence[str] = DEFAULTS.stats,
) -> list[str]:
    """Sorted global feature list for the given metrics."""
    per = [*[s for s in stats if s != "rate"], "rate"]
    return sorted(f"{m}_{s}_{w}m" for m in metrics for s in per for w in windows)


def feature_table(
    features: DataFrame, metrics: Sequence[str], step: str = "1 hour",
    windows: Sequence[int] = DEFAULTS.windows, stats: Sequence[str] = DEFAULTS.stats,
) -> DataFrame:
    """One vector per server and time step over the fixed sorted feature list.

    Within a step the newest value of each feature counts; a metric the server
    did not send gives 0.0, as do undefined values.
    """
    per = [f"{s}_{w}m" for w in windows for s in [*[x for x in stats if x != "rate"], "rate"]]
    newest = features.groupBy("server_id", F.window("timestamp", step).start.alias("step"), "name").agg(
        F.max_by(F.struct(*per), F.struct("timestamp", "seq")).alias("f")
    )
    wide = newest.groupBy("server_id", "step").pivot("name", list(metrics)).agg(F.first("f"))
    cols = {f"{m}_{p}": F.col(f"`{m}`.{p}") for m in metrics for p in per}
    vector = [nan_to_num(cols[n]) for n in sorted(cols)]
    return wide.select("server_id", "step", F.array(*vector).alias("vector"))


def normalize_column(df: DataFrame, value: str = "value", keys: Sequence[str] = o.KEYS,
                     method: str = "zscore") -> DataFrame:
    """Scale a column by its group's mean and deviation, or range, as ``normalized``.

    A group without spread and an unknown method leave it unchanged.
    """
    x = F.col(value)
    if method == "zscore":
        base, width = F.avg(value), F.stddev_pop(value)
    elif method == "minmax":
        base, width = F.min(value), F.max(value) - F.min(value)
    else:
        return df.withColumn("normalized", x)
    groups = sized(df.groupBy(*keys).agg(base.alias("_base"), width.alias("_width")))
    scaled = F.when(F.col("_width") > 0, (x - F.col("_base")) / F.col("_width")).otherwise(x)
    return df.join(groups, list(keys)).withColumn("normalized", scaled).drop("_base", "_width")


def readiness(points: DataFrame, ready: int = DEFAULTS.ready_points,
              keys: Sequence[str] = o.KEYS, order: Sequence[str] = o.ORDER) -> DataFrame:
    """Flag each point whose series has ``ready`` or more values by then."""
    chunks = o.chunked(points, ready - 1, 0, keys, order)
    n = F.count("*").over(o.chunk_window(keys).rowsBetween(-(ready - 1), 0))
    return o.home(chunks.withColumn("is_ready", n >= ready))


def sequences(points: DataFrame, length: int, value: str | Sequence[str] = "value",
              keys: Sequence[str] = o.KEYS, order: Sequence[str] = o.ORDER,
              horizon: int = 0, chunk_rows: int = 1 << 16) -> DataFrame:
    """Overlapping windows of ``length`` values ending at each point (stride 1).

    With ``horizon`` the next values are attached as ``target``; only complete
    windows and targets are kept. ``value`` may name several columns: a window is then
    the flat array of its points' values, and the target that of the first column.
    """
    several = not isinstance(value, str)
    columns = list(value) if several else [value]
    chunks = o.chunked(points.select(*keys, *order, *columns), length - 1, horizon, keys, order, chunk_rows)
    spec = o.chunk_window(keys)
    rows = F.array(*columns) if several else F.col(value)
    last = F.collect_list(rows).over(spec.rowsBetween(-(length - 1), 0))
    df = chunks.withColumn("sequence", F.flatten(last) if several else last)
    keep = F.size("sequence") == length * len(columns)
    if horizon:
        df = df.withColumn("target", F.collect_list(columns[0]).over(spec.rowsBetween(1, horizon)))
        keep &= F.size("target") == horizon
    return o.home(df.filter(keep))
