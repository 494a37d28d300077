"""Stateful streaming operators: rolling features and suppression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsewarden.config import DEFAULTS
from pulsewarden.operators.suppression import ALERT_KEY, HOUR, cap_can_bind


def window_stats(values: np.ndarray, stats: Sequence[str]) -> dict[str, float | None]:
    """Features of one window; skew and kurtosis are undefined for constant values."""
    d = values - values.mean()
    m2 = float((d * d).mean())
    moments = {
        "mean": lambda: float(values.mean()),
        "std": lambda: m2 ** 0.5,
        "min": lambda: float(values.min()),
        "max": lambda: float(values.max()),
        "skew": lambda: float((d ** 3).mean()) / m2 ** 1.5 if m2 > 0 else None,
        "kurtosis": lambda: float((d ** 4).mean()) / m2 ** 2 - 3.0 if m2 > 0 else None,
    }
    out = {s: moments[s]() for s in stats if s in moments}
    out["rate"] = float(values[-1] - values[0])
    return out


#: Event time in milliseconds that a row or a timer of the two steps below carries.
def _ms(stamp) -> int:
    return int(stamp.timestamp() * 1000)


class SeriesFeatures(StatefulProcessor):
    """Features of one series, a row for each trigger that brings points of it.

    State: the last values, as many as the longest window needs, and the newest time. A
    timer forgets a series that has been silent for ``idle_ms`` of event time.
    """

    def __init__(self, windows: Sequence[int], stats: Sequence[str], points_per_minute: int, min_points: int, idle_ms: int):
        self.windows, self.stats, self.per_minute, self.min_points, self.idle_ms = windows, stats, points_per_minute, min_points, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", "kept array<double>, newest bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        size = max(self.windows) * self.per_minute
        kept, newest = self.ring.get() if self.ring.exists() else ([], 0)
        # a trigger may hold many points, so batches are cut to what the windows can still see
        pending, first = None, None
        for pdf in rows:
            first = pdf["timestamp"].min() if first is None else min(first, pdf["timestamp"].min())
            newest = max(newest, _ms(pdf["timestamp"].max()))
            part = pdf[["timestamp", "seq", "value"]]
            pending = part if pending is None else pd.concat([pending, part])
            pending = pending.sort_values(["timestamp", "seq"]).tail(size)
        kept = (list(kept) + pending["value"].tolist())[-size:]
        self.ring.update((kept, newest))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        # silence counts from the newest point seen, however long a stretch a trigger brings
        self.handle.registerTimer(max(newest + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        names, xs = [], []
        if len(kept) >= self.min_points:
            for w in self.windows:
                frame = np.array(kept[-w * self.per_minute:], dtype=float)
                if len(frame) >= 2:
                    for stat, x in window_stats(frame, self.stats).items():
                        if x is not None:
                            names.append(f"{key[1]}_{stat}_{w}m")
                            xs.append(x)
        yield pd.DataFrame({"server_id": [key[0]], "name": [key[1]], "timestamp": [first], "features": [names], "xs": [xs]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ring.clear()
        return iter(())

    def close(self) -> None:
        """Nothing is held but state."""


class ServerFeatures(StatefulProcessor):
    """All features of a server in one row for each trigger, from those of its series.

    State: the features that each series had last; of points nothing comes here.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "name string", "features array<string>, xs array<double>")
        self.newest = handle.getValueState("newest", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, newest = None, self.newest.get()[0] if self.newest.exists() else 0
        for pdf in rows:
            for r in pdf.itertuples():
                first = r.timestamp if first is None else min(first, r.timestamp)
                newest = max(newest, _ms(r.timestamp))
                self.last.updateValue((r.name,), (list(r.features), [float(x) for x in r.xs]))
        self.newest.update((newest,))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(newest + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        features = {f: float(x) for names, xs in self.last.values() for f, x in zip(names, xs)}
        if features:
            yield pd.DataFrame({"server_id": [key[0]], "timestamp": [first], "features": [features]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        """Nothing is held but state."""


SERIES = "server_id string, name string, timestamp timestamp, features array<string>, xs array<double>"


def series_features(points: DataFrame, windows: Sequence[int] = DEFAULTS.windows, stats: Sequence[str] = DEFAULTS.stats,
                    points_per_minute: int = DEFAULTS.points_per_minute, min_points: int = DEFAULTS.min_points,
                    watermark: str = "10 minutes", idle_minutes: int = 120, chained: bool = False) -> DataFrame:
    """One row of features per series and micro-batch (``SERIES``), state per series.

    Points of a batch are taken in time order; rows behind the watermark are dropped. ``chained``:
    another stateful step follows.
    """
    rows = points.select("server_id", "name", "timestamp", "seq", "value").withWatermark("timestamp", watermark)
    step = SeriesFeatures(tuple(windows), tuple(stats), points_per_minute, min_points, idle_minutes * 60_000)
    more = {"eventTimeColumnName": "timestamp"} if chained else {}
    return rows.groupBy("server_id", "name").transformWithStateInPandas(step, SERIES, "append", "eventTime", **more)


def stream_features(points: DataFrame, windows: Sequence[int] = DEFAULTS.windows,
                    stats: Sequence[str] = DEFAULTS.stats, points_per_minute: int = DEFAULTS.points_per_minute,
                    min_points: int = DEFAULTS.min_points, watermark: str = "10 minutes",
                    idle_minutes: int = 120) -> DataFrame:
    """One row of all features per server and micro-batch that brings points of it.

    Two steps of state: the values of each series under its own key, and the features that
    came of them under the server's, where a row is put together. A server's points never
    meet, however many metrics it has. A server silent for ``idle_minutes`` of event time is
    forgotten. Needs a state store that holds several columns of state (``session.STATE_STORE``).
    """
    own = series_features(points, windows, stats, points_per_minute, min_points, watermark, idle_minutes, chained=True)
    return own.groupBy("server_id").transformWithStateInPandas(
        ServerFeatures(idle_minutes * 60_000), "server_id string, timestamp timestamp, features map<string,double>", "append", "eventTime")


def stream_suppress(graded: DataFrame, cooldown_minutes: float = DEFAULTS.cooldown_minutes,
                    max_per_hour: int = DEFAULTS.max_alerts_per_hour,
                    watermark: str = "10 minutes") -> DataFrame:
    """Alerts that pass cooldown and hourly cap; state per (server, metric, severity).

    All columns are kept. Of a trigger's rows of a key only those are held that may still pass
    and, of one instant, only the first. ``jobs.alert_stream``, which splits keys into blocks,
    takes triggers of any size.
    """
    cooldown = int(cooldown_minutes * 60_000_000)
    capped = cap_can_bind(cooldown_minutes, max_per_hour)
    idle_ms = max(cooldown // 1000, 3_600_000) + 60_000
    schema = graded.schema

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, hour, sent = state.get if state.exists else (None, None, 0)
        pdf = None
        for part in batches:
            if last is not None and cooldown > 0:
                part = part[part["timestamp"].astype("datetime64[us]").astype("int64") >= last + cooldown]
            pdf = part if pdf is None else pd.concat([pdf, part])
            pdf = pdf.sort_values(["timestamp", "seq"])
            if cooldown > 0:  # at one instant only the first can be sent
                pdf = pdf.drop_duplicates("timestamp")
        keep = []
        for place, us in enumerate(pdf["timestamp"].astype("datetime64[us]").astype("int64")):
            if hour != us // HOUR:
                hour, sent = us // HOUR, 0
            ok = (last is None or us - last >= cooldown) and not (capped and sent >= max_per_hour)
            if ok:
                last, sent = us, sent + 1
                keep.append(place)
        if last is not None:
            state.update((last, hour, sent))
            state.setTimeoutTimestamp(max(last // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        if keep:
            yield pdf.iloc[keep]

    return graded.withWatermark("timestamp", watermark).groupBy(*ALERT_KEY).applyInPandasWithState(
        step, schema, "last bigint, hour bigint, sent bigint", "append", GroupStateTimeout.EventTimeTimeout)


def stream_dedupe(alerts: DataFrame, minutes: int = DEFAULTS.dedup_minutes) -> DataFrame:
    """First alert per paging key within ``minutes`` of event time."""
    return (
        alerts.withColumn("dedup_key", F.concat_ws("-", F.lit("anomaly"), "server_id", "metric_name"))
        .withWatermark("timestamp", f"{minutes} minutes")
        .dropDuplicatesWithinWatermark(["dedup_key"])
    )
