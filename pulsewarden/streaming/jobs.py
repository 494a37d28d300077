"""Streaming jobs: the batch operators on unbounded tables.

Latest values, alert counts, downsampling and parsing work on streams as they are;
this module adds what needs a watermark, a sink or a static side.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsewarden.config import DEFAULTS, Settings
from pulsewarden.functions import scalars as s
from pulsewarden.operators import alerts as al, histograms as dr, percentiles as pc
from pulsewarden.operators.detectors.base import Detector
from pulsewarden.operators.ensemble import EnsembleRegistry, attach_forecast
from pulsewarden.operators.service import process_batch
from pulsewarden.session import sized
from pulsewarden.sinks import stores
from pulsewarden.sinks.channels import Channel
from pulsewarden.sinks.outbox import run_id
from pulsewarden.sources.messages import split_bad_records
from pulsewarden.streaming.stateful import stream_features


#: Take what there is and stop; pass ``{"processingTime": "10 seconds"}`` to keep running.
ONCE = {"availableNow": True}


def file_sink(df: DataFrame, path: str, checkpoint: str, by: Sequence[str] = (), trigger: Mapping = ONCE) -> StreamingQuery:
    """Append to Parquet; the sink's log keeps a replayed batch from writing twice."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if by:
        writer = writer.partitionBy(*by)
    return writer.trigger(**trigger).start(path)


class LateRows(StreamingQueryListener):
    """Counts the rows that stateful operators drop as too late, per query, over every trigger.

    Add it with ``spark.streams.addListener`` before the query starts. A query's own
    ``recentProgress`` forgets all but its last triggers.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self.triggers: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        """Counts begin with the first trigger."""

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        self.dropped[str(p.id)] = self.dropped.get(str(p.id), 0) + late
        self.triggers[str(p.id)] = self.triggers.get(str(p.id), 0) + 1

    def onQueryIdle(self, event) -> None:
        """Nothing came, nothing was dropped."""

    def onQueryTerminated(self, event) -> None:
        """The counts stay: a query started again under the same id goes on with them."""

    def of(self, query: StreamingQuery) -> int:
        return self.dropped.get(str(query.id), 0)


def write_split(parsed: DataFrame, good_path: str, bad_path: str, checkpoint: str, trigger: Mapping = ONCE) -> StreamingQuery:
    """Good points to one folder and rejected messages to another, from a single parse.

    A batch is written under its number, so a replay replaces it.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        good, bad = split_bad_records(batch)
        good.write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{bad_path}/batch={number}")
        batch.unpersist()

    return parsed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def on_features(points: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str,
                trigger: Mapping = ONCE, **kw) -> StreamingQuery:
    """Call ``handler(feature rows, batch number)`` for every micro-batch."""
    return (
        stream_features(points, **kw).writeStream.foreachBatch(handler)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def score_features(features: DataFrame, detector: Detector, names: Sequence[str]) -> DataFrame:
    """Feature maps → detections worth dispatching; names are a fixed sorted list.

    Stateless, so the same call serves batches and streams.
    """
    # generated rather than projected: the scorer needs rows in Spark's binary form,
    # which a stateful operator's output is not
    rows = features.withColumn("vector", F.explode(F.array(s.map_vector(F.col("features"), names))))
    scored = detector.score(rows)
    return scored.filter(s.dispatch_gate(F.col("is_anomaly"), F.col("anomaly_score"))).select(
        "server_id", F.lit("unknown").alias("metric_name"), "timestamp",
        F.xxhash64("server_id", "timestamp").alias("seq"), "anomaly_score", "is_anomaly",
    )


def detect_stream(points: DataFrame, detector: Detector, names: Sequence[str], path: str,
                  checkpoint: str, trigger: Mapping = ONCE, **kw) -> StreamingQuery:
    """First half of live detection: points → features → score → stored detections."""
    return file_sink(score_features(stream_features(points, **kw), detector, names), path, checkpoint, trigger=trigger)


def alert_stream(detections: DataFrame, path: str, checkpoint: str, settings: Settings = DEFAULTS,
                 channels: Sequence[Channel] = (), trigger: Mapping = ONCE) -> StreamingQuery:
    """Second half: stored detections → suppression → alerts and payloads of the channels, in the store at ``path``.

    A batch's alerts, payloads and what suppression has to remember become visible together
    (``service.stored_alerts``, ``stored_payloads``), however often the batch is tried. Late
    detections can't pass an alert that was sent after them.
    """
    otherwise = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        process_batch(batch, channels, path, run_id(batch.sparkSession, otherwise), number, settings)
        batch.unpersist()

    return detections.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def feature_kinds(rows: DataFrame) -> DataFrame:
    """Feature maps as rows: name of the metric, kind (statistic and window) and x."""
    kind = F.regexp_extract("feature", r"_([a-z]+_\d+m)$", 1)
    keep = [c for c in rows.columns if c != "features"]
    return rows.select(*keep, F.explode("features").alias("feature", "x")).select(
        *keep, F.regexp_replace("feature", r"_[a-z]+_\d+m$", "").alias("name"), kind.alias("kind"), "x")


def usual_features(rows: DataFrame) -> DataFrame:
    """Mean and deviation of every feature over all servers and times: what verdicts are explained by.

    ``rows`` has feature maps, as stored while training; the result is a small table to keep with the models.
    """
    return feature_kinds(rows).groupBy("name", "kind").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))


def ensemble_detections(features: DataFrame, registry: EnsembleRegistry, names: Sequence[str],
                        sequence: DataFrame | None = None, smoothing: DataFrame | None = None,
                        usual: DataFrame | None = None) -> DataFrame:
    """Feature maps of a batch → verdicts of all registered detectors, with forecast, metric and each model's score.

    Detectors score the vector of ``names``. Forecast tables have server_id, name and
    forecast. A verdict's metric is the one whose feature lies farthest from ``usual``
    (``usual_features`` of the training data), in deviations; unknown without that table.
    """
    rows = features.withColumn("vector", s.map_vector(F.col("features"), names)).withColumn(
        "obs", F.xxhash64("server_id", "timestamp"))
    verdicts = registry.detect(rows, {n: rows for n in registry.active}, ("obs",)).drop("error")
    if "models" in verdicts.columns:
        scores = F.transform("models", lambda m: F.struct(m["model_name"], m["score"]))
        verdicts = verdicts.withColumn("model_details", F.map_from_entries(scores)).drop("models")
    if usual is None:
        named = verdicts.drop("metric_name").withColumn("metric_name", F.lit("unknown"))
    else:
        far = feature_kinds(rows.select("obs", "features")).join(sized(usual), ["name", "kind"]).filter("sd > 0").groupBy("obs", "name").agg(
            F.max(F.abs(F.col("x") - F.col("m")) / F.col("sd")).alias("score"))
        named = al.attribute_metric(verdicts, far)
    named = named.join(rows.select("obs", "server_id", "timestamp"), "obs")
    if sequence is not None or smoothing is not None:
        named = attach_forecast(named.withColumnRenamed("metric_name", "name"), sequence, smoothing).withColumnRenamed("name", "metric_name")
    return named.withColumnRenamed("obs", "seq")


#: Columns of detections that alerts are made from; those a detection lacks are left out.
DETECTION = ("server_id", "metric_name", "timestamp", "seq", "anomaly_score", "is_anomaly",
             "prediction_horizon", "model_details", "actual", "forecast", "correlation_id")


def live_stream(points: DataFrame, registry: EnsembleRegistry, names: Sequence[str], detections: str, checkpoint: str,
                settings: Settings = DEFAULTS, sequence: DataFrame | None = None, smoothing: DataFrame | None = None,
                usual: DataFrame | None = None, inference: str | None = None, trigger: Mapping = ONCE, **kw) -> StreamingQuery:
    """First half with the whole ensemble: points → features → verdicts worth dispatching.

    A batch is written under its number, so a replay replaces it; ``alert_stream`` does the
    rest from there. ``inference`` names a folder for one row per batch and model: the calls
    that ``aggregates.inference_stats`` summarises, with the time a verdict took on average.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        n, newest = batch.agg(F.count("*"), F.max("timestamp")).first()
        began = time.perf_counter()
        found = ensemble_detections(batch, registry, names, sequence, smoothing, usual)
        found = found.filter(s.dispatch_gate(F.col("is_anomaly"), F.col("anomaly_score")))
        found.select(*[c for c in DETECTION if c in found.columns]).write.mode("overwrite").parquet(f"{detections}/batch={number}")
        if inference and n:
            each = (time.perf_counter() - began) * 1000 / n
            calls = [(m, newest, number, each, n) for m in registry.active]
            batch.sparkSession.createDataFrame(calls, INFERENCE).write.mode("overwrite").parquet(f"{inference}/batch={number}")
        batch.unpersist()

    return (
        stream_features(points, **kw).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


INFERENCE = "model_name string, timestamp timestamp, seq long, latency_ms double, n_rows long"


def stream_downsample(points: DataFrame, step: str = DEFAULTS.downsample, watermark: str = "10 minutes") -> DataFrame:
    return stores.downsample(points.withWatermark("timestamp", watermark), step)


def stream_drift(points: DataFrame, reference: DataFrame, window: str = "1 hour", watermark: str = "10 minutes",
                 threshold: float = DEFAULTS.drift_threshold, bins: int = 10) -> DataFrame:
    """Drift of every name and tumbling window against a stored reference.

    State is one row of bin counts per open window and name.
    """
    ref = sized(dr.reference_arrays(reference))
    rows = points.withWatermark("timestamp", watermark).select("name", "timestamp", s.nan_to_num(F.col("value")).alias("_x"))
    binned = dr.with_bins(rows, ref, bins)
    now = binned.groupBy("name", F.window("timestamp", window).alias("w"), "lo", "hi", "ref").agg(
        dr.bin_counts(bins).alias("now")
    )
    value = dr.psi_of_counts(F.col("ref"), F.col("now"), (F.col("hi") - F.col("lo")) / bins)
    return now.select(
        F.col("name").alias("feature"), F.col("w.start").alias("window_start"), value.alias("psi")
    ).withColumn("level", dr.drift_level(F.col("psi"), threshold))


def stream_retrain(windows: DataFrame, watermark: str = "0 seconds", raise_after: int = dr.RAISE, calm_after: int = dr.CALM) -> DataFrame:
    """``retrain_events`` of a stream of drift windows, as ``file_sink`` stores them; one small state per feature.

    Windows of a feature must come in order, as a watermark lets them out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else dr.START
        rows = pd.concat(list(batches)).sort_values("window_start")
        out = []
        for row in rows.itertuples():
            now, event = dr.retrain_step((int(now[0]), int(now[1]), bool(now[2])), row.level, raise_after, calm_after)
            if event:
                out.append((key[0], row.window_start, row.psi))
        state.update(now)
        yield pd.DataFrame(out, columns=["feature", "window_start", "psi"])

    rows = windows.select("feature", "window_start", "psi", "level").withWatermark("window_start", watermark)
    return rows.groupBy("feature").applyInPandasWithState(
        step, dr.EVENT, "hot int, calm int, armed boolean", "append", GroupStateTimeout.NoTimeout)


def stream_thresholds(points: DataFrame, q: float, window: str = "1 hour", watermark: str = "10 minutes",
                      keys: Sequence[str] = ("server_id", "name"), value: str = "value") -> DataFrame:
    """Percentile of every key and tumbling window, from a sketch: state is a few kilobytes for each.

    A window's sketch is kept in the result, so that longer spans can be merged from it
    (``percentiles.merge_sketches``); the percentile lies within ``percentiles.rank_error`` of
    the exact one's rank.
    """
    rows = points.withWatermark("timestamp", watermark)
    sketches = pc.quantile_sketches(rows, [*keys, F.window("timestamp", window).alias("w")], value)
    kept = sketches.select(*keys, F.col("w.start").alias("window_start"), "sketch")
    return kept.withColumn("percentile", F.kll_sketch_get_quantile_double("sketch", F.lit(q / 100.0)))


def train_when_ready(features: DataFrame, detector: Detector, min_samples: int = DEFAULTS.min_samples) -> DataFrame | None:
    """Train once the feature table holds ``min_samples`` rows; repeating is the scheduler's part."""
    # take() stops reading as soon as it has enough rows
    if len(features.select(F.lit(1)).take(min_samples)) < min_samples:
        return None
    return detector.train(features)
