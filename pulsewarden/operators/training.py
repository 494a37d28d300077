"""Training job: fit every detector, store the model tables and the drift reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pulsewarden.config import DEFAULTS, Settings
from pulsewarden.operators import aggregates as ag, histograms as dr
from pulsewarden.operators.detectors.holtwinters import HoltWinters
from pulsewarden.operators.detectors.iforest import IsolationForest
from pulsewarden.operators.detectors.sequence import SequenceReconstruction
from pulsewarden.session import materialize
from pulsewarden.sinks import stores
from pulsewarden.sources.tables import impute_numeric, wide_to_long


def long_matrix(table: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature columns as ``(name, value)`` rows, for drift references."""
    pairs = F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).cast("double").alias("value")) for f in features])
    return table.select(F.inline(pairs))


def train_all(table: DataFrame, features: Sequence[str], base: str, version: str = "1.0.0",
              settings: Settings = DEFAULTS, seasonal_periods: int | None = None) -> DataFrame:
    """Fit on a wide table ``(timestamp, server_id, id, feature columns)`` and store everything under ``base``.

    The forest sees rows of all features; Holt-Winters and the sequence model are
    fitted per server and feature. Returns the training report, one row per metric.
    """
    spark = table.sparkSession
    table = impute_numeric(table, features)
    points = wide_to_long(table, ("timestamp", "server_id", "id"), features).withColumnRenamed("id", "seq")

    forest = IsolationForest(features, "id", settings.n_trees, settings.max_samples, settings.contamination, settings.seed)
    smoothing = HoltWinters(seasonal_periods or settings.seasonal_periods)
    sequence = SequenceReconstruction(settings.sequence_length, percentile=settings.threshold_percentile)
    report = {}
    if forest.train(table) is not None:
        report["isolation_forest"] = ag.training_metrics(forest.score(table), len(features))
    smoothing.train(points)
    report["holt_winters"] = smoothing.model.agg(
        F.count("*").alias("n_series"), F.sum("n").alias("n_samples"),
        F.avg("resid_std").alias("residual_std"), F.sum("sse").alias("sse"),
    )
    if sequence.train(points) is not None:
        report["lstm_autoencoder"] = sequence.model.select("n_sequences", "threshold")
    for model in (forest, smoothing, sequence):
        if model.model_name in report:
            summary = materialize(report[model.model_name])  # one row: the report and the registration take it
            report[model.model_name] = summary
            model.save(base, version, summary.first().asDict())
            model.load(spark, base, version)
    stores.store_model(dr.set_reference(long_matrix(table, features)), base, "drift_reference", version, "histogram")
    return stores.report_rows(**report)
