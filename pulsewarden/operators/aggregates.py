"""Aggregations over points, detections and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pulsewarden.functions.scalars import counter_severity
from pulsewarden.operators.ordering import numbered
from pulsewarden.session import sized


def latest_metrics(points: DataFrame, server: str | None = None) -> DataFrame:
    """Last value of every metric, one row per server and metric."""
    if server is not None:
        points = points.filter(F.col("server_id") == server)
    return points.groupBy("server_id", "name").agg(
        F.max_by("value", F.struct("timestamp", "seq")).alias("value"),
        F.max("timestamp").alias("timestamp"),
    )


def server_metrics(points: DataFrame, server: str | None = None) -> DataFrame:
    """The same as one map per server; a map has one entry per metric name."""
    pairs = F.sort_array(F.collect_list(F.struct("name", "value")))
    return latest_metrics(points, server).groupBy("server_id").agg(F.map_from_entries(pairs).alias("metrics"))


def servers(points: DataFrame) -> DataFrame:
    """Known servers with their number of series."""
    return points.select("server_id", "name").distinct().groupBy("server_id").agg(
        F.count("*").alias("n_windows")
    )


def server_status(points: DataFrame, active_models: Sequence[str]) -> DataFrame:
    """Latest metrics of each server with the models in use (a short list)."""
    return server_metrics(points).withColumn(
        "active_models", F.array(*[F.lit(m) for m in sorted(active_models)])
    )


def alert_stats(alerts: DataFrame) -> DataFrame:
    """Alert counts in total, by severity and by server, in one pass."""
    sets = [[], ["severity"], ["server_id"]]
    return alerts.groupingSets(
        [[F.col(c) for c in s] for s in sets], F.col("severity"), F.col("server_id")
    ).agg(F.count("*").alias("n_alerts"), F.grouping_id().alias("_level")).select(
        F.when(F.col("_level") == 3, "total").when(F.col("_level") == 1, "severity")
        .otherwise("server").alias("level"),
        F.coalesce("severity", "server_id", F.lit("all")).alias("key"),
        "n_alerts",
    )


def detection_counter(detections: DataFrame) -> DataFrame:
    """Anomalies per server and counter severity."""
    return (
        detections.filter("is_anomaly")
        .groupBy("server_id", counter_severity(F.col("anomaly_score")).alias("severity"))
        .agg(F.count("*").alias("n_detections"))
    )


def training_metrics(scored: DataFrame, n_features: int, raw: str = "raw_score") -> DataFrame:
    """Summary of a trained forest over its training scores."""
    return scored.agg(
        F.count("*").alias("n_samples"),
        F.lit(n_features).alias("n_features"),
        F.avg(raw).alias("score_mean"),
        F.stddev_pop(raw).alias("score_std"),
        F.avg((F.col(raw) < 0).cast("double")).alias("anomaly_rate"),
    )


def residual_stats(residuals: DataFrame, skip: str = "m", keys: Sequence[str] = ("server_id", "name")) -> DataFrame:
    """Population deviation and squared error of ``residual`` after the first ``skip`` points (``rn`` from 1)."""
    return residuals.filter(F.col("rn") > F.col(skip)).groupBy(*keys).agg(
        F.stddev_pop("residual").alias("residual_std"),
        F.sum(F.col("residual") * F.col("residual")).alias("sse"),
        F.count("*").alias("n_residuals"),
    )


def inference_stats(calls: DataFrame, alpha: float = 0.1, keys: Sequence[str] = ("model_name",),
                    order: Sequence[str] = ("timestamp", "seq")) -> DataFrame:
    """Calls, time of the last call and moving average of latency (starting at 0) per model.

    The average is a weighted sum over all calls: the i-th newest has weight
    ``alpha * (1 - alpha) ** (i - 1)``. Calls are numbered by place, without a window
    over a model's calls, and summed on the map side.
    """
    totals = sized(calls.groupBy(*keys).agg(
        F.count("*").alias("inference_count"), F.max(order[0]).alias("last_inference_at")
    ))
    rows = numbered(calls.select(*keys, *order, "latency_ms"), "_rn", keys, order).join(totals, list(keys))
    weight = alpha * F.pow(F.lit(1.0 - alpha), F.col("inference_count") - F.col("_rn"))
    return rows.groupBy(*keys).agg(
        F.first("inference_count").alias("inference_count"), F.first("last_inference_at").alias("last_inference_at"),
        F.sum(F.col("latency_ms") * weight).alias("avg_latency_ms"))


def buffer_status(features: DataFrame, limit: int) -> DataFrame:
    """Buffered rows per server when each keeps its newest ``limit``; no row is moved."""
    n = features.groupBy("server_id").agg(F.count("*").alias("_n"))
    return n.select("server_id", F.least("_n", F.lit(limit)).alias("n_buffered"))


def classification_report(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per class, from one confusion count."""
    confusion = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = confusion.select(F.inline(F.array(
        F.struct(F.col("t").alias("class"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"),
                 F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("claimed")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("hit"),
                 F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("claimed")),
    )))
    per = sides.groupBy("class").agg(
        F.sum("hit").alias("hit"), F.sum("actual").alias("support"), F.sum("claimed").alias("claimed")
    )
    precision = F.coalesce(F.try_divide("hit", "claimed"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return per.select(
        "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support"
    )
