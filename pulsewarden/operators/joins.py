"""Look-ups by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pulsewarden.operators.alerts import suggested_action


def with_action(df: DataFrame, metric: str = "metric_name") -> DataFrame:
    return df.withColumn("suggested_action", suggested_action(F.col(metric)))


def with_model(points: DataFrame, models: DataFrame, keys: Sequence[str] = ("server_id", "name")) -> DataFrame:
    """Points of the series that have a model, with its columns.

    Spark broadcasts the model table when its size allows, else it sorts and merges
    and splits hot series at run time.
    """
    return points.join(models, list(keys))


def with_truth(predictions: DataFrame, truth: DataFrame, key: str, label: str = "truth") -> DataFrame:
    """Predictions with ground truth; a row without truth counts as normal (0)."""
    return predictions.join(truth, key, "left").withColumn(label, F.coalesce(F.col(label), F.lit(0)))


def having_reference(df: DataFrame, reference: DataFrame, key: str = "name") -> DataFrame:
    return df.join(reference.select(key), key, "left_semi")


def merge_sources(*sources: DataFrame) -> DataFrame:
    """One flow of points from several sources, matched by column name."""
    out = sources[0]
    for df in sources[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def latest_per_server(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Newest feature row of every server."""
    return features.groupBy("server_id").agg(
        F.max_by(F.struct(*columns), F.struct("timestamp", "seq")).alias("_r")
    ).select("server_id", "_r.*")
