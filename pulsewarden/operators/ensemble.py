"""Combining detectors. Input rows: ``(obs, model_name, anomaly_score, is_anomaly)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pulsewarden.config import DEFAULTS


def model_weight(name: Column, n_models: Column, weights: Mapping[str, float]) -> Column:
    """Configured weight, ``1/n`` for a model without one."""
    out = 1.0 / n_models
    for model, weight in weights.items():
        out = F.when(name == model, F.lit(float(weight))).otherwise(out)
    return out


def weighted(detections: DataFrame, weights: Mapping[str, float] = DEFAULTS.weights,
             threshold: float = DEFAULTS.ensemble_threshold, obs: Sequence[str] = ("obs",)) -> DataFrame:
    """Weighted mean score of the models present; anomalous above ``threshold``.

    The weight 1/n of an unlisted model needs the number of models, so listed and
    unlisted scores are summed apart and combined afterwards: one aggregation.
    """
    listed = F.col("model_name").isin(*weights) if weights else F.lit(False)
    w = F.when(listed, model_weight(F.col("model_name"), F.lit(1.0), weights))
    score = F.col("anomaly_score")
    sums = detections.groupBy(*obs).agg(
        F.count("*").alias("n_models"),
        F.coalesce(F.sum(w * score), F.lit(0.0)).alias("_ws"),
        F.coalesce(F.sum(w), F.lit(0.0)).alias("_w"),
        F.coalesce(F.sum(F.when(~listed, score)), F.lit(0.0)).alias("_us"),
        F.sum(F.when(listed, 0).otherwise(1)).alias("_un"),
        F.sort_array(F.collect_list(F.struct("model_name", F.round(score, 4).alias("score"), "is_anomaly"))).alias("models"),
    )
    total = F.col("_w") + F.col("_un") / F.col("n_models")
    final = F.coalesce(F.try_divide(F.col("_ws") + F.col("_us") / F.col("n_models"), total), F.lit(0.0))
    return sums.select(
        *obs, final.alias("anomaly_score"), (final > threshold).alias("is_anomaly"),
        F.round(total, 4).alias("total_weight"), "n_models", "models",
    )


def majority(detections: DataFrame, obs: Sequence[str] = ("obs",)) -> DataFrame:
    """Anomalous when more than half of the models say so; mean score."""
    count = F.sum(F.col("is_anomaly").cast("int"))
    return detections.groupBy(*obs).agg(
        F.avg("anomaly_score").alias("anomaly_score"),
        (count > F.count("*") / 2).alias("is_anomaly"),
        count.alias("anomaly_count"),
        F.count("*").alias("n_models"),
    )


def any_flag(detections: DataFrame, obs: Sequence[str] = ("obs",)) -> DataFrame:
    """Anomalous when one model says so; highest score and the models that flagged."""
    flagged = F.collect_list(F.when(F.col("is_anomaly"), F.col("model_name")))
    return detections.groupBy(*obs).agg(
        F.max("anomaly_score").alias("anomaly_score"),
        F.bool_or("is_anomaly").alias("is_anomaly"),
        F.sort_array(flagged).alias("flagging_models"),
        F.count("*").alias("n_models"),
    )


#: What the methods tell besides the verdict.
DETAILS = ("models", "total_weight", "anomaly_count", "flagging_models")
METHODS = {"weighted": weighted, "majority": majority, "any": any_flag}


def ensemble(observations: DataFrame, detections: DataFrame, method: str = DEFAULTS.ensemble_method,
             obs: Sequence[str] = ("obs",), **kw) -> DataFrame:
    """Verdict for every observation, with the method's details; one no model scored gets 0 and an error note."""
    verdict = METHODS.get(method, weighted)(detections, obs=obs, **kw)
    known = observations.select(*obs).distinct()
    joined = known.join(verdict, list(obs), "left")
    return joined.select(
        *obs,
        F.coalesce("anomaly_score", F.lit(0.0)).alias("anomaly_score"),
        F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"),
        F.lit(method if method in METHODS else "weighted").alias("method"),
        F.coalesce("n_models", F.lit(0)).alias("n_models"),
        *[c for c in DETAILS if c in verdict.columns],
        F.when(F.col("n_models").isNull(), "no trained models in ensemble").alias("error"),
    )


def attach_forecast(verdicts: DataFrame, sequence: DataFrame | None, smoothing: DataFrame | None,
                    keys: Sequence[str] = ("server_id", "name"), steps: int = DEFAULTS.horizon_steps) -> DataFrame:
    """Forecast of the sequence model, else of Holt-Winters, as ``prediction_horizon``.

    Each forecast table has the keys and ``forecast array<double>``.
    """
    out, found = verdicts, []
    for source, table in (("lstm", sequence), ("holt_winters", smoothing)):
        if table is None:
            continue
        col = f"_f_{source}"
        out = out.join(table.select(*keys, F.col("forecast").alias(col)), list(keys), "left")
        rounded = F.transform(F.slice(col, 1, steps), lambda v: F.round(v, 4))
        found.append((col, F.when(F.col(col).isNotNull(), F.struct(
            F.lit(source).alias("source"), rounded.alias("values"), F.lit(steps).alias("steps")))))
    if not found:
        return verdicts
    horizon = F.coalesce(*[f for _, f in found])
    return out.withColumn("prediction_horizon", horizon).drop(*[c for c, _ in found])


def predictions(asked: DataFrame, latest: DataFrame, detections: DataFrame, sequence: DataFrame | None,
                smoothing: DataFrame | None, method: str = DEFAULTS.ensemble_method,
                steps: int = DEFAULTS.horizon_steps) -> DataFrame:
    """Score and forecast for the servers ``asked`` from their latest feature row.

    ``latest`` has one row per server, ``detections`` the detectors' scores of it. A
    server without data or without a score gets 0 and a warning.
    """
    verdict = METHODS.get(method, weighted)(detections, obs=("server_id",))
    rows = attach_forecast(latest, sequence, smoothing, steps=steps)
    if "prediction_horizon" not in rows.columns:
        rows = rows.withColumn("prediction_horizon", F.lit(None))
    rows = rows.select("server_id", "prediction_horizon", F.lit(True).alias("_known"))
    joined = asked.select("server_id").distinct().join(rows, "server_id", "left").join(
        verdict.select("server_id", "anomaly_score"), "server_id", "left")
    return joined.select(
        "server_id", F.coalesce(F.round("anomaly_score", 4), F.lit(0.0)).alias("anomaly_score"), "prediction_horizon",
        F.when(F.col("_known").isNull(), "no data buffered for this server")
        .when(F.col("anomaly_score").isNull(), "no trained models available").alias("warning"),
    )


class EnsembleRegistry:
    """Detectors by name with their weights; a detector counts once it has a model."""

    def __init__(self, method: str = DEFAULTS.ensemble_method, weights: Mapping[str, float] | None = None):
        self.method = method
        self.weights = dict(DEFAULTS.weights if weights is None else weights)
        self.detectors: dict[str, object] = {}

    def register(self, name: str, detector, weight: float | None = None) -> None:
        self.detectors[name] = detector
        if weight is not None:
            self.weights[name] = weight

    @property
    def active(self) -> list[str]:
        return [n for n, d in self.detectors.items() if getattr(d, "model", None) is not None]

    def detect(self, observations: DataFrame, inputs: Mapping[str, DataFrame], obs: Sequence[str] = ("obs",)) -> DataFrame:
        """Score ``inputs[name]`` by each active detector and combine per observation."""
        scored = None
        for name in self.active:
            if name not in inputs:
                continue
            rows = self.detectors[name].score(inputs[name]).select(
                *obs, F.lit(name).alias("model_name"), "anomaly_score", "is_anomaly"
            )
            scored = rows if scored is None else scored.unionByName(rows)
        if scored is None:
            return observations.select(*obs).distinct().select(
                *obs, F.lit(0.0).alias("anomaly_score"), F.lit(False).alias("is_anomaly"),
                F.lit(self.method).alias("method"), F.lit(0).cast("bigint").alias("n_models"),
                F.lit("no trained models in ensemble").alias("error"),
            )
        kw = {"weights": self.weights} if METHODS.get(self.method, weighted) is weighted else {}
        return ensemble(observations, scored, self.method, obs, **kw)
