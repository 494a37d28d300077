"""Sequence models over the last L points of one or several metrics: linear reconstruction and direct forecast.

Both are fitted from second moments that the executors sum from products at lags, so no
window is written down; the matrices are bounded by the window's length and the number of
metrics. A window is the flat array of its points' values, the oldest point first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pulsewarden.config import DEFAULTS
from pulsewarden.functions.linalg import over_windows, second_moments, stretches
from pulsewarden.functions.scalars import nan_to_num
from pulsewarden.operators import ordering as o
from pulsewarden.operators.detectors.base import Detector, StoredModel
from pulsewarden.operators.percentiles import exact_percentile
from pulsewarden.operators.rolling import sequences
from pulsewarden.session import materialize


def error_score(error: Column, threshold: Column) -> Column:
    """``min(1, error / (2·threshold))``; 0 without a threshold."""
    return F.when(threshold > 0, F.least(F.lit(1.0), error / (2 * threshold))).otherwise(0.0)


def feature_list(value: str | Sequence[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def averages(df: DataFrame, features: Sequence[str]) -> list[float]:
    """Means of the cleaned features, to centre sums on."""
    row = df.agg(*[F.avg(nan_to_num(F.col(f))) for f in features]).first()
    return [float(x or 0.0) for x in row]


def left_pad(sequence: Column, length: int) -> Column:
    """The last ``length`` values, zeros in front of a short sequence."""
    zeros = F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), length - F.size(sequence)))
    return F.concat(zeros, F.slice(sequence, F.greatest(F.lit(1), F.size(sequence) - length + 1), length))


@dataclass(frozen=True)
class WindowState:
    """Mergeable training state of windows: their second moments around ``pivot``, and the last points of
    each series, which the next windows begin with."""

    moments: np.ndarray
    pivot: list[float]
    tail: DataFrame


def window_state(df: DataFrame, features: Sequence[str], window: int, keys: Sequence[str], order: Sequence[str],
                 before: WindowState | None = None, chunk_rows: int = 1 << 16) -> WindowState:
    """The state after the points ``df``, which come after those behind ``before``: only the new ones are read."""
    rows = df.select(*keys, *order, *features)
    pivot = averages(df, features) if before is None else before.pivot
    whole = rows if before is None else before.tail.unionByName(rows)
    # all windows that end in a new point: those of the tail alone are too short
    moments = second_moments(stretches(whole, features, window, keys, order, chunk_rows), window, pivot)
    tail = materialize(o.newest(whole, window - 1, keys, order) if window > 1 else whole.limit(0))
    return WindowState(moments if before is None else before.moments + moments, pivot, tail)


class SequenceReconstruction(Detector):
    """Principal components of standardised windows; the error is what they cannot rebuild.

    ``value`` names one metric or several columns of a wide table. Detected rows carry a
    ``sequence`` array. The threshold is a percentile of the training errors.
    """

    model_name = "lstm_autoencoder"

    def __init__(self, length: int = DEFAULTS.sequence_length, components: int = 8,
                 percentile: float = DEFAULTS.threshold_percentile,
                 keys: Sequence[str] = o.KEYS, order: Sequence[str] = o.ORDER, value: str | Sequence[str] = "value"):
        self.length, self.components, self.percentile = length, components, percentile
        self.keys, self.order, self.features = list(keys), list(order), feature_list(value)
        self.model = None

    @property
    def size(self) -> int:
        return self.length * len(self.features)

    def windows(self, points: DataFrame) -> DataFrame:
        rows = points.withColumns({f: nan_to_num(F.col(f)) for f in self.features})
        value = self.features[0] if len(self.features) == 1 else self.features
        return sequences(rows, self.length, value, self.keys, self.order)

    def train(self, df: DataFrame, chunk_rows: int = 1 << 16) -> DataFrame | None:
        chunks = stretches(df, self.features, self.length, self.keys, self.order, chunk_rows)
        pivot = averages(df, self.features)
        params = self.parameters(second_moments(chunks, self.length, pivot), pivot)
        return None if params is None else self._with_threshold(params, chunks)

    def state(self, df: DataFrame, before: WindowState | None = None) -> WindowState:
        """Training state after ``df``; see ``window_state``."""
        return window_state(df, self.features, self.length, self.keys, self.order, before)

    def train_from(self, state: WindowState, recent: DataFrame) -> DataFrame | None:
        """The components of ``train`` on all points behind ``state``; the threshold comes from ``recent`` points."""
        params = self.parameters(state.moments, state.pivot)
        return None if params is None else self._with_threshold(
            params, stretches(recent, self.features, self.length, self.keys, self.order))

    def _with_threshold(self, params: dict, chunks: DataFrame) -> DataFrame:
        errors = materialize(over_windows(chunks, self.length, self._rebuild(params)))
        params["threshold"] = float(exact_percentile(errors, self.percentile).first()["percentile"])
        self.model = chunks.sparkSession.createDataFrame(
            [params], "mean array<double>, scale array<double>, basis array<double>, n_sequences long, threshold double"
        )
        return self.model

    def parameters(self, moments: np.ndarray, pivot: Sequence[float]) -> dict | None:
        """Mean, scale and principal components of the windows, from their moments around ``pivot``."""
        n = moments[0, 0]
        if n < 2:
            return None
        mean = moments[0, 1:] / n
        cov = moments[1:, 1:] / n - np.outer(mean, mean)
        scale = np.sqrt(np.clip(np.diag(cov), 0, None))
        scale[scale == 0] = 1.0
        _, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
        basis = vectors[:, ::-1][:, : min(self.components, self.size)]
        return {"mean": (mean + np.tile(pivot, self.length)).tolist(), "scale": scale.tolist(),
                "basis": basis.ravel().tolist(), "n_sequences": int(n)}

    @staticmethod
    def _rebuild(params: dict):
        mean, scale = np.array(params["mean"]), np.array(params["scale"])
        basis = np.array(params["basis"]).reshape(len(mean), -1)

        def error(windows: np.ndarray) -> np.ndarray:
            z = (windows - mean) / scale
            rest = z - (z @ basis) @ basis.T
            return (rest * rest).mean(axis=1)

        return error

    def _error(self, params: dict):
        error, size = self._rebuild(params), len(params["mean"])

        @F.arrow_udf("double")
        def reconstruction_error(rows: pa.Array) -> pa.Array:
            return pa.array(error(rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)))

        return reconstruction_error.asNondeterministic()

    def score(self, df: DataFrame) -> DataFrame:
        params = self.model.first().asDict()
        padded = left_pad(F.transform("sequence", nan_to_num), self.size)
        threshold = F.lit(params["threshold"])
        out = df.withColumn("reconstruction_error", self._error(params)(padded))
        return out.withColumns({
            "threshold": threshold,
            "anomaly_score": error_score(F.col("reconstruction_error"), threshold),
            "is_anomaly": F.col("reconstruction_error") > threshold,
        })


class SequenceForecaster(StoredModel):
    """Next ``horizon`` values of the first metric from the last ``length`` points of all, by ridge regression."""

    model_name = "lstm_forecaster"

    def __init__(self, length: int = DEFAULTS.sequence_length, horizon: int = DEFAULTS.horizon_steps,
                 ridge: float = 1e-3, keys: Sequence[str] = o.KEYS, order: Sequence[str] = o.ORDER,
                 value: str | Sequence[str] = "value"):
        self.length, self.horizon, self.ridge = length, horizon, ridge
        self.keys, self.order, self.features = list(keys), list(order), feature_list(value)
        self.model = None

    def train(self, df: DataFrame, chunk_rows: int = 1 << 16) -> DataFrame | None:
        f, whole = len(self.features), self.length + self.horizon
        pivot = averages(df, self.features)
        chunks = stretches(df, self.features, whole, self.keys, self.order, chunk_rows)
        moments = second_moments(chunks, whole, pivot)
        if moments[0, 0] < 2:
            return None
        k = 1 + self.length * f
        targets = k + f * np.arange(self.horizon)  # the first metric behind the window
        penalty = self.ridge * np.trace(moments[1:k, 1:k]) / (k - 1) * np.eye(k)
        penalty[0, 0] = 0.0
        weights = np.linalg.solve(moments[:k, :k] + penalty, moments[:k, targets])
        self.model = df.sparkSession.createDataFrame(
            [{"weights": weights.ravel().tolist(), "pivot": pivot}], "weights array<double>, pivot array<double>"
        )
        return self.model

    def latest_windows(self, points: DataFrame) -> DataFrame:
        """Last window of every series; a short one gets zeros in front."""
        last = o.newest(points.select(*self.keys, *self.order, *self.features), self.length, self.keys, self.order)
        row = F.array(*[nan_to_num(F.col(f)) for f in self.features])
        ordered = F.sort_array(F.collect_list(F.struct(*self.order, row.alias("_v"))))
        values = F.flatten(F.transform(ordered, lambda r: r["_v"]))
        return last.groupBy(*self.keys).agg(left_pad(values, self.length * len(self.features)).alias("sequence"))

    def forecast(self, points: DataFrame) -> DataFrame:
        """``forecast array<double>`` per series, from its last window."""
        model = self.model.first()
        pivot = np.array(model["pivot"])
        centre = np.tile(pivot, self.length)
        weights = np.array(model["weights"]).reshape(len(centre) + 1, -1)

        @F.pandas_udf("array<double>")
        def predict(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            x = np.vstack(rows.to_numpy()) - centre
            return pd.Series(list(weights[0] + x @ weights[1:] + pivot[0]))

        return self.latest_windows(points).select(*self.keys, predict("sequence").alias("forecast"))
