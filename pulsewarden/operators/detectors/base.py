"""What every model and detector offers."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame

from pulsewarden.sinks.stores import load_model, store_model


class StoredModel(ABC):
    """``train`` fits and keeps a model table; being a DataFrame, it is stored and loaded as a table."""

    model_name: str
    model: DataFrame | None = None

    @abstractmethod
    def train(self, df: DataFrame) -> DataFrame | None: ...

    @property
    def is_trained(self) -> bool:
        return self.model is not None

    def save(self, base: str, version: str = "1.0.0", metrics: dict[str, float] | None = None) -> str:
        """Store the model table and register it; the version is the active one from then on."""
        return store_model(self.model, base, self.model_name, version, type(self).__name__, metrics)

    def load(self, spark, base: str, version: str | None = None) -> "StoredModel":
        """Of the given version, else the active one."""
        self.model = load_model(spark, base, self.model_name, version)
        return self


class Detector(StoredModel):
    """``score`` adds ``anomaly_score`` in [0, 1] and ``is_anomaly`` to its rows."""

    @abstractmethod
    def score(self, df: DataFrame) -> DataFrame: ...
