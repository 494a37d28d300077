"""Default settings; every field can be overridden by keyword."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Severity:
    name: str
    min_score: float
    color: str


# Severity levels, lowest first.
SEVERITY_LEVELS = (
    Severity("info", 0.5, "#36a3eb"),
    Severity("warning", 0.7, "#f5a623"),
    Severity("critical", 0.85, "#e74c3c"),
)

# Ensemble weights by model name.
MODEL_WEIGHTS = {
    "isolation_forest": 0.4,
    "lstm_autoencoder": 0.4,
    "holt_winters": 0.2,
}

# Advice shown with an alert, by metric name.
SUGGESTED_ACTIONS = {
    "cpu_usage": "Investigate high CPU usage — check for runaway processes, consider scaling",
    "memory_usage": "Check for memory leaks, consider adding resources or restarting service",
    "disk_io_util": "Investigate high disk I/O — check for heavy writes, disk contention",
    "network_in": "Investigate network ingress spike — check for DDoS or traffic surge",
    "network_out": "Investigate network egress spike — check for data exfiltration or surge",
    "iowait": "Investigate I/O wait — check disk health and optimize I/O patterns",
    "error_rate": "Investigate increased error rate — check application logs for root cause",
    "load_avg_5m": "Investigate high load average — check running processes and resource allocation",
}
DEFAULT_ACTION = "Investigate the anomalous metric behavior"


# The default settings.
@dataclass(frozen=True)
class Settings:
    windows: tuple[int, ...] = (5, 15, 60)
    stats: tuple[str, ...] = ("mean", "std", "min", "max", "skew", "kurtosis")
    points_per_minute: int = 12
    min_points: int = 5
    ready_points: int = 10

    contamination: float = 0.05
    n_trees: int = 100
    max_samples: int = 256
    seed: int = 42

    sequence_length: int = 60
    threshold_percentile: float = 95.0
    horizon_steps: int = 24

    seasonal_periods: int = 288
    min_samples: int = 1000

    ensemble_method: str = "weighted"
    ensemble_threshold: float = 0.7
    weights: dict[str, float] = field(default_factory=lambda: dict(MODEL_WEIGHTS))

    drift_threshold: float = 0.15
    retrain_on_drift: bool = True

    severity_levels: tuple[Severity, ...] = SEVERITY_LEVELS
    cooldown_minutes: float = 30
    max_alerts_per_hour: int = 50
    dedup_minutes: int = 5
    dashboard_base: str = ""

    retention_days: int = 90
    downsample: str = "5 minutes"

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)


DEFAULTS = Settings()
