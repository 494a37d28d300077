"""Registered queries, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Decimal ties (x.xxxxxx5) come out of sums either way; both sides are moved off
# them by the same amount before rounding.
NUDGE = 1.3e-9


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + NUDGE, 6)


def sql6(x: str) -> str:
    return f"(round(({x}) + {NUDGE}, 6) + 0.0)"


def ntz(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


# ---- inputs ------------------------------------------------------------------

#: Metric points: eight servers, one metric per event type.
POINTS = """
p AS (SELECT 'srv-' || (user_id % 8) AS server_id, event_type AS name, ts AS timestamp, value,
             event_id AS seq, user_id FROM events)
"""


def points(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("srv-"), (F.col("user_id") % 8).cast("string")).alias("server_id"),
        F.col("event_type").alias("name"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        "value",
        F.col("event_id").alias("seq"),
        *extra,
    )


METRIC_OF = {
    "view": "cpu_usage", "click": "memory_usage", "purchase": "disk_io_util",
    "signup": "error_rate", "error": "queue_depth",
}

#: One verdict per event, with a forecast except for clicks; signups are predictions.
VERDICTS = POINTS.rstrip() + """,
v AS (SELECT seq AS obs, server_id,
             CASE name WHEN 'view' THEN 'cpu_usage' WHEN 'click' THEN 'memory_usage'
                       WHEN 'purchase' THEN 'disk_io_util' WHEN 'signup' THEN 'error_rate'
                       ELSE 'queue_depth' END AS metric_name,
             timestamp, seq, least(1.0, value / 120.0) AS anomaly_score,
             least(1.0, value / 120.0) > 0.7 AS is_anomaly, value AS actual,
             CASE WHEN name = 'click' THEN NULL ELSE 50.0 END AS forecast,
             name = 'signup' AS is_predicted
      FROM p)
"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    name = F.col("name")
    metric = F.lit("queue_depth")
    for event, m in METRIC_OF.items():
        metric = F.when(name == event, F.lit(m)).otherwise(metric)
    score = F.least(F.lit(1.0), F.col("value") / 120.0)
    horizon = F.struct(
        F.lit("holt_winters").alias("source"), F.array(F.col("value")).alias("values"), F.lit(1).alias("steps")
    )
    return p.select(
        F.col("seq").alias("obs"), "server_id", metric.alias("metric_name"), "timestamp", "seq",
        score.alias("anomaly_score"), (score > 0.7).alias("is_anomaly"), F.col("value").alias("actual"),
        F.when(name != "click", 50.0).alias("forecast"),
        F.when(name == "signup", horizon).alias("prediction_horizon"),
    )


#: Up to four detectors per event; one of them has no configured weight.
DETECTIONS = POINTS.rstrip() + """,
d AS (SELECT seq AS obs, server_id, 'isolation_forest' AS model_name, least(1.0, value / 120.0) AS anomaly_score,
             least(1.0, value / 120.0) > 0.5 AS is_anomaly FROM p
      UNION ALL
      SELECT seq, server_id, 'lstm_autoencoder', least(1.0, abs(value - 40.0) / 150.0),
             least(1.0, abs(value - 40.0) / 150.0) > 0.6 FROM p WHERE name <> 'signup'
      UNION ALL
      SELECT seq, server_id, 'holt_winters', least(1.0, abs(value - 50.0) / 200.0),
             least(1.0, abs(value - 50.0) / 200.0) > 0.7 FROM p WHERE name <> 'click'
      UNION ALL
      SELECT seq, server_id, 'custom_model', least(1.0, value / 80.0), least(1.0, value / 80.0) > 0.5
      FROM p WHERE name = 'view')
"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    v, name = F.col("value"), F.col("name")
    models = [
        ("isolation_forest", v / 120.0, 0.5, F.lit(True)),
        ("lstm_autoencoder", F.abs(v - 40.0) / 150.0, 0.6, name != "signup"),
        ("holt_winters", F.abs(v - 50.0) / 200.0, 0.7, name != "click"),
        ("custom_model", v / 80.0, 0.5, name == "view"),
    ]
    rows = F.filter(F.array(*[
        F.when(present, F.struct(
            F.lit(model).alias("model_name"), F.least(F.lit(1.0), s).alias("anomaly_score"),
            (F.least(F.lit(1.0), s) > cut).alias("is_anomaly")))
        for model, s, cut, present in models
    ]), lambda r: r.isNotNull())
    return p.select(F.col("seq").alias("obs"), "server_id", F.inline(rows))


#: Alerts of a cooldown-free batch: every verdict that passes the gate.
SEVERITY_SQL = "CASE WHEN {0} >= 0.85 THEN 'critical' WHEN {0} >= 0.7 THEN 'warning' ELSE 'info' END"
GRADED = VERDICTS.rstrip() + f""",
g AS (SELECT *, {SEVERITY_SQL.format('anomaly_score')} AS severity FROM v
      WHERE is_anomaly OR {SEVERITY_SQL.format('anomaly_score')} <> 'info')
"""
