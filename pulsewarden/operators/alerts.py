"""From detections to alerts: grading, suppression, rules, acknowledgement, look-ups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pulsewarden.config import DEFAULT_ACTION, DEFAULTS, SUGGESTED_ACTIONS, Settings
from pulsewarden.functions import scalars as s
from pulsewarden.operators.ordering import first_per_key
from pulsewarden.operators.suppression import suppress
from pulsewarden.schema import HORIZON_TYPE
from pulsewarden.session import sized


def suggested_action(metric: Column) -> Column:
    """Advice for a metric, or the default text."""
    table = F.create_map(*[F.lit(x) for pair in SUGGESTED_ACTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, metric), F.lit(DEFAULT_ACTION))


def alert_id(*parts: Column) -> Column:
    """Id that depends only on the alert's content, so a replay gives the same id."""
    return F.concat(F.lit("alt_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))


def _column(df: DataFrame, name: str, dtype) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def grade(detections: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Severity of every detection worth an alert."""
    score, flag = F.col("anomaly_score"), F.col("is_anomaly")
    return detections.withColumn("severity", s.severity(score, settings.severity_levels)).filter(
        s.alert_gate(flag, score, settings.severity_levels)
    )


def build_alerts(graded: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Alert rows (without suppression). Optional inputs: ``actual``, ``forecast``,
    ``prediction_horizon``, ``model_details``, ``correlation_id``."""
    horizon = _column(graded, "prediction_horizon", HORIZON_TYPE)
    predicted = horizon.isNotNull()
    server, metric = F.col("server_id"), F.col("metric_name")
    details = "map<string,double>"
    return graded.select(
        alert_id(server, metric, F.col("severity"), F.unix_micros("timestamp").cast("string"),
                 F.col("seq").cast("string")).alias("alert_id"),
        "server_id", "metric_name", "anomaly_score", "severity",
        predicted.alias("is_predicted"),
        horizon.alias("prediction_horizon"),
        s.alert_message(server, metric, F.col("anomaly_score"), predicted,
                        _column(graded, "actual", "double"), _column(graded, "forecast", "double"),
                        settings.severity_levels).alias("message"),
        suggested_action(metric).alias("suggested_action"),
        F.coalesce(_column(graded, "model_details", details), F.create_map().cast(details)).alias("model_details"),
        s.dashboard_url(server, settings.dashboard_base).alias("dashboard_url"),
        "timestamp",
        F.coalesce(_column(graded, "correlation_id", "string"), F.lit("")).alias("correlation_id"),
        F.lit(False).alias("acknowledged"),
        F.lit("").alias("acknowledged_by"),
        "seq",
    )


def attribute_metric(verdicts: DataFrame, scores: DataFrame, obs: Sequence[str] = ("obs",)) -> DataFrame:
    """Name each verdict's metric: the one with the highest score of its own.

    ``scores`` has the observation, ``name`` and ``score``; without any the metric is
    ``unknown``.
    """
    top = scores.groupBy(*obs).agg(F.max_by("name", F.struct("score", "name")).alias("metric_name"))
    named = verdicts.drop("metric_name").join(top, list(obs), "left")
    return named.withColumn("metric_name", F.coalesce("metric_name", F.lit("unknown")))


def evaluate(detections: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Gate, suppress and describe: the alerts of a batch of detections."""
    passed = suppress(grade(detections, settings), settings.cooldown_minutes, settings.max_alerts_per_hour)
    return build_alerts(passed, settings)


@dataclass(frozen=True)
class AlertRule:
    name: str
    metric_pattern: str = "*"
    threshold: float = 0.7
    severity: str = "warning"
    condition_type: str = "anomaly_score"
    cooldown_min: int = 30
    enabled: bool = True


RULE = "name string, metric_pattern string, threshold double, severity string, condition_type string, cooldown_min int, enabled boolean"
#: Characters that a shell pattern may begin a wildcard with.
_WILD = r"[*?\[]"


def rule_table(spark: SparkSession, rules: Sequence[AlertRule]) -> DataFrame:
    return spark.createDataFrame([(r.name, r.metric_pattern, float(r.threshold), r.severity, r.condition_type, r.cooldown_min, r.enabled)
                                  for r in rules], RULE)


@F.pandas_udf(T.StringType())
def _regex_of(patterns: pd.Series) -> pd.Series:
    return patterns.map(s.glob_regex, na_action="ignore")


def rule_index(rules: DataFrame) -> DataFrame:
    """Enabled rules by the longer of the literal ends of their patterns.

    ``side`` says which end (0 the beginning), ``literal`` what it is, ``regex`` verifies. A
    pattern without a wildcard is its own beginning.
    """
    pattern = F.col("metric_pattern")
    before = F.regexp_extract(pattern, rf"(?s)\A(.*?)(?:{_WILD}|\z)", 1)
    # behind a set's end any character may still belong to the set, so only what follows * or ? is literal
    after = F.when(pattern.rlike(r"\["), "").otherwise(F.regexp_extract(pattern, r"(?s)([^*?]*)\z", 1))
    side = (F.length(after) > F.length(before)).cast("int")
    return rules.filter(F.coalesce("enabled", F.lit(True))).select(
        F.col("name").alias("rule"), "threshold", F.col("severity").alias("rule_severity"),
        side.alias("side"), F.when(side == 1, after).otherwise(before).alias("literal"), _regex_of(pattern).alias("regex"))


def match_rules(df: DataFrame, rules: Sequence[AlertRule] | DataFrame, metric: str = "metric_name") -> DataFrame:
    """Rows with every enabled rule whose pattern fits the metric.

    A short configured list is tried in passing: one pass over the rows, no join. A table of
    rules is looked up: the distinct metrics probe ``rule_index`` with their own beginnings
    and ends, of the lengths that occur there, by equal literals; the pattern only verifies
    what is found, and rows meet the rules of their metric.
    """
    columns = ("rule", "threshold", "rule_severity")
    if isinstance(rules, DataFrame):
        index = sized(rule_index(rules))
        lengths = index.groupBy("side").agg(F.collect_set(F.length("literal")).alias("n")).collect()  # no longer than patterns are
        probes = [F.struct(F.lit(r["side"]).alias("side"), literal.alias("literal"))
                  for r in lengths for n in sorted(r["n"])
                  for literal in [F.when(F.length("_m") >= n, F.substring("_m", 1, n) if r["side"] == 0 else F.expr(f"right(_m, {n})"))]]
        if not probes:
            return match_rules(df, ())
        names = df.select(F.col(metric).alias("_m")).distinct()
        asked = names.select("_m", F.inline(F.array(*probes))).filter("literal IS NOT NULL")
        fits = sized(asked.join(index, ["side", "literal"]).filter(F.expr("_m RLIKE regex")).select("_m", *columns))
        kept = df.drop(*columns)
        return kept.join(fits, kept[metric] == fits["_m"]).drop("_m")
    enabled = [r for r in rules if r.enabled]
    if not enabled:
        return df.limit(0).withColumns({c: F.lit(None).cast("double" if c == "threshold" else "string") for c in columns})
    candidates = F.array(*[
        F.struct(
            F.lit(r.name).alias("rule"), F.lit(float(r.threshold)).alias("threshold"),
            F.lit(r.severity).alias("rule_severity"),
            F.col(metric).rlike(s.glob_regex(r.metric_pattern)).alias("fits"),
        ) for r in enabled
    ])
    fitting = F.filter(candidates, lambda r: r["fits"])
    return df.drop(*columns).select("*", F.inline(fitting)).drop("fits")


def apply_rules(detections: DataFrame, rules: Sequence[AlertRule] | DataFrame) -> DataFrame:
    """Detections that reach the threshold of a fitting rule."""
    return match_rules(detections, rules).filter(F.col("anomaly_score") >= F.col("threshold"))


def dedupe_key(server: Column, metric: Column) -> Column:
    return F.concat(F.lit("anomaly-"), server, F.lit("-"), metric)


def dedupe_for_paging(alerts: DataFrame, minutes: int = DEFAULTS.dedup_minutes) -> DataFrame:
    """Alerts that page: none within ``minutes`` of the last one sent under the same key."""
    keyed = alerts.withColumn("dedup_key", dedupe_key(F.col("server_id"), F.col("metric_name")))
    never = ceil(60 / minutes)  # as many as the span itself lets through in an hour
    return suppress(keyed, minutes, never, keys=("dedup_key",))


def acknowledge(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Alerts with their latest acknowledgement ``(alert_id, acknowledged_by, acked_at)``."""
    last = acks.groupBy("alert_id").agg(F.max_by("acknowledged_by", "acked_at").alias("_by"))
    return alerts.join(last, "alert_id", "left").withColumns({
        "acknowledged": F.coalesce("acknowledged", F.lit(False)) | F.col("_by").isNotNull(),
        "acknowledged_by": F.coalesce("_by", "acknowledged_by"),
    }).drop("_by")


def recent_alerts(alerts: DataFrame, limit: int = 50, severity: str | None = None,
                  server: str | None = None) -> DataFrame:
    """Newest ``limit`` alerts after filtering, oldest first."""
    if severity:
        alerts = alerts.filter(F.col("severity") == severity)
    if server:
        alerts = alerts.filter(F.col("server_id") == server)
    newest = alerts.orderBy(F.desc("timestamp"), F.desc("seq")).limit(limit)
    return newest.orderBy("timestamp", "seq")


def history(alerts: DataFrame, cap: int = 1000) -> DataFrame:
    return recent_alerts(alerts, cap)


def alert_by_id(alerts: DataFrame, wanted: str) -> DataFrame:
    return alerts.filter(F.col("alert_id") == wanted)
