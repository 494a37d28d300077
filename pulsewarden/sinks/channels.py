"""Notification payloads: one JSON text per alert and channel."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pulsewarden.config import DEFAULTS
from pulsewarden.functions.scalars import alert_json, fixed, iso_time
from pulsewarden.operators.alerts import dedupe_key


class Channel(ABC):
    """A channel turns an alert row into the text it would deliver."""

    name: str

    @abstractmethod
    def payload(self) -> Column: ...

    def format(self, alerts: DataFrame) -> DataFrame:
        return alerts.select("alert_id", F.lit(self.name).alias("channel"), self.payload().alias("payload"))


def _text(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), text.alias("text"))


class Webhook(Channel):
    name = "webhook"

    def payload(self) -> Column:
        return alert_json()


class Slack(Channel):
    name = "slack"
    # Sign shown before the title, by severity.
    SIGNS = {"info": "i", "warning": "w", "critical": "c"}

    def __init__(self, channel: str = "#alerts", username: str = "Anomaly Detector", levels=DEFAULTS.severity_levels):
        self.channel, self.username, self.levels = channel, username, levels

    def payload(self) -> Column:
        severity = F.col("severity")
        sign, color = F.lit("⚠️"), F.lit("#999")
        for name, mark in self.SIGNS.items():
            sign = F.when(severity == name, F.lit(mark)).otherwise(sign)
        for level in self.levels:
            color = F.when(severity == level.name, F.lit(level.color)).otherwise(color)

        def field(label: str, value: Column) -> Column:
            return _text("mrkdwn", F.concat(F.lit(f"*{label}:* "), value))

        def code(value: Column) -> Column:
            return F.concat(F.lit("`"), value, F.lit("`"))

        def section(text: Column) -> Column:
            return F.to_json(F.struct(F.lit("section").alias("type"), text.alias("text")))

        header = F.to_json(F.struct(F.lit("header").alias("type"), _text(
            "plain_text", F.concat(sign, F.lit(" Anomaly Alert — "), F.upper(severity))).alias("text")))
        fields = F.to_json(F.struct(F.lit("section").alias("type"), F.array(
            field("Server", code(F.col("server_id"))),
            field("Metric", code(F.col("metric_name"))),
            field("Score", code(fixed(F.col("anomaly_score"), 2))),
            field("Predicted", F.when(F.col("is_predicted"), "Yes").otherwise("No")),
        ).alias("fields")))
        button = F.to_json(F.struct(F.lit("actions").alias("type"), F.array(F.struct(
            F.lit("button").alias("type"), _text("plain_text", F.lit("View Dashboard")).alias("text"),
            F.col("dashboard_url").alias("url"),
        )).alias("elements")))
        # blocks differ in shape, so each is rendered on its own
        blocks = F.concat_ws(
            ",", header, fields, section(field("Message", F.col("message"))),
            section(field("Suggested Action", F.col("suggested_action"))),
            F.when(F.col("dashboard_url") != "", button),
        )
        head = F.to_json(F.struct(F.lit(self.channel).alias("channel"), F.lit(self.username).alias("username")))
        # what follows the head takes the place of its closing brace
        return F.concat(
            head.substr(F.lit(1), F.length(head) - 1), F.lit(',"attachments":[{"color":"'), color,
            F.lit('","blocks":['), blocks, F.lit("]}]}"),
        )


class PagerDuty(Channel):
    name = "pagerduty"

    def __init__(self, routing_key: str = "", severity_map: Mapping[str, str] | None = None):
        self.routing_key = routing_key
        self.severity_map = severity_map or {"info": "info", "warning": "warning", "critical": "critical"}

    def payload(self) -> Column:
        grade = F.lit("warning")
        for name, mapped in self.severity_map.items():
            grade = F.when(F.col("severity") == name, F.lit(mapped)).otherwise(grade)
        return F.to_json(F.struct(
            F.lit(self.routing_key).alias("routing_key"),
            F.lit("trigger").alias("event_action"),
            dedupe_key(F.col("server_id"), F.col("metric_name")).alias("dedup_key"),
            F.struct(
                F.col("message").alias("summary"), grade.alias("severity"),
                F.col("server_id").alias("source"), F.col("metric_name").alias("component"),
                F.lit("infrastructure").alias("group"), F.lit("anomaly_detection").alias("class"),
                F.col("model_details").alias("custom_details"), iso_time(F.col("timestamp")).alias("timestamp"),
            ).alias("payload"),
        ))


class Email(Channel):
    name = "email"

    def __init__(self, sender: str = "", recipients: Sequence[str] = ()):
        self.sender, self.recipients = sender, tuple(recipients)

    def payload(self) -> Column:
        subject = F.concat(F.lit("["), F.upper("severity"), F.lit("] Anomaly: "),
                           F.col("metric_name"), F.lit(" on "), F.col("server_id"))
        return F.to_json(F.struct(
            F.lit(self.sender).alias("from"), F.lit(", ".join(self.recipients)).alias("to"),
            subject.alias("subject"), alert_json().alias("body"),
        ))


#: Rows of ``route_alerts``.
PAYLOAD = "alert_id string, channel string, payload string"


def route_alerts(alerts: DataFrame, channels: Sequence[Channel]) -> DataFrame:
    """One row per alert and channel. The channels are a short configured list."""
    if not channels:
        return alerts.limit(0).select("alert_id", F.lit("").alias("channel"), F.lit("").alias("payload"))
    pairs = F.array(*[F.struct(F.lit(c.name).alias("channel"), c.payload().alias("payload")) for c in channels])
    return alerts.select("alert_id", F.inline(pairs))


def delivery_results(outcomes: DataFrame) -> DataFrame:
    """``(alert_id, channel, ok)`` → success per channel, one map per alert."""
    pairs = F.sort_array(F.collect_set(F.struct("channel", "ok")))
    return outcomes.groupBy("alert_id", "channel").agg(F.bool_and("ok").alias("ok")).groupBy("alert_id").agg(
        F.map_from_entries(pairs).alias("results")
    )


def write_payloads(routed: DataFrame, path: str) -> None:
    routed.write.mode("append").partitionBy("channel").json(path)
