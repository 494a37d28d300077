"""Alert service: evaluate detections, store what is new with its payloads, in one step."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsewarden.config import DEFAULTS, Settings
from pulsewarden.operators import alerts as al
from pulsewarden.operators.suppression import HISTORY, suppress, updated_history
from pulsewarden.schema import ALERT_SCHEMA
from pulsewarden.session import materialize
from pulsewarden.sinks.channels import PAYLOAD, Channel, route_alerts
from pulsewarden.sinks.outbox import Outbox

ALERTS, PAYLOADS, SUPPRESSION = "alerts", "payloads", "suppression"


def stored_alerts(spark: SparkSession, store: str) -> DataFrame:
    return Outbox(spark, store).read(ALERTS, ALERT_SCHEMA)


def stored_payloads(spark: SparkSession, store: str) -> DataFrame:
    return Outbox(spark, store).read(PAYLOADS, PAYLOAD)


def new_alerts(alerts: DataFrame, box: Outbox) -> DataFrame:
    """One row per alert id that the store lacks; only the stored time that the batch touches is read."""
    rows = materialize(alerts.select(*ALERT_SCHEMA.fieldNames()).dropDuplicates(["alert_id"]))
    first, last = rows.agg(F.min("timestamp"), F.max("timestamp")).first()
    if first is None:
        return rows
    stored = box.read(ALERTS, ALERT_SCHEMA).filter(F.col("timestamp").between(first, last))
    return materialize(rows.join(stored.select("alert_id"), "alert_id", "left_anti"))


def deliver(alerts: DataFrame, channels: Sequence[Channel], box: Outbox, run: str, batch: int, **tables: DataFrame) -> None:
    """Store the new ones of ``alerts`` together with one payload for each channel, and other ``tables``.

    Ids depend on content only, so alerts that are stored already are left out; alerts and
    payloads become visible in one commit, so a batch that fails anywhere is simply run again.
    """
    if box.is_committed(run, batch):
        return
    new = new_alerts(alerts, box)
    box.stage(run, batch, {ALERTS: new, PAYLOADS: route_alerts(new, channels), **tables})
    box.commit(run, batch)


def process_detections(detections: DataFrame, channels: Sequence[Channel], store: str,
                       settings: Settings = DEFAULTS, run: str | None = None) -> DataFrame:
    """Gate, suppress, describe, store and route a batch of detections; the payloads of its new alerts.

    ``run`` names the call: one with the same name that was committed is not repeated.
    """
    box, run = Outbox(detections.sparkSession, store), run or f"call.{uuid.uuid4().hex}"
    deliver(al.evaluate(detections, settings), channels, box, run, 0)
    return box.latest(PAYLOADS, run, PAYLOAD)


def process_batch(detections: DataFrame, channels: Sequence[Channel], store: str, run: str, batch: int,
                  settings: Settings = DEFAULTS) -> None:
    """The same for a numbered batch of a stream, continuing the suppression of the batches before it.

    What was sent per key is staged with the alerts, so it is never ahead of them nor behind.
    """
    box = Outbox(detections.sparkSession, store)
    if box.is_committed(run, batch):
        return
    before = box.latest(SUPPRESSION, run, HISTORY)
    sent = materialize(suppress(al.grade(detections, settings), settings.cooldown_minutes, settings.max_alerts_per_hour, history=before))
    after = updated_history(sent, before, settings.cooldown_minutes)
    previous = box.committed().get(run)
    deliver(al.build_alerts(sent, settings), channels, box, run, batch, **{SUPPRESSION: after})
    if previous is not None:
        box.forget(SUPPRESSION, run, previous)
