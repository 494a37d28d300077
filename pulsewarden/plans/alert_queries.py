"""Suppression and the alert flow."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pulsewarden.functions import scalars as s
from pulsewarden.operators import alerts as al, rolling, service
from pulsewarden.operators.detectors.holtwinters import z_score
from pulsewarden.plans.catalog import GRADED, POINTS, SEVERITY_SQL, VERDICTS, ntz, points, query, r6, sql6, verdicts
from pulsewarden.plans.source_queries import ACTION, MESSAGE, _channels
from pulsewarden.schema import ALERT_SCHEMA
from pulsewarden.session import scratch_dir
from pulsewarden.sinks.outbox import Outbox

_FRAME = "OVER (PARTITION BY server_id, name ORDER BY timestamp, seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
_SEEN = "count(*) OVER (PARTITION BY server_id, name ORDER BY timestamp, seq)"


@query("flagship_rolling_alerts", f"""WITH {POINTS}, f AS (SELECT server_id, name, timestamp, seq, value, avg(value) {_FRAME} AS m,
        stddev_pop(value) {_FRAME} AS sd, min(value) {_FRAME} AS lo, max(value) {_FRAME} AS hi, {_SEEN} AS seen FROM p),
    z AS (SELECT *, CASE WHEN seen < 5 OR sd = 0 THEN 0.0 ELSE least(1.0, abs(value - m) / sd / 4.0) END AS score FROM f)
    SELECT server_id, name, timestamp, seq, {sql6('CASE WHEN seen >= 5 THEN m END')} AS mean, {sql6('CASE WHEN seen >= 5 THEN sd END')} AS std,
           CASE WHEN seen >= 5 THEN lo END AS lowest, CASE WHEN seen >= 5 THEN hi END AS highest, {sql6('score')} AS anomaly_score,
           {SEVERITY_SQL.format(sql6('score'))} AS severity FROM z""")
def flagship(spark, sf_dir):
    f = rolling.rolling_features(points(spark, sf_dir), (5,), ("mean", "std", "min", "max"))
    z = z_score(f.withColumns({"forecast": F.col("mean_5m"), "resid_std": F.col("std_5m")}))
    score = r6("anomaly_score")
    return z.select("server_id", "name", ntz("timestamp").alias("timestamp"), "seq", r6("mean_5m").alias("mean"),
                    r6("std_5m").alias("std"), F.col("min_5m").alias("lowest"), F.col("max_5m").alias("highest"),
                    score.alias("anomaly_score"), s.severity(score).alias("severity"))


def _fold_sql(src: str, minutes: int, cap: int) -> str:
    """Suppression of ``src`` one candidate after another, as a recursive query over each key."""
    us = minutes * 60_000_000
    hour = "epoch_us(n.timestamp) // 3600000000"
    sent = f"CASE WHEN f.hour = {hour} THEN f.sent ELSE 0 END"
    ok = f"(f.last IS NULL OR epoch_us(n.timestamp) - f.last >= {us}) AND {sent} < {cap}"
    return f"""n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY server_id, metric_name, severity ORDER BY timestamp, seq) AS rn FROM {src}),
f AS (SELECT server_id, metric_name, severity, seq, rn, true AS emitted, epoch_us(timestamp) AS last, epoch_us(timestamp) // 3600000000 AS hour, 1 AS sent
      FROM n WHERE rn = 1
      UNION ALL
      SELECT n.server_id, n.metric_name, n.severity, n.seq, n.rn, {ok}, CASE WHEN {ok} THEN epoch_us(n.timestamp) ELSE f.last END, {hour},
             {sent} + CASE WHEN {ok} THEN 1 ELSE 0 END
      FROM f JOIN n ON n.server_id = f.server_id AND n.metric_name = f.metric_name AND n.severity = f.severity AND n.rn = f.rn + 1)"""


# All verdicts as candidates of a key without the server, so that keys are dense.
_DENSE = f"""{VERDICTS.rstrip()}, c AS (SELECT seq, timestamp, 'all' AS server_id, metric_name, CASE WHEN anomaly_score >= 0.85 THEN 'critical'
    WHEN anomaly_score >= 0.7 THEN 'warning' ELSE 'info' END AS severity FROM v)"""


def _dense(spark, sf_dir):
    v = verdicts(spark, sf_dir)
    return v.select("seq", "timestamp", F.lit("all").alias("server_id"), "metric_name", s.severity(F.col("anomaly_score")).alias("severity"))


def _emitted(name: str, minutes: int, cap: int, **kw):
    @query(name, f"WITH RECURSIVE {_DENSE}, {_fold_sql('c', minutes, cap)} SELECT seq, metric_name, severity FROM f WHERE emitted")
    def run(spark, sf_dir):
        return al.suppress(_dense(spark, sf_dir), minutes, cap, **kw).select("seq", "metric_name", "severity")

    return run


_emitted("al1_cooldown", 30, 50)
_emitted("al1_long_cooldown", 240, 50)
_emitted("al1_cooldown_levels", 30, 50, fan=2, block_rows=16)
_emitted("al2_hourly_cap", 5, 2)
_emitted("al2_cap_levels", 5, 2, fan=3, block_rows=16)
_emitted("al2_cap_without_cooldown", 0, 3)


@query("al3_evaluate", f"""WITH RECURSIVE {GRADED}, {_fold_sql('g', 30, 50)},
    k AS (SELECT g.* FROM g JOIN f USING (server_id, metric_name, severity, seq) WHERE f.emitted)
    SELECT 'alt_' || substr(sha256(concat_ws('|', server_id, metric_name, severity, epoch_us(timestamp)::VARCHAR, seq::VARCHAR)), 1, 12) AS alert_id,
           server_id, metric_name, severity, {sql6('anomaly_score')} AS anomaly_score, {MESSAGE} AS message, {ACTION} AS suggested_action, is_predicted,
           timestamp FROM k""")
def al3(spark, sf_dir):
    a = al.evaluate(verdicts(spark, sf_dir))
    return a.select("alert_id", "server_id", "metric_name", "severity", r6("anomaly_score").alias("anomaly_score"),
                    "message", "suggested_action", "is_predicted", ntz("timestamp").alias("timestamp"))


_AL4 = f"""WITH RECURSIVE {GRADED}, {_fold_sql('g', 30, 50)}, k AS (SELECT g.* FROM g JOIN f USING (server_id, metric_name, severity, seq) WHERE f.emitted),
    a AS (SELECT 'alt_' || substr(sha256(concat_ws('|', server_id, metric_name, severity, epoch_us(timestamp)::VARCHAR, seq::VARCHAR)), 1, 12) AS alert_id,
                 server_id, metric_name, severity FROM k)
    SELECT *, unnest(['webhook', 'slack', 'pagerduty', 'email']) AS channel FROM a"""


@query("al4_process_detections", _AL4)
def al4(spark, sf_dir):
    """Detections go through the store twice; the second time adds nothing."""
    store = f"{scratch_dir(spark)}/al4-{uuid.uuid4().hex}"
    detections = verdicts(spark, sf_dir)
    service.process_detections(detections, _channels(), store)
    service.process_detections(detections, _channels(), store)
    stored, routed = service.stored_alerts(spark, store), service.stored_payloads(spark, store)
    return stored.select("alert_id", "server_id", "metric_name", "severity").join(routed.select("alert_id", "channel"), "alert_id")


def _batches(spark, sf_dir, failing=()):
    """Verdicts in four batches of time through the store; a batch whose number is ``failing`` dies half way first."""
    store = f"{scratch_dir(spark)}/al4-{uuid.uuid4().hex}"
    v = verdicts(spark, sf_dir)
    first, last = v.agg(F.min(F.unix_micros("timestamp")), F.max(F.unix_micros("timestamp"))).first()
    number = F.least(F.floor((F.unix_micros("timestamp") - first) * 4 / F.lit(max(1, last - first))), F.lit(3))
    for n in range(4):
        part = v.filter(number == n)
        if n in failing:
            Outbox(spark, store).stage("run", n, {service.ALERTS: al.build_alerts(al.grade(part)).select(*ALERT_SCHEMA.fieldNames())})
        service.process_batch(part, _channels(), store, "run", n)
        service.process_batch(part, _channels(), store, "run", n)  # a replay
    stored, routed = service.stored_alerts(spark, store), service.stored_payloads(spark, store)
    return stored.select("alert_id", "server_id", "metric_name", "severity").join(routed.select("alert_id", "channel"), "alert_id")


@query("al4_batches_and_replays", _AL4)
def al4_batches(spark, sf_dir):
    return _batches(spark, sf_dir, failing=(1, 3))


@query("al5_acknowledge", f"""WITH {GRADED}, k AS (SELECT obs FROM g WHERE server_id = 'srv-2')
    SELECT obs, obs IN (SELECT obs FROM k) AS acknowledged, CASE WHEN obs IN (SELECT obs FROM k) THEN 'oncall' ELSE '' END AS acknowledged_by FROM g""")
def al5(spark, sf_dir):
    alerts = al.build_alerts(al.grade(verdicts(spark, sf_dir)))
    acks = alerts.filter("server_id = 'srv-2'").select("alert_id", F.lit("oncall").alias("acknowledged_by"), F.col("timestamp").alias("acked_at"))
    return al.acknowledge(alerts, acks).select(F.col("seq").alias("obs"), "acknowledged", "acknowledged_by")


@query("al7_paging_dedupe", f"""WITH RECURSIVE {GRADED}, d AS (SELECT seq, timestamp, server_id, metric_name, '' AS severity FROM g), {_fold_sql('d', 360, 1000)}
    SELECT 'anomaly-' || server_id || '-' || metric_name AS dedup_key, seq FROM f WHERE emitted""")
def al7(spark, sf_dir):
    alerts = al.build_alerts(al.grade(verdicts(spark, sf_dir)))
    return al.dedupe_for_paging(alerts, 360).select("dedup_key", "seq")


@query("al3_metric_attribution", f"""WITH {POINTS}, h AS (SELECT server_id, time_bucket(INTERVAL 1 HOUR, timestamp) AS step, name, max(value) AS score FROM p GROUP BY ALL),
    v AS (SELECT DISTINCT server_id, time_bucket(INTERVAL 1 HOUR, timestamp) AS step FROM p),
    t AS (SELECT server_id, step, arg_max(name, (score, name)) AS name FROM h WHERE score > 60 GROUP BY ALL)
    SELECT v.server_id, v.step, coalesce(name, 'unknown') AS metric_name FROM v LEFT JOIN t USING (server_id, step)""")
def al3_attribution(spark, sf_dir):
    steps = points(spark, sf_dir).withColumn("step", F.window("timestamp", "1 hour").start)
    scores = steps.groupBy("server_id", "step", "name").agg(F.max("value").alias("score")).filter("score > 60")
    seen = steps.select("server_id", "step").distinct()
    out = al.attribute_metric(seen, scores, ("server_id", "step"))
    return out.select("server_id", ntz("step").alias("step"), "metric_name")
