"""Column functions, look-ups and rule matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsewarden.functions import scalars as s
from pulsewarden.operators import alerts as al, joins
from pulsewarden.operators.ensemble import model_weight
from pulsewarden.config import DEFAULTS
from pulsewarden.plans.catalog import (
    DETECTIONS, POINTS, SEVERITY_SQL, VERDICTS, detections, ntz, points, query, r6, sql6, table, verdicts,
)
from pulsewarden.plans.source_queries import ACTION
from pulsewarden.session import spread

_DIRTY = "CASE event_id % 5 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN '-Infinity'::DOUBLE WHEN 3 THEN NULL ELSE value END"


@query("sc1_nan_to_num", f"""WITH t AS (SELECT event_id, {_DIRTY} AS x FROM events)
    SELECT event_id, CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 0.0 ELSE x END AS cleaned FROM t""")
def sc1(spark, sf_dir):
    k = F.col("event_id") % 5
    dirty = (F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf"))
             .when(k == 3, F.lit(None).cast("double")).otherwise(F.col("value")))
    return table(spark, sf_dir, "events").select("event_id", s.nan_to_num(dirty).alias("cleaned"))


def _normalized(method: str):
    def run(spark, sf_dir):
        e = table(spark, sf_dir, "embeddings")
        v = s.normalize(F.transform("embedding", lambda x: x.cast("double")), method)
        return e.select("vec_id", F.posexplode(v).alias("pos", "x")).select("vec_id", "pos", r6("x").alias("x"))

    return run


_UNNEST = "e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)"
query("sc2_normalize_zscore", f"""WITH {_UNNEST},
    z AS (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS sd FROM e GROUP BY vec_id)
    SELECT vec_id, pos::INT AS pos, {sql6('CASE WHEN sd > 0 THEN (x - m) / sd ELSE x END')} AS x FROM e JOIN z USING (vec_id)""")(
    _normalized("zscore"))
query("sc2_normalize_minmax", f"""WITH {_UNNEST},
    z AS (SELECT vec_id, min(x) AS lo, max(x) AS hi FROM e GROUP BY vec_id)
    SELECT vec_id, pos::INT AS pos, {sql6('CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE x END')} AS x FROM e JOIN z USING (vec_id)""")(
    _normalized("minmax"))


@query("sc5_clip_score", f"SELECT event_id, {sql6('greatest(0.0, least(1.0, value / 100.0 - 0.2))')} AS score FROM events")
def sc5(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", r6(s.clip01(F.col("value") / 100.0 - 0.2)).alias("score"))


@query("sc6_severity", f"WITH t AS (SELECT event_id, value / 100.0 AS s FROM events) SELECT event_id, {SEVERITY_SQL.format('s')} AS severity FROM t")
def sc6(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", s.severity(F.col("value") / 100.0).alias("severity"))


@query("sc7_counter_severity", f"""WITH {VERDICTS} SELECT obs, CASE WHEN anomaly_score > 0.85 THEN 'critical' ELSE 'warning' END AS severity FROM v WHERE is_anomaly""")
def sc7(spark, sf_dir):
    return verdicts(spark, sf_dir).filter("is_anomaly").select("obs", s.counter_severity(F.col("anomaly_score")).alias("severity"))


@query("sc9_dashboard_url", f"WITH {VERDICTS} SELECT obs, 'http://g/d/server-detail?var-server=' || server_id AS url, '' AS no_base FROM v")
def sc9(spark, sf_dir):
    return verdicts(spark, sf_dir).select("obs", s.dashboard_url(F.col("server_id"), "http://g").alias("url"),
                                          s.dashboard_url(F.col("server_id")).alias("no_base"))


@query("sc10_dispatch_gate", f"WITH {VERDICTS} SELECT obs FROM v WHERE is_anomaly OR anomaly_score > 0.5")
def sc10(spark, sf_dir):
    return verdicts(spark, sf_dir).filter(s.dispatch_gate(F.col("is_anomaly"), F.col("anomaly_score"))).select("obs")


@query("sc11_alert_gate", f"WITH {VERDICTS} SELECT obs FROM v WHERE is_anomaly OR anomaly_score >= 0.7")
def sc11(spark, sf_dir):
    return verdicts(spark, sf_dir).filter(s.alert_gate(F.col("is_anomaly"), F.col("anomaly_score"))).select("obs")


_HIT = ("regexp_matches(text, '(?i)(password|passwd|pwd|secret|token|api[_-]?key)') "
        "OR regexp_matches(text, '\\b\\d{3}\\.\\d{3}\\.\\d{3}-\\d{2}\\b') "
        "OR regexp_matches(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b')")
_MASKED = f"CASE WHEN {_HIT} THEN CASE WHEN contains(text, '@') THEN substr(split_part(text, '@', 1), 1, 2) || '***@' || split_part(text, '@', 2) ELSE '***MASKED***' END ELSE text END"


@query("sc12_mask_documents", f"SELECT doc_id, {_MASKED} AS masked FROM documents")
def sc12(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", s.mask_pii(F.col("text")).alias("masked"))


@query("sc12_mask_conversations", f"SELECT conv_id, turn, {_MASKED} AS masked, role FROM conversations")
def sc12_map(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    masked = s.mask_pii_map(F.create_map(F.lit("role"), F.col("role"), F.lit("text"), F.col("text")))
    return c.select("conv_id", "turn", masked["text"].alias("masked"), masked["role"].alias("role"))


@query("sc13_hash_key", "SELECT c_custkey, sha256(c_name) AS hashed FROM customer")
def sc13(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", s.hash_key(F.col("c_name")).alias("hashed"))


_STATUS = "(ARRAY['200', '404', '500', '503', '5xx1'])[(event_id % 5) + 1]"


@query("sc15_label_filter", f"""SELECT event_id, {_STATUS} AS status FROM events
    WHERE event_type <> 'click' AND regexp_full_match({_STATUS}, '5..')""")
def sc15(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.array(*[F.lit(x) for x in ("200", "404", "500", "503", "5xx1")]), (F.col("event_id") % 5 + 1).cast("int"))
    labels = F.create_map(F.lit("status"), status, F.lit("mode"), F.when(F.col("event_type") == "click", "idle").otherwise("busy"))
    rows = e.select("event_id", labels.alias("labels"))
    keep = s.label_filter(F.col("labels"), {"mode": "busy"}, {"status": "5.."})
    return rows.filter(keep).select("event_id", F.col("labels")["status"].alias("status"))


# ---- joins -------------------------------------------------------------------

@query("j1_suggested_action", f"WITH {VERDICTS} SELECT obs, {ACTION} AS suggested_action FROM v")
def j1(spark, sf_dir):
    return joins.with_action(verdicts(spark, sf_dir)).select("obs", "suggested_action")


RULES = (
    al.AlertRule("all"),
    al.AlertRule("usage", "*_usage", 0.8),
    al.AlertRule("cpu", "cpu_*", 0.9, "critical"),
    al.AlertRule("one", "?rror_rate", 0.75),
    al.AlertRule("set", "[cd]*", 0.6),
    al.AlertRule("not_set", "[!cdm]*", 0.65),
    al.AlertRule("off", "*", 0.1, enabled=False),
)
_RULES = "r AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{r.name}', '{r.metric_pattern}', {r.threshold}::DOUBLE)" for r in RULES if r.enabled) + ") t(rule, pattern, threshold))"


@query("j2_rule_match", f"WITH {VERDICTS}, {_RULES} SELECT obs, rule FROM v JOIN r ON metric_name GLOB pattern")
def j2(spark, sf_dir):
    return al.match_rules(verdicts(spark, sf_dir), RULES).select("obs", "rule")


@query("al6_rule_filter", f"WITH {VERDICTS}, {_RULES} SELECT obs, rule, threshold FROM v JOIN r ON metric_name GLOB pattern WHERE anomaly_score >= threshold")
def al6(spark, sf_dir):
    return al.apply_rules(verdicts(spark, sf_dir), RULES).select("obs", "rule", "threshold")


# Ten thousand rules for each of several shapes, as a table: most fit nothing.
_MANY = f"""rt AS (SELECT 'rule-' || i AS rule, CASE i % 7 WHEN 0 THEN 'cpu_' || (i // 7) || '*' WHEN 1 THEN '*_' || (i // 7) WHEN 2 THEN 'mem' || '*' || (i // 7)
    WHEN 3 THEN 'metric-' || (i // 7) WHEN 4 THEN '?rror_rate' || repeat('?', (i // 7) % 50) WHEN 5 THEN 'disk_io_util' || repeat('*', (i // 7) % 3)
    ELSE '[cq]' || substr('pu_usage', 1, (i // 7) % 9) || '*' END AS pattern, (i % 10) / 10.0 AS threshold, i % 11 <> 0 AS enabled FROM range(10000) t(i))"""


def _many_rules(spark):
    i = F.col("id")
    k = F.floor(i / 7)
    text = k.cast("string")
    pattern = (
        F.when(i % 7 == 0, F.concat(F.lit("cpu_"), text, F.lit("*"))).when(i % 7 == 1, F.concat(F.lit("*_"), text))
        .when(i % 7 == 2, F.concat(F.lit("mem*"), text)).when(i % 7 == 3, F.concat(F.lit("metric-"), text))
        .when(i % 7 == 4, F.concat(F.lit("?rror_rate"), F.repeat(F.lit("?"), (k % 50).cast("int"))))
        .when(i % 7 == 5, F.concat(F.lit("disk_io_util"), F.repeat(F.lit("*"), (k % 3).cast("int"))))
        .otherwise(F.concat(F.lit("[cq]"), F.substring(F.lit("pu_usage"), F.lit(1), (k % 9).cast("int")), F.lit("*"))))
    return spark.range(10000).select(
        F.concat(F.lit("rule-"), i.cast("string")).alias("name"), pattern.alias("metric_pattern"), ((i % 10) / 10.0).alias("threshold"),
        F.lit("warning").alias("severity"), F.lit("anomaly_score").alias("condition_type"), F.lit(30).alias("cooldown_min"), (i % 11 != 0).alias("enabled"))


@query("j2_rule_table", f"WITH {VERDICTS}, {_MANY}, m AS (SELECT DISTINCT metric_name FROM v), k AS (SELECT metric_name, rule FROM m JOIN rt ON metric_name GLOB pattern WHERE enabled) SELECT metric_name, rule, count(*) AS n_rows FROM v JOIN k USING (metric_name) GROUP BY ALL")
def j2_table(spark, sf_dir):
    fits = al.match_rules(verdicts(spark, sf_dir), _many_rules(spark))
    return fits.groupBy("metric_name", "rule").agg(F.count("*").alias("n_rows"))


@query("al6_rule_table", f"WITH {VERDICTS}, {_RULES} SELECT obs, rule, threshold FROM v JOIN r ON metric_name GLOB pattern WHERE anomaly_score >= threshold")
def al6_table(spark, sf_dir):
    return al.apply_rules(verdicts(spark, sf_dir), al.rule_table(spark, RULES)).select("obs", "rule", "threshold")


_WEIGHT = "CASE model_name WHEN 'isolation_forest' THEN 0.4 WHEN 'lstm_autoencoder' THEN 0.4 WHEN 'holt_winters' THEN 0.2 ELSE 1.0 / n END"


@query("j3_model_weights", f"""WITH {DETECTIONS}, c AS (SELECT obs, count(*) AS n FROM d GROUP BY obs)
    SELECT obs, model_name, {sql6(_WEIGHT)} AS weight FROM d JOIN c USING (obs)""")
def j3(spark, sf_dir):
    d = detections(spark, sf_dir)
    n = d.groupBy("obs").agg(F.count("*").alias("n"))
    return d.join(n, "obs").select("obs", "model_name", r6(
        model_weight(F.col("model_name"), F.col("n"), DEFAULTS.weights)).alias("weight"))


#: Seasonal means by hour as a model table that SQL can build too.
_HOURS = 24
MODELS = f"""
hm AS (SELECT server_id, name, count(*)::INT AS n, {_HOURS} AS m, avg(value) AS level, 0.01 AS trend, stddev_pop(value) AS resid_std,
       [{', '.join(f"coalesce(avg(value) FILTER (hour(timestamp) = {h}), avg(value)) - avg(value)" for h in range(_HOURS))}] AS season
       FROM p GROUP BY server_id, name)
"""


def hour_models(p):
    level = F.avg("value")
    season = F.array(*[
        F.coalesce(F.avg(F.when(F.hour("timestamp") == h, F.col("value"))), level) - level for h in range(_HOURS)])
    return p.groupBy("server_id", "name").agg(
        F.count("*").cast("int").alias("n"), F.lit(_HOURS).alias("m"), level.alias("level"),
        F.lit(0.01).alias("trend"), F.stddev_pop("value").alias("resid_std"), season.alias("season"))


@query("j4_model_to_point", f"WITH {POINTS}, {MODELS} SELECT p.seq, {sql6('value - level')} AS off FROM p JOIN hm USING (server_id, name)")
def j4(spark, sf_dir):
    p = points(spark, sf_dir)
    return joins.with_model(p, hour_models(p)).select("seq", r6(F.col("value") - F.col("level")).alias("off"))


@query("j6_truth", "SELECT doc_id, (n_chars > 2000)::INT AS predicted, coalesce(toxic, 0)::INT AS truth FROM documents LEFT JOIN labels USING (doc_id)")
def j6(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 2000).cast("int").alias("predicted"))
    truth = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("truth"))
    return joins.with_truth(d, truth, "doc_id").select("doc_id", "predicted", F.col("truth").cast("int").alias("truth"))


_ACKS = """k AS (SELECT event_id % 997 AS obs_key, 'op-' || user_id AS acknowledged_by, ts AS acked_at FROM events)"""


@query("j7_acknowledged", f"""WITH {VERDICTS}, {_ACKS}, last AS (SELECT obs_key, arg_max(acknowledged_by, acked_at) AS who FROM k GROUP BY obs_key)
    SELECT obs, who IS NOT NULL AS acknowledged, coalesce(who, '') AS acknowledged_by FROM v LEFT JOIN last ON obs = obs_key""")
def j7(spark, sf_dir):
    alerts = verdicts(spark, sf_dir).select(
        F.col("obs").cast("string").alias("alert_id"), "obs", F.lit(False).alias("acknowledged"), F.lit("").alias("acknowledged_by"))
    acks = table(spark, sf_dir, "events").select(
        (F.col("event_id") % 997).cast("string").alias("alert_id"),
        F.concat(F.lit("op-"), F.col("user_id").cast("string")).alias("acknowledged_by"), F.col("ts").alias("acked_at"))
    return al.acknowledge(alerts, acks).select("obs", "acknowledged", "acknowledged_by")


@query("j8_having_reference", f"WITH {POINTS} SELECT seq, name FROM p WHERE name IN (SELECT DISTINCT name FROM p WHERE name > 'error')")
def j8(spark, sf_dir):
    p = points(spark, sf_dir)
    known = p.filter("name > 'error'").select("name").distinct()
    return joins.having_reference(p, known).select("seq", "name")
