"""Aggregations, top-k, ensemble, drift and queries over raw samples."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pulsewarden.operators import aggregates as ag, ensemble as en, histograms as dr, joins, metric_queries as mq
from pulsewarden.operators import alerts as al, ordering as o, percentiles as pc
from pulsewarden.operators.percentiles import exact_percentile
from pulsewarden.plans.catalog import (
    DETECTIONS, GRADED, POINTS, VERDICTS, detections, ntz, points, query, r6, sql6, table, verdicts,
)

_NEW = "(timestamp, seq)"


@query("ag1_latest_metrics", f"WITH {POINTS} SELECT server_id, name, arg_max(value, {_NEW}) AS value, max(timestamp) AS timestamp FROM p GROUP BY ALL")
def ag1(spark, sf_dir):
    d = ag.latest_metrics(points(spark, sf_dir))
    return d.select("server_id", "name", "value", ntz("timestamp").alias("timestamp"))


@query("ag1_latest_of_server", f"WITH {POINTS} SELECT name, arg_max(value, {_NEW}) AS value FROM p WHERE server_id = 'srv-3' GROUP BY ALL")
def ag1_one(spark, sf_dir):
    return ag.latest_metrics(points(spark, sf_dir), "srv-3").select("name", "value")


@query("ag2_servers", f"WITH {POINTS} SELECT server_id, count(DISTINCT name) AS n_windows FROM p GROUP BY server_id")
def ag2(spark, sf_dir):
    return ag.servers(points(spark, sf_dir))


@query("ag3_server_status", f"""WITH {POINTS}, l AS (SELECT server_id, name, arg_max(value, {_NEW}) AS value FROM p GROUP BY ALL)
    SELECT server_id, string_agg(name || '=' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY name) AS metrics,
           'holt_winters,isolation_forest' AS active_models FROM l GROUP BY server_id""")
def ag3(spark, sf_dir):
    d = ag.server_status(points(spark, sf_dir), ["isolation_forest", "holt_winters"])
    pairs = F.transform(F.array_sort(F.map_entries("metrics")), lambda e: F.concat(
        e["key"], F.lit("="), F.round(e["value"] * 100).cast("bigint").cast("string")))
    return d.select("server_id", F.array_join(pairs, ",").alias("metrics"), F.array_join("active_models", ",").alias("active_models"))


@query("ag4_alert_stats", f"""WITH {GRADED} SELECT 'total' AS level, 'all' AS key, count(*) AS n_alerts FROM g
    UNION ALL SELECT 'severity', severity, count(*) FROM g GROUP BY severity
    UNION ALL SELECT 'server', server_id, count(*) FROM g GROUP BY server_id""")
def ag4(spark, sf_dir):
    return ag.alert_stats(al.grade(verdicts(spark, sf_dir)))


@query("ag5_detection_counter", f"""WITH {VERDICTS} SELECT server_id, CASE WHEN anomaly_score > 0.85 THEN 'critical' ELSE 'warning' END AS severity,
    count(*) AS n_detections FROM v WHERE is_anomaly GROUP BY ALL""")
def ag5(spark, sf_dir):
    return ag.detection_counter(verdicts(spark, sf_dir))


@query("ag6_training_metrics", f"""WITH t AS (SELECT l_discount - 0.02 AS r FROM lineitem)
    SELECT count(*) AS n_samples, 4 AS n_features, {sql6('avg(r)')} AS score_mean, {sql6('stddev_pop(r)')} AS score_std,
           {sql6('avg((r < 0)::INT)')} AS anomaly_rate FROM t""")
def ag6(spark, sf_dir):
    scored = table(spark, sf_dir, "lineitem").select((F.col("l_discount") - 0.02).alias("raw_score"))
    m = ag.training_metrics(scored, 4)
    return m.select("n_samples", "n_features", *[r6(c).alias(c) for c in ("score_mean", "score_std", "anomaly_rate")])


@query("ag7_residual_stats", f"""WITH {POINTS}, t AS (SELECT server_id, name, value - 50.0 AS r, row_number() OVER (PARTITION BY server_id, name ORDER BY timestamp, seq) AS rn FROM p)
    SELECT server_id, name, {sql6('stddev_pop(r)')} AS residual_std, {sql6('sum(r * r)')} AS sse, count(*) AS n_residuals FROM t WHERE rn > 24 GROUP BY ALL""")
def ag7(spark, sf_dir):
    numbered = o.numbered(points(spark, sf_dir)).withColumns({"residual": F.col("value") - 50.0, "m": F.lit(24)})
    d = ag.residual_stats(numbered)
    return d.select("server_id", "name", r6("residual_std").alias("residual_std"), r6("sse").alias("sse"), "n_residuals")


@query("ag8_percentile_by_name", f"WITH {POINTS} SELECT name, {sql6('quantile_cont(value, 0.95)')} AS percentile FROM p GROUP BY name")
def ag8(spark, sf_dir):
    d = exact_percentile(points(spark, sf_dir), 95.0, "value", ["name"])
    return d.select("name", r6("percentile").alias("percentile"))


@query("ag8_percentile_binned", f"WITH {POINTS} SELECT name, {sql6('quantile_cont(value, 0.95)')} AS percentile FROM p GROUP BY name")
def ag8_binned(spark, sf_dir):
    d = exact_percentile(points(spark, sf_dir), 95.0, "value", ["name"], few=1)
    return d.select("name", r6("percentile").alias("percentile"))


@query("ag8_percentile_outlier", f"""WITH {POINTS}, x AS (SELECT name, value FROM p UNION ALL
        SELECT name, CASE WHEN seq % 2 = 0 THEN 1e300 ELSE 'Infinity'::DOUBLE END FROM p WHERE seq % 100 = 7)
    SELECT name, {sql6('quantile_cont(value, 0.95)')} AS percentile FROM x GROUP BY name""")
def ag8_outlier(spark, sf_dir):
    p = points(spark, sf_dir)
    far = p.filter("seq % 100 = 7").select("name", F.when(F.col("seq") % 2 == 0, 1e300).otherwise(float("inf")).alias("value"))
    d = exact_percentile(p.select("name", "value").unionByName(far), 95.0, "value", ["name"], few=100)
    return d.select("name", r6("percentile").alias("percentile"))


@query("ag8_percentile_all", f"SELECT {sql6('quantile_cont(l_extendedprice, 0.05)')} AS percentile FROM lineitem")
def ag8_all(spark, sf_dir):
    d = exact_percentile(table(spark, sf_dir, "lineitem"), 5.0, "l_extendedprice")
    return d.select(r6("percentile").alias("percentile"))


# A sketch's percentile is a value that occurred; its rank must lie within the stated error of the wanted one.
@query("ag8_sketch_within_bound", f"WITH {POINTS} SELECT name, count(*) AS n, true AS within FROM p GROUP BY name")
def ag8_sketch(spark, sf_dir):
    p = points(spark, sf_dir)
    days = pc.quantile_sketches(p, ["name", F.to_date("timestamp").alias("day")])
    found = pc.sketch_percentile(pc.merge_sketches(days, ["name"]), 95.0).withColumnRenamed("name", "_name")
    ranked = p.join(found, p["name"] == found["_name"]).groupBy("name").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") <= F.col("percentile")).alias("_below"))
    return ranked.select("name", "n", (F.abs(F.col("_below") / F.col("n") - 0.95) <= pc.rank_error() + 2 / F.col("n")).alias("within"))


@query("ag8_sketch_of_few", f"WITH {POINTS} SELECT server_id, name, CAST(timestamp AS DATE) AS day, quantile_disc(value, 0.5) AS median FROM p GROUP BY ALL HAVING count(*) < 100")
def ag8_few(spark, sf_dir):
    """Below its size a sketch holds every value, so its percentiles are exact."""
    p = points(spark, sf_dir).withColumn("day", F.to_date("timestamp"))
    few = p.groupBy("server_id", "name", "day").count().filter("count < 100").drop("count")
    found = pc.sketch_percentile(pc.quantile_sketches(p, ["server_id", "name", "day"]), 50.0, "median")
    return found.join(few, ["server_id", "name", "day"], "left_semi")


def _hist(name: str, src: str) -> str:
    """Reference histogram of ``src(name, value)`` as CTEs e (edges) and ``name`` (counts)."""
    return f"""
e AS (SELECT name, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
             CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM {src} GROUP BY name),
bins AS (SELECT name, lo, hi, unnest(range(10))::INT AS bin FROM e),
{name} AS (SELECT b.name, b.bin, b.lo, b.hi, count(s.value) AS n FROM bins b LEFT JOIN {src} s
       ON s.name = b.name AND least(floor((s.value - b.lo) / ((b.hi - b.lo) / 10)), 9) = b.bin GROUP BY ALL)
"""


_LINES = """li AS (SELECT l_shipdate < TIMESTAMP '1998-01-01' AS early, unnest([
    {name: 'discount', value: l_discount}, {name: 'price', value: l_extendedprice},
    {name: 'quantity', value: l_quantity}, {name: 'shifted', value: l_quantity + CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 0 ELSE 12 END}], recursive := true) FROM lineitem),
early AS (SELECT name, value FROM li WHERE early), late AS (SELECT name, value FROM li WHERE NOT early)"""


def lines(spark, sf_dir):
    """Long features of line items before and after a date; one feature moves."""
    li = table(spark, sf_dir, "lineitem")
    early = F.col("l_shipdate") < F.lit(datetime(1998, 1, 1)).cast("timestamp_ntz")
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in (
        ("discount", F.col("l_discount")), ("price", F.col("l_extendedprice")), ("quantity", F.col("l_quantity")),
        ("shifted", F.col("l_quantity") + F.when(early, 0).otherwise(12)))])
    rows = li.select(early.alias("early"), F.inline(pairs))
    return rows.filter("early").drop("early"), rows.filter("NOT early").drop("early")


@query("ag9_histogram", f"WITH {POINTS}, {_hist('h', 'p')} SELECT name, bin, lo, hi, n FROM h")
def ag9(spark, sf_dir):
    return dr.set_reference(points(spark, sf_dir))


@query("ag10_inference_stats", f"""WITH {POINTS}, t AS (SELECT name AS model_name, timestamp, value,
        row_number() OVER (PARTITION BY name ORDER BY timestamp DESC, seq DESC) - 1 AS age FROM p)
    SELECT model_name, count(*) AS inference_count, max(timestamp) AS last_inference_at,
           {sql6('sum(value * 0.1 * power(0.9, age))')} AS avg_latency_ms FROM t GROUP BY model_name""")
def ag10(spark, sf_dir):
    calls = points(spark, sf_dir).select(F.col("name").alias("model_name"), "timestamp", "seq", F.col("value").alias("latency_ms"))
    d = ag.inference_stats(calls)
    return d.select("model_name", "inference_count", ntz("last_inference_at").alias("last_inference_at"), r6("avg_latency_ms").alias("avg_latency_ms"))


@query("ag10_inference_stats_slow", f"""WITH {POINTS}, t AS (SELECT 'all' AS model_name, timestamp, value,
        row_number() OVER (ORDER BY timestamp DESC, seq DESC) - 1 AS age FROM p)
    SELECT model_name, count(*) AS inference_count, max(timestamp) AS last_inference_at,
           {sql6('sum(value * 0.0005 * power(0.9995, age))')} AS avg_latency_ms FROM t GROUP BY model_name""")
def ag10_slow(spark, sf_dir):
    calls = points(spark, sf_dir).select(F.lit("all").alias("model_name"), "timestamp", "seq", F.col("value").alias("latency_ms"))
    d = ag.inference_stats(calls, 0.0005)
    return d.select("model_name", "inference_count", ntz("last_inference_at").alias("last_inference_at"), r6("avg_latency_ms").alias("avg_latency_ms"))


@query("ag11_buffer_status", f"WITH {POINTS} SELECT server_id, least(count(*), 1200) AS n_buffered FROM p GROUP BY server_id")
def ag11(spark, sf_dir):
    return ag.buffer_status(points(spark, sf_dir), 1200).select("server_id", F.col("n_buffered").cast("bigint").alias("n_buffered"))


@query("ag12_classification_report", f"""WITH t AS (SELECT coalesce(toxic, 0)::INT AS truth, (n_chars > 2000)::INT AS predicted FROM documents LEFT JOIN labels USING (doc_id)),
    c AS (SELECT unnest([0, 1])::INT AS class),
    k AS (SELECT class, count(*) FILTER (truth = class AND predicted = class) AS hit, count(*) FILTER (truth = class) AS support,
                 count(*) FILTER (predicted = class) AS claimed FROM t, c GROUP BY class),
    m AS (SELECT class, support, coalesce(hit / nullif(claimed, 0), 0.0) AS precision, coalesce(hit / nullif(support, 0), 0.0) AS recall FROM k)
    SELECT class, support, {sql6('precision')} AS precision, {sql6('recall')} AS recall,
           {sql6('coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0)')} AS f1 FROM m""")
def ag12(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 2000).cast("int").alias("predicted"))
    truth = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("truth"))
    r = ag.classification_report(joins.with_truth(d, truth, "doc_id"))
    return r.select("class", "support", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


# ---- top-k -------------------------------------------------------------------

@query("tk1_recent_alerts", f"""WITH {GRADED} SELECT obs, metric_name, timestamp FROM g WHERE severity = 'critical' AND server_id = 'srv-1'
    ORDER BY timestamp DESC, seq DESC LIMIT 50""")
def tk1(spark, sf_dir):
    d = al.recent_alerts(al.grade(verdicts(spark, sf_dir)), 50, "critical", "srv-1")
    return d.select("obs", "metric_name", ntz("timestamp").alias("timestamp"))


@query("tk2_alert_by_id", f"""WITH {GRADED} SELECT 'alt_' || substr(sha256(concat_ws('|', server_id, metric_name, severity, epoch_us(timestamp)::VARCHAR, seq::VARCHAR)), 1, 12) AS alert_id,
    server_id, metric_name, severity FROM g WHERE server_id = 'srv-1' ORDER BY timestamp, seq LIMIT 1""")
def tk2(spark, sf_dir):
    """The alert whose id a user has from the first message of a server."""
    alerts = al.build_alerts(al.grade(verdicts(spark, sf_dir)))
    wanted = alerts.filter("server_id = 'srv-1'").orderBy("timestamp", "seq").select("alert_id").first()
    found = al.alert_by_id(alerts, wanted["alert_id"] if wanted else "")
    return found.select("alert_id", "server_id", "metric_name", "severity")


@query("tk3_history_cap", f"WITH {GRADED} SELECT obs, severity FROM g ORDER BY timestamp DESC, seq DESC LIMIT 1000")
def tk3(spark, sf_dir):
    return al.history(al.grade(verdicts(spark, sf_dir))).select("obs", "severity")


@query("tk4_latest_row_per_server", f"WITH {POINTS} SELECT server_id, name, value, seq FROM p QUALIFY row_number() OVER (PARTITION BY server_id ORDER BY timestamp DESC, seq DESC) = 1")
def tk4(spark, sf_dir):
    return joins.latest_per_server(points(spark, sf_dir), ["name", "value", "seq"])


# ---- ensemble ----------------------------------------------------------------

_W = "CASE model_name WHEN 'isolation_forest' THEN 0.4 WHEN 'lstm_autoencoder' THEN 0.4 WHEN 'holt_winters' THEN 0.2 ELSE 1.0 / n END"
_EN1 = f"""{DETECTIONS.rstrip()}, c AS (SELECT obs, count(*) AS n FROM d GROUP BY obs),
q AS (SELECT obs, sum(anomaly_score * {_W}) / sum({_W}) AS s, sum({_W}) AS w, any_value(n) AS n FROM d JOIN c USING (obs) GROUP BY obs)"""


@query("en1_weighted", f"WITH {_EN1} SELECT obs, {sql6('s')} AS anomaly_score, s > 0.7 AS is_anomaly, {sql6('w')} AS total_weight, n AS n_models FROM q")
def en1(spark, sf_dir):
    d = en.weighted(detections(spark, sf_dir))
    return d.select("obs", r6("anomaly_score").alias("anomaly_score"), "is_anomaly", r6("total_weight").alias("total_weight"), "n_models")


@query("en1_model_details", f"""WITH {DETECTIONS} SELECT obs, model_name, CAST(round(CAST(CAST(anomaly_score AS VARCHAR) AS DECIMAL(38, 26)), 4) AS DOUBLE) AS score, is_anomaly FROM d""")
def en1_details(spark, sf_dir):
    d = en.weighted(detections(spark, sf_dir))
    return d.select("obs", F.inline("models"))


@query("en2_majority", f"""WITH {DETECTIONS} SELECT obs, {sql6('avg(anomaly_score)')} AS anomaly_score, sum(is_anomaly::INT) > count(*) / 2 AS is_anomaly,
    sum(is_anomaly::INT)::BIGINT AS anomaly_count, count(*) AS n_models FROM d GROUP BY obs""")
def en2(spark, sf_dir):
    d = en.majority(detections(spark, sf_dir))
    return d.select("obs", r6("anomaly_score").alias("anomaly_score"), "is_anomaly", "anomaly_count", "n_models")


@query("en3_any_flag", f"""WITH {DETECTIONS} SELECT obs, {sql6('max(anomaly_score)')} AS anomaly_score, bool_or(is_anomaly) AS is_anomaly,
    coalesce(string_agg(model_name, ',' ORDER BY model_name) FILTER (is_anomaly), '') AS flagging_models FROM d GROUP BY obs""")
def en3(spark, sf_dir):
    d = en.any_flag(detections(spark, sf_dir))
    return d.select("obs", r6("anomaly_score").alias("anomaly_score"), "is_anomaly", F.array_join("flagging_models", ",").alias("flagging_models"))


@query("en4_dispatch", f"""WITH {DETECTIONS}, k AS (SELECT * FROM d WHERE model_name IN ('lstm_autoencoder', 'custom_model')),
    a AS (SELECT obs, avg(anomaly_score) AS s, sum(is_anomaly::INT) > count(*) / 2 AS f, sum(is_anomaly::INT) AS c, count(*) AS n FROM k GROUP BY obs)
    SELECT p.seq AS obs, {sql6('coalesce(s, 0.0)')} AS anomaly_score, coalesce(f, false) AS is_anomaly, 'majority' AS method, coalesce(n, 0) AS n_models, c AS anomaly_count,
           CASE WHEN n IS NULL THEN 'no trained models in ensemble' END AS error FROM p LEFT JOIN a ON p.seq = a.obs""")
def en4(spark, sf_dir):
    seen = points(spark, sf_dir).select(F.col("seq").alias("obs"))
    some = detections(spark, sf_dir).filter(F.col("model_name").isin("lstm_autoencoder", "custom_model"))
    d = en.ensemble(seen, some, "majority")
    return d.withColumn("anomaly_score", r6("anomaly_score"))


@query("en5_attach_forecast", f"""WITH {POINTS},
    a AS (SELECT server_id, name, avg(value) AS x FROM p WHERE name <> 'view' GROUP BY ALL), b AS (SELECT server_id, name, max(value) AS x FROM p GROUP BY ALL)
    SELECT p.seq, CASE WHEN a.x IS NULL THEN 'holt_winters' ELSE 'lstm' END AS source, 2 AS steps,
           {sql6('round(coalesce(a.x, b.x) + 1.3e-9, 4)')} AS first_value, {sql6('round(coalesce(a.x, b.x) + 1 + 1.3e-9, 4)')} AS second_value
    FROM p LEFT JOIN a USING (server_id, name) LEFT JOIN b USING (server_id, name)""")
def en5(spark, sf_dir):
    p = points(spark, sf_dir)

    def forecast(x):
        return F.array(x + 1.3e-9, x + 1 + 1.3e-9, x + 2)

    lstm = p.filter("name <> 'view'").groupBy("server_id", "name").agg(forecast(F.avg("value")).alias("forecast"))
    hw = p.groupBy("server_id", "name").agg(forecast(F.max("value")).alias("forecast"))
    d = en.attach_forecast(p, lstm, hw, steps=2)
    h = F.col("prediction_horizon")
    return d.select("seq", h["source"].alias("source"), h["steps"].alias("steps"),
                    r6(h["values"][0]).alias("first_value"), r6(h["values"][1]).alias("second_value"))


@query("tk4_predictions", f"""WITH {POINTS},
    l AS (SELECT server_id, name, value, seq FROM p QUALIFY row_number() OVER (PARTITION BY server_id ORDER BY timestamp DESC, seq DESC) = 1),
    k AS (SELECT server_id, (least(1.0, value / 120.0) * 0.4 + least(1.0, abs(value - 40.0) / 150.0) * 0.4) / 0.8 AS s FROM l WHERE name <> 'signup'),
    h AS (SELECT server_id, name, max(value) AS x FROM p WHERE name <> 'view' GROUP BY ALL), a AS (SELECT DISTINCT server_id FROM p UNION ALL SELECT 'srv-none')
    SELECT a.server_id, {sql6('coalesce(round(s + 1.3e-9, 4), 0.0)')} AS anomaly_score,
           CASE WHEN l.server_id IS NULL THEN 'no data buffered for this server' WHEN s IS NULL THEN 'no trained models available' END AS warning,
           {sql6('round(x, 4)')} AS first_value
    FROM a LEFT JOIN l USING (server_id) LEFT JOIN k USING (server_id) LEFT JOIN h ON h.server_id = l.server_id AND h.name = l.name""")
def tk4_predictions(spark, sf_dir):
    p = points(spark, sf_dir)
    asked = p.select("server_id").distinct().unionByName(spark.range(1).select(F.lit("srv-none").alias("server_id")))
    latest = joins.latest_per_server(p, ["name", "value"])
    v = F.col("value")
    scores = F.array(*[F.struct(F.lit(m).alias("model_name"), (F.least(F.lit(1.0), s) + 1.3e-9).alias("anomaly_score"), F.lit(False).alias("is_anomaly"))
                       for m, s in (("isolation_forest", v / 120.0), ("lstm_autoencoder", F.abs(v - 40.0) / 150.0))])
    found = latest.filter("name <> 'signup'").select("server_id", F.inline(scores))
    hw = p.filter("name <> 'view'").groupBy("server_id", "name").agg(F.array(F.max("value")).alias("forecast"))
    d = en.predictions(asked, latest, found, None, hw, steps=1)
    return d.select("server_id", r6("anomaly_score").alias("anomaly_score"), "warning",
                    r6(F.col("prediction_horizon")["values"][0]).alias("first_value"))


# ---- drift -------------------------------------------------------------------

@query("dr1_set_reference", f"WITH {_LINES}, {_hist('h', 'early')} SELECT name, bin, lo, hi, n FROM h")
def dr1(spark, sf_dir):
    early, _ = lines(spark, sf_dir)
    return dr.set_reference(early)


def _psi_sql(src: str) -> str:
    return f"""{_hist('h', 'early')},
now AS (SELECT h.name, h.bin, h.lo, h.hi, h.n, count(s.value) AS c FROM h LEFT JOIN {src} s ON s.name = h.name
        AND s.value BETWEEN h.lo AND h.hi AND least(floor((s.value - h.lo) / ((h.hi - h.lo) / 10)), 9) = h.bin GROUP BY ALL),
dens AS (SELECT name, bin, n / (sum(n) OVER w * (hi - lo) / 10) + 1e-6 AS r,
         coalesce(c / (nullif(sum(c) OVER w, 0) * (hi - lo) / 10), 0) + 1e-6 AS c FROM now WINDOW w AS (PARTITION BY name)),
sh AS (SELECT name, r / sum(r) OVER w AS r, c / sum(c) OVER w AS c FROM dens WINDOW w AS (PARTITION BY name)),
psi AS (SELECT name, sum((c - r) * ln(c / r)) AS psi FROM sh WHERE name IN (SELECT name FROM {src}) GROUP BY name)"""


@query("dr2_psi", f"WITH {_LINES}, {_psi_sql('late')}, x AS (SELECT name FROM late UNION SELECT 'unknown') SELECT x.name, {sql6('coalesce(psi, 0.0)')} AS psi FROM x LEFT JOIN psi USING (name)")
def dr2(spark, sf_dir):
    early, late = lines(spark, sf_dir)
    extra = late.filter("name = 'price'").withColumn("name", F.lit("unknown"))
    return dr.psi_or_zero(late.unionByName(extra), dr.set_reference(early)).select("name", r6("psi").alias("psi"))


_LEVEL = "CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.15 THEN 'moderate' ELSE 'significant' END"


@query("dr3_drift_level", f"WITH {_LINES}, {_psi_sql('late')} SELECT name AS feature, {sql6('psi')} AS psi, {_LEVEL} AS level, 0.15 AS threshold, psi >= 0.15 AS retrain FROM psi")
def dr3(spark, sf_dir):
    early, late = lines(spark, sf_dir)
    return dr.check_drift(late, dr.set_reference(early)).withColumn("psi", r6("psi")).withColumn("threshold", F.lit(0.15))


@query("dr4_drift_of_known", f"""WITH {_LINES}, {_psi_sql('late')} SELECT name AS feature, {sql6('psi')} AS psi, {_LEVEL} AS level FROM psi WHERE name <> 'price'""")
def dr4(spark, sf_dir):
    early, late = lines(spark, sf_dir)
    reference = dr.set_reference(early.filter("name <> 'price'"))
    return dr.check_drift(late, reference).select("feature", r6("psi").alias("psi"), "level")


_BUF = f"""{POINTS.rstrip()}, st AS (SELECT server_id, name, time_bucket(INTERVAL 6 HOUR, timestamp) AS step, avg(value) AS value FROM p GROUP BY ALL),
early AS (SELECT name, value FROM st WHERE step < TIMESTAMP '2024-01-15'), late AS (SELECT name, value FROM st WHERE step >= TIMESTAMP '2024-01-15')"""


@query("dr5_drift_of_buffer", f"WITH {_BUF}, {_psi_sql('late')} SELECT name AS feature, {sql6('psi')} AS psi, {_LEVEL} AS level FROM psi WHERE (SELECT count(*) FROM late l WHERE l.name = psi.name) >= 10")
def dr5(spark, sf_dir):
    p = points(spark, sf_dir)
    steps = p.groupBy("server_id", "name", F.window("timestamp", "6 hours").start.alias("step")).agg(F.avg("value").alias("value"))
    cut = F.lit(datetime(2024, 1, 15)).cast("timestamp")
    reference = dr.set_reference(steps.filter(F.col("step") < cut))
    return dr.check_buffer(steps.filter(F.col("step") >= cut), reference).select("feature", r6("psi").alias("psi"), "level")


# Six-hour averages graded by their distance from 50, as drift windows would be.
_GRADES = f"""{POINTS.rstrip()}, st AS (SELECT name AS feature, time_bucket(INTERVAL 6 HOUR, timestamp) AS window_start, abs(avg(value) - 50) / 100 AS psi FROM p GROUP BY ALL),
wd AS MATERIALIZED (SELECT *, {_LEVEL} AS level, row_number() OVER (PARTITION BY feature ORDER BY window_start) AS rn FROM st)"""
_HOT = "CASE WHEN w.level = 'significant' THEN f.hot + 1 ELSE 0 END"
_COLD = "CASE WHEN w.level = 'none' THEN f.calm + 1 ELSE 0 END"
_ARMED = f"(f.armed OR {_COLD} >= {dr.CALM})"
_RAISED = f"({_ARMED} AND {_HOT} >= {dr.RAISE})"


@query("dr6_retrain_events", f"""WITH RECURSIVE {_GRADES},
    f AS (SELECT feature, 0::BIGINT AS rn, NULL::TIMESTAMP AS window_start, NULL::DOUBLE AS psi, 0 AS hot, 0 AS calm, true AS armed, false AS event FROM wd GROUP BY feature
      UNION ALL SELECT w.feature, w.rn, w.window_start, w.psi, {_HOT}, {_COLD}, {_ARMED} AND NOT {_RAISED}, {_RAISED} FROM f JOIN wd w ON w.feature = f.feature AND w.rn = f.rn + 1)
    SELECT feature, window_start, {sql6('psi')} AS psi FROM f WHERE event""")
def dr6(spark, sf_dir):
    steps = points(spark, sf_dir).groupBy(F.col("name").alias("feature"), F.window("timestamp", "6 hours").start.alias("window_start"))
    w = steps.agg((F.abs(F.avg("value") - 50) / 100).alias("psi")).withColumn("level", dr.drift_level(F.col("psi")))
    return dr.retrain_events(w).select("feature", ntz("window_start").alias("window_start"), r6("psi").alias("psi"))


@query("j5_histogram_join", f"""WITH {_LINES}, {_psi_sql('late')} SELECT name, bin, n, c AS n_now FROM now""")
def j5(spark, sf_dir):
    early, late = lines(spark, sf_dir)
    ref = dr.reference_arrays(dr.set_reference(early))
    now = dr.with_bins(late.withColumnRenamed("value", "_x"), ref.select("name", "lo", "hi"), 10)
    counts = now.groupBy("name").agg(dr.bin_counts(10).alias("now"))
    both = ref.join(counts, "name").select("name", F.posexplode(F.arrays_zip("ref", "now")).alias("bin", "b"))
    return both.select("name", "bin", F.col("b.ref").alias("n"), F.col("b.now").alias("n_now"))


# ---- queries over raw samples ------------------------------------------------

@query("pq1_counter_rate", f"""WITH {POINTS}, w AS (SELECT *, time_bucket(INTERVAL 6 HOUR, timestamp) AS b FROM p),
    t AS (SELECT *, lag(value) OVER (PARTITION BY server_id, name, b ORDER BY timestamp, seq) AS prev FROM w)
    SELECT server_id, name, b AS window_start, count(*) AS n_samples,
           {sql6('sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END)')} AS increase,
           {sql6('sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END) / nullif((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6, 0)')} AS rate
    FROM t GROUP BY ALL""")
def pq1(spark, sf_dir):
    d = mq.counter_rate(points(spark, sf_dir), "6 hours")
    return d.select("server_id", "name", ntz("window_start").alias("window_start"), "n_samples",
                    r6("increase").alias("increase"), r6("rate").alias("rate"))


def _labelled(spark, sf_dir):
    return points(spark, sf_dir, "user_id").withColumn("labels", F.create_map(
        F.lit("instance"), F.concat(F.lit("i-"), (F.col("user_id") % 50).cast("string")), F.lit("status"),
        F.when(F.col("name") == "error", "500").otherwise("200")))


_INSTANTS = """i AS (SELECT server_id, name, 'i-' || (user_id % 50) AS instance, time_bucket(INTERVAL 1 DAY, timestamp) AS step,
    arg_max(value, (timestamp, seq)) AS value FROM p GROUP BY ALL)"""


@query("pq2_sum_by_label", f"WITH {POINTS}, {_INSTANTS} SELECT step, instance, {sql6('sum(value)')} AS sum_value FROM i GROUP BY ALL")
def pq2(spark, sf_dir):
    d = mq.by_label(_labelled(spark, sf_dir), "instance", "sum", step="1 day")
    return d.select(ntz("step").alias("step"), "instance", r6("sum_value").alias("sum_value"))


@query("pq2_avg_by_label", f"WITH {POINTS}, {_INSTANTS} SELECT step, instance, {sql6('avg(value)')} AS avg_value FROM i GROUP BY ALL")
def pq2_avg(spark, sf_dir):
    d = mq.by_label(_labelled(spark, sf_dir), "instance", "avg", step="1 day")
    return d.select(ntz("step").alias("step"), "instance", r6("avg_value").alias("avg_value"))


@query("pq3_error_ratio", f"""WITH {POINTS}, {_INSTANTS} SELECT step, server_id,
    {sql6('100 * coalesce(sum(value) FILTER (name = \'error\'), 0) / sum(value)')} AS ratio FROM i GROUP BY ALL""")
def pq3(spark, sf_dir):
    from pulsewarden.functions.scalars import label_filter

    failed = label_filter(F.col("labels"), matches={"status": "5.."})
    d = mq.ratio(_labelled(spark, sf_dir), failed, F.lit(True), ["server_id"], scale=100.0, step="1 day")
    return d.select(ntz("step").alias("step"), "server_id", r6("ratio").alias("ratio"))


@query("pq4_gauge", f"WITH {POINTS} SELECT server_id, seq, value FROM p WHERE name = 'view'")
def pq4(spark, sf_dir):
    return mq.gauge(points(spark, sf_dir), "view").select("server_id", "seq", "value")


_LE = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0)


@query("pq5_histogram_quantile", f"""WITH {POINTS}, b AS (SELECT server_id, unnest([{', '.join(str(x) for x in _LE)}, 'Infinity'::DOUBLE]) AS le, value FROM p),
    c AS (SELECT server_id, le, count(*) FILTER (value <= le)::DOUBLE AS c FROM b GROUP BY ALL),
    l AS (SELECT *, coalesce(lag(c) OVER w, 0) AS below, lag(le) OVER w AS lo, max(c) OVER (PARTITION BY server_id) * 0.95 AS rank FROM c WINDOW w AS (PARTITION BY server_id ORDER BY le)),
    f AS (SELECT * FROM l WHERE c >= rank QUALIFY row_number() OVER (PARTITION BY server_id ORDER BY le) = 1)
    SELECT server_id, {sql6('CASE WHEN isinf(le) THEN lo ELSE coalesce(lo, 0) + (le - coalesce(lo, 0)) * (rank - below) / (c - below) END')} AS quantile FROM f""")
def pq5(spark, sf_dir):
    borders = F.array(*[F.lit(x) for x in (*_LE, float("inf"))])
    p = points(spark, sf_dir).withColumn("le", F.explode(borders))
    buckets = p.groupBy("server_id", "le").agg(F.count_if(F.col("value") <= F.col("le")).alias("count"))
    return mq.histogram_quantile(buckets, 0.95, ["server_id"]).withColumn("quantile", r6("quantile"))


@query("pq6_step_alignment", f"WITH {POINTS} SELECT server_id, name, time_bucket(INTERVAL 300 SECOND, timestamp) AS step, arg_max(value, {_NEW}) AS value FROM p GROUP BY ALL")
def pq6(spark, sf_dir):
    d = mq.align_steps(points(spark, sf_dir))
    return d.select("server_id", "name", ntz("step").alias("step"), "value")


@query("pq2_rate_by_label", f"""WITH {POINTS}, w AS (SELECT *, 'i-' || (user_id % 5) AS instance, time_bucket(INTERVAL 1 DAY, timestamp) AS b FROM p),
    t AS (SELECT *, lag(value) OVER (PARTITION BY server_id, name, instance, b ORDER BY timestamp, seq) AS prev FROM w),
    r AS (SELECT server_id, name, instance, b, sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END)
                 / nullif((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6, 0) AS rate FROM t GROUP BY ALL)
    SELECT instance, b AS window_start, {sql6('sum(rate)')} AS sum_rate FROM r GROUP BY ALL""")
def pq2_rate(spark, sf_dir):
    p = points(spark, sf_dir, "user_id").withColumn(
        "labels", F.create_map(F.lit("instance"), F.concat(F.lit("i-"), (F.col("user_id") % 5).cast("string"))))
    d = mq.rate_by_label(p, "instance", "1 day")
    return d.select("instance", ntz("window_start").alias("window_start"), r6("sum_rate").alias("sum_rate"))


_RAW = {"view": mq.CPU_SECONDS, "click": mq.REQUESTS, "error": mq.LOAD, "signup": mq.MEMORY_FREE, "purchase": mq.MEMORY_ALL}


@query("pq_default_metrics", f"""WITH {POINTS}, w AS (SELECT *, user_id % 3 AS k, time_bucket(INTERVAL 1 DAY, timestamp) AS b FROM p),
    t AS (SELECT *, lag(value) OVER (PARTITION BY server_id, name, k, b ORDER BY timestamp, seq) AS prev FROM w WHERE name IN ('view', 'click')),
    r AS (SELECT server_id, name, k, b, sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END)
                 / nullif((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6, 0) AS rate FROM t GROUP BY ALL),
    m AS (SELECT server_id, b, 'cpu_usage' AS name, 100 - avg(rate) FILTER (name = 'view' AND k = 0) * 100 AS value FROM r GROUP BY ALL
          UNION ALL SELECT server_id, b, 'iowait', avg(rate) FILTER (name = 'view' AND k = 1) * 100 FROM r GROUP BY ALL
          UNION ALL SELECT server_id, b, 'error_rate', coalesce(sum(rate) FILTER (name = 'click' AND k = 1), 0) / nullif(sum(rate) FILTER (name = 'click'), 0) * 100 FROM r GROUP BY ALL
          UNION ALL SELECT server_id, b, 'load_avg_5m', arg_max(value, (timestamp, seq)) FILTER (name = 'error') FROM w WHERE name IN ('error', 'signup', 'purchase') GROUP BY ALL
          UNION ALL SELECT server_id, b, 'memory_usage', 100 * (1 - arg_max(value, (timestamp, seq)) FILTER (name = 'signup') / arg_max(value, (timestamp, seq)) FILTER (name = 'purchase'))
                    FROM w WHERE name IN ('error', 'signup', 'purchase') GROUP BY ALL)
    SELECT server_id, b AS timestamp, name, {sql6('value')} AS value FROM m WHERE value IS NOT NULL""")
def pq_default(spark, sf_dir):
    p = points(spark, sf_dir, "user_id")
    k = F.col("user_id") % 3
    mode = F.when(k == 0, "idle").when(k == 1, "iowait").otherwise("user")
    status = F.when(k == 0, "200").when(k == 1, "503").otherwise("404")
    raw = F.lit(None).cast("string")
    for event, name in _RAW.items():
        raw = F.when(F.col("name") == event, F.lit(name)).otherwise(raw)
    samples = p.withColumns({"name": raw, "labels": F.create_map(F.lit("mode"), mode, F.lit("status"), status)})
    d = mq.default_metrics(samples, "1 day")
    return d.select("server_id", ntz("timestamp").alias("timestamp"), "name", r6("value").alias("value"))
