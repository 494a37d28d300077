"""Sources and sinks."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from pulsewarden.functions import scalars as s
from pulsewarden.operators import alerts as al
from pulsewarden.operators.aggregates import latest_metrics
from pulsewarden.plans.catalog import (
    GRADED, POINTS, ntz, points, query, r6, sql6, table, verdicts,
)
from pulsewarden.schema import WIDE_METRICS
from pulsewarden.session import scratch_dir, shared_dir, spread
from pulsewarden.sinks import channels as ch, stores
from pulsewarden.sources import exposition, messages, responses, tables

# ---- messages ----------------------------------------------------------------

# One message per event; the shape of the message changes with the event id.
_SHAPES_SQL = """
m AS (SELECT event_id, ts, CASE event_id % 10
    WHEN 0 THEN '{"name":"' || event_type || '","value":' || value || ',"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","server_id":"srv-' || user_id || '","labels":{"k":"v"},"type":"gauge"}'
    WHEN 1 THEN '{"name":"' || event_type || '","value":"' || value || '","timestamp":' || (epoch_us(ts) // 1000000) || ',"server_id":"srv-' || user_id || '"}'
    WHEN 2 THEN '{"name":"' || event_type || '","value":' || value || ',"server_id":"srv-' || user_id || '","type":"counter"}'
    WHEN 3 THEN '{"name":"' || event_type || '","value":' || value || ',"timestamp":"not a time"}'
    WHEN 4 THEN '{"name":"' || event_type || '","value":"n/a","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"}'
    WHEN 5 THEN '{"value":' || value || ',"timestamp":' || (epoch_us(ts) // 1000000) || '}'
    WHEN 6 THEN '{"name":"' || event_type || '","value":' || value || ',"timestamp":null,"type":"summary"}'
    WHEN 7 THEN 'event ' || event_id
    WHEN 8 THEN '{"name":"' || event_type || '","value":' || value || ',"timestamp":' || (epoch_us(ts) // 1000000) || '.5,"type":"histogram"}'
    ELSE '{"name":"' || event_type || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"}'
    END AS value FROM events)
"""


def _messages(spark, sf_dir):
    e = spread(table(spark, sf_dir, "events"))
    ts = F.col("ts").cast("timestamp")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    secs = F.unix_seconds(ts).cast("string")
    name = F.concat(F.lit('"name":"'), F.col("event_type"), F.lit('"'))
    num = F.concat(F.lit('"value":'), F.col("value").cast("string"))
    server = F.concat(F.lit('"server_id":"srv-'), F.col("user_id").cast("string"), F.lit('"'))
    quoted = F.concat(F.lit('"value":"'), F.col("value").cast("string"), F.lit('"'))
    at_iso = F.concat(F.lit('"timestamp":"'), iso, F.lit('"'))
    at_secs = F.concat(F.lit('"timestamp":'), secs)

    def obj(*fields):
        return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))

    shapes = [
        obj(name, num, at_iso, server, F.lit('"labels":{"k":"v"}'), F.lit('"type":"gauge"')),
        obj(name, quoted, at_secs, server),
        obj(name, num, server, F.lit('"type":"counter"')),
        obj(name, num, F.lit('"timestamp":"not a time"')),
        obj(name, F.lit('"value":"n/a"'), at_iso),
        obj(num, at_secs),
        obj(name, num, F.lit('"timestamp":null'), F.lit('"type":"summary"')),
        F.concat(F.lit("event "), F.col("event_id").cast("string")),
        obj(name, num, F.concat(at_secs, F.lit(".5")), F.lit('"type":"histogram"')),
        obj(name, at_iso),
    ]
    text = shapes[-1]
    for k, shape in enumerate(shapes[:-1]):
        text = F.when(F.col("event_id") % 10 == k, shape).otherwise(text)
    return e.select("event_id", ts.alias("arrived"), text.alias("value"))


_PARSE_SQL = """
j AS (SELECT event_id, ts, value AS raw, json_valid(value) AS ok,
             CASE WHEN json_valid(value) THEN value::JSON END AS b FROM m),
x AS (SELECT event_id, raw, ok, json_extract_string(b, '$.name') AS name,
             json_extract_string(b, '$.value') AS rv,
             TRY_CAST(json_extract_string(b, '$.value') AS DOUBLE) AS value,
             coalesce(json_extract_string(b, '$.server_id'), 'unknown') AS server_id,
             coalesce(json_extract_string(b, '$.type'), 'gauge') AS metric_type,
             coalesce(json_extract_string(b, '$.labels.k'), '') AS label_k,
             CASE json_type(b, '$.timestamp')
                  WHEN 'VARCHAR' THEN try_strptime(json_extract_string(b, '$.timestamp'), '%Y-%m-%dT%H:%M:%SZ')
                  WHEN 'UBIGINT' THEN make_timestamp(CAST(CAST(json_extract_string(b, '$.timestamp') AS DOUBLE) * 1000000 AS BIGINT))
                  WHEN 'DOUBLE' THEN make_timestamp(CAST(CAST(json_extract_string(b, '$.timestamp') AS DOUBLE) * 1000000 AS BIGINT))
                  ELSE ts END AS timestamp FROM j),
y AS (SELECT *, CASE WHEN NOT ok THEN 'not_json' WHEN timestamp IS NULL THEN 'bad_timestamp'
                     WHEN name IS NULL THEN 'missing_name' WHEN rv IS NULL THEN 'missing_value'
                     WHEN value IS NULL THEN 'bad_value'
                     WHEN metric_type NOT IN ('gauge', 'counter', 'histogram') THEN 'bad_type' END AS reason FROM x)
"""


def _parsed(spark, sf_dir):
    return messages.parse_metric_messages(_messages(spark, sf_dir), "value", F.col("arrived")).drop("arrived")


@query("src1_parse_messages", f"""WITH {_SHAPES_SQL}, {_PARSE_SQL}
    SELECT event_id, server_id, name, timestamp, value, metric_type, label_k FROM y WHERE reason IS NULL""")
def src1(spark, sf_dir):
    good, _ = messages.split_bad_records(_parsed(spark, sf_dir))
    label = F.coalesce(F.col("labels")["k"], F.lit(""))
    return good.select("event_id", "server_id", "name", ntz("timestamp").alias("timestamp"), "value",
                       "metric_type", label.alias("label_k"))


@query("src2_rejected_messages", f"WITH {_SHAPES_SQL}, {_PARSE_SQL} SELECT event_id, raw, reason FROM y WHERE reason IS NOT NULL")
def src2(spark, sf_dir):
    _, bad = messages.split_bad_records(_parsed(spark, sf_dir))
    return bad.select("event_id", "raw", "reason")


# ---- saved responses ---------------------------------------------------------

def _labels(*pairs):
    out = F.lit("{")
    for i, (k, v) in enumerate(pairs):
        out = F.concat(out, F.lit(("," if i else "") + f'"{k}":"'), v, F.lit('"'))
    return F.concat(out, F.lit("}"))


def _responses(spark, sf_dir, kind: str, values):
    """One response per event with two series: one labelled, one bare or by job."""
    e = table(spark, sf_dir, "events")
    server = F.concat(F.lit("srv-"), F.col("user_id").cast("string"))
    first = F.concat(F.lit('{"metric":'), _labels(("instance", server), ("job", F.lit("node"))), values[0], F.lit("}"))
    second = F.concat(F.lit('{"metric":'), F.when(F.col("user_id") % 2 == 0, _labels(("job", F.lit("node")))).otherwise("{}"),
                      values[1], F.lit("}"))
    status = F.when(F.col("event_type") == "error", "error").otherwise("success")
    body = F.concat(F.lit('{"status":"'), status, F.lit(f'","data":{{"resultType":"{kind}","result":['),
                    first, F.lit(","), second, F.lit("]}}"))
    return e.select("event_id", F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("scraped_at"),
                    body.alias("body"))


@query("src4_instant_vector", """
    SELECT event_id, event_type AS name, 'srv-' || user_id AS server_id, ts AS timestamp, value, 2 AS n_labels
    FROM events WHERE event_type <> 'error'
    UNION ALL
    SELECT event_id, event_type, CASE WHEN user_id % 2 = 0 THEN 'node' ELSE 'unknown' END, ts,
           CASE event_type WHEN 'click' THEN 0.0 ELSE value * 2 END, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END
    FROM events WHERE event_type NOT IN ('error', 'view')""")
def src4(spark, sf_dir):
    def pair(v):
        return F.concat(F.lit(',"value":[1700000000.5,"'), v, F.lit('"]'))

    twice = (F.col("value") * 2).cast("string")
    second = (F.when(F.col("event_type") == "view", pair(F.lit("broken")))
              .when(F.col("event_type") == "click", F.lit("")).otherwise(pair(twice)))
    df = _responses(spark, sf_dir, "vector", (pair(F.col("value").cast("string")), second))
    out = responses.flatten_instant_vector(df)
    return out.select("event_id", "name", "server_id", ntz("timestamp").alias("timestamp"), "value",
                      F.size("labels").alias("n_labels"))


@query("src5_range_matrix", """
    WITH k AS (SELECT *, unnest([0, 1, 2]) AS i FROM events WHERE event_type <> 'error')
    SELECT event_id, event_type AS name, 'srv-' || user_id AS server_id,
           make_timestamp((1700000000::BIGINT + 300 * i) * 1000000) AS timestamp, value + i AS value FROM k
    UNION ALL
    SELECT event_id, event_type, 'unknown', make_timestamp((1700000000::BIGINT + 300 * i) * 1000000), value
    FROM k WHERE i <> 1""")
def src5(spark, sf_dir):
    def pairs(cells):
        out = F.lit(',"values":[')
        for i, v in enumerate(cells):
            out = F.concat(out, F.lit(("," if i else "") + f'[{1700000000 + 300 * i},"'), v, F.lit('"]'))
        return F.concat(out, F.lit("]"))

    v = F.col("value")
    first = pairs([(v + i).cast("string") for i in range(3)])
    second = pairs([v.cast("string"), F.lit("bad"), v.cast("string")])
    out = responses.flatten_range_matrix(_responses(spark, sf_dir, "matrix", (first, second)))
    return out.select("event_id", "name", "server_id", ntz("timestamp").alias("timestamp"), "value")


# ---- tables ------------------------------------------------------------------

_LINE_SCHEMA = "id bigint, quantity double, price double, discount double, empty double"


@query("src6_csv_impute", f"""
    WITH t AS (SELECT event_id AS id, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS quantity,
                      CASE WHEN event_type = 'click' THEN NULL ELSE user_id::DOUBLE END AS price, value * 2 AS discount FROM events)
    SELECT id, {sql6('coalesce(quantity, (SELECT avg(quantity) FROM t))')} AS quantity,
           {sql6('coalesce(price, (SELECT avg(price) FROM t))')} AS price,
           {sql6('discount')} AS discount, 0.0::DOUBLE AS empty FROM t""")
def src6(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.concat_ws(
        ",", F.col("event_id").cast("string"),
        F.when(F.col("event_type") == "view", "NaN").otherwise(F.col("value").cast("string")),
        F.when(F.col("event_type") == "click", "").otherwise(F.col("user_id").cast("string")),
        (F.col("value") * 2).cast("string"), F.lit(""))
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL(_LINE_SCHEMA)
    rows = tables.parse_csv_lines(e.select(line.alias("line")), "line", schema)
    filled = tables.impute_numeric(rows, ["quantity", "price", "discount", "empty"])
    return filled.select("id", *[r6(c).alias(c) for c in ("quantity", "price", "discount", "empty")])


_WIDE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("src7_wide_to_long", " UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, l_partkey, '{c}' AS name, {c} AS value FROM lineitem" for c in _WIDE))
def src7_long(spark, sf_dir):
    ids = ("l_orderkey", "l_linenumber", "l_partkey")
    li = table(spark, sf_dir, "lineitem").select(*ids, *_WIDE)
    return tables.wide_to_long(li, ids, _WIDE)


_EVENTS = ("click", "error", "purchase", "signup", "view")


@query("src7_long_to_wide", f"""WITH {POINTS} SELECT server_id, time_bucket(INTERVAL 1 HOUR, timestamp) AS timestamp,
    {', '.join(f"max(value) FILTER (name = '{m}') AS m_{m}" for m in _EVENTS)} FROM p GROUP BY ALL""")
def src7_wide(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("timestamp", F.window("timestamp", "1 hour").start)
    wide = tables.long_to_wide(p, _EVENTS)
    return wide.select("server_id", ntz("timestamp").alias("timestamp"), *[F.col(m).alias(f"m_{m}") for m in _EVENTS])


_LATEST = f"""lm AS (SELECT server_id, name, arg_max(value, (timestamp, seq)) AS value FROM p GROUP BY ALL)"""


@query("src10_exposition", f"""WITH {POINTS}, {_LATEST}
    SELECT name, 0 AS line_no, '' AS server_id, '# HELP ' || name || ' Simulated ' || name || ' metric' AS line FROM (SELECT DISTINCT name FROM lm)
    UNION ALL SELECT name, 1, '', '# TYPE ' || name || ' gauge' FROM (SELECT DISTINCT name FROM lm)
    UNION ALL SELECT name, 2, server_id, name || '{{instance="' || server_id || ':9100"}} ' || CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) FROM lm""")
def src10(spark, sf_dir):
    return exposition.exposition_lines(latest_metrics(points(spark, sf_dir)))


@query("so1_merge_sources", f"""WITH {POINTS} SELECT server_id, name, timestamp, value, seq, 'events' AS source, NULL AS priority FROM p
    UNION ALL SELECT 'cust-' || o_custkey, 'total_price', o_orderdate, o_totalprice, o_orderkey, 'orders', o_orderpriority FROM orders""")
def so1(spark, sf_dir):
    from pulsewarden.operators.joins import merge_sources

    first = points(spark, sf_dir).withColumn("source", F.lit("events"))
    second = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("server_id"),
        F.lit("total_price").alias("name"), F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"), F.lit("orders").alias("source"),
        F.col("o_orderpriority").alias("priority"))
    out = merge_sources(first, second)
    return out.select("server_id", "name", ntz("timestamp").alias("timestamp"), "value", "seq", "source", "priority")


# ---- sinks -------------------------------------------------------------------

_VERSIONS = """m AS (SELECT DISTINCT event_type AS name, '1.' || (user_id % 12) || '.0' AS version FROM events),
w AS (SELECT DISTINCT event_type AS name, '1.' || (user_id % 20) || '.0' AS version FROM events)"""


@query("snk1_resolve_version", f"""WITH {_VERSIONS} SELECT w.name, w.version,
    CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.name = w.name AND m.version = w.version) THEN w.version
         ELSE (SELECT max(version) FROM m WHERE m.name = w.name) END AS resolved FROM w""")
def snk1(spark, sf_dir):
    e = table(spark, sf_dir, "events")

    def versions(k):
        v = F.concat(F.lit("1."), (F.col("user_id") % k).cast("string"), F.lit(".0"))
        return e.select(F.col("event_type").alias("name"), v.alias("version")).distinct()

    return stores.resolve_version(versions(12), versions(20))


@query("snk1_model_info", f"""WITH {POINTS}, m AS (SELECT name, '1.' || (user_id % 3) || '.0' AS version, timestamp AS created_at, seq, value FROM p),
    n AS (SELECT name, version, arg_max(seq, (created_at, 'models/' || seq)) AS seq, max(created_at) AS created_at FROM m GROUP BY ALL),
    a AS (SELECT name, arg_max(version, (created_at, version)) AS active FROM m GROUP BY name)
    SELECT name, version, 'algorithm of ' || name AS algorithm, 'models/' || n.seq AS path, {sql6('p.value')} AS score, n.created_at, version = active AS is_active
    FROM n JOIN a USING (name) JOIN (SELECT seq, value FROM p) p ON p.seq = n.seq""")
def snk1_info(spark, sf_dir):
    """Every event registers a version of its type's model; the table is written, listed by name and read."""
    p = points(spark, sf_dir, "user_id")
    path = f"{scratch_dir(spark)}/models-{uuid.uuid4().hex}"
    stores.register_models(p.select(
        "name", F.concat(F.lit("1."), (F.col("user_id") % 3).cast("string"), F.lit(".0")).alias("version"),
        F.concat(F.lit("algorithm of "), "name").alias("algorithm"), F.concat(F.lit("models/"), F.col("seq").cast("string")).alias("path"),
        F.create_map(F.lit("score"), F.col("value")).alias("metrics"), F.col("timestamp").alias("created_at")), path, replace=True)
    both = stores.list_models(spark, path, "view").unionByName(stores.list_models(spark, path).filter("name <> 'view'"))
    return both.select("name", "version", "algorithm", "path", r6(F.col("metrics")["score"]).alias("score"),
                       ntz("created_at").alias("created_at"), "is_active")


@query("snk1_active_model", f"WITH {POINTS} SELECT 'active' AS loaded, name, max(value) AS top FROM p WHERE user_id % 3 = 1 GROUP BY name UNION ALL SELECT 'wanted', name, max(value) FROM p WHERE user_id % 3 = 2 GROUP BY name")
def snk1_active(spark, sf_dir):
    """Three versions of a model table; an earlier one is made active again, and one is asked for by name."""
    p, base = points(spark, sf_dir, "user_id"), f"{scratch_dir(spark)}/models-{uuid.uuid4().hex}"
    for k in range(3):
        top = p.filter(F.col("user_id") % 3 == k).groupBy("name").agg(F.max("value").alias("top"))
        stores.store_model(top, base, "tops", f"1.{k}.0", "maximum", {"part": k})
    stores.activate_model(spark, base, "tops", "1.1.0")
    active, wanted = stores.load_model(spark, base, "tops"), stores.load_model(spark, base, "tops", "1.2.0")
    return active.select(F.lit("active").alias("loaded"), "name", "top").unionByName(wanted.select(F.lit("wanted").alias("loaded"), "name", "top"))


def _alerts(spark, sf_dir):
    """Alerts of every verdict that passes the gate, without suppression."""
    return al.build_alerts(al.grade(verdicts(spark, sf_dir)), al.DEFAULTS.with_(dashboard_base="http://grafana:3000"))


_TWO = "CAST(round(CAST(CAST({0} AS VARCHAR) AS DECIMAL(38, 26)), 2) AS DECIMAL(18, 2))::VARCHAR"
_ONE = "CAST(round(CAST(CAST({0} AS VARCHAR) AS DECIMAL(38, 26)), 1) AS DECIMAL(18, 1))::VARCHAR"
_SCORE = _TWO.format("anomaly_score")
MESSAGE = f"""CASE WHEN is_predicted THEN '[PREDICTED] ' || metric_name || ' on ' || server_id || ' is forecast to reach anomalous levels within the prediction horizon (score: ' || {_SCORE} || ')'
    WHEN forecast IS NOT NULL THEN upper(severity) || ': ' || metric_name || ' on ' || server_id || ' at ' || {_ONE.format('actual')} || '% deviates from predicted normal of ' || {_ONE.format('forecast')} || '% (anomaly score: ' || {_SCORE} || ')'
    ELSE upper(severity) || ': ' || metric_name || ' on ' || server_id || ' shows anomalous behavior (score: ' || {_SCORE} || ', threshold exceeded)' END"""
_ACTIONS = {m: a for m, a in al.SUGGESTED_ACTIONS.items()}
ACTION = ("CASE metric_name " + " ".join(f"WHEN '{m}' THEN '{a}'" for m, a in _ACTIONS.items())
          + f" ELSE '{al.DEFAULT_ACTION}' END")
ISO = "strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(timestamp) % 1000000 = 0 THEN '' ELSE strftime(timestamp, '.%f') END || '+00:00'"
ALERTS = GRADED.rstrip() + f""",
a AS (SELECT *, 'alt_' || substr(sha256(concat_ws('|', server_id, metric_name, severity, epoch_us(timestamp)::VARCHAR, seq::VARCHAR)), 1, 12) AS alert_id,
             {MESSAGE} AS message, {ACTION} AS suggested_action,
             'http://grafana:3000/d/server-detail?var-server=' || server_id AS dashboard_url, {ISO} AS iso,
             round(CAST(CAST(anomaly_score AS VARCHAR) AS DECIMAL(38, 26)), 4)::DOUBLE AS score4 FROM g)
"""
_HORIZON = """CASE WHEN is_predicted THEN '{"source":"holt_winters","values":[' || actual || '],"steps":1}' ELSE 'null' END"""
_JSON = f"""'{{"alert_id":"' || alert_id || '","server_id":"' || server_id || '","metric_name":"' || metric_name || '","anomaly_score":' || score4 || ',"severity":"' || severity || '","is_predicted":' || is_predicted || ',"prediction_horizon":' || {_HORIZON} || ',"message":"' || message || '","suggested_action":"' || suggested_action || '","model_details":{{}},"dashboard_url":"' || dashboard_url || '","timestamp":"' || iso || '","correlation_id":"","acknowledged":false,"acknowledged_by":""}}'"""


@query("sc14_alert_json", f"WITH {ALERTS} SELECT alert_id, {_JSON} AS json FROM a")
def sc14(spark, sf_dir):
    return _alerts(spark, sf_dir).select("alert_id", s.alert_json().alias("json"))


@query("sc8_alert_message", f"WITH {ALERTS} SELECT alert_id, message FROM a")
def sc8(spark, sf_dir):
    return _alerts(spark, sf_dir).select("alert_id", "message")


_SLACK = f"""'{{"channel":"#alerts","username":"Anomaly Detector","attachments":[{{"color":"' || CASE severity WHEN 'info' THEN '#36a3eb' WHEN 'warning' THEN '#f5a623' ELSE '#e74c3c' END ||
    '","blocks":[{{"type":"header","text":{{"type":"plain_text","text":"' || severity[1] || ' Anomaly Alert — ' || upper(severity) || '"}}}},{{"type":"section","fields":[{{"type":"mrkdwn","text":"*Server:* `' || server_id || '`"}},{{"type":"mrkdwn","text":"*Metric:* `' || metric_name || '`"}},{{"type":"mrkdwn","text":"*Score:* `' || {_SCORE} || '`"}},{{"type":"mrkdwn","text":"*Predicted:* ' || CASE WHEN is_predicted THEN 'Yes' ELSE 'No' END || '"}}]}},{{"type":"section","text":{{"type":"mrkdwn","text":"*Message:* ' || message || '"}}}},{{"type":"section","text":{{"type":"mrkdwn","text":"*Suggested Action:* ' || suggested_action || '"}}}},{{"type":"actions","elements":[{{"type":"button","text":{{"type":"plain_text","text":"View Dashboard"}},"url":"' || dashboard_url || '"}}]}}]}}]}}'"""
_PD = """'{"routing_key":"rk","event_action":"trigger","dedup_key":"anomaly-' || server_id || '-' || metric_name || '","payload":{"summary":"' || message || '","severity":"' || severity || '","source":"' || server_id || '","component":"' || metric_name || '","group":"infrastructure","class":"anomaly_detection","custom_details":{},"timestamp":"' || iso || '"}}'"""
_MAIL = f"""'{{"from":"a@b.c","to":"x@y.z, u@v.w","subject":"[' || upper(severity) || '] Anomaly: ' || metric_name || ' on ' || server_id || '","body":"' || replace({_JSON}, '"', '\\"') || '"}}'"""


def _channels():
    return [ch.Webhook(), ch.Slack(), ch.PagerDuty("rk"), ch.Email("a@b.c", ["x@y.z", "u@v.w"])]


@query("snk3_channel_payloads", f"""WITH {ALERTS} SELECT alert_id, 'webhook' AS channel, {_JSON} AS payload FROM a
    UNION ALL SELECT alert_id, 'slack', {_SLACK} FROM a
    UNION ALL SELECT alert_id, 'pagerduty', {_PD} FROM a
    UNION ALL SELECT alert_id, 'email', {_MAIL} FROM a""")
def snk3(spark, sf_dir):
    return ch.route_alerts(_alerts(spark, sf_dir), _channels())


@query("snk4_route_results", f"""WITH {ALERTS} SELECT alert_id, 'email=' || (length(message) < 100) || ',pagerduty=' || (severity = 'critical') || ',webhook=true' AS results FROM a""")
def snk4(spark, sf_dir):
    a = _alerts(spark, sf_dir)
    routed = ch.route_alerts(a, [ch.Webhook(), ch.PagerDuty("rk"), ch.Email()])
    facts = a.select("alert_id", "severity", F.length("message").alias("n"))
    outcome = routed.select("alert_id", "channel").join(facts, "alert_id").select(
        "alert_id", "channel",
        F.when(F.col("channel") == "email", F.col("n") < 100)
        .when(F.col("channel") == "pagerduty", F.col("severity") == "critical").otherwise(True).alias("ok"))
    results = ch.delivery_results(outcome)
    text = F.array_join(F.transform(F.map_entries("results"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return results.select("alert_id", text.alias("results"))


@query("snk2_alert_store", f"""WITH {ALERTS} SELECT alert_id, server_id, metric_name, severity, message,
    CAST(timestamp AS DATE) AS alert_date, timestamp FROM a""")
def snk2(spark, sf_dir):
    import uuid

    path = f"{shared_dir(spark)}/pulsewarden/alerts-{uuid.uuid4().hex}"
    rows = _alerts(spark, sf_dir)
    stores.append_alerts(rows, path)
    stores.append_alerts(rows, path)  # a repeated batch adds nothing
    return spark.read.parquet(path).select("alert_id", "server_id", "metric_name", "severity", "message",
                                           F.col("alert_date").cast("date").alias("alert_date"),
                                           ntz("timestamp").alias("timestamp"))


@query("snk6_retention", f"WITH {POINTS} SELECT server_id, name, seq, value FROM p WHERE timestamp >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAYS")
def snk6_keep(spark, sf_dir):
    return stores.retain(points(spark, sf_dir), datetime(2024, 1, 31), 10).select("server_id", "name", "seq", "value")


@query("snk6_downsample", f"""WITH {POINTS} SELECT server_id, name, time_bucket(INTERVAL 1 HOUR, timestamp) AS step,
    {sql6('avg(value)')} AS avg_value, min(value) AS min_value, max(value) AS max_value, count(value) AS n_points FROM p GROUP BY ALL""")
def snk6_down(spark, sf_dir):
    d = stores.downsample(points(spark, sf_dir), "1 hour")
    return d.select("server_id", "name", ntz("step").alias("step"), r6("avg_value").alias("avg_value"),
                    "min_value", "max_value", "n_points")


@query("snk6_incremental", f"""WITH {POINTS} SELECT server_id, name, time_bucket(INTERVAL 1 HOUR, timestamp) AS step,
    {sql6('avg(value)')} AS avg_value, min(value) AS min_value, max(value) AS max_value, count(value) AS n_points FROM p GROUP BY ALL""")
def snk6_incremental(spark, sf_dir):
    """The days one after the other, then points that come late, then the rest of a day."""
    p, path = points(spark, sf_dir), f"{scratch_dir(spark)}/summaries-{uuid.uuid4().hex}"
    late = F.col("seq") % 50 == 7
    half = F.dayofmonth("timestamp") <= 15
    for part in (p.filter(half & ~late), p.filter(~half & ~late), p.filter(late)):
        stores.add_points(part, path)
    d = stores.read_summaries(spark, path)
    return d.select("server_id", "name", ntz("step").alias("step"), r6("avg_value").alias("avg_value"), "min_value", "max_value", "n_points")
