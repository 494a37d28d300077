"""Severity, suppression, rules, messages and payloads."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsewarden.config import DEFAULTS
from pulsewarden.functions import scalars as s
from pulsewarden.operators import alerts as al, suppression as sup
from pulsewarden.schema import ALERT_SCHEMA
from pulsewarden.sinks import channels as ch, stores

T0 = dt.datetime(2026, 1, 1)
CAND = "server_id string, metric_name string, severity string, timestamp timestamp, seq bigint"


def candidates(spark, minutes, key=("a", "cpu", "warning"), start=0):
    return [(*key, T0 + dt.timedelta(minutes=float(m)), start + i) for i, m in enumerate(minutes)]


def sequential(rows, cooldown, cap):
    """The rule applied to one candidate after another."""
    state, out = {}, set()
    for r in sorted(rows, key=lambda r: (r[3], r[4])):
        last, hour, sent = state.get(r[:3], (None, None, 0))
        now = r[3].replace(minute=0, second=0, microsecond=0)
        sent = sent if now == hour else 0
        if (last is None or r[3] - last >= dt.timedelta(minutes=cooldown)) and sent < cap:
            out.add(r[4])
            last, sent = r[3], sent + 1
        state[r[:3]] = (last, now, sent)
    return out


def test_severity_borders(spark):
    scores = [0.3, 0.5, 0.55, 0.7, 0.75, 0.85, 0.9]
    df = spark.createDataFrame([(x,) for x in scores], "x double")
    got = [r[0] for r in df.select(s.severity(F.col("x"))).collect()]
    assert got == ["info", "info", "info", "warning", "warning", "critical", "critical"]
    counter = [r[0] for r in df.select(s.counter_severity(F.col("x"))).collect()]
    assert counter[5:] == ["warning", "critical"]


def test_cooldown_is_strict_and_only_sent_alerts_count(spark):
    rows = candidates(spark, [0, 10, 29, 30, 45, 61])
    got = al.suppress(spark.createDataFrame(rows, CAND), 30).collect()
    assert sorted(r["seq"] for r in got) == [0, 3, 5]


def test_keys_do_not_share_a_cooldown(spark):
    rows = candidates(spark, [0, 5]) + candidates(spark, [1, 6], ("b", "cpu", "warning"), 10)
    got = al.suppress(spark.createDataFrame(rows, CAND), 30).collect()
    assert sorted(r["seq"] for r in got) == [0, 10]


@pytest.mark.parametrize("cooldown,cap,seed", [(30, 50, 1), (7, 3, 2), (0, 4, 3), (90, 50, 4), (1, 50, 5), (0.5, 50, 6)])
def test_suppression_equals_sequential_rule(spark, cooldown, cap, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(3):
        minutes = np.round(np.sort(rng.exponential(rng.choice([0.3, 5, 400]), 400).cumsum()), 2)
        minutes[10:14] = minutes[10]  # equal times
        rows += candidates(spark, minutes, ("s", f"m{k}", "warning"), 1000 * k)
    got = {r["seq"] for r in al.suppress(spark.createDataFrame(rows, CAND).repartition(4), cooldown, cap).collect()}
    assert got == sequential(rows, cooldown, cap)


@pytest.mark.parametrize("gap,fan,cooldown,cap", [(400, 3, 30, 50), (90, 2, 45, 50), (40, 2, 10, 2)])
def test_long_histories_are_joined_level_by_level(spark, gap, fan, cooldown, cap):
    rng = np.random.default_rng(gap)
    rows = []
    for k in range(2):
        minutes = np.round(rng.exponential(gap, 250).cumsum() + 1e4 * k, 2)
        minutes[100:] += 20_000 * k  # a stretch without candidates
        rows += candidates(spark, minutes, ("s", f"m{k}", "warning"), 1000 * k)
    got = {r["seq"] for r in al.suppress(spark.createDataFrame(rows, CAND), cooldown, cap, fan=fan).collect()}
    assert got == sequential(rows, cooldown, cap)


def test_nothing_passes_a_zero_cap(spark):
    assert al.suppress(spark.createDataFrame(candidates(spark, [0, 40]), CAND), 30, 0).count() == 0


def test_cap_binding():
    assert not sup.cap_can_bind(30, 50) and sup.cap_can_bind(0, 50) and sup.cap_can_bind(1, 50)


def test_tables_compose_to_the_sequential_rule():
    """Any cut of a history into blocks and any tree over them gives the alerts of the plain walk."""
    r = np.random.default_rng(4)
    for trial in range(300):
        minute = 60_000_000
        cooldown = int(r.choice([1, 7, 25, 90])) * minute
        cap = int(r.choice([1, 2, 5, 1 << 61]))
        rule = sup.Rule(cooldown, cap, max(cooldown, sup.HOUR) if cap < 100 else cooldown)
        times = np.unique((r.exponential(r.choice([0.2, 2, 30]), r.integers(1, 150)).cumsum() * minute).astype(np.int64))
        cuts = np.unique(np.append(0, r.integers(0, len(times), r.integers(0, 30))))
        blocks = np.split(times, cuts[1:])
        tables = [sup.Table.of_rows(b, rule) for b in blocks]
        want = {int(times[p]) for p in sup._sent(times.tolist(), *[int(x[0]) for x in vars(sup.begin()).values()], rule)}

        def resolve(tables, blocks, state, fan):
            if len(tables) == 1:
                return {int(blocks[0][p]) for p in sup._sent(blocks[0].tolist(), *[int(x[0]) for x in vars(state).values()], rule)}
            size, out = max(1, -(-len(tables) // fan)), set()
            for i in range(0, len(tables), size):
                out |= resolve(tables[i: i + size], blocks[i: i + size], state, fan)
                whole = sup.compose(tables[i: i + size], rule)
                assert len(whole.t) <= 1 + (times < whole.t[0] + rule.reach).sum()
                state = whole.advance(state, rule)
            return out

        assert resolve(tables, blocks, sup.begin(), int(r.integers(2, 5))) == want


@pytest.mark.parametrize("cooldown,cap,rows,fan,gap", [(30, 50, 16, 2, 4), (5, 2, 16, 3, 2), (1, 5, 3, 2, 0.4), (600, 50, 5, 3, 20), (2, 3, 1, 4, 3)])
def test_blocks_of_few_rows(spark, cooldown, cap, rows, fan, gap):
    rng = np.random.default_rng(rows)
    cand = []
    for k, key in enumerate([("s", "a", "warning"), ("s", None, "warning"), ("s", "", "warning"), ("s", "b", "info")]):
        cand += candidates(spark, np.round(rng.exponential(gap, 180 if k < 2 else 4).cumsum(), 2), key, 1000 * k)
    df = spark.createDataFrame(cand, CAND).repartition(3)
    got = {r["seq"] for r in al.suppress(df, cooldown, cap, fan=fan, block_rows=rows).collect()}
    assert got == sequential(cand, cooldown, cap)


def test_no_array_is_longer_than_a_block(spark, monkeypatch):
    """A key whose alerts all lie inside one cooldown: tables stay in pieces."""
    seen, write = [], sup.materialize

    def watched(df, *by):
        out = write(df, *by)
        seen.extend(out.select(F.max(F.size(c)).alias("n")).first()["n"] for c, kind in out.dtypes if kind.startswith("array"))
        return out

    monkeypatch.setattr(sup, "materialize", watched)
    cand = candidates(spark, np.arange(1000) / 50)
    got = al.suppress(spark.createDataFrame(cand, CAND), 30, 50, fan=4, block_rows=16)
    assert [r["seq"] for r in got.collect()] == [0]
    assert len(seen) > 10 and max(seen) == 16


def test_tiny_blocks_take_few_tables(spark, monkeypatch):
    """Levels of a small fan are joined in one task, not with a written table each."""
    tables, write = [], sup.materialize
    monkeypatch.setattr(sup, "materialize", lambda df, *by: (tables.append(df.columns), write(df, *by))[1])
    cand = candidates(spark, np.round(np.random.default_rng(3).exponential(9, 300).cumsum(), 2))
    got = {r["seq"] for r in al.suppress(spark.createDataFrame(cand, CAND), 30, 50, fan=2, block_rows=1).collect()}
    assert got == sequential(cand, 30, 50)
    assert sum("piece" in columns for columns in tables) == 2


def test_groups_of_tables_stay_whole_if_a_join_turns_broadcast(spark):
    """Spark may read such a join's rows without shuffling them, in pieces of groups."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB"}
    before = {k: spark.conf.get(k, None) for k in settings}
    cand = candidates(spark, np.round(np.random.default_rng(5).exponential(2, 2500).cumsum(), 2))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r["seq"] for r in al.suppress(spark.createDataFrame(cand, CAND), 30, 50, fan=2, block_rows=1).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == sequential(cand, 30, 50)


def test_tables_of_many_stretches_are_joined_in_step():
    """All groups of a level at once give the same tables as one group after the other."""
    r, minute = np.random.default_rng(9), 60_000_000
    for cooldown, cap, fan in ((5, 2, 3), (1, 3, 2), (7, 1 << 61, 4)):
        rule = sup.Rule(cooldown * minute, cap, sup.HOUR)
        times = [np.unique((r.exponential(r.choice([0.5, 20]), n).cumsum() * minute).astype(np.int64)) for n in r.integers(1, 9, 40)]
        start = np.cumsum([0, *[int(x[-1]) + minute for x in times[:-1]]])
        times = [x + s for x, s in zip(times, start)]
        every = sup.Table.of_rows(np.concatenate(times), rule, np.cumsum([0, *map(len, times[:-1])]))
        heads = np.arange(0, 40, fan)
        got = every.compose(heads, rule)
        for i, k in enumerate(heads):
            want = sup.compose([sup.Table.of_rows(x, rule) for x in times[k: k + fan]], rule)
            own = slice(got.at[i], got.at[i + 1])
            assert [x.tolist() for x in (got.t[own], got.w[own], got.exit.free[own], got.exit.hour[own], got.exit.sent[own])] == [
                x.tolist() for x in (want.t, want.w, want.exit.free, want.exit.hour, want.exit.sent)]


def detection(spark, score, flag, **extra):
    cols = {"server_id": "web-1", "metric_name": "cpu_usage", "timestamp": T0, "seq": 1,
            "anomaly_score": score, "is_anomaly": flag, **extra}
    df = spark.range(1)
    for k, v in cols.items():
        df = df.withColumn(k, v if hasattr(v, "_jc") or not isinstance(v, (str, int, float, bool, dt.datetime)) else F.lit(v))
    return df.drop("id")


def test_evaluate_builds_an_alert(spark):
    d = detection(spark, 0.85, True, actual=92.0, forecast=45.0)
    a = al.evaluate(d, DEFAULTS.with_(dashboard_base="http://g")).first()
    assert a["severity"] == "critical" and a["is_predicted"] is False
    assert a["message"] == ("CRITICAL: cpu_usage on web-1 at 92.0% deviates from predicted normal of 45.0% (anomaly score: 0.85)")
    assert a["suggested_action"].startswith("Investigate high CPU usage")
    assert a["dashboard_url"] == "http://g/d/server-detail?var-server=web-1"
    assert a["alert_id"].startswith("alt_") and len(a["alert_id"]) == 16
    assert set(ALERT_SCHEMA.fieldNames()) <= set(a.asDict())


def test_low_scores_give_no_alert_unless_flagged(spark):
    assert al.evaluate(detection(spark, 0.3, False)).count() == 0
    assert al.evaluate(detection(spark, 0.3, True)).first()["severity"] == "info"


def test_predicted_message(spark):
    horizon = F.struct(F.lit("lstm").alias("source"), F.array(F.lit(1.0)).alias("values"), F.lit(1).alias("steps"))
    a = al.evaluate(detection(spark, 0.75, True, prediction_horizon=horizon)).first()
    assert a["is_predicted"] and a["message"].startswith("[PREDICTED] cpu_usage on web-1 is forecast")


@pytest.mark.parametrize("pattern,name,fits", [
    ("cpu_usage", "cpu_usage", True), ("cpu_*", "cpu_usage", True), ("cpu_*", "memory_usage", False), ("*", "", True),
    ("c?u", "cpu", True), ("c?u", "cu", False), ("[cm]*", "memory", True), ("[!cm]*", "memory", False),
    ("a.c", "abc", False), ("a[", "a[", True), ("[a-c]x", "bx", True), ("CPU", "cpu", False), ("[]]", "]", True),
    ("a+(b)", "a+(b)", True), ("cpu", "cpu_usage", False),
])
def test_glob(spark, pattern, name, fits):
    got = spark.range(1).select(F.lit(name).rlike(s.glob_regex(pattern))).first()[0]
    assert got is fits


def test_disabled_rules_match_nothing(spark):
    assert al.match_rules(detection(spark, 0.9, True), [al.AlertRule("x", enabled=False)]).count() == 0


@pytest.mark.parametrize("text,masked", [
    ("all fine", "all fine"), ("my Password is x", s.MASK), ("api-key=1", s.MASK), ("id 123.456.789-01 ok", s.MASK),
    ("mail john.doe@example.com now", "ma***@example.com now"), ("token a@b", "to***@b"), ("a@b no tld", "a@b no tld"),
    ("x@y.com and z@w.org", "x***@y.com and z"),
])
def test_masking(spark, text, masked):
    assert spark.range(1).select(s.mask_pii(F.lit(text))).first()[0] == masked


@pytest.fixture(scope="module")
def one_alert(spark):
    d = detection(spark, 0.91239, True, actual=92.0, forecast=45.0)
    return al.evaluate(d, DEFAULTS.with_(dashboard_base="http://g")).cache()


def test_payloads_are_json(spark, one_alert):
    rows = ch.route_alerts(one_alert, [ch.Webhook(), ch.Slack(), ch.PagerDuty("rk"), ch.Email("f", ["t"])]).collect()
    p = {r["channel"]: json.loads(r["payload"]) for r in rows}
    assert p["webhook"]["anomaly_score"] == 0.9124 and len(p["webhook"]) == 15
    assert p["webhook"]["timestamp"] == "2026-01-01T00:00:00+00:00" and p["webhook"]["prediction_horizon"] is None
    att = p["slack"]["attachments"][0]
    assert att["color"] == "#e74c3c" and len(att["blocks"]) == 5 and p["slack"]["channel"] == "#alerts"
    assert att["blocks"][0]["text"]["text"] == "c Anomaly Alert — CRITICAL"
    assert att["blocks"][1]["fields"][2]["text"] == "*Score:* `0.91`"
    assert p["pagerduty"]["dedup_key"] == "anomaly-web-1-cpu_usage" and p["pagerduty"]["payload"]["severity"] == "critical"
    assert p["email"]["subject"] == "[CRITICAL] Anomaly: cpu_usage on web-1"
    assert json.loads(p["email"]["body"])["alert_id"] == p["webhook"]["alert_id"]


def test_slack_without_dashboard_has_no_button(spark):
    a = al.evaluate(detection(spark, 0.9, True))
    blocks = json.loads(ch.Slack().format(a).first()["payload"])["attachments"][0]["blocks"]
    assert [b["type"] for b in blocks] == ["header", "section", "section", "section"]


def test_no_channels_no_payloads(spark, one_alert):
    assert ch.route_alerts(one_alert, []).count() == 0


def test_store_is_idempotent(spark, one_alert, tmp_path):
    path = str(tmp_path / "alerts")
    stores.append_alerts(one_alert, path)
    stores.append_alerts(one_alert, path)
    assert spark.read.parquet(path).count() == 1


def test_acknowledge_takes_the_latest(spark, one_alert):
    i = one_alert.first()["alert_id"]
    acks = spark.createDataFrame([(i, "ann", T0), (i, "bob", T0 + dt.timedelta(1)), ("x", "c", T0)],
                                 "alert_id string, acknowledged_by string, acked_at timestamp")
    a = al.acknowledge(one_alert, acks).first()
    assert a["acknowledged"] and a["acknowledged_by"] == "bob"


def test_recent_alerts_filters_before_limiting(spark):
    rows = [("a", "critical" if i % 3 == 0 else "info", T0 + dt.timedelta(minutes=i), i) for i in range(30)]
    df = spark.createDataFrame(rows, "server_id string, severity string, timestamp timestamp, seq bigint")
    got = [r["seq"] for r in al.recent_alerts(df, 4, "critical").collect()]
    assert got == [18, 21, 24, 27]
