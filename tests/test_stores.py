"""Stored tables: models, rules, summaries and the outbox."""

import datetime as dt
import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from pulsewarden.operators import alerts as al, service, suppression as sup
from pulsewarden.operators.detectors.holtwinters import HoltWinters
from pulsewarden.sinks import stores
from pulsewarden.sinks.channels import Slack, Webhook
from pulsewarden.sinks.outbox import Outbox

T0 = dt.datetime(2026, 1, 1)


def test_the_registry_says_what_is_loaded(spark, tmp_path):
    base = str(tmp_path)
    for v, x in (("1.9.0", 1), ("1.10.0", 2), ("2.0.0", 3)):
        stores.store_model(spark.range(x), base, "m", v, "range", {"rows": x, "none": None})
    assert stores.active_version(spark, base, "m") == "2.0.0" and stores.load_model(spark, base, "m").count() == 3
    stores.activate_model(spark, base, "m", "1.9.0")
    assert stores.load_model(spark, base, "m").count() == 1 and stores.load_model(spark, base, "m", "1.10.0").count() == 2
    assert stores.load_model(spark, base, "m", "9.9.9").count() == 3  # not stored: the last by name order
    info = {r["version"]: r for r in stores.list_models(spark, f"{base}/_registry", "m").collect()}
    assert set(info) == {"1.9.0", "1.10.0", "2.0.0"} and info["1.9.0"]["is_active"] and info["1.9.0"]["metrics"] == {"rows": 1.0}
    with pytest.raises(LookupError):
        stores.activate_model(spark, base, "m", "3.0.0")
    with pytest.raises(LookupError):
        stores.load_model(spark, base, "other")


def test_a_name_and_version_are_registered_once(spark, tmp_path):
    path = str(tmp_path / "models")
    row = lambda v, n=1: spark.createDataFrame([("m", v, "a", "p", {}, T0)] * n, stores.MODEL_SCHEMA)
    stores.register_models(row("1"), path)
    for twice in (row("1"), row("2", 2)):
        with pytest.raises(ValueError):
            stores.register_models(twice, path)
    stores.register_models(row("2"), path)
    stores.register_models(row("1"), path, replace=True)
    assert sorted(r["version"] for r in stores.list_models(spark, path).collect()) == ["1", "2"]


def test_training_registers_its_models(spark, events, tmp_path):
    hw = HoltWinters(12)
    hw.train(events)
    hw.save(str(tmp_path), "1.0.0", {"n_series": 40.0})
    info = stores.list_models(spark, f"{tmp_path}/_registry").first()
    assert (info["name"], info["algorithm"], info["is_active"], info["metrics"]) == ("holt_winters", "HoltWinters", True, {"n_series": 40.0})
    assert HoltWinters(12).load(spark, str(tmp_path)).model.count() == hw.model.count()


def test_rules_found_by_their_literal_ends(spark):
    r = random.Random(5)
    alphabet = "ab_*?[!]"
    names = sorted({"".join(r.choice("ab_[]*") for _ in range(r.randint(0, 6))) for _ in range(150)} | {"cpu_usage", "mem_usage", "a" * 40})
    patterns = sorted({"".join(r.choice(alphabet) for _ in range(r.randint(0, 5))) for _ in range(400)}
                      | {"*", "cpu_*", "*_usage", "*u*", "cpu_usage", "[cm]*_usage", "[!c]*", "*[ab]", "a*[b]a", "?" * 40})
    rules = [al.AlertRule(str(i), p, enabled=i % 9 != 0) for i, p in enumerate(patterns)]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)] + [(None, -1)], "metric_name string, id int")
    got = {(x["metric_name"], x["rule"]) for x in al.match_rules(df, al.rule_table(spark, rules)).collect()}
    want = {(n, rule.name) for n in names for rule in rules if rule.enabled and fnmatch.fnmatchcase(n, rule.metric_pattern)}
    assert got == want and len(want) > 500
    plan = al.match_rules(df, al.rule_table(spark, rules))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert al.match_rules(df, al.rule_table(spark, rules).limit(0)).count() == 0


def test_only_touched_days_are_written_again(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [("a", "m", T0 + dt.timedelta(minutes=7 * i), float(i)) for i in range(800)]
    points = spark.createDataFrame(rows, "server_id string, name string, timestamp timestamp, value double")
    assert len(stores.add_points(points.filter("value % 10 <> 3"), path)) == 4

    def files():
        return {f.relative_to(tmp_path).as_posix() for f in tmp_path.rglob("*.parquet")}

    before = files()
    assert stores.add_points(points.filter("value % 10 = 3 AND value < 150"), path) == ["2026-01-01"]
    changed = before - files()
    assert changed and all("day=2026-01-01" in f for f in changed) and {f.split("/")[1] for f in changed} == {"step=5_minutes", "step=1_hour"}
    stores.add_points(points.filter("value % 10 = 3 AND value >= 150"), path)
    assert stores.add_points(points.limit(0), path) == []
    for step in stores.LEVELS:
        got = {tuple(r) for r in stores.read_summaries(spark, path, step).collect()}
        assert got == {tuple(r) for r in stores.downsample(points, step).collect()}


def graded(spark, minutes):
    rows = [("a", "cpu", 0.9, True, T0 + dt.timedelta(minutes=m), m) for m in minutes]
    return spark.createDataFrame(rows, "server_id string, metric_name string, anomaly_score double, is_anomaly boolean, timestamp timestamp, seq long")


def test_a_batch_is_all_there_or_not_at_all(spark, tmp_path, monkeypatch):
    store, channels = str(tmp_path / "box"), [Webhook(), Slack()]
    service.process_batch(graded(spark, [0, 10]), channels, store, "run", 0)
    commit = Outbox.commit
    monkeypatch.setattr(Outbox, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        service.process_batch(graded(spark, [20, 40]), channels, store, "run", 1)
    assert [r["timestamp"].minute for r in service.stored_alerts(spark, store).collect()] == [0]
    assert service.stored_payloads(spark, store).count() == 2
    monkeypatch.setattr(Outbox, "commit", commit)
    for _ in range(2):  # again, and once more
        service.process_batch(graded(spark, [20, 40]), channels, store, "run", 1)
    service.process_batch(graded(spark, [45, 71]), channels, store, "run", 2)
    assert sorted(r["timestamp"] for r in service.stored_alerts(spark, store).collect()) == [T0 + dt.timedelta(minutes=m) for m in (0, 40, 71)]
    assert service.stored_payloads(spark, store).groupBy("alert_id", "channel").count().filter("count > 1").isEmpty()
    assert len(list((tmp_path / "box" / "log").glob("run-*"))) == 1 and len(list((tmp_path / "box" / "suppression").rglob("_batch=*"))) == 1
    # another run over the same detections finds them stored
    service.process_batch(graded(spark, [0, 10, 20, 40]), channels, store, "other", 0)
    assert service.stored_alerts(spark, store).count() == 3


@pytest.mark.parametrize("cooldown,cap", [(30, 50), (5, 3), (0, 4)])
def test_suppression_continued_over_batches(spark, cooldown, cap):
    r = random.Random(cooldown)
    minutes = sorted({round(r.uniform(0, 400), 1) for _ in range(300)})
    rows = [("a", "cpu", r.choice(["warning", "critical"]), T0 + dt.timedelta(minutes=m), i) for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "server_id string, metric_name string, severity string, timestamp timestamp, seq long")
    history, got = None, set()
    for k in range(0, 300, 60):
        sent = sup.suppress(df.filter((F.col("seq") >= k) & (F.col("seq") < k + 60)), cooldown, cap, history=history, block_rows=7, fan=2)
        got |= {x["seq"] for x in sent.collect()}
        history = stores.materialize(sup.updated_history(sent, history, cooldown))
    assert got == {x["seq"] for x in sup.suppress(df, cooldown, cap).collect()}
    assert history.count() <= 2

