"""Streams give what the batch operators give on the same rows."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from pulsewarden.functions.scalars import severity
from pulsewarden.operators import alerts as al, histograms as dr, percentiles as pc, rolling, service
from pulsewarden.operators.aggregates import inference_stats, latest_metrics
from pulsewarden.operators.detectors.iforest import IsolationForest
from pulsewarden.sinks import stores
from pulsewarden.sinks.outbox import Outbox
from pulsewarden.sources import log, messages
from pulsewarden.streaming import jobs
from pulsewarden.streaming.stateful import stream_dedupe, stream_features, stream_suppress


def _as_stream(spark, df, path, files=1, per_trigger=1):
    """Write ``df`` as ``files`` files in time order and read them as a stream."""
    for i, part in enumerate(df.orderBy("timestamp", "seq").toPandas().pipe(lambda p: np.array_split(p.index, files))):
        pdf = df.orderBy("timestamp", "seq").toPandas().loc[part]
        spark.createDataFrame(pdf, df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _drain(stream_df, name, mode="append"):
    q = stream_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream_df.sparkSession.table(name)


def test_features_of_one_trigger_equal_batch(spark, events, tmp_path):
    stream = _as_stream(spark, events.drop("user_id"), str(tmp_path / "in"))
    got = _drain(stream_features(stream, windows=(1, 5)), "feats").collect()
    batch = rolling.rolling_features(events, (1, 5))
    names = [f"{s}_{w}m" for w in (1, 5) for s in (*rolling.STATS,)]
    want = {}
    for r in rolling.latest_features(batch, names).collect():
        want.setdefault(r["server_id"], {})[r["feature"]] = r["feature_value"]
    assert {r["server_id"] for r in got} == set(want)
    for r in got:
        assert set(r["features"]) == set(want[r["server_id"]])
        for k, v in r["features"].items():
            assert v == pytest.approx(want[r["server_id"]][k], rel=1e-9, abs=1e-9)


def test_features_over_several_triggers_end_as_batch(spark, events, tmp_path):
    stream = _as_stream(spark, events, str(tmp_path / "in"), files=3)
    got = _drain(stream_features(stream, windows=(1,), stats=("mean",)), "feats3").collect()
    assert len(got) == 24  # one row per server and trigger
    last = {}
    for r in sorted(got, key=lambda r: r["timestamp"]):
        last[r["server_id"]] = r["features"]
    want = rolling.latest_features(rolling.rolling_features(events, (1,), ("mean",)), ["mean_1m", "rate_1m"]).collect()
    for r in want:
        assert last[r["server_id"]][r["feature"]] == pytest.approx(r["feature_value"], rel=1e-9)


def _minutes(spark, numbers, path):
    """One point a minute for each number; its value is the number."""
    t0 = dt.datetime(2026, 1, 1)
    rows = [("a", "cpu", t0 + dt.timedelta(minutes=i), float(i), i) for i in numbers]
    df = spark.createDataFrame(rows, "server_id string, name string, timestamp timestamp, value double, seq bigint")
    df.coalesce(1).write.mode("append").parquet(path)
    return df


def test_history_survives_a_long_trigger_and_a_restart(spark, tmp_path):
    """300 minutes in one trigger, then ten more after a restart: frames reach back over both; late rows are counted."""
    path, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    schema = _minutes(spark, range(300), path).schema
    seen, late = [], jobs.LateRows()
    spark.streams.addListener(late)

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        q = jobs.on_features(stream, lambda df, n: seen.extend(r["features"] for r in df.collect()), cp, windows=(5,), stats=("mean", "min"))
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return late.of(q)

    assert go() == 0
    _minutes(spark, range(300, 310), path)
    assert go() == 0
    frame = np.arange(250, 310)
    assert seen[-1]["cpu_min_5m"] == 250 and seen[-1]["cpu_mean_5m"] == pytest.approx(frame.mean())
    _minutes(spark, range(3), path)
    assert go() == 3
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")  # the query itself forgets all but two triggers
    for i in range(4):
        _minutes(spark, range(i + 1), path)
    assert go() == 3 + 1 + 2 + 3 + 4
    spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    spark.streams.removeListener(late)


def test_a_silent_metric_stays_in_its_servers_row(spark, tmp_path):
    """Points of a server's metrics are held apart; the row has what each metric had last."""
    t0, path = dt.datetime(2026, 1, 1), str(tmp_path / "in")
    schema = "server_id string, name string, timestamp timestamp, value double, seq bigint"

    def put(name, minutes):
        rows = [("a", name, t0 + dt.timedelta(minutes=i), float(i), i) for i in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    seen = []

    def go():
        stream = spark.readStream.schema(schema).parquet(path)
        jobs.on_features(stream, lambda df, n: seen.extend(r["features"] for r in df.collect()), str(tmp_path / "cp"),
                         windows=(1,), stats=("max",)).awaitTermination()

    put("cpu", range(20))
    put("mem", range(10))
    go()
    put("mem", range(20, 30))
    go()
    assert seen[0]["cpu_max_1m"] == 19 and seen[0]["mem_max_1m"] == 9
    assert seen[-1]["cpu_max_1m"] == 19 and seen[-1]["mem_max_1m"] == 29


def test_suppression_keeps_every_column(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame(
        [("a", "cpu", "warning", t0 + dt.timedelta(minutes=m), m, ("holt_winters", [1.0], 1), {"x": 0.5}) for m in (0, 10, 31)],
        "server_id string, metric_name string, severity string, timestamp timestamp, seq bigint, "
        "prediction_horizon struct<source:string,values:array<double>,steps:int>, model_details map<string,double>")
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    got = _drain(stream_suppress(spark.readStream.schema(df.schema).parquet(path), 30), "kept_columns").collect()
    assert sorted(r["seq"] for r in got) == [0, 31]
    assert all(r["prediction_horizon"]["source"] == "holt_winters" and r["model_details"] == {"x": 0.5} for r in got)


@pytest.mark.parametrize("cooldown,cap", [(30, 50), (5, 2)])
def test_suppression_stream_equals_batch(spark, events, tmp_path, cooldown, cap):
    score = F.least(F.lit(1.0), F.col("value") / 100)
    graded = events.select(
        F.lit("all").alias("server_id"), F.col("name").alias("metric_name"), severity(score).alias("severity"),
        "timestamp", "seq", score.alias("anomaly_score"), (score > 0.7).alias("is_anomaly"))
    stream = _as_stream(spark, graded, str(tmp_path / "in"), files=3)
    got = {r["seq"] for r in _drain(stream_suppress(stream, cooldown, cap), f"sup{cooldown}").collect()}
    want = {r["seq"] for r in al.suppress(graded, cooldown, cap).collect()}
    assert got == want


def test_drift_windows_equal_batch(spark, events, tmp_path):
    reference = dr.set_reference(events).cache()
    stream = _as_stream(spark, events, str(tmp_path / "in"), files=2)
    got = {(r["feature"], r["window_start"]): r["psi"]
           for r in _drain(jobs.stream_drift(stream, reference, "10 days"), "drift", "append").collect()}
    assert got
    start = min(k[1] for k in got)
    first = events.filter((F.col("timestamp") >= F.lit(start)) & (F.col("timestamp") < F.lit(start + dt.timedelta(days=10))))
    for r in dr.psi(first, reference).collect():
        assert got[(r["name"], start)] == pytest.approx(r["psi"], abs=1e-9)


def test_downsample_and_latest_stream(spark, events, tmp_path):
    stream = _as_stream(spark, events, str(tmp_path / "in"), files=2)
    got = {tuple(r) for r in _drain(jobs.stream_downsample(stream, "1 hour"), "down").collect()}
    want = {tuple(r) for r in stores.downsample(events, "1 hour").collect()}
    assert got and got <= want
    latest = {tuple(r) for r in _drain(latest_metrics(stream), "latest", "complete").collect()}
    assert latest == {tuple(r) for r in latest_metrics(events).collect()}


def test_paging_dedupe_keeps_one_per_key(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    rows = [("a", "cpu", t0 + dt.timedelta(minutes=m), m) for m in (0, 1, 2)] + [("b", "cpu", t0, 9)]
    df = spark.createDataFrame(rows, "server_id string, metric_name string, timestamp timestamp, seq bigint")
    got = _drain(stream_dedupe(_as_stream(spark, df, str(tmp_path / "in"))), "dedupe").collect()
    assert sorted(r["dedup_key"] for r in got) == ["anomaly-a-cpu", "anomaly-b-cpu"]


def test_messages_split_into_two_folders(spark, tmp_path):
    lines = [json.dumps({"name": "cpu", "value": i, "timestamp": 1700000000 + i}) for i in range(20)] + ["nonsense", "{}"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / "in"))
    parsed = messages.parse_metric_messages(
        messages.read_message_files(spark, str(tmp_path / "in")), "value", F.col("arrived"))
    jobs.write_split(parsed, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 20
    assert {r["reason"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {"not_json", "missing_name"}


def test_live_detection_end_to_end(spark, events, tmp_path):
    names = rolling.feature_names(["click", "view"], (1,), ("mean", "std"))
    table = rolling.feature_table(
        rolling.rolling_features(events.filter(F.col("name").isin("click", "view")), (1,), ("mean", "std")),
        ["click", "view"], "1 hour", (1,), ("mean", "std")).withColumn("id", F.xxhash64("server_id", "step"))
    forest = IsolationForest(None, "id", n_trees=20, contamination=0.3)
    assert jobs.train_when_ready(table, forest, 10**6) is None
    assert jobs.train_when_ready(table, forest, 50) is not None
    stream = _as_stream(spark, events, str(tmp_path / "in"), files=3)
    jobs.detect_stream(stream, forest, names, str(tmp_path / "det"), str(tmp_path / "cp1"),
                       windows=(1,), stats=("mean", "std")).awaitTermination()
    detections = spark.read.parquet(str(tmp_path / "det"))
    assert detections.count() > 0
    schema = detections.schema
    for cp in ("cp2", "cp3"):  # a second run from scratch stores nothing new
        jobs.alert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "det")), str(tmp_path / "alerts"),
                          str(tmp_path / cp)).awaitTermination()
    stored = service.stored_alerts(spark, str(tmp_path / "alerts"))
    assert stored.count() == al.evaluate(detections).count() == stored.select("alert_id").distinct().count()


def test_live_detection_with_the_ensemble(spark, events, tmp_path, monkeypatch):
    """Points → features → two detectors, forecasts and metric → alerts and payloads, over a crash."""
    from pulsewarden.operators.detectors.holtwinters import HoltWinters
    from pulsewarden.operators.ensemble import EnsembleRegistry
    from pulsewarden.sinks.channels import Slack, Webhook

    names = rolling.feature_names(["click", "view"], (1,), ("mean", "std"))
    table = rolling.feature_table(rolling.rolling_features(events, (1,), ("mean", "std")), ["click", "view"], "1 hour", (1,), ("mean", "std"))
    table = table.withColumn("id", F.xxhash64("server_id", "step"))
    registry = EnsembleRegistry()
    for i, seed in enumerate((1, 2)):
        forest = IsolationForest(None, "id", n_trees=20, contamination=0.4, seed=seed)
        forest.train(table)
        registry.register(f"forest{i}", forest)
    smoothing = HoltWinters(12)
    smoothing.train(events)
    stream = _as_stream(spark, events, str(tmp_path / "in"), files=3)
    usual = jobs.usual_features(_drain(stream_features(stream, windows=(1,), stats=("mean", "std")), "usual_rows"))
    for n in range(3):  # one server in each trigger
        spark.createDataFrame(events.filter(F.col("server_id") == f"srv-{n}").toPandas(), events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "one"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "one"))
    jobs.live_stream(stream, registry, names, str(tmp_path / "det"), str(tmp_path / "cp1"), smoothing=smoothing.forecast(4), usual=usual,
                     inference=str(tmp_path / "calls"), windows=(1,), stats=("mean", "std"), watermark="3650 days").awaitTermination()
    found = spark.read.parquet(str(tmp_path / "det")).drop("batch")
    assert found.count() > 0 and found.filter("metric_name = 'unknown'").count() == 0
    assert found.filter("prediction_horizon.source = 'holt_winters'").count() > 0
    calls = inference_stats(spark.read.parquet(str(tmp_path / "calls"))).collect()
    assert {r["model_name"] for r in calls} == {"forest0", "forest1"} and all(r["inference_count"] == 3 and r["avg_latency_ms"] > 0 for r in calls)

    alerts, cp = str(tmp_path / "alerts"), str(tmp_path / "cp2")

    def alert():
        rows = spark.readStream.schema(found.schema).parquet(str(tmp_path / "det") + "/batch=*")
        return jobs.alert_stream(rows, alerts, cp, channels=[Webhook(), Slack()])

    # the first try dies between the alerts and the payloads
    stage = Outbox.stage

    def dies(box, run, batch, tables):
        stage(box, run, batch, {"alerts": tables["alerts"]})
        raise RuntimeError("lost")

    monkeypatch.setattr(Outbox, "stage", dies)
    with pytest.raises(StreamingQueryException):
        alert().awaitTermination()
    assert service.stored_alerts(spark, alerts).count() == 0
    monkeypatch.setattr(Outbox, "stage", stage)
    alert().awaitTermination()
    stored, sent = service.stored_alerts(spark, alerts), service.stored_payloads(spark, alerts)
    want = al.evaluate(found)
    assert {r["alert_id"] for r in stored.collect()} == {r["alert_id"] for r in want.collect()} and stored.count() == want.count() > 0
    assert sent.count() == 2 * stored.count() == sent.distinct().count()
    predicted = stored.filter("is_predicted").first()
    assert predicted["message"].startswith("[PREDICTED] ") and predicted["prediction_horizon"]["values"]
    assert set(predicted["model_details"]) == {"forest0", "forest1"}
    assert sent.filter("channel = 'webhook' AND payload LIKE '%[PREDICTED]%'").count() > 0
    alert().awaitTermination()  # nothing new
    assert service.stored_payloads(spark, alerts).count() == sent.count()


def test_feature_hook_sees_every_batch(spark, events, tmp_path):
    seen = []
    stream = _as_stream(spark, events, str(tmp_path / "in"), files=2)
    jobs.on_features(stream, lambda df, n: seen.append((n, df.count())), str(tmp_path / "cp"), windows=(1,)).awaitTermination()
    assert [n for _, n in seen if n] == [8, 8]


def test_batch_operators_on_streams(spark, events, tmp_path):
    """Union, scoring against stored models, counting and payloads need no streaming twin."""
    from pulsewarden.operators.aggregates import alert_stats, detection_counter
    from pulsewarden.operators.detectors.holtwinters import HoltWinters
    from pulsewarden.operators.joins import merge_sources
    from pulsewarden.sinks.channels import PagerDuty, Slack, route_alerts

    hw = HoltWinters(12)
    hw.train(events)
    hw.save(str(tmp_path / "models"))
    hw.load(spark, str(tmp_path / "models"))
    a = _as_stream(spark, events.filter("seq % 2 = 0"), str(tmp_path / "a"))
    b = _as_stream(spark, events.filter("seq % 2 = 1"), str(tmp_path / "b"))

    def scored(points):
        return hw.score(points).withColumnRenamed("name", "metric_name")

    stream, batch = scored(merge_sources(a, b)), scored(events)
    got = {tuple(r) for r in _drain(detection_counter(stream), "counter", "complete").collect()}
    assert got == {tuple(r) for r in detection_counter(batch).collect()}
    got = {tuple(r) for r in _drain(alert_stats(al.grade(stream)), "stats", "complete").collect()}
    assert got == {tuple(r) for r in alert_stats(al.grade(batch)).collect()}
    channels = [Slack(), PagerDuty("k")]
    got = {tuple(r) for r in _drain(route_alerts(al.build_alerts(al.grade(stream)), channels), "payloads").collect()}
    assert got == {tuple(r) for r in route_alerts(al.build_alerts(al.grade(batch)), channels).collect()} and got


def test_message_log_goes_on_at_its_offsets(spark, tmp_path):
    """Messages appended between runs, a run that fails half way: every message once in the end."""
    topic, cp, out = str(tmp_path / "topic"), str(tmp_path / "cp"), str(tmp_path / "out")
    log.register(spark)

    def put(first, n):
        rows = [(json.dumps({"name": "cpu", "value": i, "server_id": f"s{i % 3}", "timestamp": 1700000000 + i}), i % 2) for i in range(first, first + n)]
        spark.createDataFrame(rows, "value string, partition int").repartition(2).write.format("message_log").mode("append").save(topic)

    def run(fail=False, **options):
        def write(batch, number):
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
            if fail:
                raise RuntimeError("lost")
        reader = spark.readStream.format("message_log").options(**options).load(topic)
        q = reader.writeStream.foreachBatch(write).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    put(0, 50)
    run()
    put(50, 30)
    with pytest.raises(StreamingQueryException):
        run(fail=True)
    put(80, 7)
    run()  # the batch that failed, at its old offsets
    run()  # what came after
    got = spark.read.parquet(out).collect()
    assert sorted(json.loads(r["value"])["value"] for r in got) == list(range(87))
    assert sorted((r["partition"], r["offset"]) for r in got) == [(p, i) for p, n in ((0, 44), (1, 43)) for i in range(n)]
    batch = spark.read.format("message_log").load(topic)
    assert {tuple(r) for r in batch.collect()} == {(r["value"], r["partition"], r["offset"], r["arrived"]) for r in got}
    points = _drain(messages.read_metric_stream(messages.read_message_log(spark, topic)), "log_points")
    assert points.count() == 87 and points.filter("name = 'cpu' AND value >= 80").count() == 7
    assert _drain(messages.read_message_log(spark, topic, "latest"), "log_latest").count() == 0
    assert [r.end - r.start for r in log.Topic(topic).ranges({0: 10, 1: 43}, {0: 12, 1: 43})] == [2]


def test_stream_thresholds_are_near_the_exact_percentile(spark, events, tmp_path):
    stream = _as_stream(spark, events.select("name", "timestamp", "value", "seq"), str(tmp_path / "in"), files=2)
    got = _drain(jobs.stream_thresholds(stream, 95, "1 hour", keys=("name",)), "thresholds")
    rows = got.collect()
    assert rows
    for r in rows[:5]:
        own = events.filter((F.col("name") == r["name"]) & (F.col("timestamp") >= F.lit(r["window_start"]))
                            & (F.col("timestamp") < F.lit(r["window_start"] + dt.timedelta(hours=1)))).toPandas()["value"]
        assert np.quantile(own, 0.95, method="lower") <= r["percentile"] <= np.quantile(own, 0.95, method="higher")
    # merged over windows: within the bound of the exact rank
    last = max(r["window_start"] for r in rows)
    whole = pc.sketch_percentile(pc.merge_sketches(got, ["name"]), 95).collect()
    for r in whole:
        own = np.sort(events.filter((F.col("name") == r["name"]) & (F.col("timestamp") < F.lit(last + dt.timedelta(hours=1)))).toPandas()["value"])
        rank = np.searchsorted(own, r["percentile"], "right") / len(own)
        assert abs(rank - 0.95) <= pc.rank_error() + 2 / len(own)


def test_retrain_stream_equals_batch(spark, tmp_path):
    r = np.random.default_rng(3)
    t0 = dt.datetime(2026, 1, 1)
    rows = [(f, t0 + dt.timedelta(hours=i), float(i), str(r.choice(["none", "moderate", "significant"], p=[0.3, 0.1, 0.6])), i)
            for f in "abc" for i in range(120)]
    df = spark.createDataFrame(rows, "feature string, timestamp timestamp, psi double, level string, seq bigint")
    windows = lambda d: d.withColumnRenamed("timestamp", "window_start")
    want = {tuple(x) for x in dr.retrain_events(windows(df)).collect()}
    got = {tuple(x) for x in _drain(jobs.stream_retrain(windows(_as_stream(spark, df, str(tmp_path / "in"), files=4))), "retrain").collect()}
    assert got == want and 3 < len(want) < 100
    plain = set()
    for f in "abc":
        hot = calm = 0
        armed = True
        for x in (x for x in rows if x[0] == f):
            hot = hot + 1 if x[3] == "significant" else 0
            calm = calm + 1 if x[3] == "none" else 0
            armed = armed or calm >= 2
            if armed and hot >= 3:
                plain.add((f, x[1], x[2]))
                armed = False
    assert want == plain
