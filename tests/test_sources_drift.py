"""Sources, drift, aggregates and raw-sample queries on small tables."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from pulsewarden.functions import scalars as s
from pulsewarden.operators import aggregates as ag, histograms as dr, metric_queries as mq
from pulsewarden.schema import WIDE_METRICS
from pulsewarden.sinks import stores
from pulsewarden.sources import exposition, messages, responses, tables

T0 = dt.datetime(2026, 1, 1)


def parse(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    return messages.parse_metric_messages(df, "value", F.lit(T0).cast("timestamp")).collect()


def test_message_times(spark):
    base = {"name": "cpu", "value": 1}
    got = parse(spark, *[json.dumps({**base, "timestamp": t}) for t in (
        "2026-06-13T10:00:00Z", "2026-06-13T12:00:00+02:00", 1781344800, 1781344800.25, None, True, "soon", "2026", "10:00", "2026-06-13")], json.dumps(base))
    at = dt.datetime(2026, 6, 13, 10)
    assert [r["timestamp"] for r in got] == [at, at, at, at + dt.timedelta(milliseconds=250), T0, T0, None, None, None, dt.datetime(2026, 6, 13), T0]
    assert [r["reason"] for r in got] == [None] * 6 + ["bad_timestamp"] * 3 + [None, None]


def test_message_fields(spark):
    got = parse(
        spark, '{"name":"cpu","value":"75.5","server_id":"s","labels":{"a":"b"},"type":"counter"}', '{"name":"cpu","value":"x"}',
        '{"name":"cpu"}', '{"value":1}', '{"name":"cpu","value":1,"type":"other"}', "not json", "[1]", '{"name":"cpu","value":null}')
    assert got[0]["value"] == 75.5 and got[0]["server_id"] == "s" and got[0]["labels"] == {"a": "b"} and got[0]["reason"] is None
    assert [r["reason"] for r in got[1:]] == [
        "bad_value", "missing_value", "missing_name", "bad_type", "not_json", "not_json", "missing_value"]
    assert got[4]["labels"] == {} and got[4]["server_id"] == "unknown"


def test_instant_response(spark):
    body = json.dumps({"status": "success", "data": {"resultType": "vector", "result": [
        {"metric": {"instance": "i", "job": "j"}, "value": [1.5, "2.5"]}, {"metric": {"job": "j"}, "value": [1, "3"]},
        {"metric": {}, "value": [1, "bad"]}, {"metric": {}}]}})
    df = spark.createDataFrame([("cpu", T0, body), ("cpu", T0, '{"status":"error"}')], "name string, scraped_at timestamp, body string")
    got = [(r["server_id"], r["value"], r["timestamp"]) for r in responses.flatten_instant_vector(df).collect()]
    assert got == [("i", 2.5, T0), ("j", 3.0, T0), ("unknown", 0.0, T0)]


def test_range_response(spark):
    body = json.dumps({"status": "success", "data": {"result": [{"metric": {"job": "j"}, "values": [[1767225600, "1"], [1767225900.5, "2"], [3, "x"]]}]}})
    got = responses.flatten_range_matrix(spark.createDataFrame([("cpu", body)], "name string, body string")).collect()
    assert [(r["server_id"], r["value"]) for r in got] == [("unknown", 1.0), ("unknown", 2.0)]
    assert got[1]["timestamp"] == dt.datetime(2026, 1, 1, 0, 5, 0, 500000)


def test_csv_gaps_become_means(spark, tmp_path):
    (tmp_path / "m.csv").write_text("timestamp,server_id,a,b\n2026-01-01T00:00:00,s,1,\n2026-01-01T00:05:00,s,,\n2026-01-01T00:10:00,s,NaN,\n2026-01-01T00:15:00,s,4,\n")
    schema = T.StructType.fromDDL("timestamp timestamp, server_id string, a double, b double")
    got = tables.load_metrics_csv(spark, str(tmp_path / "m.csv"), schema).collect()
    assert [r["a"] for r in got] == [1.0, 2.5, 2.5, 4.0] and {r["b"] for r in got} == {0.0}


def test_wide_and_long_round_trip(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").limit(200).withColumn("n", F.monotonically_increasing_id())
    wide = rows.select(F.timestamp_seconds("n").alias("timestamp"), F.lit("s").alias("server_id"),
                       *[F.col("l_quantity").alias(m) for m in WIDE_METRICS]).cache()
    back = tables.long_to_wide(tables.wide_to_long(wide))
    assert {tuple(r) for r in back.select(*wide.columns).collect()} == {tuple(r) for r in wide.collect()}


def test_exposition_file(spark, tmp_path):
    latest = spark.createDataFrame([("s1", "cpu", 1.0), ("s2", "cpu", 2.345), ("s1", "mem", 3.0)], "server_id string, name string, value double")
    exposition.write_exposition(latest, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines() == [
        "# HELP cpu Simulated cpu metric", "# TYPE cpu gauge", 'cpu{instance="s1:9100"} 1.00', 'cpu{instance="s2:9100"} 2.35',
        "# HELP mem Simulated mem metric", "# TYPE mem gauge", 'mem{instance="s1:9100"} 3.00']


def named(spark, **series):
    return spark.createDataFrame([(k, float(v)) for k, vs in series.items() for v in vs], "name string, value double")


def numpy_psi(ref, cur):
    r, edges = np.histogram(ref, bins=10, density=True)
    c, _ = np.histogram(cur, bins=edges, density=True)
    r, c = r + 1e-6, c + 1e-6
    r, c = r / r.sum(), c / c.sum()
    return np.sum((c - r) * np.log(c / r))


def test_psi_equals_numpy(spark):
    rng = np.random.default_rng(42)
    ref, same, moved = rng.normal(50, 10, 1000), rng.normal(50, 10, 500), rng.normal(80, 15, 500)
    reference = dr.set_reference(named(spark, a=ref, b=ref, flat=[5.0] * 20))
    got = {r["feature"]: r for r in dr.check_drift(named(spark, a=same, b=moved, flat=[5.0] * 3, unknown=[1.0]), reference).collect()}
    assert set(got) == {"a", "b", "flat"}
    assert got["a"]["psi"] == pytest.approx(numpy_psi(ref, same), abs=1e-6) and got["a"]["psi"] < 0.15
    assert got["b"]["psi"] == pytest.approx(numpy_psi(ref, moved), abs=1e-6)
    assert got["b"]["level"] == "significant" and got["b"]["retrain"]
    assert got["flat"]["psi"] == 0 and got["flat"]["level"] == "none"


def test_reference_counts_equal_numpy(spark):
    values = np.round(np.random.default_rng(1).normal(size=300), 2)
    got = [r["n"] for r in dr.set_reference(named(spark, a=values)).orderBy("bin").collect()]
    assert got == np.histogram(values, bins=10)[0].tolist()


def test_values_outside_the_reference_mean_drift(spark):
    reference = dr.set_reference(named(spark, a=range(100)))
    r = dr.check_drift(named(spark, a=[1e6] * 20), reference).first()
    assert r["level"] == "significant" and r["retrain"] and np.isnan(r["psi"])


def test_drift_levels(spark):
    df = spark.createDataFrame([(0.09,), (0.1,), (0.1499,), (0.15,)], "x double")
    assert [r[0] for r in df.select(dr.drift_level(F.col("x"))).collect()] == ["none", "moderate", "moderate", "significant"]


def test_small_buffer_is_not_checked(spark):
    reference = dr.set_reference(named(spark, a=range(100), b=range(100)))
    got = dr.check_buffer(named(spark, a=range(9), b=range(10)), reference).collect()
    assert [r["feature"] for r in got] == ["b"]


@pytest.mark.parametrize("method", ["zscore", "minmax", "other"])
def test_normalize(spark, method):
    v = np.array([1.0, 2, 3, 4, 5])
    want = {"zscore": (v - v.mean()) / v.std(), "minmax": (v - 1) / 4, "other": v}[method]
    df = spark.createDataFrame([(v.tolist(),), ([3.0, 3.0],)], "v array<double>")
    got = [r[0] for r in df.select(s.normalize(F.col("v"), method)).collect()]
    assert np.allclose(got[0], want) and got[1] == [3.0, 3.0]


def test_counter_rate_with_reset(spark):
    rows = [("s", "c", T0 + dt.timedelta(seconds=60 * i), float(v), i) for i, v in enumerate([10, 20, 5, 8])]
    rows += [("s", "lonely", T0, 1.0, 0)]
    df = spark.createDataFrame(rows, "server_id string, name string, timestamp timestamp, value double, seq bigint")
    got = {r["name"]: r for r in mq.counter_rate(df).collect()}
    assert got["c"]["increase"] == 18.0 and got["c"]["rate"] == pytest.approx(0.1) and got["lonely"]["rate"] is None


@pytest.mark.parametrize("counts,q,want", [
    ([0, 5, 10, 10], 0.5, 2.0), ([4, 8, 10, 10], 0.2, 0.5), ([0, 0, 0, 10], 0.9, 4.0), ([0, 0, 0, 0], 0.5, float("nan")),
])
def test_histogram_quantile(spark, counts, q, want):
    rows = [("g", le, c) for le, c in zip([1.0, 2.0, 4.0, float("inf")], counts)]
    got = mq.histogram_quantile(spark.createDataFrame(rows, "g string, le double, count long"), q, ["g"]).first()["quantile"]
    assert got == pytest.approx(want, nan_ok=True)


def test_moving_average_of_latency(spark):
    x = np.random.default_rng(2).random(300)
    ema = 0.0
    for v in x:
        ema = ema * 0.9 + v * 0.1
    rows = [("m", T0 + dt.timedelta(seconds=i), i, float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "model_name string, timestamp timestamp, seq long, latency_ms double")
    r = ag.inference_stats(df).first()
    assert r["avg_latency_ms"] == pytest.approx(ema, rel=1e-9) and r["inference_count"] == 300


def test_model_versions(spark, tmp_path):
    table = spark.createDataFrame([(1,)], "x int")
    for v in ("1.0.0", "1.2.0", "1.10.0"):
        stores.save_model(table.withColumn("v", F.lit(v)), str(tmp_path), "forest", v)
    assert stores.load_model(spark, str(tmp_path), "forest", "1.0.0").first()["v"] == "1.0.0"
    assert stores.load_model(spark, str(tmp_path), "forest").first()["v"] == "1.2.0"  # last by name, not by number
    with pytest.raises(LookupError):
        stores.load_model(spark, str(tmp_path), "none")


def test_report_file(spark, tmp_path):
    one = spark.createDataFrame([(3, 0.5)], "n long, rate double")
    stores.write_report(stores.report_rows(forest=one), str(tmp_path / "r"))
    got = {(r["model"], r["metric"]): r["value"] for r in spark.read.json(str(tmp_path / "r")).collect()}
    assert got == {("forest", "n"): 3.0, ("forest", "rate"): 0.5}


def test_retention_reaches_the_scan(spark, events, tmp_path):
    events.write.parquet(str(tmp_path / "p"))
    df = stores.retain(spark.read.parquet(str(tmp_path / "p")), dt.datetime(2024, 1, 31), 10)
    assert "GreaterThanOrEqual(timestamp" in df._jdf.queryExecution().executedPlan().toString()
