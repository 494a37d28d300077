"""Ordering, rolling features and sequences against plain NumPy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsewarden.operators import ordering as o, rolling
from pulsewarden.schema import METRIC_SCHEMA

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "server_id string, name string, timestamp timestamp, value double, seq bigint"


def make(spark, series, step=5):
    rows = [
        (server, "cpu", T0 + dt.timedelta(seconds=step * i), float(v), i)
        for server, values in series.items() for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def expect(values, i, size):
    a = np.array(values[max(0, i - size + 1): i + 1], dtype=float)
    d = a - a.mean()
    m2 = (d**2).mean()
    return {
        "mean": a.mean(), "std": np.sqrt(m2), "min": a.min(), "max": a.max(), "rate": a[-1] - a[0],
        "skew": (d**3).mean() / m2**1.5 if m2 > 0 else None,
        "kurtosis": (d**4).mean() / m2**2 - 3 if m2 > 0 else None,
    }


def check(rows, series, windows, ppm, rel=1e-9):
    for r in rows:
        for w in windows:
            want = expect(series[r["server_id"]], r["seq"], w * ppm)
            for stat, x in want.items():
                got = r[f"{stat}_{w}m"]
                if r["seq"] < 4 or x is None:
                    assert got is None, (r["seq"], stat)
                else:
                    assert got == pytest.approx(x, rel=rel, abs=1e-7), (r["seq"], stat, w)


@pytest.mark.parametrize("chunk_rows", [64, 1 << 16])
def test_rolling_matches_numpy_across_chunks(spark, chunk_rows):
    rng = np.random.default_rng(1)
    series = {"hot": rng.normal(50, 10, 900), "short": [1.0, 2.0, 4.0, 8.0], "five": [1, 2, 3, 4, 100.0],
              "flat": [7.0] * 40, "mixed": [7.0] * 30 + list(rng.normal(size=30))}
    df = rolling.rolling_features(make(spark, series), (1, 2, 5), points_per_minute=12, chunk_rows=chunk_rows)
    rows = df.collect()
    assert len(rows) == sum(map(len, series.values()))
    check(rows, series, (1, 2, 5), 12)


def test_rolling_equals_builtin_frames(spark, events):
    got = rolling.rolling_features(events, (5,))
    w = Window.partitionBy("server_id", "name").orderBy("timestamp", "seq").rowsBetween(-59, 0)
    want = events.select(
        "seq", F.avg("value").over(w).alias("m"), F.stddev_pop("value").over(w).alias("s"),
        F.skewness("value").over(w).alias("k3"), F.kurtosis("value").over(w).alias("k4"),
        F.count("*").over(w).alias("n"))
    for r in got.join(want, "seq").filter("n >= 5").collect():
        for a, b in (("mean_5m", "m"), ("std_5m", "s"), ("skew_5m", "k3"), ("kurtosis_5m", "k4")):
            assert r[a] == pytest.approx(r[b], rel=1e-9, abs=1e-9)


def test_large_values_keep_their_spread(spark):
    rng = np.random.default_rng(2)
    values = 1e9 + np.arange(400) * 0.5 + rng.normal(size=400)
    rows = rolling.rolling_features(make(spark, {"a": values}), (1,), chunk_rows=64).collect()
    for r in rows[5:]:
        want = expect(values, r["seq"], 12)
        if r["seq"] >= 4:
            assert r["std_1m"] == pytest.approx(want["std"], rel=1e-6)
            assert r["skew_1m"] == pytest.approx(want["skew"], abs=1e-5)


def test_equal_times_are_ordered_by_tie_break(spark):
    rows = [("s", "m", T0, float(i), i) for i in range(20)]
    df = rolling.rolling_features(spark.createDataFrame(rows, SCHEMA), (1,), ("mean",), chunk_rows=8)
    got = {r["seq"]: r["rate_1m"] for r in df.collect()}
    assert got[19] == 11.0 and got[4] == 4.0 and got[3] is None


def test_nan_poisons_only_its_frames(spark):
    values = [1.0] * 20
    values[3] = float("nan")
    got = {r["seq"]: r for r in rolling.rolling_features(make(spark, {"a": values}), (1,), ("mean",)).collect()}
    assert np.isnan(got[10]["mean_1m"]) and got[19]["mean_1m"] == 1.0


def test_time_frames(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=300)
    df = rolling.rolling_features_by_time(make(spark, {"a": values}, step=30), (5, 20), ("mean", "max"))
    rows = {r["seq"]: r for r in df.collect()}
    assert len(rows) == 300
    for i in (4, 50, 150, 299):
        assert rows[i]["mean_5m"] == pytest.approx(np.mean(values[max(0, i - 10): i + 1]))
        assert rows[i]["max_20m"] == pytest.approx(np.max(values[max(0, i - 40): i + 1]))


def test_positions_are_complete(spark, events):
    got = [r[0] for r in o.ordered(events).orderBy("server_id", "name", "timestamp", "seq").select(o.POS).collect()]
    assert got == list(range(len(got)))


def test_newest_rows(spark):
    df = make(spark, {"a": range(500), "b": range(3)})
    got = o.newest(df, 10, ["server_id"], o.ORDER).collect()
    assert sorted(r["value"] for r in got if r["server_id"] == "a") == list(range(490, 500))
    assert len([r for r in got if r["server_id"] == "b"]) == 3


def test_window_eviction_keeps_last_five(spark):
    got = o.newest(make(spark, {"a": range(10)}), 5, list(o.KEYS), o.ORDER).collect()
    assert sorted(r["value"] for r in got) == [5.0, 6.0, 7.0, 8.0, 9.0]


def test_readiness_starts_at_ten(spark):
    got = {r["seq"]: r["is_ready"] for r in rolling.readiness(make(spark, {"a": range(15)})).collect()}
    assert sorted(i for i in got if got[i]) == list(range(9, 15))


def test_sequences_and_targets(spark):
    df = make(spark, {"a": range(10), "b": range(3)})
    seqs = {r["seq"]: r["sequence"] for r in rolling.sequences(df, 4).collect()}
    assert sorted(seqs) == list(range(3, 10)) and seqs[5] == [2.0, 3.0, 4.0, 5.0]
    pairs = {r["seq"]: r for r in rolling.sequences(df, 4, horizon=2).collect()}
    assert sorted(pairs) == list(range(3, 8)) and pairs[7]["target"] == [8.0, 9.0]


def test_feature_names_and_table(spark):
    names = rolling.feature_names(["mem", "cpu"], (5,), ("mean", "std"))
    assert names == ["cpu_mean_5m", "cpu_rate_5m", "cpu_std_5m", "mem_mean_5m", "mem_rate_5m", "mem_std_5m"]
    feats = rolling.rolling_features(make(spark, {"a": [50.0] * 20}), (5,), ("mean", "std"))
    row = rolling.feature_table(feats, ["cpu", "mem"], "1 hour", (5,), ("mean", "std")).first()
    assert row["vector"] == [50.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_empty_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rolling.rolling_features(empty, (5,)).count() == 0
    assert METRIC_SCHEMA.fieldNames()[:2] == ["server_id", "name"]


def test_frames_equal_plain_statistics():
    from pulsewarden.operators.frames import back_by_rows, back_by_time, frame_moments, last_of_time

    r = np.random.default_rng(11)
    y = np.round(r.normal(50, 10, 700), 1)
    y[100:130] = 7.0
    starts = np.repeat([0, 250, 251], [250, 1, 449])
    us = np.sort(r.integers(0, 400, 700))
    us[250] = 5
    here = np.arange(700)
    frames = [(back_by_rows(starts, 13), here), (back_by_rows(starts, 400), here), (back_by_time(starts, us, 20), last_of_time(starts, us))]
    for (a, b), m in zip(frames, frame_moments(y, frames, ("mean", "std", "min", "max", "skew", "kurtosis"))):
        for i in range(700):
            f = y[a[i]: b[i] + 1]
            d, m2 = f - f.mean(), f.var()
            want = [f.mean(), f.std(), f.min(), f.max()]
            assert [m.stat(s)[0][i] for s in ("mean", "std", "min", "max")] == pytest.approx(want, abs=1e-9) and m.n[i] == len(f)
            for s, x in (("skew", lambda: (d**3).mean() / m2**1.5), ("kurtosis", lambda: (d**4).mean() / m2**2 - 3)):
                value, none = m.stat(s)
                assert none[i] == (f.min() == f.max())
                if not none[i]:
                    assert value[i] == pytest.approx(x(), abs=1e-7)
    assert all((starts[a] == starts[b]).all() for a, b in frames)
    a, b = frames[2]
    assert all(us[a[i]] >= us[i] - 20 and (a[i] == starts[i] or us[a[i] - 1] < us[i] - 20) and us[b[i]] == us[i] for i in range(700))


def test_time_frames_longer_than_chunks(spark):
    """A dense series: frames of more rows than a chunk was to have; equal times and nulls."""
    t0, r = dt.datetime(2026, 1, 1), np.random.default_rng(2)
    seconds = np.sort(r.integers(0, 3000, 1500))
    rows = [("a", "m", t0 + dt.timedelta(seconds=int(s)), float(i % 37), i) for i, s in enumerate(seconds)]
    rows += [("b", "m", t0 + dt.timedelta(days=i), None if i % 3 else float(i), i) for i in range(20)]
    df = spark.createDataFrame(rows, "server_id string, name string, timestamp timestamp, value double, seq bigint")
    got = rolling.rolling_features_by_time(df, (10, 40), ("mean", "max"), min_points=2, chunk_rows=64).collect()
    assert len(got) == len(rows)
    for x in (x for x in got if x["server_id"] == "a" and x["seq"] % 97 == 0):
        now = seconds[x["seq"]]
        frame = np.flatnonzero((seconds >= now - 600) & (seconds <= now))
        if len(frame) >= 2:
            assert x["mean_10m"] == pytest.approx(np.mean(frame % 37)) and x["rate_10m"] == x["seq"] % 37 - frame[0] % 37
    assert all(x["mean_40m"] is None for x in got if x["server_id"] == "b")


def test_layout_of_chunks():
    from pulsewarden.operators.ordering import layout

    size, per, parts = layout(10**10, 60, 8, 2877, 1 << 16)
    assert size == 1 << 16 and parts < 10_000 and 64 << 20 < size * per * 60 <= 96 << 20
    for total in (0, 1, 5000, 300_000, 10**7):
        size, per, parts = layout(total, 60, 8, 20, 1 << 16)
        assert parts * per * size >= total and (parts - 1) * per * size < max(total, 1)


def test_no_partition_of_chunks_is_empty(spark):
    df = spark.range(30_000).selectExpr("'a' AS server_id", "'m' AS name", "timestamp_seconds(id) AS timestamp", "id * 1.0 AS value", "id AS seq")
    chunks = rolling.o.chunked(df, 5, 5, chunk_rows=1000)
    sizes = [r[1] for r in chunks.groupBy("_part").count().collect()]
    assert len(sizes) == chunks.rdd.getNumPartitions() and min(sizes) > 900 and max(sizes) < 3100
    w = chunks.withColumn("n", rolling.F.count("*").over(rolling.o.chunk_window()))
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("BroadcastExchange") == 1  # windows move no row
