"""Detectors against NumPy and planted structure."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsewarden.functions.linalg import over_windows, second_moments, stretches
from pulsewarden.operators import ensemble as en
from pulsewarden.operators.detectors import holtwinters as hw
from pulsewarden.operators.detectors.iforest import IsolationForest, _Forest, average_path
from pulsewarden.operators.detectors.sequence import SequenceForecaster, SequenceReconstruction, left_pad
from pulsewarden.operators.percentiles import exact_percentile

T0 = dt.datetime(2026, 1, 1)


def matrix(spark, x):
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(x.shape[1])])
    pdf.insert(0, "id", range(len(x)))
    return spark.createDataFrame(pdf)


def points(spark, series):
    rows = [(k, "cpu", T0 + dt.timedelta(minutes=5 * i), float(v), i) for k, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "server_id string, name string, timestamp timestamp, value double, seq bigint")


@pytest.fixture(scope="module")
def trained(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(50, 10, (2000, 4))
    x[:20] = 200 + rng.normal(size=(20, 4))
    df = matrix(spark, x).cache()
    f = IsolationForest(["f0", "f1", "f2", "f3"], "id")
    f.train(df)
    return f, df


def test_forest_flags_planted_outliers(trained):
    f, df = trained
    got = f.score(df).toPandas().set_index("id").sort_index()
    assert got["anomaly_score"].between(0, 1).all()
    assert got["is_anomaly"].mean() == pytest.approx(0.05, abs=0.005)
    assert got.loc[:19, "is_anomaly"].all()
    assert got.loc[:19, "anomaly_score"].min() > got.loc[20:, "anomaly_score"].median()
    assert (got["is_anomaly"] == (got["anomaly_score"] > 0.5)).all()


def test_forest_trees_are_sound(trained):
    nodes = trained[0].model.filter("tree >= 0").toPandas()
    assert nodes["tree"].nunique() == 100
    assert (nodes[nodes["node"] == 0]["size"] == 256).all()
    assert nodes["depth"].max() <= 8
    leaves = nodes[nodes["feature"] < 0]
    assert (leaves.groupby("tree")["size"].sum() == 256).all()


def test_forest_does_not_depend_on_partitions(spark, trained):
    f, df = trained
    again = IsolationForest(["f0", "f1", "f2", "f3"], "id")
    again.train(df.repartition(13))
    a = f.model.orderBy("tree", "node").toPandas()
    b = again.model.orderBy("tree", "node").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_path_length_against_one_by_one_descent(trained):
    nodes = trained[0].model.filter("tree >= 0").toPandas()
    rng = np.random.default_rng(5)
    x = rng.normal(50, 30, (50, 4))
    fast = _Forest(nodes, 256).depth_score(x)
    trees = {t: g.set_index("node") for t, g in nodes.groupby("tree")}
    for row, got in zip(x[:5], fast):
        total = 0.0
        for tree in trees.values():
            n = tree.loc[0]
            while n["feature"] >= 0:
                n = tree.loc[int(n["left"] if row[int(n["feature"])] <= n["threshold"] else n["right"])]
            total += n["depth"] + float(average_path(n["size"]))
        assert got == pytest.approx(-(2 ** (-total / 100 / float(average_path(256)))))


def test_forest_large_table_draws_each_row_once(spark):
    rng = np.random.default_rng(1)
    df = matrix(spark, rng.normal(size=(5000, 2)))
    f = IsolationForest(["f0", "f1"], "id", n_trees=10, max_samples=32)
    f.train(df)
    roots = f.model.filter("tree >= 0 AND node = 0").toPandas()
    assert len(roots) == 10 and (roots["size"] == 32).all()


def test_forest_edge_cases(spark, tmp_path):
    small = matrix(spark, np.ones((9, 2)))
    assert IsolationForest(["f0"], "id").train(small) is None
    flat = matrix(spark, np.array([[1.0, np.nan], [1.0, np.inf]] * 10))
    f = IsolationForest(["f0", "f1"], "id", n_trees=5)
    f.train(flat)
    assert not f.score(flat).filter("is_anomaly").count()
    f.save(str(tmp_path), "1.0.0")
    loaded = IsolationForest(["f0", "f1"], "id").load(spark, str(tmp_path), "9.9.9")
    a, b = f.score(flat).select("raw_score").collect(), loaded.score(flat).select("raw_score").collect()
    assert sorted(a) == sorted(b)


def test_holt_winters_recovers_a_season():
    rng = np.random.default_rng(2)
    t = np.arange(240)
    y = 50 + 0.1 * t + 20 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 0.5, 240)
    m = hw.fit_series(y, 12)
    assert m["m"] == 12 and m["resid_std"] < 1.5
    future = np.arange(240, 252)
    want = 50 + 0.1 * future + 20 * np.sin(2 * np.pi * future / 12)
    got = [m["level"] + h * m["trend"] + m["season"][(240 + h - 1) % 12] for h in range(1, 13)]
    assert np.abs(got - want).max() < 3
    coarse = np.array([[a, b, g] for a in (0.1, 0.5, 0.9) for b in (0.1, 0.5) for g in (0.1, 0.5)])
    assert m["sse"] <= min(hw.fit_at(y, 12, p)["sse"] for p in coarse) * 1.05


def plain_smoothing(y, m, a, b, g):
    """One point after the other."""
    level, season = y[:m].mean(), list(y[:m] - y[:m].mean())
    trend, errors = (y[m: 2 * m].mean() - y[:m].mean()) / m, []
    for t, v in enumerate(y):
        e = v - level - trend - season[t % m]
        level, trend, season[t % m] = level + trend + a * e, trend + a * b * e, season[t % m] + g * e
        errors.append(e)
    e = np.array(errors[m:])
    return {"level": level, "trend": trend, "season": season, "sse": (e**2).sum(), "resid_std": e.std()}


def test_series_in_step_and_by_blocks_equal_the_plain_recursion():
    rng = np.random.default_rng(5)
    for m, lengths, size in ((7, [14, 100, 65, 333], 21), (4, [50, 50, 9], 8), (24, [700], 48)):
        series = [10 + rng.normal(0, 2, n).cumsum() + 5 * np.sin(np.arange(n)) for n in lengths]
        params = np.array([[0.3, 0.1, 0.2], [0.9, 0.05, 0.6], [0.02, 0.5, 0.01]])
        for y in series:
            for k, p in enumerate(params):
                want = plain_smoothing(y, m, *p)
                got = hw.fit_at(y, m, p)
                joined = hw.Joined(params, m)
                for i in range(0, len(y), size):
                    joined.add(hw.block_sums(y[i: i + size], m, params, i == 0), len(y[i: i + size]), i == 0)
                assert got["season"] == pytest.approx(want["season"]) and joined.x[2:, k] == pytest.approx(np.array(want["season"]), rel=1e-6, abs=1e-8)
                assert joined.sse[k] == pytest.approx(want["sse"], rel=1e-8) and joined.x[0, k] == pytest.approx(want["level"], rel=1e-8)
                for c in ("level", "trend", "sse", "resid_std"):
                    assert got[c] == pytest.approx(want[c], rel=1e-8, abs=1e-10)
        together = hw.fit_group(series, m)
        for y, got in zip(series, together):
            alone = hw.fit_group([y], m)[0]
            assert got["sse"] == pytest.approx(alone["sse"]) and got["n"] == len(y)


def test_parameters_that_diverge_are_not_chosen():
    y = 1e150 * (-1.0) ** np.arange(3000)
    with np.errstate(all="raise"):
        assert np.isfinite(hw.fit_series(y, 3)["alpha"])


def test_long_series_are_fitted_by_blocks(spark):
    rng = np.random.default_rng(6)
    t = np.arange(900)
    series = {"a": 50 + 10 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 1, 900), "b": rng.normal(0, 1, 100), "c": rng.normal(5, 2, 301)}
    whole = {r["server_id"]: r for r in hw.HoltWinters(12).train(points(spark, series)).collect()}
    blocks = {r["server_id"]: r for r in hw.HoltWinters(12, block=100).train(points(spark, series)).collect()}
    assert set(whole) == set(blocks) == {"a", "b", "c"}
    for k in series:
        for c in ("n", "m", "alpha", "beta", "gamma", "sse", "level", "trend", "resid_std", "season"):
            assert blocks[k][c] == pytest.approx(whole[k][c], rel=1e-6, abs=1e-9)


def test_blocks_of_long_series_step_together(spark, monkeypatch):
    rng = np.random.default_rng(8)
    blocks = [rng.normal(5, 2, n) for n in (48, 48, 30, 48, 7)]
    params = rng.uniform(0.05, 0.9, (5, 6, 3))
    runs, plain = [], hw.run
    monkeypatch.setattr(hw, "run", lambda *a: (runs.append(len(a[0])), plain(*a)))
    together = hw.sums_in_step(blocks, 12, params, False)
    assert runs == [5]
    for y, p, got in zip(blocks, params, together):
        assert got == pytest.approx(hw.block_sums(y, 12, p, False), rel=1e-12)
    monkeypatch.undo()
    tables, write = [], hw.materialize
    monkeypatch.setattr(hw, "materialize", lambda df: (tables.append((write(df), df.columns)), tables[-1][0])[1])
    monkeypatch.setattr(hw, "drop", lambda *t: None)
    i = F.col("id")
    rows = spark.range(80_000).select(F.lit("a").alias("server_id"), F.lit("m").alias("name"), F.timestamp_seconds(i).alias("timestamp"),
                                      (F.sin(i) + i % 24).alias("value"), i.alias("seq"))
    assert hw.HoltWinters(24).train_at(rows, 0.3, 0.1, 0.2).first()["n"] == 80_000
    packed = next(t for t, columns in tables if "y" in columns)
    sizes = [len(r["y"]) for r in packed.collect()]
    assert sum(sizes) == 80_000 and max(sizes) < 5000 and len(packed.inputFiles()) > 4


def test_descent_in_step_equals_row_by_row():
    """Rows go down all trees at once; the result is that of one row and one tree after the other."""
    from pulsewarden.operators.detectors.iforest import _grow

    rng = np.random.default_rng(11)
    grown = [_grow(1, 64)(pd.DataFrame({"tree": t, "_r": np.arange(1, 65), "vector": list(rng.normal(0, 1, (64, 3)))})) for t in range(20)]
    f, x = _Forest(pd.concat(grown, ignore_index=True), 64), rng.normal(0, 1, (500, 3))
    want = []
    for v in x:
        total = 0.0
        for at in f.roots:
            for _ in range(f.levels):
                at = f.left[at] if v[f.feature[at]] <= f.threshold[at] else f.right[at]
            total += f.length[at]
        want.append(-(2.0 ** (-total / f.scale)))
    assert f.depth_score(x) == pytest.approx(np.array(want), rel=1e-12)


def test_holt_winters_short_and_flat_series():
    assert hw.fit_series(np.arange(3.0), 12) is None
    assert hw.fit_series(np.arange(10.0), 12)["m"] == 5
    flat = hw.fit_series(np.full(60, 7.0), 12)
    assert flat["resid_std"] == 0 and flat["level"] == pytest.approx(7.0)


def test_holt_winters_per_series(spark):
    t = np.arange(120)
    series = {"a": 50 + 10 * np.sin(2 * np.pi * t / 12), "b": np.full(120, 5.0), "c": [1.0, 2.0]}
    d = hw.HoltWinters(12)
    d.train(points(spark, series))
    models = {r["server_id"]: r for r in d.model.collect()}
    assert set(models) == {"a", "b"}
    forecast = {r["server_id"]: r["forecast"] for r in d.forecast(24).collect()}
    assert len(forecast["a"]) == 24
    m = models["a"]
    assert forecast["a"][5] == pytest.approx(m["level"] + 6 * m["trend"] + m["season"][(120 + 5) % 12])
    scored = {r["seq"]: r for r in d.score(points(spark, {"a": [forecast["a"][0], 1000.0]})).collect()}
    assert scored[0]["anomaly_score"] == pytest.approx(0, abs=1e-9) and scored[1]["anomaly_score"] == 1.0
    later = points(spark, {"a": forecast["a"][:9]})
    stepped = {r["seq"]: r["residual"] for r in d.score(d.number_steps(later), "step").collect()}
    assert len(stepped) == 9 and max(stepped.values()) < 1e-9
    assert d.score(points(spark, {"b": [9.0]})).first()["anomaly_score"] == 0.0


def test_holt_winters_trains_on_the_newest_points(spark):
    y = np.concatenate([np.full(200, 1000.0), 50 + 10 * np.sin(2 * np.pi * np.arange(100) / 10)])
    d = hw.HoltWinters(10, history=100)
    assert d.train(points(spark, {"a": y})).first()["n"] == 100
    assert d.model.first()["resid_std"] < 1


def test_holt_winters_sees_every_point(spark):
    """A season only in the old part of a long series; the series comes in several batches."""
    t = np.arange(5000)
    y = np.where(t < 2500, 50 + 10 * np.sin(2 * np.pi * t / 10), 50.0)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    m = hw.HoltWinters(10).train(points(spark, {"a": y, "b": y[::-1]}))
    got = {r["server_id"]: r for r in m.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got["a"]["n"] == got["b"]["n"] == 5000
    for name, values in (("a", y), ("b", y[::-1])):
        want = hw.fit_series(values, 10)
        for c in ("sse", "level", "trend", "resid_std", "alpha", "beta", "gamma"):
            assert got[name][c] == pytest.approx(want[c], rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("sample", [8, 16, 64, 256])
def test_every_tree_has_its_rows(spark, sample):
    df = spark.range(3000).select("id", F.rand(1).alias("x"))
    nodes = IsolationForest(["x"], "id", n_trees=50, max_samples=sample).train(df).toPandas()
    roots = nodes[(nodes["tree"] >= 0) & (nodes["node"] == 0)]
    assert len(roots) == 50 and (roots["size"] == sample).all()


def test_z_border(spark):
    df = spark.createDataFrame([(2.8, 0.0, 1.0), (2.8001, 0.0, 1.0), (9.0, 0.0, 0.0)], "value double, forecast double, resid_std double")
    got = hw.z_score(df).collect()
    assert [r["is_anomaly"] for r in got] == [False, True, False]
    assert got[2]["anomaly_score"] == 0.0 and got[2]["z_score"] is None


def test_reconstruction_error_and_threshold(spark):
    t = np.arange(400)
    rng = np.random.default_rng(3)
    y = 10 * np.sin(2 * np.pi * t / 20) + rng.normal(0, 0.1, 400)
    d = SequenceReconstruction(20, 4)
    p = points(spark, {"a": y})
    d.train(p)
    windows = np.lib.stride_tricks.sliding_window_view(y, 20)
    z = (windows - windows.mean(0)) / windows.std(0)
    _, v = np.linalg.eigh(z.T @ z / len(z))
    b = v[:, ::-1][:, :4]
    err = ((z - z @ b @ b.T) ** 2).mean(1)
    scored = {r["seq"]: r for r in d.score(d.windows(p)).collect()}
    assert scored[100]["reconstruction_error"] == pytest.approx(err[81], rel=1e-6)
    m = d.model.first()
    assert m["threshold"] == pytest.approx(np.percentile(err, 95), rel=1e-6) and m["n_sequences"] == 381
    odd = spark.createDataFrame([([100.0, -100.0] * 10,), ([1.0],)], "sequence array<double>")
    got = d.score(odd).collect()
    assert got[0]["anomaly_score"] == 1.0 and got[0]["is_anomaly"]


def test_left_pad(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0, 3.0, 4.0],)], "s array<double>")
    assert [r[0] for r in df.select(left_pad(F.col("s"), 3)).collect()] == [[0.0, 1.0, 2.0], [2.0, 3.0, 4.0]]


def test_forecaster_follows_a_wave(spark):
    t = np.arange(300)
    wave = 50 + 10 * np.sin(2 * np.pi * t / 25)
    f = SequenceForecaster(25, 5, ridge=1e-8)
    f.train(points(spark, {"a": wave[:295], "b": wave[:280]}))
    got = {r["server_id"]: r["forecast"] for r in f.forecast(points(spark, {"a": wave[:295]})).collect()}
    assert np.abs(np.array(got["a"]) - wave[295:300]).max() < 0.5


def wide(spark, series):
    """Rows (server_id, timestamp, seq, m0, m1 …) of some series, each an array of points by metrics."""
    t0 = dt.datetime(2026, 1, 1)
    rows = [(k, t0 + dt.timedelta(seconds=i), i, *map(float, v)) for k, x in series.items() for i, v in enumerate(x)]
    f = len(next(iter(series.values()))[0])
    return spark.createDataFrame(rows, "server_id string, timestamp timestamp, seq long, " + ", ".join(f"m{i} double" for i in range(f)))


def flat_windows(series, w):
    views = [np.lib.stride_tricks.sliding_window_view(x, w, axis=0).transpose(0, 2, 1).reshape(-1, w * x.shape[1]) for x in series.values() if len(x) >= w]
    return np.vstack(views)


@pytest.mark.parametrize("w,f,chunk", [(1, 1, 1 << 16), (4, 1, 20), (5, 3, 40), (7, 2, 1 << 16), (12, 2, 60)])
def test_moments_of_windows_from_lags(spark, w, f, chunk):
    rng = np.random.default_rng(w)
    series = {f"s{k}": rng.normal(3, 2, size=(n, f)) for k, n in enumerate([300, w, w - 1 or 1, w + 1, 2 * w, 1])}
    v = flat_windows(series, w) - np.tile(np.arange(f), w)
    full = np.hstack([np.ones((len(v), 1)), v])
    chunks = stretches(wide(spark, series).repartition(4), [f"m{i}" for i in range(f)], w, ["server_id"], chunk_rows=chunk)
    assert np.allclose(second_moments(chunks, w, list(range(f))), full.T @ full, rtol=1e-10)
    got = over_windows(chunks, w, lambda x: x @ np.arange(1, w * f + 1.0)).toPandas()["value"]
    want = flat_windows(series, w) @ np.arange(1, w * f + 1.0)
    assert np.allclose(np.sort(got), np.sort(want))


def test_sequences_of_several_metrics(spark):
    rng = np.random.default_rng(8)
    t = np.arange(400)[:, None]
    series = {"a": 10 * np.sin(2 * np.pi * (t + [[0, 3, 5]]) / 20) + rng.normal(0, 0.1, (400, 3)), "b": rng.normal(0, 1, (50, 3))}
    df, names = wide(spark, series), ["m0", "m1", "m2"]
    windows = flat_windows(series, 6)
    d = SequenceReconstruction(6, 5, keys=["server_id"], value=names)
    d.train(df, chunk_rows=64)
    z = (windows - windows.mean(0)) / windows.std(0)
    _, v = np.linalg.eigh(z.T @ z / len(z))
    b = v[:, ::-1][:, :5]
    err = ((z - z @ b @ b.T) ** 2).mean(1)
    m = d.model.first()
    assert m["n_sequences"] == len(windows) and m["threshold"] == pytest.approx(np.percentile(err, 95), rel=1e-6)
    scored = d.score(d.windows(df)).toPandas()["reconstruction_error"]
    assert np.allclose(np.sort(scored), np.sort(err), rtol=1e-6)
    f = SequenceForecaster(6, 2, ridge=0.0, keys=["server_id"], value=names)
    f.train(df, chunk_rows=64)
    pairs = flat_windows(series, 8)
    x, y = np.hstack([np.ones((len(pairs), 1)), pairs[:, :18]]), pairs[:, [18, 21]]
    best, *_ = np.linalg.lstsq(x, y, rcond=None)
    got = {r["server_id"]: r["forecast"] for r in f.forecast(df).collect()}
    for k, s in series.items():
        assert np.allclose(got[k], np.append(1, s[-6:].ravel()) @ best, atol=1e-6)
    assert SequenceReconstruction(500, keys=["server_id"], value=names).train(df) is None


@pytest.mark.parametrize("values", [
    [1.0], [1.0, 2.0], [5.0] * 100, list(np.random.default_rng(5).normal(size=1000)),
    [0.0] * 990 + [1e12] * 10, list(np.random.default_rng(6).integers(0, 5, 500).astype(float)), [1e-9, 2e-9, 1e9, -1e9],
])
@pytest.mark.parametrize("q", [0, 5, 50, 95, 100])
def test_exact_percentile(spark, values, q):
    df = spark.createDataFrame([(float(v),) for v in values] + [(float("nan"),), (None,)], "value double")
    want = pytest.approx(np.percentile(values, q), rel=1e-12, abs=1e-12)
    assert exact_percentile(df, q, few=1).first()["percentile"] == want
    assert exact_percentile(df, q).first()["percentile"] == want


def test_percentile_per_key(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("value"))
    got = {r["k"]: r["percentile"] for r in exact_percentile(df, 50, keys=["k"], few=10).collect()}
    assert got == {k: float(np.percentile(np.arange(k, 1000, 3), 50)) for k in range(3)}


VOTES = [  # obs, model, score, flag
    (1, "isolation_forest", 0.9, True), (1, "lstm_autoencoder", 0.8, True), (1, "holt_winters", 0.2, False),
    (2, "isolation_forest", 0.7, True), (2, "other", 0.1, False),
    (3, "a", 1.0, True), (3, "b", 1.0, True), (3, "c", 0.0, False), (3, "d", 0.0, False),
]


@pytest.fixture(scope="module")
def votes(spark):
    return spark.createDataFrame(VOTES, "obs long, model_name string, anomaly_score double, is_anomaly boolean").cache()


def test_weighted_votes(votes):
    got = {r["obs"]: r for r in en.weighted(votes).collect()}
    assert got[1]["anomaly_score"] == pytest.approx((0.36 + 0.32 + 0.04) / 1.0) and got[1]["is_anomaly"]
    assert got[2]["anomaly_score"] == pytest.approx((0.28 + 0.05) / 0.9) and got[2]["total_weight"] == 0.9
    assert got[3]["anomaly_score"] == pytest.approx(0.5)


def test_majority_and_any(votes):
    m = {r["obs"]: r for r in en.majority(votes).collect()}
    assert m[1]["is_anomaly"] and not m[2]["is_anomaly"] and not m[3]["is_anomaly"]
    a = {r["obs"]: r for r in en.any_flag(votes).collect()}
    assert a[3]["flagging_models"] == ["a", "b"] and a[3]["anomaly_score"] == 1.0


def test_unscored_observation_is_kept(spark, votes):
    obs = spark.createDataFrame([(1,), (9,)], "obs long")
    got = {r["obs"]: r for r in en.ensemble(obs, votes, "no such method").collect()}
    assert set(got) == {1, 9} and got[9]["anomaly_score"] == 0.0 and got[9]["error"] and got[1]["method"] == "weighted"


def test_registry_without_models(spark):
    r = en.EnsembleRegistry()
    r.register("holt_winters", hw.HoltWinters(), 0.9)
    assert r.active == [] and r.weights["holt_winters"] == 0.9
    assert r.detect(spark.createDataFrame([(1,)], "obs long"), {}).first()["error"]


def test_forecast_precedence(spark):
    v = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "server_id string, name string")
    seq = spark.createDataFrame([("a", "x", [1.23456, 2.0])], "server_id string, name string, forecast array<double>")
    smooth = spark.createDataFrame([("a", "x", [9.0]), ("b", "x", [8.0, 7.0, 6.0])], seq.schema)
    got = {r["server_id"]: r["prediction_horizon"] for r in en.attach_forecast(v, seq, smooth, steps=2).collect()}
    assert got["a"]["source"] == "lstm" and got["a"]["values"] == [1.2346, 2.0]
    assert got["b"]["source"] == "holt_winters" and got["b"]["values"] == [8.0, 7.0] and got["c"] is None
