"""Detectors: scoring formulas with SQL, fits as rows only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pulsewarden.functions.linalg import second_moments, stretches
from pulsewarden.functions.scalars import feature_vector
from pulsewarden.operators import aggregates as ag, ensemble as en, rolling
from pulsewarden.operators.detectors.holtwinters import HoltWinters, forecast_at
from pulsewarden.operators.detectors.iforest import IsolationForest
from pulsewarden.operators.detectors.sequence import SequenceForecaster, SequenceReconstruction, error_score, window_state
from pulsewarden.plans.catalog import POINTS, ntz, points, query, r6, sql6, table
from pulsewarden.plans.scalar_queries import MODELS, hour_models
from pulsewarden.session import materialize
from pulsewarden.sinks.stores import report_rows

LINE_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", *LINE_FEATURES, F.xxhash64(order).alias("id"))


def forest(spark, sf_dir, **kw):
    lines = _lines(spark, sf_dir)
    f = IsolationForest(LINE_FEATURES, "id", **kw)
    f.train(lines)
    return f, lines


@query("if1_forest_nodes")
def if1(spark, sf_dir):
    f, _ = forest(spark, sf_dir)
    return f.model


@query("if2_forest_scores")
def if2(spark, sf_dir):
    f, lines = forest(spark, sf_dir)
    return f.score(lines).select("l_orderkey", "l_linenumber", "l_partkey", r6("raw_score").alias("raw_score"),
                                 r6("anomaly_score").alias("anomaly_score"), "is_anomaly")


@query("if2_forest_on_features")
def if2_features(spark, sf_dir):
    names = ["click", "error", "purchase", "signup", "view"]
    feats = rolling.rolling_features(points(spark, sf_dir), (1, 5))
    # training reads the feature table several times, so it is written once
    rows = materialize(rolling.feature_table(feats, names, "1 hour", (1, 5)).withColumn("id", F.xxhash64("server_id", "step")))
    f = IsolationForest(None, "id")
    f.train(rows)
    return f.score(rows).select("server_id", ntz("step").alias("step"), r6("anomaly_score").alias("anomaly_score"), "is_anomaly")


_FORECAST = "(level + {h} * trend + season[((n + {h} - 1) % m) + 1])"
_Z = "CASE WHEN resid_std > 0 THEN abs(value - forecast) / resid_std END"


@query("hw2_detect", f"""WITH {POINTS}, {MODELS}, j AS (SELECT p.seq, p.value, resid_std, {_FORECAST.format(h=1)} AS forecast FROM p JOIN hm USING (server_id, name)),
    z AS (SELECT *, {_Z} AS z FROM j)
    SELECT seq, {sql6('forecast')} AS forecast, {sql6('z')} AS z_score, {sql6('coalesce(least(1.0, z / 4.0), 0.0)')} AS anomaly_score,
           coalesce(least(1.0, z / 4.0), 0.0) > 0.7 AS is_anomaly FROM z""")
def hw2(spark, sf_dir):
    p = points(spark, sf_dir)
    hw = HoltWinters()
    hw.model = hour_models(p)
    return hw.score(p).select("seq", r6("forecast").alias("forecast"), r6("z_score").alias("z_score"),
                              r6("anomaly_score").alias("anomaly_score"), "is_anomaly")


@query("hw3_forecast", f"""WITH {POINTS}, {MODELS}, s AS (SELECT *, unnest(range(1, 49)) AS h FROM hm)
    SELECT server_id, name, h::INT AS step, {sql6(_FORECAST.format(h='h'))} AS forecast FROM s""")
def hw3(spark, sf_dir):
    hw = HoltWinters()
    hw.model = hour_models(points(spark, sf_dir))
    rows = hw.forecast(48).select("server_id", "name", F.posexplode("forecast").alias("pos", "x"))
    return rows.select("server_id", "name", (F.col("pos") + 1).alias("step"), r6("x").alias("forecast"))


@query("hw1_train_series")
def hw1(spark, sf_dir):
    m = HoltWinters(24).train(points(spark, sf_dir))
    return m.select("server_id", "name", "n", "m", r6("resid_std").alias("resid_std"), r6("sse").alias("sse"),
                    r6("alpha").alias("alpha"), r6("beta").alias("beta"), r6("gamma").alias("gamma"))


@query("hw4_train_univariate")
def hw4(spark, sf_dir):
    m = HoltWinters(24).train_univariate(points(spark, sf_dir), "srv-1", "view")
    return m.select("server_id", "name", "n", "m", r6("resid_std").alias("resid_std"))


@query("sq1_reconstruction_train")
def sq1(spark, sf_dir):
    m = SequenceReconstruction(24, 4).train(points(spark, sf_dir))
    return m.select("n_sequences", r6("threshold").alias("threshold"), F.size("basis").alias("n_basis"))


@query("sq2_reconstruction_detect")
def sq2(spark, sf_dir):
    p = points(spark, sf_dir)
    d = SequenceReconstruction(24, 4)
    d.train(p)
    scored = d.score(d.windows(p))
    return scored.select("server_id", "name", "seq", r6("reconstruction_error").alias("reconstruction_error"),
                         r6("anomaly_score").alias("anomaly_score"), "is_anomaly")


@query("sq2_error_score", f"""WITH t AS (SELECT event_id, value AS err, CASE WHEN event_type = 'view' THEN 0.0 ELSE 60.0 END AS thr FROM events)
    SELECT event_id, {sql6('CASE WHEN thr > 0 THEN least(1.0, err / (2 * thr)) ELSE 0.0 END')} AS anomaly_score, err > thr AS is_anomaly FROM t""")
def sq2_score(spark, sf_dir):
    thr = F.when(F.col("event_type") == "view", 0.0).otherwise(60.0)
    return table(spark, sf_dir, "events").select(
        "event_id", r6(error_score(F.col("value"), thr)).alias("anomaly_score"), (F.col("value") > thr).alias("is_anomaly"))


@query("sq3_forecaster_train")
def sq3(spark, sf_dir):
    m = SequenceForecaster(24, 6).train(points(spark, sf_dir))
    return m.select(F.size("weights").alias("n_weights"), r6(F.element_at("pivot", 1)).alias("pivot"))


@query("sq4_forecast")
def sq4(spark, sf_dir):
    p = points(spark, sf_dir)
    f = SequenceForecaster(24, 6)
    f.train(p)
    rows = f.forecast(p).select("server_id", "name", F.posexplode("forecast").alias("step", "x"))
    return rows.select("server_id", "name", "step", r6("x").alias("forecast"))


# ---- several metrics of a server at once ----------------------------------------------

_WIDE = """w AS (SELECT 'srv-' || (user_id % 8) AS server_id, ts AS timestamp, event_id AS seq, value, value / 2 + (event_id * 37) % 101 AS load FROM events)"""
_METRICS = ("value", "load")


def _wide(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    load = F.col("value") / 2 + (F.col("event_id") * 37) % 101
    return e.select(F.concat(F.lit("srv-"), (F.col("user_id") % 8).cast("string")).alias("server_id"),
                    F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_id").alias("seq"), "value", load.alias("load"))


_PLACES = [f"{m}{i}" for i in range(3) for m in _METRICS]
_SHIFTED = ", ".join(f"lag({m}, {2 - i}) OVER s - 50 AS {m}{i}" for i in range(3) for m in _METRICS)
_MOMENTS = f"""WITH {_WIDE}, g AS (SELECT {_SHIFTED}, row_number() OVER s AS rn FROM w WINDOW s AS (PARTITION BY server_id ORDER BY timestamp, seq)),
    h AS (SELECT * FROM g WHERE rn >= 3)
    {' UNION ALL '.join(f"SELECT {i} AS i, {j} AS j, {sql6(f'avg({a} * {b})')} AS moment, count(*) AS n FROM h" for i, a in enumerate(_PLACES) for j, b in enumerate(_PLACES))}"""


def _moment_rows(spark, sf_dir, **kw):
    chunks = stretches(_wide(spark, sf_dir), _METRICS, 3, ["server_id"], **kw)
    m = second_moments(chunks, 3, [50.0, 50.0])
    n = int(m[0, 0])
    rows = [(i, j, float(m[1 + i, 1 + j]) / n, n) for i in range(6) for j in range(6)]
    return spark.createDataFrame(rows, "i int, j int, moment double, n long").withColumn("moment", r6("moment"))


@query("sq1_multi_moments", _MOMENTS)
def sq1_moments(spark, sf_dir):
    return _moment_rows(spark, sf_dir)


@query("sq1_multi_moments_chunks", _MOMENTS)
def sq1_moments_chunks(spark, sf_dir):
    return _moment_rows(spark, sf_dir, chunk_rows=50)


@query("sq1_merged_moments", _MOMENTS)
def sq1_merged(spark, sf_dir):
    """Three spans of time one after the other, each read alone."""
    w = _wide(spark, sf_dir)
    first, last = w.agg(F.min(F.unix_micros("timestamp")), F.max(F.unix_micros("timestamp"))).first()
    span = F.floor((F.unix_micros("timestamp") - first) * 3 / F.lit(last - first + 1))
    state = None
    for k in range(3):
        state = window_state(w.filter(span == k), _METRICS, 3, ["server_id"], ["timestamp", "seq"], state)
    # around 50 as in the SQL, whatever the sums were centred on
    d, n = np.tile(np.array(state.pivot) - 50.0, 3), int(state.moments[0, 0])
    sums = state.moments[0, 1:]
    m = state.moments[1:, 1:] + np.outer(d, sums) + np.outer(sums, d) + n * np.outer(d, d)
    rows = [(i, j, float(m[i, j]) / n, n) for i in range(6) for j in range(6)]
    return spark.createDataFrame(rows, "i int, j int, moment double, n long").withColumn("moment", r6("moment"))


@query("st4_merged_forest", "WITH n AS (SELECT least(256, count(*))::INT AS n FROM lineitem) SELECT i::INT AS tree, n AS n_rows, true AS same_trees FROM n, range(100) t(i)")
def st4_forest(spark, sf_dir):
    """A forest from the merged samples of three parts against one trained on all rows."""
    whole, lines = forest(spark, sf_dir)
    parts = IsolationForest(LINE_FEATURES, "id")
    states = [parts.sample_state(lines.filter(F.pmod(F.col("l_orderkey"), F.lit(3)) == k)) for k in range(3)]
    parts.train_from(parts.merged(*states), lines.limit(1000))
    columns = ["tree", "node", "feature", "threshold", "left", "right", "size", "depth"]

    def trees(model):
        rows = model.filter("tree >= 0").select(columns)
        return rows.groupBy("tree").agg(F.max(F.when(F.col("node") == 0, F.col("size"))).alias("n_rows"),
                                        F.sort_array(F.collect_list(F.struct(*columns))).alias("nodes"))

    other = trees(parts.model).withColumnRenamed("nodes", "others").drop("n_rows")
    return trees(whole.model).join(other, "tree").select("tree", "n_rows", (F.col("nodes") == F.col("others")).alias("same_trees"))


# Two standardised metrics that fall together have (1, 1) / sqrt(2) as their first component, else (1, -1).
@query("sq1_multi", f"""WITH {_WIDE}, a AS (SELECT count(*) AS n, avg(value) AS mv, avg(load) AS ml, stddev_pop(value) AS sv, stddev_pop(load) AS sl, corr(value, load) AS c FROM w),
    e AS (SELECT power((value - mv) / sv - sign(c) * (load - ml) / sl, 2) / 4 AS err FROM w, a)
    SELECT n AS n_sequences, {sql6('mv')} AS mean_value, {sql6('ml')} AS mean_load, {sql6('sv')} AS scale_value, {sql6('sl')} AS scale_load,
           {sql6('(SELECT quantile_cont(err, 0.95) FROM e)')} AS threshold FROM a""")
def sq1_multi(spark, sf_dir):
    m = SequenceReconstruction(1, 1, keys=["server_id"], value=_METRICS).train(_wide(spark, sf_dir))
    at = {f"{c}_{m}": r6(F.element_at(c, i)).alias(f"{c}_{m}") for c in ("mean", "scale") for i, m in enumerate(_METRICS, 1)}
    return m.select("n_sequences", *at.values(), r6("threshold").alias("threshold"))


# Ridge regression on two inputs, from the normal equations around the averages.
@query("sq3_multi", f"""WITH {_WIDE}, a AS (SELECT avg(value) AS pv, avg(load) AS pl FROM w),
    g AS (SELECT value - pv AS x, load - pl AS y, lead(value, 1) OVER s - pv AS t1, lead(value, 2) OVER s - pv AS t2
          FROM w, a WINDOW s AS (PARTITION BY server_id ORDER BY timestamp, seq)),
    k AS (SELECT * FROM g WHERE t2 IS NOT NULL),
    l AS (SELECT count(*) AS n, 1e-3 * (sum(x * x) + sum(y * y)) / 2 AS ridge, avg(x) AS mx, avg(y) AS my FROM k),
    c AS (SELECT unnest([1, 2]) AS step, sum((x - mx) * (x - mx)) + any_value(ridge) AS xx, sum((y - my) * (y - my)) + any_value(ridge) AS yy, sum((x - mx) * (y - my)) AS xy,
                 unnest([sum((x - mx) * t1), sum((x - mx) * t2)]) AS xt, unnest([sum((y - my) * t1), sum((y - my) * t2)]) AS yt,
                 unnest([avg(t1), avg(t2)]) AS mt, any_value(mx) AS mx, any_value(my) AS my FROM k, l),
    b AS (SELECT step, (xt * yy - yt * xy) / (xx * yy - xy * xy) AS wx, (yt * xx - xt * xy) / (xx * yy - xy * xy) AS wy, mt, mx, my FROM c)
    SELECT step, {sql6('mt - wx * mx - wy * my')} AS intercept, {sql6('wx')} AS w_value, {sql6('wy')} AS w_load FROM b""")
def sq3_multi(spark, sf_dir):
    m = SequenceForecaster(1, 2, keys=["server_id"], value=_METRICS).train(_wide(spark, sf_dir))
    at = lambda k: F.element_at("weights", F.col("step") + 2 * k)
    steps = m.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("step"), "weights")
    return steps.select("step", *[r6(at(k)).alias(c) for k, c in enumerate(("intercept", "w_value", "w_load"))])


@query("w9_multi_pairs", f"""WITH {_WIDE} SELECT seq, {', '.join(f'lag({m}, {2 - i}) OVER s AS {m}{i}' for i in range(3) for m in _METRICS)},
    lead(value, 1) OVER s AS t1, lead(value, 2) OVER s AS t2 FROM w WINDOW s AS (PARTITION BY server_id ORDER BY timestamp, seq)
    QUALIFY row_number() OVER s >= 3 AND lead(value, 2) OVER s IS NOT NULL""")
def w9_multi(spark, sf_dir):
    p = rolling.sequences(_wide(spark, sf_dir), 3, _METRICS, ["server_id"], ["timestamp", "seq"], horizon=2, chunk_rows=50)
    return p.select("seq", *[F.element_at("sequence", k + 1).alias(c) for k, c in enumerate(_PLACES)],
                    F.element_at("target", 1).alias("t1"), F.element_at("target", 2).alias("t2"))


# ---- the arithmetic at fixed models ---------------------------------------------------

@query("if1_forest_invariants", """WITH n AS (SELECT least(256, count(*))::INT AS n FROM lineitem)
    SELECT i::INT AS tree, n AS n_rows, n::BIGINT AS n_in_leaves, true AS shallow, true AS binary FROM n, range(100) t(i)""")
def if1_invariants(spark, sf_dir):
    f, _ = forest(spark, sf_dir)
    nodes = f.model.filter("tree >= 0")
    leaf = F.col("feature") < 0
    return nodes.groupBy("tree").agg(
        F.max(F.when(F.col("node") == 0, F.col("size"))).alias("n_rows"),
        F.sum(F.when(leaf, F.col("size"))).cast("long").alias("n_in_leaves"),
        (F.max("depth") <= 8).alias("shallow"),
        (F.count_if(leaf) == F.count_if(~leaf) + 1).alias("binary"))


@query("if1_contamination", "SELECT round(0.05 * count(*)) AS n_expected, true AS near FROM lineitem")
def if1_contamination(spark, sf_dir):
    f, lines = forest(spark, sf_dir, contamination=0.05)
    n = f.score(lines).agg(F.count("*").alias("n"), F.count_if("is_anomaly").alias("hit"))
    want = F.round(F.col("n") * 0.05)
    return n.select(want.alias("n_expected"), (F.abs(F.col("hit") - want) <= 0.02 * F.col("n")).alias("near"))


# tree, node, feature, threshold, left, right, size, depth; the first row has offset and sample size
_NODES = [
    (-1, 0, -1, -0.5, -1, -1, 256, 0),
    (0, 0, 0, 25.0, 1, 2, 256, 0), (0, 1, -1, 0.0, -1, -1, 100, 1), (0, 2, 1, 30000.0, 3, 4, 156, 1),
    (0, 3, -1, 0.0, -1, -1, 150, 2), (0, 4, -1, 0.0, -1, -1, 6, 2),
    (1, 0, 2, 0.05, 1, 2, 256, 0), (1, 1, 3, 0.03, 3, 4, 254, 1), (1, 2, -1, 0.0, -1, -1, 2, 1),
    (1, 3, -1, 0.0, -1, -1, 1, 2), (1, 4, -1, 0.0, -1, -1, 253, 2),
]


def _path_sql(n: int) -> str:
    return "0.0" if n <= 1 else "1.0" if n == 2 else f"(2 * (ln({n - 1}.0) + 0.57721566490153286) - 2.0 * {n - 1} / {n})"


def _descent_sql(tree: int, names) -> str:
    """Path length of a row in a tree of ``_NODES``, as nested CASE."""
    nodes = {r[1]: r for r in _NODES if r[0] == tree}

    def at(k: int) -> str:
        _, _, feature, cut, left, right, size, depth = nodes[k]
        return f"{depth} + {_path_sql(size)}" if feature < 0 else f"CASE WHEN {names[feature]} <= {cut} THEN {at(left)} ELSE {at(right)} END"

    return f"({at(0)})"


_RAW = f"(0.5 - power(2.0, -({_descent_sql(0, LINE_FEATURES)} + {_descent_sql(1, LINE_FEATURES)}) / (2 * {_path_sql(256)})))"


def fixed_forest(spark, features=LINE_FEATURES, id_col="id"):
    f = IsolationForest(features, id_col)
    f.model = spark.createDataFrame(_NODES, "tree int, node int, feature int, threshold double, left int, right int, size int, depth int")
    return f


@query("if2_fixed_forest", f"""SELECT l_orderkey, l_linenumber, l_partkey, {sql6(_RAW)} AS raw_score,
    {sql6(f'least(1.0, greatest(0.0, 0.5 - {_RAW}))')} AS anomaly_score, {_RAW} < 0 AS is_anomaly FROM lineitem""")
def if2_fixed(spark, sf_dir):
    scored = fixed_forest(spark).score(_lines(spark, sf_dir))
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", r6("raw_score").alias("raw_score"),
                         r6("anomaly_score").alias("anomaly_score"), "is_anomaly")


_A, _B, _G = 0.3, 0.1, 0.2
_SMOOTH = f"""y AS MATERIALIZED (SELECT server_id, name, value, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY server_id, name) AS n
        FROM p WINDOW w AS (PARTITION BY server_id, name ORDER BY timestamp, seq)),
    q AS (SELECT *, CASE WHEN n >= 48 THEN 24 ELSE greatest(2, n // 2) END AS m FROM y),
    i AS (SELECT server_id, name, n, m, avg(value) FILTER (t < m) AS level,
                 (avg(value) FILTER (t >= m AND t < 2 * m) - avg(value) FILTER (t < m)) / m AS trend,
                 list(value ORDER BY t) FILTER (t < m) AS first FROM q WHERE n >= 2 * m GROUP BY server_id, name, n, m),
    r AS (SELECT server_id, name, n, m, 0::BIGINT AS t, level, trend, list_transform(first, lambda x: x - level) AS season, 0.0::DOUBLE AS sse, 0.0::DOUBLE AS es FROM i
      UNION ALL
      SELECT r.server_id, r.name, r.n, r.m, r.t + 1, level + trend + {_A} * e, trend + {_A} * {_B} * e,
             season[1:r.t % r.m] || [season[r.t % r.m + 1] + {_G} * e] || season[r.t % r.m + 2:],
             sse + CASE WHEN r.t >= r.m THEN e * e ELSE 0 END, es + CASE WHEN r.t >= r.m THEN e ELSE 0 END
      FROM (SELECT r.*, y.value - r.level - r.trend - r.season[r.t % r.m + 1] AS e
            FROM r JOIN y ON y.server_id = r.server_id AND y.name = r.name AND y.t = r.t) r)"""
_FITTED = f"""SELECT server_id, name, n::INT AS n, m::INT AS m, {sql6('level')} AS level, {sql6('trend')} AS trend, {sql6('season[1]')} AS first_season,
    {sql6('sse')} AS sse, {sql6('sqrt(greatest(0, sse / (n - m) - power(es / (n - m), 2)))')} AS resid_std FROM r WHERE t = n"""


def _fitted(m):
    return m.select("server_id", "name", "n", "m", r6("level").alias("level"), r6("trend").alias("trend"),
                    r6(F.element_at("season", 1)).alias("first_season"), r6("sse").alias("sse"), r6("resid_std").alias("resid_std"))


@query("hw1_fixed_smoothing", f"WITH RECURSIVE {POINTS}, {_SMOOTH} {_FITTED}")
def hw1_fixed(spark, sf_dir):
    return _fitted(HoltWinters(24).train_at(points(spark, sf_dir), _A, _B, _G))


@query("hw1_fixed_smoothing_blocks", f"WITH RECURSIVE {POINTS}, {_SMOOTH} {_FITTED}")
def hw1_fixed_blocks(spark, sf_dir):
    return _fitted(HoltWinters(24, block=100).train_at(points(spark, sf_dir), _A, _B, _G))


@query("hw4_fixed_smoothing", f"WITH RECURSIVE {POINTS}, {_SMOOTH} {_FITTED} AND server_id = 'srv-1' AND name = 'view'")
def hw4_fixed(spark, sf_dir):
    one = points(spark, sf_dir).filter("server_id = 'srv-1' AND name = 'view'")
    return _fitted(HoltWinters(24).train_at(one, _A, _B, _G))


_MEAN, _SCALE = (40.0, 45.0, 50.0, 55.0), (10.0, 20.0, 30.0, 40.0)
_LAGS = f"""g AS (SELECT server_id, name, seq, row_number() OVER w AS rn, {', '.join(f'lag(value, {3 - i}) OVER w AS v{i}' for i in range(4))}
    FROM p WINDOW w AS (PARTITION BY server_id, name ORDER BY timestamp, seq)),
    z AS (SELECT *, {', '.join(f'(v{i} - {_MEAN[i]}) / {_SCALE[i]} AS z{i}' for i in range(4))} FROM g WHERE rn >= 4),
    b AS (SELECT *, (z0 + z1 + z2 + z3) / 2 AS a, (z0 - z1 + z2 - z3) / 2 AS d FROM z),
    e AS (SELECT *, (power(z0 - (a + d) / 2, 2) + power(z1 - (a - d) / 2, 2) + power(z2 - (a + d) / 2, 2) + power(z3 - (a - d) / 2, 2)) / 4 AS err FROM b)"""


@query("sq2_fixed_reconstruction", f"""WITH {POINTS}, {_LAGS} SELECT server_id, name, seq, {sql6('err')} AS reconstruction_error,
    {sql6('least(1.0, err / 1.4)')} AS anomaly_score, err > 0.7 AS is_anomaly FROM e""")
def sq2_fixed(spark, sf_dir):
    d = SequenceReconstruction(4, 2)
    basis = [0.5, 0.5, 0.5, -0.5, 0.5, 0.5, 0.5, -0.5]
    d.model = spark.createDataFrame([(list(_MEAN), list(_SCALE), basis, 1, 0.7)],
                                    "mean array<double>, scale array<double>, basis array<double>, n_sequences long, threshold double")
    scored = d.score(d.windows(points(spark, sf_dir)))
    return scored.select("server_id", "name", "seq", r6("reconstruction_error").alias("reconstruction_error"),
                         r6("anomaly_score").alias("anomaly_score"), "is_anomaly")


@query("sq4_fixed_forecast", f"""WITH {POINTS}, g AS (SELECT server_id, name, row_number() OVER (PARTITION BY server_id, name ORDER BY timestamp DESC, seq DESC) AS k, value FROM p),
    x AS (SELECT server_id, name, coalesce(max(value) FILTER (k = 3), 0) - 50 AS a, coalesce(max(value) FILTER (k = 2), 0) - 50 AS b,
                 max(value) FILTER (k = 1) - 50 AS c FROM g GROUP BY ALL)
    SELECT server_id, name, 0 AS step, {sql6('51 + 0.5 * a + 0.3 * b + 0.2 * c')} AS forecast FROM x
    UNION ALL SELECT server_id, name, 1, {sql6('52 + 0.1 * a + 0.2 * b + 0.7 * c')} FROM x""")
def sq4_fixed(spark, sf_dir):
    f = SequenceForecaster(3, 2)
    f.model = spark.createDataFrame([([1.0, 2.0, 0.5, 0.1, 0.3, 0.2, 0.2, 0.7], [50.0])], "weights array<double>, pivot array<double>")
    rows = f.forecast(points(spark, sf_dir)).select("server_id", "name", F.posexplode("forecast").alias("step", "x"))
    return rows.select("server_id", "name", "step", r6("x").alias("forecast"))


_POINT_NODES = ("value", "hour", "value", "hour")
_POINT_RAW = f"(0.5 - power(2.0, -({_descent_sql(0, _POINT_NODES)} + {_descent_sql(1, _POINT_NODES)}) / (2 * {_path_sql(256)})))"


@query("en6_two_detectors", f"""WITH {POINTS}, {MODELS}, h AS (SELECT *, hour(timestamp)::DOUBLE AS hour FROM p),
    f AS (SELECT seq, least(1.0, greatest(0.0, 0.5 - {_POINT_RAW})) AS s FROM h),
    j AS (SELECT p.seq, coalesce(least(1.0, CASE WHEN resid_std > 0 THEN abs(value - {_FORECAST.format(h=1)}) / resid_std END / 4), 0.0) AS s FROM p JOIN hm USING (server_id, name))
    SELECT f.seq, {sql6('(0.7 * f.s + 0.2 * j.s) / 0.9')} AS anomaly_score, 2 AS n_models, {sql6('0.9')} AS total_weight FROM f JOIN j USING (seq)""")
def en6_two(spark, sf_dir):
    """A forest and a smoothing model, one weight overridden on registration; an untrained one has no say."""
    p = points(spark, sf_dir).withColumn("hour", F.hour("timestamp").cast("double"))
    smoothing = HoltWinters()
    smoothing.model = hour_models(p)
    registry = en.EnsembleRegistry()
    registry.register("isolation_forest", fixed_forest(spark, _POINT_NODES, "seq"), 0.7)
    registry.register("holt_winters", smoothing)
    registry.register("lstm_autoencoder", SequenceReconstruction())
    out = registry.detect(p, {n: p for n in registry.active}, obs=("seq",))
    return out.select("seq", r6("anomaly_score").alias("anomaly_score"), F.col("n_models").cast("int").alias("n_models"),
                      r6("total_weight").alias("total_weight"))


@query("snk5_fixed_report", f"""WITH RECURSIVE {POINTS}, {_SMOOTH}, w AS ({_FITTED}),
    f AS (SELECT count(*)::DOUBLE AS n, avg({_RAW}) AS m, stddev_pop({_RAW}) AS sd, avg(({_RAW} < 0)::INT) AS rate FROM lineitem),
    k AS (SELECT count(*)::DOUBLE AS n, avg(resid_std) AS sd FROM w)
    SELECT 'isolation_forest' AS model, unnest(['n_samples', 'n_features', 'score_mean', 'score_std', 'anomaly_rate']) AS metric,
           unnest([{', '.join(sql6(x) for x in ('n', '4.0', 'm', 'sd', 'rate'))}]) AS value FROM f
    UNION ALL SELECT 'holt_winters', unnest(['n_series', 'residual_std']), unnest([{sql6('n')}, {sql6('sd')}]) FROM k""")
def snk5_fixed(spark, sf_dir):
    summary = ag.training_metrics(fixed_forest(spark).score(_lines(spark, sf_dir)), len(LINE_FEATURES))
    hw = _fitted(HoltWinters(24).train_at(points(spark, sf_dir), _A, _B, _G)).agg(
        F.count("*").alias("n_series"), F.avg("resid_std").alias("residual_std"))
    return report_rows(isolation_forest=summary, holt_winters=hw).withColumn("value", r6("value"))


@query("snk5_training_report")
def snk5(spark, sf_dir):
    f, lines = forest(spark, sf_dir)
    summary = ag.training_metrics(f.score(lines), len(LINE_FEATURES))
    hw = HoltWinters(24).train(points(spark, sf_dir)).agg(
        F.count("*").alias("n_series"), F.avg("resid_std").alias("residual_std"), F.sum("sse").alias("sse"))
    return report_rows(isolation_forest=summary, holt_winters=hw).withColumn("value", r6("value"))
