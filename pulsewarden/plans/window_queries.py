"""Rolling features."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsewarden.functions.scalars import feature_vector
from pulsewarden.operators import ordering as o, rolling
from pulsewarden.plans.catalog import POINTS, ntz, points, query, r6, sql6

WINDOWS = (1, 5, 15)  # frames of 12, 60 and 180 points
STATS = ("mean", "std", "min", "max", "skew", "kurtosis")


def _frame_sql(n: int) -> str:
    return f"OVER (PARTITION BY server_id, name ORDER BY timestamp, seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _stat_sql(w: int, frame: str) -> dict[str, str]:
    m = f"avg(value) {frame}"
    m2 = f"(avg(value*value) {frame})"
    m3 = f"(avg(value*value*value) {frame})"
    var = f"(var_pop(value) {frame})"
    return {
        f"mean_{w}m": m,
        f"std_{w}m": f"stddev_pop(value) {frame}",
        f"min_{w}m": f"min(value) {frame}",
        f"max_{w}m": f"max(value) {frame}",
        f"skew_{w}m": f"CASE WHEN {var} > 1e-12 THEN ({m3} - 3*({m})*{m2} + 2*power({m}, 3)) / power({var}, 1.5) END",
        f"kurtosis_{w}m": f"kurtosis_pop(value) {frame}",
        f"rate_{w}m": f"value - first_value(value) {frame}",
    }


def _features_sql(windows=WINDOWS, ppm: int = 12, rounded: bool = True) -> str:
    seen = f"count(*) {_frame_sql(1_000_000_000)}"
    cols = []
    for w in windows:
        for name, x in _stat_sql(w, _frame_sql(w * ppm)).items():
            x = f"CASE WHEN {seen} >= 5 THEN {x} END"
            cols.append(f"{sql6(x) if rounded else x} AS {name}")
    return f"SELECT server_id, name, timestamp, seq, value, {', '.join(cols)} FROM p"


def _names(windows=WINDOWS) -> list[str]:
    return [f"{s}_{w}m" for w in windows for s in (*STATS, "rate")]


def features(spark, sf_dir, windows=WINDOWS):
    return rolling.rolling_features(points(spark, sf_dir), windows)


@query("w1_rolling_features", f"WITH {POINTS} {_features_sql()}")
def w1(spark, sf_dir):
    df = features(spark, sf_dir)
    return df.select("server_id", "name", ntz("timestamp").alias("timestamp"), "seq", "value",
                     *[r6(n).alias(n) for n in _names()])


@query("w1_default_windows", f"WITH {POINTS} {_features_sql((5, 15, 60))}")
def w1_default(spark, sf_dir):
    df = features(spark, sf_dir, (5, 15, 60))
    return df.select("server_id", "name", ntz("timestamp").alias("timestamp"), "seq", "value",
                     *[r6(n).alias(n) for n in _names((5, 15, 60))])


@query("w1_across_chunks", f"WITH {POINTS} {_features_sql((12, 36, 144), 1)}")
def w1_chunks(spark, sf_dir):
    """Frames that fill, in chunks that end inside a series."""
    df = rolling.rolling_features(points(spark, sf_dir), (12, 36, 144), points_per_minute=1, chunk_rows=200)
    return df.select("server_id", "name", ntz("timestamp").alias("timestamp"), "seq", "value",
                     *[r6(n).alias(n) for n in _names((12, 36, 144))])


@query("w2_rate", f"""WITH {POINTS} SELECT server_id, name, seq,
    {sql6(f"CASE WHEN count(*) {_frame_sql(10**9)} >= 5 THEN value - first_value(value) {_frame_sql(60)} END")} AS rate_5m FROM p""")
def w2(spark, sf_dir):
    df = rolling.rolling_features(points(spark, sf_dir), (5,), stats=())
    return df.select("server_id", "name", "seq", r6("rate_5m").alias("rate_5m"))


_LAST = f"""f AS ({_features_sql(rounded=False)}),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY server_id, name ORDER BY timestamp DESC, seq DESC) = 1)"""
_UNPIVOT = " UNION ALL ".join(
    f"SELECT server_id, name || '_{n}' AS feature, {n} AS feature_value FROM l" for n in _names())


@query("w3_all_features", f"""WITH {POINTS}, {_LAST}, u AS ({_UNPIVOT})
    SELECT server_id, feature, {sql6('feature_value')} AS feature_value FROM u WHERE feature_value IS NOT NULL""")
def w3(spark, sf_dir):
    df = rolling.latest_features(features(spark, sf_dir), _names())
    return df.select("server_id", "feature", r6("feature_value").alias("feature_value"))


def _time_sql(windows=(60, 360)) -> str:
    cols = []
    for w in windows:
        frame = f"OVER (PARTITION BY server_id, name ORDER BY timestamp RANGE BETWEEN INTERVAL {w} MINUTES PRECEDING AND CURRENT ROW)"
        for name, x in _stat_sql(w, frame).items():
            if name.startswith("rate"):
                x = f"value - arg_min(value, (timestamp, seq)) {frame}"
            x = f"CASE WHEN count(*) {frame} >= 5 THEN {x} END"
            cols.append(f"{sql6(x)} AS {name}")
    return f"WITH {POINTS} SELECT server_id, name, seq, {', '.join(cols)} FROM p"


def _time_features(spark, sf_dir, windows, **kw):
    df = rolling.rolling_features_by_time(points(spark, sf_dir), windows, **kw)
    return df.select("server_id", "name", "seq", *[r6(n).alias(n) for n in _names(windows)])


@query("w4_time_frames", _time_sql())
def w4(spark, sf_dir):
    return _time_features(spark, sf_dir, (60, 360))


@query("w4_frames_across_chunks", _time_sql((360, 2880)))
def w4_chunks(spark, sf_dir):
    """Frames of more rows than a chunk is given."""
    return _time_features(spark, sf_dir, (360, 2880), chunk_rows=20)


@query("w5_readiness", f"""WITH {POINTS} SELECT server_id, name, seq,
    count(*) {_frame_sql(10)} >= 10 AS is_ready FROM p""")
def w5(spark, sf_dir):
    return rolling.readiness(points(spark, sf_dir)).select("server_id", "name", "seq", "is_ready")


@query("w6_newest_per_server", f"""WITH {POINTS} SELECT server_id, name, seq, value FROM p
    QUALIFY row_number() OVER (PARTITION BY server_id ORDER BY timestamp DESC, seq DESC) <= 200""")
def w6(spark, sf_dir):
    return o.newest(points(spark, sf_dir), 200, ["server_id"], o.ORDER).select("server_id", "name", "seq", "value")


@query("w7_newest_per_series", f"""WITH {POINTS} SELECT server_id, name, seq, value FROM p
    QUALIFY row_number() OVER (PARTITION BY server_id, name ORDER BY timestamp DESC, seq DESC) <= 60""")
def w7(spark, sf_dir):
    return o.newest(points(spark, sf_dir), 60, o.KEYS, o.ORDER).select("server_id", "name", "seq", "value")


_SEQ = """s AS (SELECT server_id, name, seq, list(value) OVER w AS xs, list(value) OVER nx AS ys FROM p
    WINDOW w AS (PARTITION BY server_id, name ORDER BY timestamp, seq ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
           nx AS (PARTITION BY server_id, name ORDER BY timestamp, seq ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING))"""


def _text(c):
    return F.array_join(F.transform(c, lambda v: F.round(v * 100).cast("bigint").cast("string")), ",")


_TEXT_SQL = "array_to_string([CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR) FOR x IN {0}], ',')"


@query("w8_sequences", f"""WITH {POINTS}, {_SEQ} SELECT server_id, name, seq, {_TEXT_SQL.format('xs')} AS sequence
    FROM s WHERE len(xs) = 12""")
def w8(spark, sf_dir):
    df = rolling.sequences(points(spark, sf_dir), 12)
    return df.select("server_id", "name", "seq", _text("sequence").alias("sequence"))


@query("w9_forecast_pairs", f"""WITH {POINTS}, {_SEQ} SELECT server_id, name, seq, {_TEXT_SQL.format('xs')} AS sequence,
    {_TEXT_SQL.format('ys')} AS target FROM s WHERE len(xs) = 12 AND len(ys) = 4""")
def w9(spark, sf_dir):
    df = rolling.sequences(points(spark, sf_dir), 12, horizon=4)
    return df.select("server_id", "name", "seq", _text("sequence").alias("sequence"), _text("target").alias("target"))


@query("w9_pairs_across_chunks", f"""WITH {POINTS}, {_SEQ} SELECT server_id, name, seq, {_TEXT_SQL.format('xs')} AS sequence,
    {_TEXT_SQL.format('ys')} AS target FROM s WHERE len(xs) = 12 AND len(ys) = 4""")
def w9_chunks(spark, sf_dir):
    df = rolling.sequences(points(spark, sf_dir), 12, horizon=4, chunk_rows=50)
    return df.select("server_id", "name", "seq", _text("sequence").alias("sequence"), _text("target").alias("target"))


@query("sc4_feature_names", f"""WITH {POINTS}, {_LAST}, u AS ({_UNPIVOT})
    SELECT feature, count(*) AS n FROM u GROUP BY feature""")
def sc4(spark, sf_dir):
    df = features(spark, sf_dir)
    last = df.groupBy("server_id", "name").agg(
        *[F.max_by(n, F.struct("timestamp", "seq")).alias(n) for n in _names()])
    return rolling.long_features(last, WINDOWS).groupBy("feature").agg(F.count("*").alias("n"))


_STEP = """z AS (SELECT server_id, name, time_bucket(INTERVAL 1 DAY, timestamp) AS step,
                 arg_max(value, (timestamp, seq)) AS v FROM p GROUP BY ALL)"""


@query("sc3_feature_vector", f"""WITH {POINTS}, {_STEP},
    w AS (SELECT server_id, step, {', '.join(f"coalesce(max(v) FILTER (name = '{m}'), 0.0) AS {m}" for m in ('click', 'error', 'purchase', 'signup', 'view'))}
          FROM z GROUP BY server_id, step)
    SELECT server_id, step, {_TEXT_SQL.format("[click, error, purchase, signup, view]")} AS vector FROM w""")
def sc3(spark, sf_dir):
    names = ["view", "click", "purchase", "signup", "error"]
    latest = points(spark, sf_dir).groupBy("server_id", F.window("timestamp", "1 day").start.alias("step"), "name").agg(
        F.max_by("value", F.struct("timestamp", "seq")).alias("v"))
    wide = latest.groupBy("server_id", "step").pivot("name", names).agg(F.max("v"))
    return wide.select("server_id", ntz("step").alias("step"), _text(feature_vector(names)).alias("vector"))


for _method, _form in (("zscore", "(value - avg(value) OVER k) / nullif(stddev_pop(value) OVER k, 0)"),
                       ("minmax", "(value - min(value) OVER k) / nullif(max(value) OVER k - min(value) OVER k, 0)")):
    def _normalized(spark, sf_dir, method=_method):
        d = rolling.normalize_column(points(spark, sf_dir), method=method)
        return d.select("seq", r6("normalized").alias("normalized"))

    query(f"sc2_{_method}_by_series", f"""WITH {POINTS} SELECT seq, {sql6(f'coalesce({_form}, value)')} AS normalized FROM p
        WINDOW k AS (PARTITION BY server_id, name)""")(_normalized)
