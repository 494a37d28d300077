"""Reference histograms and population-stability drift."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pulsewarden.config import DEFAULTS
from pulsewarden.functions.scalars import bind, nan_to_num
from pulsewarden.session import sized

EPS = 1e-6


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin number from 0; the last bin holds its upper edge."""
    return F.least(F.floor((x - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")


def _values(df: DataFrame) -> DataFrame:
    return df.select("name", nan_to_num(F.col("value")).alias("_x"))


def _edges(values: DataFrame) -> DataFrame:
    lo, hi = F.min("_x"), F.max("_x")
    pad = F.when(lo == hi, 0.5).otherwise(0.0)
    return values.groupBy("name").agg((lo - pad).alias("lo"), (hi + pad).alias("hi"))


def set_reference(df: DataFrame, bins: int = 10) -> DataFrame:
    """``(name, value)`` → ``(name, bin, lo, hi, n)``: equal-width bins over [min, max].

    ``lo`` and ``hi`` are the whole range of the name; constant data get a range
    of one. Empty bins have n = 0.
    """
    values = _values(df)
    edges = sized(_edges(values))
    counted = with_bins(values, edges, bins).groupBy("name", "lo", "hi").agg(bin_counts(bins).alias("_n"))
    return counted.select("name", F.posexplode("_n").alias("bin", "n"), "lo", "hi").select(
        "name", "bin", "lo", "hi", "n"
    )


def bin_counts(bins: int) -> Column:
    """Aggregate: ``array<bigint>`` of the rows per bin; a null bin counts nowhere."""
    return F.array(*[F.count_if(F.col("_bin") == b) for b in range(bins)])


def with_bins(values: DataFrame, edges: DataFrame, bins: int) -> DataFrame:
    """Bin of every value on its name's reference edges, null outside them."""
    x, lo, hi = F.col("_x"), F.col("lo"), F.col("hi")
    inside = (x >= lo) & (x <= hi)
    return values.join(edges, "name").withColumn("_bin", F.when(inside, _bin(x, lo, hi, bins)))


def psi_of_counts(ref: Column, now: Column, width: Column) -> Column:
    """Stability index of two count arrays: smoothed densities, rescaled to one, compared.

    NaN when no current value fell into a bin, which grades as significant drift.
    """

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda t, v: t + v)

    def shares(counts: Column) -> Column:
        smooth = bind(total(counts), lambda t: F.transform(
            counts, lambda n: F.coalesce(F.try_divide(n, t * width), F.lit(0.0)) + EPS))
        return bind(smooth, lambda d: bind(total(d), lambda t: F.transform(d, lambda v: v / t)))

    index = total(F.zip_with(shares(ref), shares(now), lambda r, c: (c - r) * F.ln(c / r)))
    return F.when(total(now) > 0, index).otherwise(float("nan"))


def reference_arrays(reference: DataFrame) -> DataFrame:
    """One row per name: range and counts in bin order."""
    rows = F.sort_array(F.collect_list(F.struct("bin", "n")))
    return reference.groupBy("name").agg(
        F.first("lo").alias("lo"), F.first("hi").alias("hi"), rows.getField("n").alias("ref")
    )


def psi(current: DataFrame, reference: DataFrame, bins: int = 10) -> DataFrame:
    """Population stability index of every current name that has a reference.

    Current values outside the reference range are not counted. One pass over the
    current values, combined on the map side.
    """
    ref = sized(reference_arrays(reference))
    binned = with_bins(_values(current), ref.select("name", "lo", "hi"), bins)
    now = binned.groupBy("name").agg(bin_counts(bins).alias("now"))
    width = (F.col("hi") - F.col("lo")) / bins
    return now.join(ref, "name").select("name", psi_of_counts(F.col("ref"), F.col("now"), width).alias("psi"))


def drift_level(value: Column, threshold: float = DEFAULTS.drift_threshold) -> Column:
    return F.when(value < 0.1, "none").when(value < threshold, "moderate").otherwise("significant")


def check_drift(current: DataFrame, reference: DataFrame, threshold: float = DEFAULTS.drift_threshold,
                retrain_on_drift: bool = DEFAULTS.retrain_on_drift, bins: int = 10) -> DataFrame:
    """Drift of every name with a reference: index, level and whether to retrain."""
    level = drift_level(F.col("psi"), threshold)
    return psi(current, reference, bins).select(
        F.col("name").alias("feature"),
        F.round("psi", 6).alias("psi"),
        level.alias("level"),
        F.lit(threshold).alias("threshold"),
        ((level == "significant") & F.lit(retrain_on_drift)).alias("retrain"),
    )


def psi_or_zero(current: DataFrame, reference: DataFrame, bins: int = 10) -> DataFrame:
    """Every current name; one without a reference has index 0."""
    names = current.select("name").distinct()
    return names.join(psi(current, reference, bins), "name", "left").select(
        "name", F.coalesce("psi", F.lit(0.0)).alias("psi")
    )


def check_buffer(features: DataFrame, reference: DataFrame, min_rows: int = 10, **kw) -> DataFrame:
    """Drift of the buffered features ``(server_id, step, name, value)``; fewer than ``min_rows`` rows give nothing."""
    enough = features.groupBy("name").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_rows)
    return check_drift(features.join(sized(enough.select("name")), "name", "left_semi"), reference, **kw)


# ---- from drift to retraining -----------------------------------------------------

#: Windows in a row that raise a retrain event, and calm ones in a row that arm it again.
RAISE, CALM = 3, 2


def retrain_step(state: tuple[int, int, bool], level: str, raise_after: int = RAISE, calm_after: int = CALM) -> tuple[tuple[int, int, bool], bool]:
    """One window of a name: the state behind it, and whether it raises a retrain event.

    The state counts significant and calm windows in a row and holds whether an event may be
    raised. After an event none follows, whatever drifts, until ``calm_after`` windows in a
    row had no drift; a moderate window breaks both runs.
    """
    hot, calm, armed = state
    hot, calm = (hot + 1, 0) if level == "significant" else (0, calm + 1 if level == "none" else 0)
    armed = armed or calm >= calm_after
    if armed and hot >= raise_after:
        return (hot, calm, False), True
    return (hot, calm, armed), False


START = (0, 0, True)
EVENT = "feature string, window_start timestamp, psi double"


def retrain_events(windows: DataFrame, raise_after: int = RAISE, calm_after: int = CALM) -> DataFrame:
    """The windows (feature, window_start, psi, level) at which a model of the feature is to be trained anew."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = START, []
        for row in pdf.sort_values("window_start").itertuples():
            state, event = retrain_step(state, row.level, raise_after, calm_after)
            if event:
                out.append((row.feature, row.window_start, row.psi))
        return pd.DataFrame(out, columns=["feature", "window_start", "psi"])

    # windows are summaries already: a feature has one row for each
    return windows.select("feature", "window_start", "psi", "level").groupBy("feature").applyInPandas(run, EVENT)
