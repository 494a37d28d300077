"""Queries over raw samples: counter rates, label sums, ratios, quantiles of histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pulsewarden.operators import ordering as o


def counter_rate(samples: DataFrame, span: str = "5 minutes", keys: Sequence[str] = o.KEYS,
                 order: Sequence[str] = o.ORDER, chunk_rows: int = 1 << 16) -> DataFrame:
    """Per-second increase of a counter in each stretch of ``span``.

    A drop is a reset and counts from zero. The rate is the increase divided by the
    time between the first and last sample; one sample alone gives no rate.
    """
    rows = samples.select(*keys, *order, "value").withColumn("_w", F.window(order[0], span).start)
    chunks = o.chunked(rows, 1, 0, keys, order, chunk_rows)
    w = o.chunk_window(keys)
    before, slot = F.lag("value").over(w), F.lag("_w").over(w)
    step = F.when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    inc = F.when(slot == F.col("_w"), step).otherwise(F.lit(0.0))
    steps = o.home(chunks.withColumn("_inc", inc))
    ts = F.unix_micros(order[0])
    seconds = (F.max(ts) - F.min(ts)) / 1e6
    return steps.groupBy(*keys, F.col("_w").alias("window_start")).agg(
        F.sum("_inc").alias("increase"),
        F.try_divide(F.sum("_inc"), seconds).alias("rate"),
        F.count("*").alias("n_samples"),
    )


def rate_by_label(samples: DataFrame, label: str, span: str = "5 minutes", how: str = "sum") -> DataFrame:
    """Rates of the series, summed or averaged over all series with the same label."""
    fn = {"sum": F.sum, "avg": F.avg}[how]
    rows = samples.withColumn("_l", F.coalesce(F.col("labels")[label], F.lit("")))
    rates = counter_rate(rows, span, keys=(*o.KEYS, "_l"))
    return rates.groupBy("window_start", F.col("_l").alias(label)).agg(fn("rate").alias(f"{how}_rate"))


def instants(samples: DataFrame, step: str = "5 minutes", value: str = "value") -> DataFrame:
    """The newest sample of each series in each step. A series is a server, a name and its labels."""
    series = F.to_json(F.array_sort(F.map_entries("labels")))
    last = samples.groupBy("server_id", "name", series.alias("_s"), F.window("timestamp", step).start.alias("step")).agg(
        F.max_by(value, F.struct("timestamp", "seq")).alias(value), F.first("labels").alias("labels"))
    return last.drop("_s")


def by_label(samples: DataFrame, label: str, how: str = "sum", value: str = "value", step: str = "5 minutes") -> DataFrame:
    """Sum (or another aggregate) over the series with the same label, at each step."""
    fn = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}[how]
    rows = instants(samples, step, value)
    return rows.groupBy("step", F.col("labels")[label].alias(label)).agg(fn(value).alias(f"{how}_{value}"))


def ratio(samples: DataFrame, part: Column, whole: Column, by: Sequence[str], value: str = "value",
          scale: float = 1.0, step: str = "5 minutes") -> DataFrame:
    """At each step, the sum over the ``part`` series divided by that over the ``whole`` ones, in one pass."""
    top = F.sum(F.when(part, F.col(value)).otherwise(0.0))
    base = F.sum(F.when(whole, F.col(value)).otherwise(0.0))
    return instants(samples, step, value).groupBy("step", *by).agg((F.try_divide(top, base) * scale).alias("ratio"))


def gauge(samples: DataFrame, name: str) -> DataFrame:
    return samples.filter(F.col("name") == name)


def histogram_quantile(buckets: DataFrame, q: float, by: Sequence[str], le: str = "le",
                       count: str = "count") -> DataFrame:
    """Quantile from cumulative buckets ``(le, count)``, linear inside the bucket.

    ``le`` is a double with +Inf for the last bucket. A quantile in the last bucket
    gives its lower border; an empty histogram gives NaN. A group has one row per
    bucket border.
    """
    totals = buckets.groupBy(*by, le).agg(F.sum(count).cast("double").alias("_c"))
    w = Window.partitionBy(*by).orderBy(le)
    rows = totals.withColumns({
        "_below": F.coalesce(F.lag("_c").over(w), F.lit(0.0)),
        "_from": F.lag(le).over(w),
        "_total": F.max("_c").over(Window.partitionBy(*by)),
    })
    rank = F.lit(q) * F.col("_total")
    border = F.coalesce("_from", F.when(F.col(le) > 0, 0.0).otherwise(F.col(le)))
    inside = border + (F.col(le) - border) * F.try_divide(rank - F.col("_below"), F.col("_c") - F.col("_below"))
    value = F.when(F.col(le) == float("inf"), F.coalesce("_from", F.lit(float("nan")))).otherwise(
        F.coalesce(inside, F.col(le)))
    hit = F.min_by(value, F.when(F.col("_c") >= rank, F.col(le)))
    return rows.groupBy(*by).agg(
        F.when(F.max("_total") > 0, hit).otherwise(float("nan")).alias("quantile")
    )


def align_steps(points: DataFrame, step: str = "300 seconds") -> DataFrame:
    """Last value of each series in each step, stamped with the step's start."""
    last = points.groupBy("server_id", "name", F.window("timestamp", step).alias("_w")).agg(
        F.max_by("value", F.struct("timestamp", "seq")).alias("value")
    )
    return last.select("server_id", "name", F.col("_w.start").alias("step"), "value")


# Raw series behind each default metric.
RATE_METRICS = {
    "disk_io_util": "node_disk_io_time_seconds_total",
    "network_in": "node_network_receive_bytes_total",
    "network_out": "node_network_transmit_bytes_total",
}
CPU_SECONDS = "node_cpu_seconds_total"
CPU_METRICS = {"cpu_usage": "idle", "iowait": "iowait"}
MEMORY_FREE, MEMORY_ALL = "node_memory_MemAvailable_bytes", "node_memory_MemTotal_bytes"
LOAD = "node_load5"
REQUESTS = "http_requests_total"


def default_metrics(samples: DataFrame, span: str = "5 minutes") -> DataFrame:
    """The eight default metrics per server and stretch of ``span`` from raw samples.

    Input: ``server_id, name, timestamp, value, labels, seq``. Series of one name differ
    in their labels. Counters are turned into rates in one pass; each metric is then one
    aggregate over rates or latest gauges.
    """
    mode, status = F.col("labels")["mode"], F.col("labels")["status"]
    series = F.to_json(F.array_sort(F.map_entries("labels")))
    raw = samples.select("server_id", "name", "timestamp", "value", "seq", series.alias("_s"), mode.alias("_mode"), status.alias("_status"))

    counters = raw.filter(F.col("name").isin(CPU_SECONDS, REQUESTS, *RATE_METRICS.values()))
    rates = counter_rate(counters, span, keys=("server_id", "name", "_s", "_mode", "_status"))

    def pick(metric: str, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("name"), value.alias("value"))

    def of(name: str, keep: Column | None = None) -> Column:
        hit = F.col("name") == name
        return F.when(hit if keep is None else hit & keep, F.col("rate"))

    idle, wait = (F.avg(of(CPU_SECONDS, F.col("_mode") == m)) for m in CPU_METRICS.values())
    failed = F.sum(of(REQUESTS, F.col("_status").rlike("^5..$")))
    from_rates = rates.groupBy("server_id", F.col("window_start").alias("timestamp")).agg(F.array(
        pick("cpu_usage", 100 - idle * 100), pick("iowait", wait * 100),
        pick("error_rate", F.try_divide(F.coalesce(failed, F.lit(0.0)), F.sum(of(REQUESTS))) * 100),
        *[pick(m, F.sum(of(n))) for m, n in RATE_METRICS.items()],
    ).alias("_m"))

    gauges = raw.filter(F.col("name").isin(MEMORY_FREE, MEMORY_ALL, LOAD))
    order = F.struct("timestamp", "seq")

    def last(name: str) -> Column:
        hit = F.col("name") == name
        return F.max_by(F.when(hit, F.col("value")), F.when(hit, order))

    from_gauges = gauges.groupBy("server_id", F.window("timestamp", span).start.alias("_w")).agg(F.array(
        pick("memory_usage", 100 * (1 - F.try_divide(last(MEMORY_FREE), last(MEMORY_ALL)))), pick("load_avg_5m", last(LOAD)),
    ).alias("_m")).withColumnRenamed("_w", "timestamp")
    both = from_rates.unionByName(from_gauges)
    return both.select("server_id", "timestamp", F.inline("_m")).filter(F.col("value").isNotNull())
