"""Stored tables: alerts, models, training reports, downsampled points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsewarden.config import DEFAULTS
from pulsewarden.schema import MODEL_SCHEMA
from pulsewarden.session import materialize


# ---- models ------------------------------------------------------------------

def save_model(table: DataFrame, base: str, name: str, version: str = "1.0.0") -> str:
    """Write a model table under ``name`` and ``version``; a rerun replaces it."""
    path = f"{base}/{name}/version={version}"
    table.write.mode("overwrite").parquet(path)
    return path


def resolve_version(models: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(name, version)`` wanted → the version found: that one, else the last by name order."""
    available = models.groupBy("name").agg(F.max("version").alias("_last"))
    exact = models.select("name", F.col("version").alias("_v")).distinct()
    exact = exact.select("name", F.col("_v").alias("version"), F.col("_v").alias("_exact"))
    return (
        wanted.join(exact, ["name", "version"], "left")
        .join(available, "name", "left")
        .select("name", "version", F.coalesce("_exact", "_last").alias("resolved"))
    )


def _versions(spark: SparkSession, base: str, name: str) -> list[str]:
    """Stored versions, from the folder names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(f"{base}/{name}")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [st.getPath().getName() for st in fs.listStatus(root)]
    return sorted(f.split("=", 1)[1] for f in found if f.startswith("version="))


def _registry(base: str) -> str:
    return f"{base}/_registry"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def store_model(table: DataFrame, base: str, name: str, version: str = "1.0.0", algorithm: str = "unknown",
                metrics: dict[str, float] | None = None, replace: bool = True) -> str:
    """``save_model``, and the registration that makes this version the active one."""
    spark = table.sparkSession
    path = save_model(table, base, name, version)
    values = {k: float(v) for k, v in (metrics or {}).items() if v is not None}
    row = spark.createDataFrame([(name, version, algorithm, path, values)], "name string, version string, algorithm string, path string, metrics map<string,double>")
    register_models(row.withColumn("created_at", F.current_timestamp()), _registry(base), replace)
    return path


def active_version(spark: SparkSession, base: str, name: str) -> str | None:
    """The version that the registry of ``base`` marks active."""
    if not _exists(spark, _registry(base)):
        return None
    found = list_models(spark, _registry(base), name).filter("is_active").select("version").first()
    return found["version"] if found else None


def activate_model(spark: SparkSession, base: str, name: str, version: str) -> None:
    """Make an earlier version the active one: it is registered anew, as it was."""
    rows = list_models(spark, _registry(base), name).filter(F.col("version") == version).drop("is_active").collect()
    if not rows:
        raise LookupError(f"no model {name} in version {version}")
    again = spark.createDataFrame(rows, MODEL_SCHEMA).withColumn("created_at", F.current_timestamp())
    register_models(again, _registry(base), replace=True)


def load_model(spark: SparkSession, base: str, name: str, version: str | None = None) -> DataFrame:
    """The table of ``version``; without one, of the active version; if it isn't stored, of the last by name order."""
    versions = _versions(spark, base, name)
    if not versions:
        raise LookupError(f"no stored model named {name}")
    wanted = version or active_version(spark, base, name)
    pick = wanted if wanted in versions else versions[-1]
    return spark.read.parquet(f"{base}/{name}/version={pick}")


def register_models(registrations: DataFrame, path: str, replace: bool = False) -> None:
    """Append registrations (``MODEL_SCHEMA``) to the table of models.

    A name and version can be registered once; ``replace`` lets a newer registration take the
    place of an older one.
    """
    names = MODEL_SCHEMA.fieldNames()
    rows = registrations.select(*names)
    if not replace:
        spark, key = rows.sparkSession, ["name", "version"]
        rows = materialize(rows)
        taken = rows.groupBy(*key).count().filter("count > 1").select(*key)
        if _exists(spark, path):
            taken = taken.unionByName(rows.select(*key).join(spark.read.schema(MODEL_SCHEMA).parquet(path).select(*key), key, "left_semi"))
        first = taken.first()
        if first:
            raise ValueError(f"model {first['name']} is registered in version {first['version']} already")
    rows.write.mode("append").parquet(path)


def model_info(models: DataFrame) -> DataFrame:
    """One row per name and version, its newest registration; ``is_active`` marks the version registered last."""
    rest = [c for c in MODEL_SCHEMA.fieldNames() if c not in ("name", "version")]
    newest = models.groupBy("name", "version").agg(F.max_by(F.struct(*rest), F.struct("created_at", "path")).alias("r"))
    active = models.groupBy("name").agg(F.max_by("version", F.struct("created_at", "version")).alias("_active"))
    return newest.join(active, "name").select("name", "version", "r.*", (F.col("version") == F.col("_active")).alias("is_active"))


def list_models(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """``model_info`` of a stored table; the filter on a name reaches the scan."""
    models = spark.read.schema(MODEL_SCHEMA).parquet(path)
    return model_info(models.filter(F.col("name") == name) if name else models)


# ---- alerts ------------------------------------------------------------------

def alert_rows(alerts: DataFrame) -> DataFrame:
    """Alert rows as stored: with a date, one row per id."""
    dated = alerts.withColumn("alert_date", F.to_date("timestamp"))
    return dated.dropDuplicates(["alert_id"])


def append_alerts(alerts: DataFrame, path: str) -> DataFrame:
    """Append the alerts that are not stored yet, so a repeated batch adds nothing; returns those.

    Only the stored dates the batch touches are read.
    """
    spark = alerts.sparkSession
    rows = materialize(alert_rows(alerts))
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(fs_path):
        days = rows.agg(F.min("alert_date"), F.max("alert_date")).first()
        if days[0] is None:
            return rows
        stored = spark.read.parquet(path).filter(F.col("alert_date").between(*days))
        # written before the store grows: what is new must not be asked again
        rows = materialize(rows.join(stored.select("alert_id", "alert_date"), ["alert_id", "alert_date"], "left_anti"))
    rows.write.mode("append").partitionBy("alert_date").parquet(path)
    return rows


# ---- reports -----------------------------------------------------------------

def report_rows(**metrics: DataFrame) -> DataFrame:
    """``model=one-row metrics`` → long ``(model, metric, value)``."""
    out = None
    for model, df in metrics.items():
        pairs = F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns
        ])
        rows = df.select(F.lit(model).alias("model"), F.inline(pairs))
        out = rows if out is None else out.unionByName(rows)
    return out


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


# ---- retention ---------------------------------------------------------------

def retain(points: DataFrame, now, days: int = DEFAULTS.retention_days) -> DataFrame:
    """Points of the last ``days`` before ``now`` (a literal, so the filter reaches the scan)."""
    return points.filter(F.col("timestamp") >= F.lit(now) - F.expr(f"INTERVAL {days} DAYS"))


def downsample(points: DataFrame, step: str = DEFAULTS.downsample) -> DataFrame:
    # grouped by the window itself, which carries a stream's watermark
    per = points.groupBy("server_id", "name", F.window("timestamp", step).alias("_w")).agg(
        F.avg("value").alias("avg_value"), F.min("value").alias("min_value"),
        F.max("value").alias("max_value"), F.count("value").alias("n_points"),
    )
    return per.withColumn("step", F.col("_w.start")).select(
        "server_id", "name", "step", "avg_value", "min_value", "max_value", "n_points"
    )


#: Steps of stored summaries, the finest first; each is summed up from the one before.
LEVELS = ("5 minutes", "1 hour")
_SUMS = {"value_sum": F.sum, "n_points": F.sum, "min_value": F.min, "max_value": F.max}


def partial_sums(points: DataFrame, step: str) -> DataFrame:
    """What two parts of a step's points can be put together from, per series, step and day."""
    per = points.groupBy("server_id", "name", F.window("timestamp", step).start.alias("step")).agg(
        F.sum("value").alias("value_sum"), F.count("value").alias("n_points"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    return per.withColumn("day", F.to_date("step"))


def merge_sums(parts: DataFrame, step: str | None = None) -> DataFrame:
    """Partial sums of the same steps, or (with ``step``) of finer ones, as one."""
    if step:
        parts = parts.withColumn("step", F.window("step", step).start).withColumn("day", F.to_date("step"))
    return parts.groupBy("server_id", "name", "step", "day").agg(*[how(c).alias(c) for c, how in _SUMS.items()])


def _level(path: str, step: str) -> str:
    return f"{path}/step={step.replace(' ', '_')}"


def add_points(points: DataFrame, path: str, levels: Sequence[str] = LEVELS) -> list[str]:
    """Take new points, late ones too, into the stored summaries; the days that were rewritten.

    Points are summed up on their own and merged with the stored sums of the days that they
    touch. Only those days are read and written again, on every level. Steps must divide a day
    and each other. A batch must come once: stage it (``sinks.outbox``) where it may be repeated.
    """
    spark = points.sparkSession
    new = materialize(partial_sums(points, levels[0]))
    days = [r["day"] for r in new.select("day").distinct().collect()]
    if not days:
        return []
    fresh = new
    for i, step in enumerate(levels):
        place = _level(path, step)
        if i:
            fresh = merge_sums(fresh, step)
        elif _exists(spark, place):
            stored = spark.read.parquet(place).filter(F.col("day").isin(days)).select(*new.columns)
            fresh = merge_sums(new.unionByName(stored))
        # read before the same days are written
        fresh = materialize(fresh.select(*new.columns))
        fresh.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(place)
    return sorted(map(str, days))


def read_summaries(spark: SparkSession, path: str, step: str = LEVELS[-1]) -> DataFrame:
    """The rows of ``downsample`` from the stored sums."""
    rows = spark.read.parquet(_level(path, step))
    return rows.select("server_id", "name", "step", F.try_divide("value_sum", "n_points").alias("avg_value"), "min_value", "max_value", "n_points")
