"""Table schemas shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import types as T

METRIC_TYPES = ("gauge", "counter", "histogram")

METRIC_SCHEMA = T.StructType([
    T.StructField("server_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metric_type", T.StringType()),
])

HORIZON_TYPE = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("values", T.ArrayType(T.DoubleType())),
    T.StructField("steps", T.IntegerType()),
])

ALERT_SCHEMA = T.StructType([
    T.StructField("alert_id", T.StringType()),
    T.StructField("server_id", T.StringType()),
    T.StructField("metric_name", T.StringType()),
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("severity", T.StringType()),
    T.StructField("is_predicted", T.BooleanType()),
    T.StructField("prediction_horizon", HORIZON_TYPE),
    T.StructField("message", T.StringType()),
    T.StructField("suggested_action", T.StringType()),
    T.StructField("model_details", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("dashboard_url", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("correlation_id", T.StringType()),
    T.StructField("acknowledged", T.BooleanType()),
    T.StructField("acknowledged_by", T.StringType()),
])

#: A registration; several of one name and version are allowed, the newest counts.
MODEL_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("algorithm", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("created_at", T.TimestampType()),
])

# Columns of the wide sample CSV, in file order.
WIDE_METRICS = (
    "cpu_usage", "memory_usage", "disk_io_util", "network_in",
    "network_out", "load_avg_5m", "iowait", "error_rate",
)

WIDE_CSV_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.TimestampType()), T.StructField("server_id", T.StringType())]
    + [T.StructField(m, T.DoubleType()) for m in WIDE_METRICS]
)
