"""Metric points from JSON messages, batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsewarden.schema import METRIC_TYPES
from pulsewarden.sources import log

# Spark also reads a bare year or a time of day; a message must give a full date.
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"


def parse_metric_messages(df: DataFrame, value_col: str = "value",
                          ingest_ts: Column | None = None) -> DataFrame:
    """Parse every message and say why a bad one was rejected.

    Adds the point's columns and ``reason`` (null for a good point). A time given
    as text is read as ISO, as a number as epoch seconds; without one the arrival
    time ``ingest_ts`` (default: now) is taken. Columns of ``df`` other than the
    message itself are kept.
    """
    arrival = ingest_ts if ingest_ts is not None else F.current_timestamp()
    keep = [c for c in df.columns if c != value_col]
    v = F.col("_v")
    df = df.withColumn("_raw", F.col(value_col).cast("string"))
    # as a generated column the document is parsed once: filters on what was read
    # from it are not pushed below the parser and repeated there
    df = df.withColumn("_v", F.explode(F.array(F.try_parse_json("_raw"))))

    kind = F.schema_of_variant(F.try_variant_get(v, "$.timestamp", "variant"))
    text = F.try_variant_get(v, "$.timestamp", "string")
    text_ts = F.when(text.rlike(_ISO), F.try_to_timestamp(text))
    seconds = F.try_variant_get(v, "$.timestamp", "double")
    number_ts = F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint"))
    is_number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    given = F.when(kind == "STRING", text_ts).when(is_number, number_ts).otherwise(arrival)

    raw_value = F.try_variant_get(v, "$.value", "string")
    value = raw_value.try_cast("double")
    metric_type = F.coalesce(F.try_variant_get(v, "$.type", "string"), F.lit("gauge"))
    name = F.try_variant_get(v, "$.name", "string")
    labels = F.coalesce(F.try_variant_get(v, "$.labels", "map<string,string>"), F.create_map().cast("map<string,string>"))

    reason = (
        F.when(v.isNull() | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "not_json")
        .when(given.isNull(), "bad_timestamp")
        .when(name.isNull(), "missing_name")
        .when(raw_value.isNull(), "missing_value")
        .when(value.isNull(), "bad_value")
        .when(~metric_type.isin(*METRIC_TYPES), "bad_type")
    )
    return df.select(
        *keep,
        F.coalesce(F.try_variant_get(v, "$.server_id", "string"), F.lit("unknown")).alias("server_id"),
        name.alias("name"),
        given.alias("timestamp"),
        value.alias("value"),
        labels.alias("labels"),
        metric_type.alias("metric_type"),
        F.col("_raw").alias("raw"),
        reason.alias("reason"),
    )


def split_bad_records(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good points, and rejected messages with their reason."""
    point = ("server_id", "name", "timestamp", "value", "labels", "metric_type")
    extra = [c for c in parsed.columns if c not in (*point, "raw", "reason")]
    good = parsed.filter(F.col("reason").isNull()).drop("raw", "reason")
    bad = parsed.filter(F.col("reason").isNotNull()).select(*extra, "raw", "reason")
    return good, bad


def read_kafka(spark: SparkSession, servers: str, topic: str = "infrastructure-metrics",
               max_per_trigger: int | None = None, starting: str = "latest", **options: str) -> DataFrame:
    """Message stream of a Kafka topic; needs Spark's Kafka package on the classpath."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
    )
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load().select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("arrived"))


def read_message_log(spark: SparkSession, path: str, starting: str = "earliest", max_per_trigger: int | None = None) -> DataFrame:
    """The same from a segmented message log (``sources.log``), with offsets like those of a topic."""
    log.register(spark)
    reader = spark.readStream.format("message_log").option("startingOffsets", starting)
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load(path).select("value", "arrived")


def read_message_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same from a folder of text files, one message per line. Without a limit a trigger takes all."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).withColumn("arrived", F.current_timestamp())


def read_metric_stream(messages: DataFrame) -> DataFrame:
    """Points of a message stream; the stream's checkpoint replaces offset commits."""
    good, _ = split_bad_records(parse_metric_messages(messages, "value", F.col("arrived")))
    return good
