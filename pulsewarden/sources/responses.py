"""Points from saved monitoring responses (one JSON document per row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_RESULT = "array<struct<metric:map<string,string>,value:array<string>,values:array<array<string>>>>"
_RESPONSE = f"struct<status:string,data:struct<resultType:string,result:{_RESULT}>>"


def _series(responses: DataFrame) -> DataFrame:
    body = F.from_json("body", _RESPONSE)
    return (
        responses.withColumn("_r", body)
        .filter(F.col("_r.status") == "success")
        .withColumn("_s", F.explode("_r.data.result"))
        .withColumn("labels", F.coalesce(F.col("_s.metric"), F.create_map().cast("map<string,string>")))
        .drop("body", "_r")
    )


def _label(name: str) -> Column:
    return F.col("labels")[name]


def flatten_instant_vector(responses: DataFrame) -> DataFrame:
    """``(name, scraped_at, body)`` → points stamped with the scrape time.

    The server is the ``instance`` label, else ``job``, else ``unknown``; a
    missing value counts as 0, an unreadable one drops the sample.
    """
    df = _series(responses)
    text = F.when(F.col("_s.value").isNull(), F.lit("0")).otherwise(F.get("_s.value", F.lit(1)))
    return df.select(
        *[c for c in df.columns if c not in ("_s", "labels", "scraped_at")],
        F.coalesce(_label("instance"), _label("job"), F.lit("unknown")).alias("server_id"),
        F.col("scraped_at").alias("timestamp"),
        text.try_cast("double").alias("value"),
        "labels",
        F.lit("gauge").alias("metric_type"),
    ).filter(F.col("value").isNotNull())


def flatten_range_matrix(responses: DataFrame) -> DataFrame:
    """Backfill responses ``(name, body)`` → one point per ``[epoch, value]`` pair."""
    df = _series(responses).withColumn("_pair", F.explode("_s.values"))
    seconds = F.get("_pair", F.lit(0)).try_cast("double")
    return df.select(
        *[c for c in df.columns if c not in ("_s", "_pair", "labels", "scraped_at")],
        F.coalesce(_label("instance"), F.lit("unknown")).alias("server_id"),
        F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint")).alias("timestamp"),
        F.get("_pair", F.lit(1)).try_cast("double").alias("value"),
        "labels",
        F.lit("gauge").alias("metric_type"),
    ).filter(F.col("value").isNotNull())
