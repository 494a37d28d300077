"""Wide CSV tables and the bridge between wide and long layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pulsewarden.schema import WIDE_CSV_SCHEMA, WIDE_METRICS


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def impute_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN or null in a numeric column becomes the column's mean, or 0 without one.

    All means come from one aggregate, read back as a one-row scalar subquery.
    """
    columns = list(columns or _numeric(df))
    present = {c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double")) for c in columns}
    means = df.select(F.struct(*[
        F.coalesce(F.avg(present[c]), F.lit(0.0)).alias(c) for c in columns
    ]).alias("means")).scalar()
    filled = {c: F.coalesce(present[c], means[c]) for c in columns}
    return df.withColumns(filled)


def load_metrics_csv(spark: SparkSession, path: str, schema: T.StructType = WIDE_CSV_SCHEMA) -> DataFrame:
    """Numeric training columns of a CSV file with gaps filled."""
    df = spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE")
    return impute_numeric(df)


def parse_csv_lines(lines: DataFrame, column: str, schema: T.StructType = WIDE_CSV_SCHEMA) -> DataFrame:
    """The same rows from a text column (files read as lines, or messages)."""
    row = F.from_csv(column, schema.simpleString()[len("struct<"):-1].replace(":", " "), {"mode": "PERMISSIVE"})
    keep = [c for c in lines.columns if c != column]
    return lines.select(*keep, row.alias("_r")).select(*keep, "_r.*")


def wide_to_long(df: DataFrame, ids: Sequence[str] = ("timestamp", "server_id"),
                 metrics: Sequence[str] = WIDE_METRICS) -> DataFrame:
    """One point per metric column; absent values give no point."""
    long = df.unpivot(list(ids), list(metrics), "name", "value")
    return long.filter(F.col("value").isNotNull())


def long_to_wide(points: DataFrame, metrics: Sequence[str] = WIDE_METRICS,
                 ids: Sequence[str] = ("timestamp", "server_id")) -> DataFrame:
    """One column per metric; the list is fixed so no extra pass finds it."""
    return points.groupBy(*ids).pivot("name", list(metrics)).agg(F.max("value"))
