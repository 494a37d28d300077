"""Prometheus text format."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsewarden.functions.scalars import fixed


def exposition_lines(latest: DataFrame) -> DataFrame:
    """``(server_id, name, value)`` → text lines with their place ``(name, line_no, server_id)``."""
    heads = latest.select("name").distinct().select(
        "name",
        F.inline(F.array(
            F.struct(F.lit(0).alias("line_no"), F.concat(
                F.lit("# HELP "), F.col("name"), F.lit(" Simulated "), F.col("name"), F.lit(" metric")).alias("line")),
            F.struct(F.lit(1).alias("line_no"), F.concat(
                F.lit("# TYPE "), F.col("name"), F.lit(" gauge")).alias("line")),
        )),
    ).withColumn("server_id", F.lit(""))
    rows = latest.select(
        "name", F.lit(2).alias("line_no"),
        F.concat(F.col("name"), F.lit('{instance="'), F.col("server_id"), F.lit(':9100"} '),
                 fixed(F.col("value"), 2)).alias("line"),
        "server_id",
    )
    return heads.unionByName(rows)


def write_exposition(latest: DataFrame, path: str) -> None:
    """Write the lines in format order; files are sorted ranges of metrics."""
    order = ["name", "line_no", "server_id"]
    lines = exposition_lines(latest).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("line").write.mode("overwrite").text(path)
