"""Train from the command line: ``python -m pulsewarden.train --source csv --path DIR --model-dir DIR``."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from pulsewarden.operators.training import train_all
from pulsewarden.schema import WIDE_CSV_SCHEMA, WIDE_METRICS
from pulsewarden.session import get_spark
from pulsewarden.sinks.stores import write_report
from pulsewarden.sources.responses import flatten_range_matrix
from pulsewarden.sources.tables import long_to_wide


def load(spark, source: str, path: str):
    """Wide training table of one source."""
    if source == "csv":
        wide = spark.read.csv(path, schema=WIDE_CSV_SCHEMA, header=True)
    else:  # saved range responses: one JSON row with name and body per metric
        responses = spark.read.schema("name string, body string").json(path)
        wide = long_to_wide(flatten_range_matrix(responses))
    return wide.withColumn("id", F.xxhash64("server_id", "timestamp"))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Train all detectors")
    parser.add_argument("--source", choices=["responses", "csv"], default="csv")
    parser.add_argument("--path", required=True)
    parser.add_argument("--model-dir", required=True)
    parser.add_argument("--version", default="1.0.0")
    parser.add_argument("--output")
    args = parser.parse_args(argv)
    spark = get_spark("train")
    report = train_all(load(spark, args.source, args.path), WIDE_METRICS, args.model_dir, args.version)
    if args.output:
        write_report(report, args.output)
    report.show(100, truncate=False)


if __name__ == "__main__":
    main()
