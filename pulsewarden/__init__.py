"""Metric analytics and anomaly detection as Spark jobs."""
