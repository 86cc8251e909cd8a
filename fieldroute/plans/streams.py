"""Queries over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldroute.streaming.requests import run_to_end, stream_table, windowed_counts


def ss_windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    done = run_to_end(windowed_counts(stream_table(spark, sf, "events")))
    return done.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {"ss_windowed_counts": ss_windowed_counts}
SQL = {"ss_windowed_counts": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"}
