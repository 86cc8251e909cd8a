"""Request and attempt streams: windowed counts with late data, and the latest request of each user."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldroute.session import shared_dir, table


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir.rstrip('/')}/{name}.parquet*")


def windowed_counts(events: DataFrame, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Events of each window and type; rows later than the watermark are dropped by the engine."""
    w = F.window("ts", window)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is and return the sink's table."""
    spark, name = stream.sparkSession, f"s{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{shared_dir(spark)}/fieldroute/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
