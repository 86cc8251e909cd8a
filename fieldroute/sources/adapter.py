"""Domain frames derived from the TPC-H-like tables: visits, engineers and region centres."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldroute.session import spread, table, wide_tasks

NORMAL_MINUTES, HEAVY_MINUTES = 45, 100


def coordinates(key):
    """Latitude and longitude columns from a positive key."""
    lat = F.lit(33.0) + ((key * 37) % 1000).cast("double") / 1000
    lon = F.lit(-84.0) - ((key * 91) % 1000).cast("double") / 1000
    return lat.alias("latitude"), lon.alias("longitude")


def center_type(key):
    return F.when(key % 5 == 0, "DMS2").otherwise("DMS")


def visits(spark: SparkSession, sf_dir: str, by_order: bool = False) -> DataFrame:
    """One row per service line; receipts repeat over lines. ``by_order``: orders are joined last, so that what follows by l_orderkey needs no shuffle of its own."""
    heavy = F.col("p_size") > 40
    # A join's tasks follow the number of lines: at a fixed width a task would sort ever more of them.
    tasks = wide_tasks(spark, sf_dir)
    side = lambda name, key: spread(table(spark, sf_dir, name), tasks, key)
    with_orders = lambda rows: rows.join(side("orders", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = table(spark, sf_dir, "lineitem")
    rows = rows if by_order else with_orders(rows)
    rows = rows.join(side("supplier", "s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.join(side("part", "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    rows = with_orders(rows) if by_order else rows
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_orderkey").cast("string").alias("receipt_no"),
        F.col("n_name").alias("city"),
        F.to_date("l_shipdate").alias("service_date"),
        F.trunc(F.to_date("l_shipdate"), "month").alias("service_month"),
        F.col("l_suppkey").cast("string").alias("engineer_code"),
        center_type(F.col("l_suppkey")).alias("center_type"),
        F.lpad((F.col("o_custkey") % 997).cast("string"), 5, "0").alias("postal_code"),
        F.col("p_brand").alias("product_group"),
        F.col("p_type").alias("product"),
        F.col("l_returnflag").alias("symptom"),
        heavy.alias("is_heavy"),
        F.when(heavy, HEAVY_MINUTES).otherwise(NORMAL_MINUTES).alias("service_min"),
        *coordinates(F.col("o_custkey")),
    )


def engineers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    lat, lon = coordinates(key)
    return rows.select(key.cast("string").alias("engineer_code"), F.col("s_name").alias("engineer_name"), F.col("n_name").alias("city"), center_type(key).alias("center_type"), F.nullif((key % 10).cast("int"), F.lit(0)).alias("slot"), (key % 3 + 1).cast("int").alias("region_seq"), F.when(key % 4 == 0, "Y").otherwise("N").alias("ref_heavy"), lat.alias("home_lat"), lon.alias("home_lon"))


#: The same frames as DuckDB common table expressions.
VISITS_SQL = """visits AS (
SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS VARCHAR) AS receipt_no, n_name AS city, CAST(l_shipdate AS DATE) AS service_date,
 CAST(date_trunc('month', l_shipdate) AS DATE) AS service_month, CAST(l_suppkey AS VARCHAR) AS engineer_code,
 CASE WHEN l_suppkey % 5 = 0 THEN 'DMS2' ELSE 'DMS' END AS center_type, lpad(CAST(o_custkey % 997 AS VARCHAR), 5, '0') AS postal_code,
 p_brand AS product_group, p_type AS product, l_returnflag AS symptom, p_size > 40 AS is_heavy, CASE WHEN p_size > 40 THEN 100 ELSE 45 END AS service_min,
 CAST(33.0 AS DOUBLE) + CAST((o_custkey * 37) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS latitude, CAST(-84.0 AS DOUBLE) - CAST((o_custkey * 91) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS longitude
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""

ENGINEERS_SQL = """engineers AS (
SELECT CAST(s_suppkey AS VARCHAR) AS engineer_code, s_name AS engineer_name, n_name AS city, CASE WHEN s_suppkey % 5 = 0 THEN 'DMS2' ELSE 'DMS' END AS center_type,
 CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE CAST(s_suppkey % 10 AS INTEGER) END AS slot, CAST(s_suppkey % 3 + 1 AS INTEGER) AS region_seq, CASE WHEN s_suppkey % 4 = 0 THEN 'Y' ELSE 'N' END AS ref_heavy,
 CAST(33.0 AS DOUBLE) + CAST((s_suppkey * 37) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS home_lat, CAST(-84.0 AS DOUBLE) - CAST((s_suppkey * 91) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS home_lon
FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
