"""Route metrics per group and their daily, city and overall summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldroute.functions.geo import travel_minutes
from fieldroute.functions.routes import nearest_neighbour, stops

ORDINALS = ("l_orderkey", "l_linenumber")


def route_groups(visits: DataFrame, keys: list[str], ordinals: tuple[str, ...] = ORDINALS) -> DataFrame:
    """One nearest-neighbour route per group: job_count, unique_stop_count, distance_km, duration_min."""
    grouped = visits.groupBy(*keys).agg(F.count(F.lit(1)).alias("job_count"), stops([F.col(c) for c in ordinals], F.col("longitude"), F.col("latitude")).alias("stops"))
    return routed(grouped, keys)


def routed(groups: DataFrame, keys: list[str]) -> DataFrame:
    """``route_groups`` of groups with their job_count and stops."""
    routed = groups.withColumn("route", nearest_neighbour(F.col("stops")))
    return routed.select(*keys, "job_count", F.size("stops").cast("long").alias("unique_stop_count"), F.round("route.km", 3).alias("distance_km"), F.round(travel_minutes(F.col("route.km")), 2).alias("duration_min"))


def daily_summary(routes: DataFrame, city: str = "city", day: str = "service_month", unit: str = "engineer_code", rounded: bool = True) -> DataFrame:
    """Sums, spread and means a unit for each city and day; ``rounded`` is for a final result, not for further means."""
    two = lambda c: (F.round(c, 2) if rounded else F.col(c)).alias(c)
    out = routes.groupBy(city, day).agg(F.countDistinct(unit).alias("deployed"), F.sum("job_count").alias("jobs"), F.sum("distance_km").alias("distance_km"), F.sum("duration_min").alias("duration_min"), F.stddev_pop("job_count").alias("jobs_std"), F.min("job_count").alias("jobs_min"), F.max("job_count").alias("jobs_max"))
    per = lambda c: F.round(F.col(c) / F.col("deployed"), 2)
    return out.select(city, day, "deployed", "jobs", two("distance_km"), two("duration_min"), two("jobs_std"), "jobs_min", "jobs_max", per("jobs").alias("jobs_avg"), per("distance_km").alias("distance_per_unit"), per("duration_min").alias("duration_per_unit"))


def city_summary(daily: DataFrame, city: str = "city") -> DataFrame:
    measures = [c for c in daily.columns if c not in (city, "service_month", "service_date")]
    return daily.groupBy(city).agg(F.count(F.lit(1)).alias("days"), *[F.round(F.avg(c), 2).alias(c) for c in measures])


def compare_scenarios(current: DataFrame, integrated: DataFrame, measures: list[str], city: str = "city") -> DataFrame:
    """Full outer by city with deltas, and an ALL row of means; percentages are null for a base of 0."""
    tag = lambda df, s: df.select(city, *[F.col(m).cast("double").alias(f"{m}_{s}") for m in measures])
    both = tag(current, "current").join(tag(integrated, "integrated"), city, "full_outer")
    total = both.agg(*[F.round(F.avg(c), 2).alias(c) for c in both.columns if c != city]).select(F.lit("ALL").alias(city), *[c for c in both.columns if c != city])
    out = both.unionByName(total)
    for m in measures:
        now, then = F.col(f"{m}_integrated"), F.col(f"{m}_current")
        out = out.withColumn(f"{m}_delta", F.round(now - then, 2)).withColumn(f"{m}_delta_pct", F.round((now - then) / F.nullif(then, F.lit(0.0)) * 100, 2))
    return out
