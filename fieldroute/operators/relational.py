"""Keyed relational operators that recur in the domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldroute.functions.geo import haversine_km


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in a stated order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``existing`` whose key is not in ``new``, and all of ``new``."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def union_by_priority(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of the frames; of rows with one key the earliest frame's stays."""
    tagged = [f.withColumn("_priority", F.lit(i)) for i, f in enumerate(frames)]
    both = tagged[0]
    for f in tagged[1:]:
        both = both.unionByName(f, allowMissingColumns=True)
    return keep_first(both, keys, [F.col("_priority"), *[F.col(c).asc_nulls_last() for c in frames[0].columns if c not in keys]]).drop("_priority")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row whose key occurs more than once."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_n > 1").drop("_n")


def most_frequent(df: DataFrame, key: str, value: str) -> DataFrame:
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return keep_first(counts, [key], [F.col("n").desc(), F.col(value)])


def lookup_with_override(rows: DataFrame, override: DataFrame, cache: DataFrame, override_key: str, cache_key: str) -> DataFrame:
    """Coordinates of the override where both are present, else of the cache; source is 'failed' without either."""
    o = override.select(override_key, F.col("latitude").alias("o_lat"), F.col("longitude").alias("o_lon"))
    c = cache.select(cache_key, F.col("latitude").alias("c_lat"), F.col("longitude").alias("c_lon"))
    own = F.col("o_lat").isNotNull() & F.col("o_lon").isNotNull()
    out = rows.join(o, override_key, "left").join(c, cache_key, "left")
    out = out.withColumn("latitude", F.when(own, F.col("o_lat")).otherwise(F.col("c_lat"))).withColumn("longitude", F.when(own, F.col("o_lon")).otherwise(F.col("c_lon")))
    missing = F.col("latitude").isNull() | F.col("longitude").isNull()
    return out.withColumn("source", F.when(missing, "failed").when(own, "override").otherwise("cache")).drop("o_lat", "o_lon", "c_lat", "c_lon")


def nearest_centre(points: DataFrame, centres: DataFrame, keys: list[str], match: str | None = None) -> DataFrame:
    """Nearest centre of each point by haversine, the smaller region number on ties.

    ``match`` names a shared column that limits the centres looked at (a city); points
    are reduced to distinct keys first. Centres come from a short region master.
    """
    c = centres.select("region_seq", F.col("latitude").alias("c_lat"), F.col("longitude").alias("c_lon"), *([match] if match else []))
    km = haversine_km(F.col("latitude"), F.col("longitude"), F.col("c_lat"), F.col("c_lon"))
    pairs = points.join(c, match) if match else points.join(c)
    best = pairs.groupBy(*keys, *([match] if match and match not in keys else [])).agg(F.min(F.struct(km.alias("km"), "region_seq")).alias("b"))
    return best.select(*keys, *([match] if match and match not in keys else []), F.col("b.region_seq").alias("region_seq"), F.col("b.km").alias("km"))


def overlap_ratio(visits: DataFrame, regions: DataFrame) -> DataFrame:
    """Distinct postal codes per engineer and region, and their share of the engineer's total."""
    per = visits.join(regions, "postal_code").groupBy("engineer_code", "region_seq").agg(F.countDistinct("postal_code").alias("overlap"))
    total = visits.groupBy("engineer_code").agg(F.countDistinct("postal_code").alias("total"))
    return per.join(total, "engineer_code").withColumn("ratio", F.col("overlap") / F.greatest(F.col("total"), F.lit(1)))


def engineer_day(roster: DataFrame, assigned: DataFrame, day: str) -> DataFrame:
    """Jobs, service minutes and overflow for every roster engineer and day, engineers without work included."""
    days = assigned.select(day).distinct()
    work = assigned.groupBy("engineer_code", day).agg(F.countDistinct("receipt_no").alias("job_count"), F.sum("service_min").alias("service_min"))
    out = roster.select("engineer_code", "center_type").join(F.broadcast(days)).join(work, ["engineer_code", day], "left").fillna(0, ["job_count", "service_min"])
    return out.withColumn("overflow_480", F.col("service_min") > 480)
