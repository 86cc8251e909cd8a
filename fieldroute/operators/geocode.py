"""A run of geocoding: addresses not yet known go to a geocoder within a daily quota, the cache grows, services get their places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldroute.operators.relational import keep_first, upsert
from fieldroute.session import cut

PLACE = ["latitude", "longitude"]


def remaining_quota(log: DataFrame, day: Column, limit: int) -> int:
    """How many addresses may still be asked for on a day, by a log of (run_date, n)."""
    used = log.where(F.col("run_date") == day).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return max(limit - int(used), 0)


def geocode_run(services: DataFrame, cache: DataFrame, geocoder: Callable[[DataFrame], DataFrame], quota: int) -> dict[str, DataFrame]:
    """Located services, the new cache and a report of one row.

    ``services`` have an address_key, null or blank where there is no address; ``cache`` and what ``geocoder`` returns
    for a frame of keys have address_key, latitude and longitude. The first ``quota`` unknown keys in their order are
    asked for, so a run that is repeated goes on where this one ended. Of several answers or cache rows to one key the first by
    place counts, nulls last; an answer without a place is kept, hence not asked for again. Services without a place
    have the source ``failed``, others ``cache`` or ``new``; every row stays.
    """
    known = keep_first(cache.select("address_key", *PLACE), ["address_key"], [F.col(c).asc_nulls_last() for c in PLACE])
    keys = services.where("trim(address_key) <> ''").select("address_key").distinct()
    state = cut(keys.join(known.withColumn("_known", F.lit(True)), "address_key", "left"), "geocode-state")
    # The quota bounds what is asked for, whatever is pending.
    batch = cut(state.where("_known is null").select("address_key").orderBy("address_key").limit(quota), "geocode-batch")
    answers = geocoder(batch).select("address_key", *PLACE).join(batch, "address_key", "left_semi")
    answers = cut(keep_first(answers, ["address_key"], [F.col(c).asc_nulls_last() for c in PLACE]), "geocode-answers")
    # Only keys of the services are looked at, so the cache is read once and the join meets what they need.
    seen = state.where("_known").select("address_key", *PLACE, F.lit("cache").alias("source")).unionByName(answers.withColumn("source", F.lit("new")))
    placed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    located = services.drop(*PLACE, "source").join(seen, "address_key", "left").withColumn("source", F.when(placed, F.col("source")).otherwise("failed"))
    sums = state.agg(F.count(F.lit(1)).alias("unique_addresses"), F.count("_known").alias("already_cached"))
    asked = batch.agg(F.count(F.lit(1)).alias("attempted"))
    got = answers.agg(F.count(F.lit(1)).alias("geocoded"))
    # Three frames of one row each.
    report = sums.join(F.broadcast(asked)).join(F.broadcast(got)).select(
        "unique_addresses", "already_cached", (F.col("unique_addresses") - F.col("already_cached")).alias("pending_before"), "attempted", "geocoded",
        (F.col("attempted") - F.col("geocoded")).alias("failed"), (F.col("unique_addresses") - F.col("already_cached") - F.col("geocoded")).alias("remaining"),
    )
    return {"located": located, "cache": upsert(cache.select("address_key", *PLACE), answers, ["address_key"]), "report": report}


def place_counts(located: DataFrame) -> DataFrame:
    """One row: located and failed services, and the distinct addresses of each."""
    ok = F.col("source") != "failed"
    return located.agg(
        F.count_if(ok).alias("located_rows"), F.count_if(~ok).alias("failed_rows"),
        F.countDistinct(F.when(ok, F.col("address_key"))).alias("located_addresses"), F.countDistinct(F.when(~ok, F.col("address_key"))).alias("failed_addresses"),
    )
