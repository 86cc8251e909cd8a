"""Routes by a chain of sources: each answers what those before it do not know, the greedy path the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldroute.functions.geo import travel_minutes
from fieldroute.functions.routes import nearest_neighbour


def ordered_key(points):
    """SHA-1 of the coordinates in their order, at six decimals."""
    return F.sha1(F.array_join(F.transform(points, lambda p: F.format_string("%.6f,%.6f", p["lon"], p["lat"])), "|"))


def chained_routes(requests: DataFrame, sources: dict[str, DataFrame], points: str = "stops") -> tuple[DataFrame, DataFrame]:
    """Requests with route_key, distance_km, duration_min and source, and the new routes, once a key, to append to the first source.

    ``sources`` are tables of cache_key, distance_km and duration_min by name, asked in their order: only keys that one
    does not have go on to the next, and what none has is computed as the greedy path from the first stop. Of rows with one
    key a source's shortest counts; rows without km are no answer. Requests of one key are answered once.
    """
    keyed = requests.withColumn("route_key", ordered_key(F.col(points)))
    missing, answers = keyed.groupBy("route_key").agg(F.first(points).alias("_points")), []
    for name, table in sources.items():
        known = table.where("distance_km is not null and duration_min is not null").groupBy(F.col("cache_key").alias("route_key")).agg(F.min(F.struct("distance_km", "duration_min")).alias("r"))
        answers.append(missing.join(known, "route_key").select("route_key", "r.distance_km", "r.duration_min", F.lit(name).alias("source")))
        missing = missing.join(known, "route_key", "left_anti")
    km = nearest_neighbour(F.col("_points"))["km"]
    answers.append(missing.select("route_key", F.round(km, 3).alias("distance_km"), F.round(travel_minutes(km), 2).alias("duration_min"), F.lit("haversine").alias("source")))
    found = answers[0]
    for a in answers[1:]:
        found = found.unionByName(a)
    new = found.where(F.col("source") != next(iter(sources), "")).select(F.col("route_key").alias("cache_key"), "distance_km", "duration_min")
    return keyed.join(found, "route_key"), new
