"""Queries of routing, scheduling, region design, assignment and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldroute.functions import text as T
from fieldroute.functions.geo import haversine_km
from fieldroute.functions.routes import best_start, coordinate_key, insertion_delta, nearest_neighbour, path_km, stops, timeline
from fieldroute.operators import relational as R
from fieldroute.operators.allocation import allocate, fixed_regions, overflow_ratio, override_regions, sweep_scores, weighted_runs
from fieldroute.operators.regions import DEFAULT_SLOT, batch_days, batch_stops, by_month, design_regions, region_count
from fieldroute.operators.routing import ORDINALS, city_summary, compare_scenarios, daily_summary, route_groups, routed
from fieldroute.plans.aggregates import regions
from fieldroute.session import cut, wide_tasks
from fieldroute.sources.adapter import VISITS_SQL, engineers, visits

MEASURES = ["deployed", "jobs", "distance_km", "duration_min", "jobs_std", "distance_per_unit"]
DAY = ["city", "service_date"]
MONTH = ["city", "service_month"]


def _current(spark, sf, rounded=False):
    return daily_summary(route_groups(visits(spark, sf), [*DAY, "engineer_code"]), day="service_date", rounded=rounded)


def df_current_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily city routing summary of the current engineers."""
    return _current(spark, sf, rounded=True)


def df_city_summary(spark: SparkSession, sf: str) -> DataFrame:
    return city_summary(_current(spark, sf))


def _jobs(spark, sf):
    v = visits(spark, sf, True)  # a receipt is an order
    return R.keep_first(v, ["l_orderkey"], [F.col("service_min").desc(), F.col("l_linenumber"), F.col("engineer_code"), F.col("service_date")])


def _regional_jobs(spark, sf):
    jobs = _jobs(spark, sf).join(cut(df_region_design(spark, sf), "regions"), ["city", "postal_code"])
    return jobs.select("city", "region", "service_date", "receipt_no", *ORDINALS, "latitude", "longitude", "service_min")


def df_integrated_units(spark: SparkSession, sf: str) -> DataFrame:
    """The fewest units that do the work of each city, region and day within the limits; regions are those of the design."""
    return batch_days(_regional_jobs(spark, sf), ["city", "region", "service_date"])


def flagship_routing_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Current engineers against integrated units: city means of the daily summaries, with deltas and an ALL row."""
    keys = ["city", "region", "service_date"]
    routes = routed(batch_stops(_regional_jobs(spark, sf), keys, ORDINALS), [*keys, "unit"])
    routes = routes.withColumn("unit", F.concat_ws("-", "region", "unit"))
    integrated = daily_summary(routes, day="service_date", unit="unit", rounded=False)
    return compare_scenarios(city_summary(_current(spark, sf)), city_summary(integrated), MEASURES)


def df_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Visit order by the greedy route from home, start and end of each engineer-day's jobs, and its lunch."""
    v = visits(spark, sf).join(engineers(spark, sf).select("engineer_code", "home_lat", "home_lon"), "engineer_code")
    day = v.groupBy("engineer_code", "service_date").agg(F.sort_array(F.collect_list(F.struct(*ORDINALS, F.struct(F.col("longitude").alias("lon"), F.col("latitude").alias("lat")).alias("stop"), F.col("service_min").cast("double").alias("minutes"), "receipt_no"))).alias("jobs"), F.first(F.struct(F.col("home_lon").alias("lon"), F.col("home_lat").alias("lat"))).alias("home"))
    day = day.withColumn("path", nearest_neighbour(F.array_distinct(F.transform("jobs", lambda j: j["stop"])), F.col("home"))["path"])
    # Jobs at one stop follow each other in their own order.
    day = day.withColumn("jobs", F.sort_array(F.transform("jobs", lambda j: F.struct(F.when(F.size("jobs") > 1, F.array_position("path", j["stop"])).alias("at"), j["l_orderkey"].alias("l_orderkey"), j["l_linenumber"].alias("l_linenumber"), j["stop"].alias("stop"), j["minutes"].alias("minutes"), j["receipt_no"].alias("receipt_no")))))
    leg = lambda a, b, minutes: F.struct(haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]).alias("km"), minutes.alias("minutes"))
    first = F.get("jobs", F.lit(0))
    later = F.transform(F.slice("jobs", 2, F.size("jobs")), lambda j, i: leg(F.get("jobs", i)["stop"], j["stop"], j["minutes"]))
    begin = F.array(leg(F.col("home"), first["stop"], first["minutes"]))
    day = day.withColumn("legs", F.when(F.size("jobs") == 1, begin).otherwise(F.concat(begin, later)))
    day = day.withColumn("rows", timeline(F.col("legs"))).select("engineer_code", "service_date", F.posexplode(F.arrays_zip("jobs", "rows")))
    return day.select("engineer_code", "service_date", (F.col("pos") + 1).alias("visit_seq"), "col.jobs.receipt_no", T.clock_text(F.floor("col.rows.start")).alias("visit_start"), T.clock_text(F.floor("col.rows.end")).alias("visit_end"), F.col("col.rows.lunch").alias("lunch"))


def df_insertion(spark: SparkSession, sf: str) -> DataFrame:
    """Extra km of one more stop for every engineer-month, and the key of its stop set."""
    day = visits(spark, sf).groupBy("engineer_code", "service_month").agg(stops([F.col(c) for c in ORDINALS], F.col("longitude"), F.col("latitude")).alias("stops"))
    extra = F.struct(F.lit(-84.5).alias("lon"), F.lit(33.5).alias("lat"))
    return day.select("engineer_code", "service_month", F.round(path_km(F.col("stops")), 3).alias("km"), F.round(insertion_delta(F.col("stops"), extra), 3).alias("delta_km"), coordinate_key(F.col("stops")).alias("stop_key"))


def df_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """An ordered day's jobs in contiguous runs of about equal weight."""
    weight = F.when(F.col("is_heavy"), 2).otherwise(1).alias("w")
    return weighted_runs(visits(spark, sf).select(*MONTH, *ORDINALS, weight, "engineer_code"), MONTH, ORDINALS, "w", "engineer_code")


def _demand(spark, sf):
    """Postal codes with their jobs a service day of the city, and the number of regions that the city's mean day and slot call for."""
    month, both = ["city", "postal_code", "service_month"], ("latitude", "longitude")
    # Lines are dealt once, by city, postal code and month; receipts of a day are counted there, and months are few.
    lines = visits(spark, sf).select(*month, "service_date", "receipt_no", *both).repartition(wide_tasks(spark, sf), *month)
    sums = lambda suffix="": [F.sum(f"{c}{suffix}").alias(f"{c}_sum") for c in both]
    daily = lines.groupBy(*month, "service_date").agg(F.countDistinct("receipt_no").alias("n"), *sums(), *[F.count(c).alias(f"{c}_n") for c in both])
    date = F.bit_or(F.call_function("shiftleft", F.lit(1), F.dayofmonth("service_date") - 1)).alias("dates")
    dated = F.sum(F.when(F.col("service_date").isNotNull(), F.col("n"))).alias("receipts")
    months = cut(daily.groupBy(*month).agg(dated, *sums("_sum"), *[F.sum(f"{c}_n").alias(f"{c}_n") for c in both], date), "demand-months")
    p = months.groupBy("city", "postal_code").agg(*[(F.sum(f"{c}_sum") / F.sum(f"{c}_n")).alias(c) for c in both], F.coalesce(F.sum("receipts"), F.lit(0)).alias("receipts"))
    days = months.groupBy("city", "service_month").agg(F.bit_count(F.bit_or("dates")).alias("days"), F.sum("receipts").alias("daily")).groupBy("city").agg(F.sum("days").alias("days"), F.sum("daily").alias("daily"))
    # A receipt has one postal code: those of the codes add up to the city's.
    days = days.join(p.where("postal_code is not null").groupBy("city").agg(F.count(F.lit(1)).alias("postals")), "city", "left").fillna(0, ["postals"])
    slots = engineers(spark, sf).groupBy("city").agg(F.coalesce(F.avg("slot"), F.lit(DEFAULT_SLOT)).alias("slot"))
    city = days.join(slots, "city").select("city", "days", "slot", region_count(F.col("daily") / F.col("days"), F.col("slot"), F.col("postals")).alias("regions"))
    return p.join(city, "city").withColumn("weight", F.col("receipts") / F.col("days"))


def df_region_design(spark: SparkSession, sf: str) -> DataFrame:
    """Balanced regions of each city's postal codes, as many as its demand calls for."""
    return design_regions(_demand(spark, sf))


def df_region_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The designed regions: postal codes, jobs a day, engineers needed, gap to an even share, centre and radii."""
    p = cut(_demand(spark, sf), "demand")
    p = p.join(design_regions(p), ["city", "postal_code"])
    middle = lambda c: (F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).alias(f"centre_{c}")
    per = p.groupBy("city", "region").agg(F.count(F.lit(1)).alias("postals"), F.sum("weight").alias("daily_jobs"), F.first("slot").alias("slot"), middle("latitude"), middle("longitude"))
    total = p.groupBy("city").agg((F.sum("weight") / F.countDistinct("region")).alias("share"))
    away = haversine_km(F.col("latitude"), F.col("longitude"), F.col("centre_latitude"), F.col("centre_longitude"))
    reach = p.select("city", "region", "latitude", "longitude").join(per.select("city", "region", "centre_latitude", "centre_longitude"), ["city", "region"]).groupBy("city", "region").agg(F.round(F.max(away), 3).alias("max_radius_km"), F.round(F.avg(away), 3).alias("mean_radius_km"))
    out = per.join(total, "city").join(reach, ["city", "region"])
    gap = F.col("daily_jobs") - F.col("share")
    return out.select("city", "region", "postals", F.round("daily_jobs", 4).alias("daily_jobs"), F.ceil(F.col("daily_jobs") / F.col("slot")).alias("engineers_needed"), F.round(gap, 4).alias("gap"), F.round(gap / F.greatest("share", F.lit(1.0)) * 100, 2).alias("gap_pct"), F.round("centre_latitude", 6).alias("centre_latitude"), F.round("centre_longitude", 6).alias("centre_longitude"), "max_radius_km", "mean_radius_km")


def df_multi_start(spark: SparkSession, sf: str) -> DataFrame:
    """Shortest greedy route of an engineer-day over all first stops, beside that from its first."""
    day = visits(spark, sf).groupBy("engineer_code", "service_date").agg(stops([F.col(c) for c in ORDINALS], F.col("longitude"), F.col("latitude")).alias("stops"))
    best = day.withColumn("best", best_start(F.col("stops")))
    return best.select("engineer_code", "service_date", F.size("stops").alias("stops"), F.round(nearest_neighbour(F.col("stops"))["km"], 3).alias("first_km"), F.round("best.km", 3).alias("best_km"))


def df_region_allocation(spark: SparkSession, sf: str) -> DataFrame:
    """The region of each engineer of a city's own centers that keeps most of their postal codes, with even counts."""
    seen = R.overlap_ratio(visits(spark, sf), regions(spark, sf))
    staff = engineers(spark, sf).where("center_type = 'DMS'").select("city", "engineer_code")
    return allocate(staff.join(seen, "engineer_code", "left"), 3)


def df_region_master(spark: SparkSession, sf: str) -> DataFrame:
    """Allocation after overrides by hand (each city's first engineers of regions 1 and 2 change places), with the workload rank in the region and flags."""
    plan = cut(df_region_allocation(spark, sf), "allocation")
    pair = plan.where("region_seq < 3").groupBy("city", "region_seq").agg(F.min("engineer_code").alias("engineer_code"))
    both = pair.groupBy("city").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("city")
    swap = pair.join(both, "city").select("engineer_code", (3 - F.col("region_seq")).alias("region_seq"))
    master = override_regions(plan, swap)
    work = visits(spark, sf).groupBy("engineer_code").agg(F.countDistinct("receipt_no").alias("receipts"))
    master = master.join(work, "engineer_code", "left").fillna(0, ["receipts"]).join(engineers(spark, sf).select("engineer_code", "slot", "ref_heavy"), "engineer_code")
    return master.withColumn("workload_rank", F.row_number().over(Window.partitionBy("city", "region_seq").orderBy(F.col("receipts").desc(), F.col("engineer_code"))))


#: Region counts that the sweep tries.
SWEEP_COUNTS = (1, 2, 3, 4, 5, 6)


def sweep_frames(spark, sf, counts: tuple[int, ...] = SWEEP_COUNTS):
    """City summaries with overflow of the current routes, and of the fewest units for each city and count of regions."""
    p = visits(spark, sf).groupBy("city", "postal_code").agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.countDistinct("receipt_no").cast("double").alias("weight"))
    designed = cut(fixed_regions(p.withColumn("regions", F.explode(F.array(*map(F.lit, counts))))), "sweep-regions")
    keys = ["city", "regions", "region", "service_date"]
    # Jobs are dealt once, by city and month; their regions, a row a postal code and count, go to where they are.
    jobs = by_month(_jobs(spark, sf).select("city", "postal_code", "service_date", "receipt_no", *ORDINALS, "latitude", "longitude"), ["city"])
    jobs = jobs.join(F.broadcast(designed), ["city", "postal_code"]).select(*keys, "_month", "receipt_no", *ORDINALS, "latitude", "longitude")
    routes = cut(routed(batch_stops(jobs, keys, ORDINALS), [*keys, "unit"]), "sweep-routes")
    tagged = routes.withColumn("unit", F.concat_ws("-", "region", "unit")).withColumn("candidate", F.struct("city", "regions"))
    found = city_summary(daily_summary(tagged, city="candidate", day="service_date", unit="unit", rounded=False), city="candidate").select("candidate.*", "*").drop("candidate")
    found = found.join(overflow_ratio(routes, ["city", "regions"]), ["city", "regions"])
    now = cut(route_groups(visits(spark, sf), [*DAY, "engineer_code"]), "current-routes")
    current = city_summary(daily_summary(now, day="service_date", rounded=False)).join(overflow_ratio(now, ["city"]), "city")
    return cut(current, "sweep-current"), cut(found, "sweep-found")


def df_region_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """For every city and count of regions: changes of the fewest units' routes against the current ones, score and best count."""
    return sweep_scores(*sweep_frames(spark, sf))


def df_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Request documents by city-month as JSON, read back and exploded."""
    v = _jobs(spark, sf)
    job = F.struct("receipt_no", "product_group", F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lng")).alias("location"), F.col("service_min").alias("service_minutes"), "is_heavy")
    packed = v.groupBy(*MONTH).agg(F.to_json(F.struct(F.lit("assign").alias("mode"), F.sort_array(F.collect_list(job)).alias("jobs"))).alias("payload"))
    schema = "mode string, jobs array<struct<receipt_no:string,product_group:string,location:struct<lat:double,lng:double>,service_minutes:int,is_heavy:boolean>>"
    back = packed.withColumn("p", F.from_json("payload", schema)).select(*MONTH, F.explode("p.jobs").alias("j"))
    return back.groupBy(*MONTH).agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("j.is_heavy")).alias("heavy_jobs"), F.sum("j.service_minutes").alias("minutes"), F.max("j.location.lat").alias("lat"))


def df_visit_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """Stop order in receipt order within an engineer-day."""
    w = Window.partitionBy("engineer_code", "service_date").orderBy("l_orderkey", "l_linenumber", "service_min", "latitude")
    return visits(spark, sf).select("engineer_code", "service_date", "receipt_no", "l_linenumber", F.row_number().over(w).alias("visit_seq"))


QUERIES = {f.__name__: f for f in (flagship_routing_compare, df_current_daily, df_city_summary, df_integrated_units, df_schedule, df_insertion, df_chunks, df_region_design, df_region_summary, df_region_sweep, df_region_allocation, df_region_master, df_multi_start, df_payload, df_visit_sequence)}
_FIRST = "f AS (SELECT *, row_number() OVER (PARTITION BY receipt_no ORDER BY service_min DESC, l_linenumber, engineer_code, service_date) AS rn FROM visits)"
SQL = {
    "df_payload": f"WITH {VISITS_SQL}, {_FIRST} SELECT city, service_month, count(*) AS jobs, count(*) FILTER (WHERE is_heavy) AS heavy_jobs, CAST(sum(service_min) AS BIGINT) AS minutes, max(latitude) AS lat FROM f WHERE rn = 1 GROUP BY 1, 2",
    "df_visit_sequence": f"WITH {VISITS_SQL} SELECT engineer_code, service_date, receipt_no, l_linenumber, row_number() OVER (PARTITION BY engineer_code, service_date ORDER BY l_orderkey, l_linenumber, service_min, latitude) AS visit_seq FROM visits",
}
