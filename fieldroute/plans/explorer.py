"""Queries behind the map, result and upload views: counters, option lists, lookups, area statistics and report summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldroute.functions import text as T
from fieldroute.operators import relational as R
from fieldroute.plans.aggregates import _REGIONS, regions
from fieldroute.plans.reports import _capacity, rp_soft_feasibility
from fieldroute.plans.staffing import _sides
from fieldroute.session import shuffle_width, table
from fieldroute.sources.adapter import ENGINEERS_SQL, VISITS_SQL, engineers, visits

UNITS = "if(is_heavy, 2, 1)"


def xt_kpi(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of one view, with the spread of weighted jobs over engineers; the travel means of a day are in df_current_daily."""
    v = visits(spark, sf)
    one = v.agg(F.countDistinct("receipt_no").alias("receipts"), F.count_if("is_heavy").alias("heavy_lines"), F.sum("service_min").alias("minutes"), F.countDistinct("engineer_code").alias("engineers"), F.countDistinct(F.when(F.col("center_type") == "DMS", F.col("engineer_code"))).alias("dms_engineers"))
    spread = v.groupBy("engineer_code").agg(F.sum(F.expr(UNITS)).alias("u")).agg(F.round(F.stddev_pop("u"), 4).alias("weighted_jobs_std"))
    return one.crossJoin(spread)  # one row each


def xt_result_view(spark: SparkSession, sf: str) -> DataFrame:
    """Receipts, engineers and the spread of an engineer's receipts by type of center."""
    per = visits(spark, sf).groupBy("center_type", "engineer_code").agg(F.countDistinct("receipt_no").alias("n"), F.sum("service_min").alias("m"))
    return per.groupBy("center_type").agg(F.count(F.lit(1)).alias("engineers"), F.sum("n").alias("engineer_receipts"), F.sum("m").alias("minutes"), F.max("n").alias("most"), F.round(F.stddev_pop("n"), 4).alias("receipts_std"))


def xt_side_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Engineer-days by the bucket of the day's first visit, and their receipts."""
    first = F.min_by("is_heavy", F.struct("l_orderkey", "l_linenumber", "service_min", "latitude"))
    days = visits(spark, sf).groupBy("service_date", "engineer_code").agg(first.alias("heavy_first"), F.countDistinct("receipt_no").alias("n"))
    return days.groupBy("service_date", F.when(F.col("heavy_first"), "heavy").otherwise("normal").alias("bucket")).agg(F.count(F.lit(1)).alias("engineers"), F.sum("n").alias("receipts"))


def xt_route_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Receipts of an engineer-day in visit order as one text, with counts and minutes."""
    jobs = F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "service_min", "latitude", "receipt_no")))
    g = visits(spark, sf).groupBy("engineer_code", "service_date").agg(jobs.alias("jobs"), F.sum("service_min").alias("minutes"))
    return g.select("engineer_code", "service_date", F.size("jobs").cast("long").alias("jobs"), "minutes", F.array_join(F.transform("jobs", lambda j: j["receipt_no"]), ">").alias("route"))


def _uploads(spark, sf):
    """Address rows as they are uploaded: blanks, copies, foreign countries, suffixes in the street, dates and places that do not parse."""
    k, s = F.col("c_custkey"), lambda c: c.cast("string")
    city, state, postal = F.concat(F.lit("City"), s(k % 7)), F.lit("GA"), F.concat(F.lit("30"), F.lpad(s(k % 50), 3, "0"))
    street = F.concat(s(k % 90 + 1), F.lit(" Main St"))
    suffix = F.when(k % 6 == 0, F.concat(F.lit(", "), city, F.lit(", "), state, F.lit(" "), postal, F.lit(" usa"))).when(k % 6 == 1, F.concat(F.lit(" "), state, F.lit(", "), postal)).when(k % 6 == 2, F.lit(" USA, usa")).when(k % 6 == 3, F.concat(F.lit(","), city, F.lit(" "), state, F.lit(" "), postal)).otherwise("")
    place = F.concat(s(-84 - k % 3), F.lit(".5,"), s(33 + k % 2))
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.when(k % 23 == 0, " ").otherwise(F.concat(street, suffix)).alias("street"),
        city.alias("city"),
        state.alias("state"),
        postal.alias("postal"),
        F.when(k % 11 == 0, "Canada").when(k % 2 == 0, "usa").otherwise("United  States").alias("country"),
        F.when(k % 5 == 0, "2026013").when(k % 5 == 1, None).when(k % 5 == 2, "20260231").otherwise("20260120").alias("day"),
        F.when(k % 4 == 0, " failed ").when(k % 4 == 1, None).otherwise("cache").alias("source"),
        F.when(k % 7 == 0, "x,1").when(k % 7 == 1, "1").when(k % 7 == 2, None).when(k % 7 == 3, F.concat(place, F.lit(",1"))).otherwise(place).alias("place"),
        F.when(k % 6 == 0, " VRP ").when(k % 6 == 1, None).when(k % 6 == 2, "z-weekend").when(k % 6 == 3, "Weekday").when(k % 6 == 4, "own").otherwise(" ").alias("mode"),
    )


def prj_street(spark: SparkSession, sf: str) -> DataFrame:
    """Streets without the city, state, postal code and country at their end."""
    u = _uploads(spark, sf)
    return u.select("c_custkey", T.street(F.col("street"), F.col("city"), F.col("state"), F.col("postal"), T.country(F.col("country"))).alias("street"))


def xt_unique_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """The first upload of every address key, of one country and with a street."""
    u = _uploads(spark, sf).withColumn("country", T.country(F.col("country"))).where("country = 'USA'")
    # Equal uploads are cleansed once, and a few bytes that take long to cleanse are spread over all tasks.
    raw = ["street", "city", "state", "postal", "country"]
    u = u.groupBy(*raw).agg(F.min("c_custkey").alias("c_custkey")).repartition(shuffle_width(spark), *raw)
    u = u.withColumn("street", T.street(*[F.col(c) for c in raw])).where("street <> ''")
    return u.groupBy(T.address_key(*[F.col(c) for c in raw]).alias("address_key")).agg(F.min(F.struct("c_custkey", "street")).alias("first")).select("address_key", "first.*")


def xt_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    """Longitude and latitude from one text; both null unless it holds two numbers."""
    lon, lat = T.coordinate_pair(F.col("place"))
    return _uploads(spark, sf).select("c_custkey", lon.alias("longitude"), lat.alias("latitude"))


def flt_services(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads whose place was not marked as failed and whose day is one; an unknown source stays."""
    day = T.day(F.col("day"))
    return _uploads(spark, sf).where(F.coalesce(F.trim("source") != "failed", F.lit(True))).select("c_custkey", day.alias("service_date")).where("service_date is not null")


def prj_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Mode names without their aliases; blank ones take the default."""
    return _uploads(spark, sf).select("c_custkey", T.routing_mode(F.col("mode"), "na_general").alias("mode"))


def xt_start_coordinate(spark: SparkSession, sf: str) -> DataFrame:
    """Where an engineer's day starts: home, else the centre of the anchor region (slot 5 has no home here)."""
    v = visits(spark, sf).join(regions(spark, sf), "postal_code").select("city", "region_seq", "latitude", "longitude")
    c = v.groupBy("city", "region_seq").agg(F.round(F.avg("latitude"), 6).alias("c_lat"), F.round(F.avg("longitude"), 6).alias("c_lon"))
    e = engineers(spark, sf).withColumn("home", F.coalesce(F.col("slot") != 5, F.lit(True))).join(c, ["city", "region_seq"], "left")
    start = lambda own, other: F.when(F.col("home"), F.col(own)).otherwise(F.col(other))
    return e.select("engineer_code", start("home_lat", "c_lat").alias("start_lat"), start("home_lon", "c_lon").alias("start_lon"))


def xt_region_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Region of each postal code in upload order, the last row wins."""
    rows = table(spark, sf, "customer").select(F.lpad((F.col("c_custkey") % 997).cast("string"), 5, "0").alias("postal_code"), "c_custkey", (F.col("c_nationkey") % 3 + 1).cast("int").alias("region_seq"))
    return rows.groupBy("postal_code").agg(F.max_by("region_seq", "c_custkey").alias("region_seq")).withColumn("region_name", F.concat(F.lit("Region "), F.col("region_seq").cast("string")))


def xt_zip_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Covered postal codes with the planned region and that of the manual table, and whether they agree."""
    manual = xt_region_lookup(spark, sf).select("postal_code", F.col("region_seq").alias("manual_region"))
    out = regions(spark, sf).join(manual, "postal_code", "left")
    return out.withColumn("status", F.when(F.col("manual_region").isNull(), "missing").when(F.col("manual_region") == F.col("region_seq"), "match").otherwise("mismatch"))


def xt_engineer_options(spark: SparkSession, sf: str) -> DataFrame:
    """One option for each named engineer of a city's own centers, in the order of the list."""
    e = engineers(spark, sf).where("center_type = 'DMS' and trim(engineer_code) <> ''")
    e = R.keep_first(e, ["city", "engineer_code"], [F.col("engineer_name")])
    w = Window.partitionBy("city").orderBy("engineer_name", "engineer_code")
    return e.select("city", "engineer_code", "engineer_name", F.row_number().over(w).alias("position"))


def xt_weekend_state(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct slots in order and the priority of each product for an engineer with any job to take; the later priority wins."""
    v = visits(spark, sf).groupBy("engineer_code", "product_group").agg(F.max_by("l_linenumber", F.struct("l_orderkey", "l_linenumber")).alias("priority"))
    skills = v.groupBy("engineer_code").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "product_group", F.col("priority").cast("string")))), ",").alias("skills"))
    slots = visits(spark, sf).groupBy("engineer_code").agg(F.array_join(F.sort_array(F.collect_set(F.dayofweek("service_date"))).cast("array<string>"), ",").alias("slots"))
    limits = engineers(spark, sf).where("coalesce(slot, 0) > 0").select("engineer_code", F.col("slot").alias("max_jobs"))
    return limits.join(slots, "engineer_code", "left").join(skills, "engineer_code", "left")


def ag_area_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Postal codes, engineers and receipts of each city's regions, the busiest first."""
    v = visits(spark, sf).join(regions(spark, sf), "postal_code")
    a = v.groupBy("city", "region_seq").agg(F.countDistinct("postal_code").alias("postal_codes"), F.countDistinct("engineer_code").alias("engineers"), F.countDistinct("receipt_no").alias("receipts"))
    w = Window.partitionBy("city").orderBy(F.col("receipts").desc(), F.col("postal_codes").desc(), F.col("region_seq"))
    return a.withColumn("position", F.row_number().over(w))


def ag_missing_zip(spark: SparkSession, sf: str) -> DataFrame:
    """Covered postal codes without a manual region, with their receipts and the city that has most of them."""
    v = visits(spark, sf).groupBy("postal_code", "city").agg(F.countDistinct("receipt_no").alias("n"))
    v = v.join(xt_region_lookup(spark, sf).where("region_seq <> 2"), "postal_code", "left_anti")
    return v.groupBy("postal_code").agg(F.sum("n").alias("receipts"), F.min_by("city", F.struct(-F.col("n"), F.col("city"))).alias("primary_city"))


def rp_expansion_support(spark: SparkSession, sf: str) -> DataFrame:
    """Region 3's surplus goes to the larger deficit of regions 1 and 2 first, to region 1 on ties."""
    gap = lambda r: F.coalesce(F.max(F.when(F.col("region_seq") == r, F.col("gap"))), F.lit(0))
    g = _capacity(spark, sf).groupBy("service_month").agg(gap(1).alias("gap_r1"), gap(2).alias("gap_r2"), gap(3).alias("gap_r3"))
    d1, d2, s = (F.greatest(x, F.lit(0)) for x in (-F.col("gap_r1"), -F.col("gap_r2"), F.col("gap_r3")))
    g = g.withColumns({"deficit_r1": d1, "deficit_r2": d2, "surplus_r3": s})
    ahead, a, b, spare = F.col("deficit_r1") >= F.col("deficit_r2"), F.col("deficit_r1"), F.col("deficit_r2"), F.col("surplus_r3")
    g = g.withColumn("support_r1", F.when(ahead, F.least(spare, a)).otherwise(F.least(spare - F.least(spare, b), a)))
    g = g.withColumn("support_r2", F.when(ahead, F.least(spare - F.least(spare, a), b)).otherwise(F.least(spare, b)))
    g = g.withColumn("remaining", a + b - F.col("support_r1") - F.col("support_r2"))
    return g.withColumn("partial_relief", (F.col("support_r1") + F.col("support_r2") > 0) & (F.col("remaining") > 0)).withColumn("feasible_before", a + b == 0).withColumn("feasible_after", F.col("remaining") <= 0)


def rp_same_region(spark: SparkSession, sf: str) -> DataFrame:
    """Engineers at work only in fact: how many of a known region worked in that of the plan."""
    actual, assigned = _sides(spark, sf)
    one = actual.groupBy("service_date", "engineer_code").agg(F.min_by("region_seq", F.struct("l_orderkey", "l_linenumber", "service_min", "latitude")).alias("seen"))
    only = one.join(assigned.select("service_date", "engineer_code").distinct(), ["service_date", "engineer_code"], "left_anti")
    only = only.join(engineers(spark, sf).select("engineer_code", F.when(F.col("slot").isNotNull(), F.col("region_seq")).alias("planned")), "engineer_code", "left")
    out = only.groupBy("service_date").agg(F.count(F.lit(1)).alias("actual_only"), F.count("planned").alias("known"), F.count_if(F.col("planned") == F.col("seen")).alias("same"))
    return out.withColumn("ratio", F.round(F.col("same") / F.nullif("known", F.lit(0)), 4))


def rp_scenario_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Engineers, minutes, spread of jobs and of weighted jobs, longest day and days over 480 minutes, of both scenarios by date."""
    def side(rows, label):
        per = rows.groupBy("service_date", "engineer_code").agg(F.countDistinct("receipt_no").alias("jobs"), F.sum(F.expr(UNITS)).alias("units"), F.sum("service_min").alias("minutes"))
        return per.groupBy("service_date").agg(F.count(F.lit(1)).alias("engineers"), F.sum("minutes").alias("minutes"), F.round(F.stddev_pop("jobs"), 3).alias("jobs_std"), F.round(F.stddev_pop("units"), 3).alias("weighted_jobs_std"), F.max("minutes").alias("longest"), F.count_if(F.col("minutes") > 480).alias("over_480")).withColumn("label", F.lit(label))

    actual, assigned = _sides(spark, sf)
    return side(actual, "actual").unionByName(side(assigned, "assigned"))


def rp_feasibility_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and means over the by-date feasibility report."""
    ok = lambda c: F.count_if(F.col(c) >= 0)
    return rp_soft_feasibility(spark, sf).agg(F.count(F.lit(1)).alias("dates"), ok("job_gap").alias("job_feasible"), ok("time_gap").alias("time_feasible"), ok("tv_gap").alias("tv_feasible"), F.count_if("feasible").alias("feasible"), F.round(F.avg("job_gap"), 4).alias("mean_job_gap"), F.round(F.avg("time_gap"), 4).alias("mean_time_gap"))


QUERIES = {f.__name__: f for f in (xt_kpi, xt_result_view, xt_side_panel, xt_route_groups, prj_street, xt_unique_addresses, xt_coordinates, flt_services, prj_mode, xt_start_coordinate, xt_region_lookup, xt_zip_compare, xt_engineer_options, xt_weekend_state, ag_area_stats, ag_missing_zip, rp_expansion_support, rp_same_region, rp_scenario_summary, rp_feasibility_summary)}

_UPLOADS = """up AS (SELECT c_custkey, c_custkey AS k, 'City' || (c_custkey % 7) AS city, 'GA' AS state, '30' || lpad(CAST(c_custkey % 50 AS VARCHAR), 3, '0') AS postal, (c_custkey % 90 + 1) || ' Main St' AS st,
 CASE WHEN c_custkey % 11 = 0 THEN 'CANADA' ELSE 'USA' END AS country, (-84 - c_custkey % 3) || '.5,' || (33 + c_custkey % 2) AS place FROM customer)"""
_STREET = "CASE WHEN k % 23 = 0 THEN '' WHEN country = 'CANADA' AND k % 6 = 0 THEN st || ', ' || city || ', GA ' || postal || ' usa' WHEN country = 'CANADA' AND k % 6 = 2 THEN st || ' USA, usa' ELSE st END"
_WORK = f"{VISITS_SQL}, {_REGIONS}, s AS (SELECT * FROM visits JOIN regions USING (postal_code))"
_LOOKUP = "l AS (SELECT lpad(CAST(c_custkey % 997 AS VARCHAR), 5, '0') AS postal_code, CAST(arg_max(c_nationkey % 3 + 1, c_custkey) AS INTEGER) AS region_seq FROM customer GROUP BY 1)"
_CAP = f"{_WORK}, u AS (SELECT service_month, region_seq, count(DISTINCT receipt_no) + count(*) FILTER (WHERE is_heavy) AS units FROM s GROUP BY 1, 2), h AS (SELECT service_month, s.region_seq, count(DISTINCT s.engineer_code) * 2 AS heads FROM s JOIN engineers e ON s.engineer_code = e.engineer_code AND s.region_seq = e.region_seq GROUP BY 1, 2), c AS (SELECT service_month, region_seq, coalesce(heads, 0) * 4 - units AS gap FROM u LEFT JOIN h USING (service_month, region_seq))"
_FEASIBLE = f"{VISITS_SQL}, v AS (SELECT service_month, count(DISTINCT engineer_code) * 4 - count(DISTINCT receipt_no) - count(*) FILTER (WHERE is_heavy) AS job_gap, count(DISTINCT engineer_code) * 480 - sum(service_min) AS time_gap, count(DISTINCT CASE WHEN center_type = 'DMS2' THEN engineer_code END) * 4 - count(*) FILTER (WHERE symptom = 'A') AS tv_gap FROM visits GROUP BY 1)"


def _scenario(label: str, without: str) -> str:
    return f"SELECT service_date, count(*) AS engineers, CAST(sum(m) AS BIGINT) AS minutes, round(stddev_pop(j), 3) AS jobs_std, round(stddev_pop(u), 3) AS weighted_jobs_std, CAST(max(m) AS BIGINT) AS longest, count(*) FILTER (WHERE m > 480) AS over_480, '{label}' AS label FROM (SELECT service_date, engineer_code, count(DISTINCT receipt_no) AS j, sum(CASE WHEN is_heavy THEN 2 ELSE 1 END) AS u, sum(service_min) AS m FROM visits WHERE symptom <> '{without}' GROUP BY 1, 2) GROUP BY 1"


SQL = {
    "xt_kpi": f"WITH {VISITS_SQL} SELECT count(DISTINCT receipt_no) AS receipts, count(*) FILTER (WHERE is_heavy) AS heavy_lines, CAST(sum(service_min) AS BIGINT) AS minutes, count(DISTINCT engineer_code) AS engineers, count(DISTINCT CASE WHEN center_type = 'DMS' THEN engineer_code END) AS dms_engineers, (SELECT round(stddev_pop(u), 4) FROM (SELECT sum(CASE WHEN is_heavy THEN 2 ELSE 1 END) AS u FROM visits GROUP BY engineer_code)) AS weighted_jobs_std FROM visits",
    "xt_result_view": f"WITH {VISITS_SQL}, p AS (SELECT center_type, engineer_code, count(DISTINCT receipt_no) AS n, sum(service_min) AS m FROM visits GROUP BY 1, 2) SELECT center_type, count(*) AS engineers, CAST(sum(n) AS BIGINT) AS engineer_receipts, CAST(sum(m) AS BIGINT) AS minutes, max(n) AS most, round(stddev_pop(n), 4) AS receipts_std FROM p GROUP BY 1",
    "xt_side_panel": f"WITH {VISITS_SQL}, d AS (SELECT service_date, engineer_code, first(is_heavy ORDER BY l_orderkey, l_linenumber, service_min, latitude) AS heavy_first, count(DISTINCT receipt_no) AS n FROM visits GROUP BY 1, 2) SELECT service_date, CASE WHEN heavy_first THEN 'heavy' ELSE 'normal' END AS bucket, count(*) AS engineers, CAST(sum(n) AS BIGINT) AS receipts FROM d GROUP BY 1, 2",
    "xt_route_groups": f"WITH {VISITS_SQL} SELECT engineer_code, service_date, count(*) AS jobs, CAST(sum(service_min) AS BIGINT) AS minutes, string_agg(receipt_no, '>' ORDER BY l_orderkey, l_linenumber, service_min, latitude) AS route FROM visits GROUP BY 1, 2",
    "prj_street": f"WITH {_UPLOADS} SELECT c_custkey, {_STREET} AS street FROM up",
    "xt_unique_addresses": f"WITH {_UPLOADS}, a AS (SELECT c_custkey, {_STREET} AS street, city, postal FROM up WHERE country = 'USA'), r AS (SELECT upper(street || '|' || city || '|GA|' || postal || '|USA') AS address_key, c_custkey, street, row_number() OVER (PARTITION BY street, city, postal ORDER BY c_custkey) AS rn FROM a WHERE street <> '') SELECT address_key, c_custkey, street FROM r WHERE rn = 1",
    "xt_coordinates": f"WITH {_UPLOADS} SELECT c_custkey, CASE WHEN k % 7 > 3 THEN CAST(split_part(place, ',', 1) AS DOUBLE) END AS longitude, CASE WHEN k % 7 > 3 THEN CAST(split_part(place, ',', 2) AS DOUBLE) END AS latitude FROM up",
    "flt_services": "SELECT c_custkey, DATE '2026-01-20' AS service_date FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 5 IN (3, 4)",
    "prj_mode": "SELECT c_custkey, CASE c_custkey % 6 WHEN 2 THEN 'z_weekend' WHEN 3 THEN 'weekday_general' WHEN 4 THEN 'own' ELSE 'na_general' END AS mode FROM customer",
    "xt_start_coordinate": f"WITH {_WORK}, {ENGINEERS_SQL}, c AS (SELECT city, region_seq, round(avg(latitude), 6) AS c_lat, round(avg(longitude), 6) AS c_lon FROM s GROUP BY 1, 2) SELECT engineer_code, CASE WHEN slot IS NULL OR slot <> 5 THEN home_lat ELSE c_lat END AS start_lat, CASE WHEN slot IS NULL OR slot <> 5 THEN home_lon ELSE c_lon END AS start_lon FROM engineers LEFT JOIN c USING (city, region_seq)",
    "xt_region_lookup": f"WITH {_LOOKUP} SELECT postal_code, region_seq, 'Region ' || region_seq AS region_name FROM l",
    "xt_zip_compare": f"WITH {VISITS_SQL}, {_REGIONS}, {_LOOKUP} SELECT postal_code, r.region_seq, l.region_seq AS manual_region, CASE WHEN l.region_seq IS NULL THEN 'missing' WHEN l.region_seq = r.region_seq THEN 'match' ELSE 'mismatch' END AS status FROM regions r LEFT JOIN l USING (postal_code)",
    "xt_engineer_options": f"WITH {ENGINEERS_SQL} SELECT city, engineer_code, engineer_name, row_number() OVER (PARTITION BY city ORDER BY engineer_name, engineer_code) AS position FROM engineers WHERE center_type = 'DMS'",
    "xt_weekend_state": f"WITH {VISITS_SQL}, {ENGINEERS_SQL}, p AS (SELECT engineer_code, product_group, last(l_linenumber ORDER BY l_orderkey, l_linenumber) AS priority FROM visits GROUP BY 1, 2), k AS (SELECT engineer_code, string_agg(product_group || ':' || priority, ',' ORDER BY product_group || ':' || priority) AS skills FROM p GROUP BY 1), t AS (SELECT engineer_code, string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) AS slots FROM (SELECT DISTINCT engineer_code, dayofweek(service_date) + 1 AS d FROM visits) GROUP BY 1) SELECT engineer_code, slot AS max_jobs, slots, skills FROM engineers LEFT JOIN t USING (engineer_code) LEFT JOIN k USING (engineer_code) WHERE slot > 0",
    "ag_area_stats": f"WITH {_WORK}, a AS (SELECT city, region_seq, count(DISTINCT postal_code) AS postal_codes, count(DISTINCT engineer_code) AS engineers, count(DISTINCT receipt_no) AS receipts FROM s GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY city ORDER BY receipts DESC, postal_codes DESC, region_seq) AS position FROM a",
    "ag_missing_zip": f"WITH {VISITS_SQL}, {_LOOKUP}, v AS (SELECT postal_code, city, count(DISTINCT receipt_no) AS n FROM visits WHERE postal_code NOT IN (SELECT postal_code FROM l WHERE region_seq <> 2) GROUP BY 1, 2) SELECT postal_code, CAST(sum(n) AS BIGINT) AS receipts, first(city ORDER BY n DESC, city) AS primary_city FROM v GROUP BY 1",
    "rp_expansion_support": f"WITH {ENGINEERS_SQL}, {_CAP}, g AS (SELECT service_month, coalesce(max(gap) FILTER (WHERE region_seq = 1), 0) AS gap_r1, coalesce(max(gap) FILTER (WHERE region_seq = 2), 0) AS gap_r2, coalesce(max(gap) FILTER (WHERE region_seq = 3), 0) AS gap_r3 FROM c GROUP BY 1), d AS (SELECT *, greatest(-gap_r1, 0) AS deficit_r1, greatest(-gap_r2, 0) AS deficit_r2, greatest(gap_r3, 0) AS surplus_r3 FROM g), t AS (SELECT *, CASE WHEN deficit_r1 >= deficit_r2 THEN least(surplus_r3, deficit_r1) ELSE least(deficit_r1, greatest(surplus_r3 - deficit_r2, 0)) END AS support_r1, CASE WHEN deficit_r1 >= deficit_r2 THEN least(deficit_r2, greatest(surplus_r3 - deficit_r1, 0)) ELSE least(surplus_r3, deficit_r2) END AS support_r2 FROM d), m AS (SELECT *, deficit_r1 + deficit_r2 - support_r1 - support_r2 AS remaining FROM t) SELECT *, support_r1 + support_r2 > 0 AND remaining > 0 AS partial_relief, deficit_r1 + deficit_r2 = 0 AS feasible_before, remaining <= 0 AS feasible_after FROM m",
    "rp_same_region": f"WITH {_WORK}, {ENGINEERS_SQL}, o AS (SELECT service_date, engineer_code, first(region_seq ORDER BY l_orderkey, l_linenumber, service_min, latitude) AS seen FROM s WHERE symptom <> 'A' AND (service_date, engineer_code) NOT IN (SELECT (service_date, engineer_code) FROM visits WHERE symptom <> 'R') GROUP BY 1, 2), p AS (SELECT service_date, seen, CASE WHEN slot IS NOT NULL THEN region_seq END AS planned FROM o LEFT JOIN engineers USING (engineer_code)) SELECT service_date, count(*) AS actual_only, count(planned) AS known, count(*) FILTER (WHERE planned = seen) AS same, round(CAST(count(*) FILTER (WHERE planned = seen) AS DOUBLE) / nullif(count(planned), 0), 4) AS ratio FROM p GROUP BY 1",
    "rp_scenario_summary": f"WITH {VISITS_SQL} {_scenario('actual', 'A')} UNION ALL {_scenario('assigned', 'R')}",
    "rp_feasibility_summary": f"WITH {_FEASIBLE} SELECT count(*) AS dates, count(*) FILTER (WHERE job_gap >= 0) AS job_feasible, count(*) FILTER (WHERE time_gap >= 0) AS time_feasible, count(*) FILTER (WHERE tv_gap >= 0) AS tv_feasible, count(*) FILTER (WHERE job_gap >= 0 AND time_gap >= 0 AND tv_gap >= 0) AS feasible, round(avg(job_gap), 4) AS mean_job_gap, round(avg(time_gap), 4) AS mean_time_gap FROM v",
}
