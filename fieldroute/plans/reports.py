"""Queries of the by-date reports and scenario comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldroute.functions.geo import haversine_km, haversine_sql
from fieldroute.operators.feasibility import balance_score, border_support, region_capacity
from fieldroute.plans.aggregates import _REGIONS, regions
from fieldroute.sources.adapter import ENGINEERS_SQL, VISITS_SQL, engineers, visits


def _capacity(spark, sf):
    v = visits(spark, sf).join(regions(spark, sf), "postal_code")
    units = v.groupBy("service_month", "region_seq").agg((F.countDistinct("receipt_no") + F.count_if(F.col("is_heavy"))).alias("units"))
    heads = v.join(engineers(spark, sf).select("engineer_code", F.col("region_seq").alias("home_region")), "engineer_code").where("region_seq = home_region").groupBy("service_month", "region_seq").agg((F.countDistinct("engineer_code") * 2).alias("headcount"))
    return region_capacity(units, heads, ["service_month", "region_seq"])


def rp_region_capacity(spark: SparkSession, sf: str) -> DataFrame:
    return _capacity(spark, sf)


def rp_border_feasibility(spark: SparkSession, sf: str) -> DataFrame:
    return border_support(_capacity(spark, sf), "service_month", F.lit(5), F.lit(7))


def rp_soft_feasibility(spark: SparkSession, sf: str) -> DataFrame:
    """Job, time and TV capacity by month; feasible when all three hold."""
    # Receipts and engineers apart: distinct counts of several columns at once would copy every line for each.
    r = visits(spark, sf).groupBy("service_month", "receipt_no").agg(F.count_if(F.col("is_heavy")).alias("heavy"))
    r = r.groupBy("service_month").agg((F.count("receipt_no") + F.sum("heavy")).alias("weighted"))
    e = visits(spark, sf).groupBy("service_month", "engineer_code").agg(F.sum("service_min").alias("minutes"), F.max(F.col("center_type") == "DMS2").alias("dms2"), F.count_if(F.col("symptom") == "A").alias("tv"))
    e = e.groupBy(F.col("service_month").alias("_month")).agg(F.sum("minutes").alias("minutes"), F.count("engineer_code").alias("headcount"), F.count(F.when(F.col("dms2"), F.col("engineer_code"))).alias("dms2"), F.sum("tv").alias("tv"))
    v = r.join(e, r["service_month"].eqNullSafe(e["_month"])).drop("_month")
    v = v.withColumn("job_gap", F.col("headcount") * 4 - F.col("weighted")).withColumn("time_gap", F.col("headcount") * 480 - F.col("minutes")).withColumn("tv_gap", F.col("dms2") * 4 - F.col("tv"))
    return v.withColumn("feasible", (F.col("job_gap") >= 0) & (F.col("time_gap") >= 0) & (F.col("tv_gap") >= 0))


def _sides(spark, sf):
    v = visits(spark, sf).select("service_month", "center_type", "engineer_code", "symptom").distinct()
    actual = v.where("symptom <> 'A'").select("service_month", "center_type", "engineer_code").distinct().withColumn("actual", F.lit(1))
    assigned = v.where("symptom <> 'R'").select("service_month", "center_type", "engineer_code").distinct().withColumn("assigned", F.lit(1))
    return actual.join(assigned, ["service_month", "center_type", "engineer_code"], "full_outer").fillna(0, ["actual", "assigned"])


def rp_engineer_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Engineers on both sides and on one only, by center type and for ALL, with their codes joined."""
    s = _sides(spark, sf)
    both = s.unionByName(s.withColumn("center_type", F.lit("ALL")))
    codes = lambda cond: F.array_join(F.sort_array(F.collect_set(F.when(cond, F.col("engineer_code")))), ", ")
    a, b = F.col("actual") == 1, F.col("assigned") == 1
    return both.groupBy("service_month", "center_type").agg(F.count_if(a & b).alias("overlap"), F.count_if(a & ~b).alias("actual_only"), F.count_if(~a & b).alias("assigned_only"), codes(a & ~b).alias("actual_only_codes"))


def rp_difference_detail(spark: SparkSession, sf: str) -> DataFrame:
    s = _sides(spark, sf).where("actual <> assigned")
    return s.select("service_month", "center_type", "engineer_code", F.when(F.col("actual") == 1, "actual_only").otherwise("assigned_only").alias("difference_type"))


def rp_jobs_per_engineer(spark: SparkSession, sf: str) -> DataFrame:
    v = visits(spark, sf)
    one = lambda cond, n: v.where(cond).groupBy("service_date").agg((F.countDistinct("receipt_no") / F.countDistinct("engineer_code")).alias(n))
    both = one("symptom <> 'A'", "actual").join(one("symptom <> 'R'", "assigned"), "service_date", "full_outer")
    return both.select("service_date", F.round("actual", 4).alias("actual"), F.round("assigned", 4).alias("assigned"), F.round(F.col("assigned") - F.col("actual"), 4).alias("difference"))


def rp_receipt_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Receipts whose first engineer differs from their last."""
    v = visits(spark, sf).groupBy("receipt_no").agg(F.min_by("engineer_code", F.struct("l_linenumber", "engineer_code")).alias("engineer_a"), F.max_by("engineer_code", F.struct("l_linenumber", "engineer_code")).alias("engineer_b"))
    return v.where("engineer_a <> engineer_b")


def df_balance_score(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of symptom R against those of A by city; the distance is that from each engineer's home, straight."""
    homes = engineers(spark, sf).select("engineer_code", "home_lat", "home_lon")
    km = F.round(haversine_km(F.col("home_lat"), F.col("home_lon"), F.col("latitude"), F.col("longitude")), 6)
    v = visits(spark, sf).join(homes, "engineer_code").groupBy("city", "symptom").agg(F.sum(km).alias("d"), F.countDistinct("receipt_no").alias("n"), F.sum("service_min").alias("m"), F.stddev_pop("service_min").alias("s"), F.countDistinct("engineer_code").alias("e"), F.count_if(F.col("is_heavy")).alias("o"))
    a = v.where("symptom = 'A'").drop("symptom")
    b = v.where("symptom = 'R'").select("city", *[F.col(c).alias(f"{c}2") for c in ("d", "n", "m", "s", "e", "o")])
    pct = lambda c: (F.col(f"{c}2") - F.col(c)) / F.nullif(F.col(c).cast("double"), F.lit(0.0)) * 100
    j = a.join(b, "city").select("city", pct("d").alias("distance_pct"), pct("m").alias("duration_pct"), pct("s").alias("std_pct"), pct("n").alias("jobs_pct"), pct("e").alias("headcount_pct"), (F.col("o2") - F.col("o")).cast("double").alias("overflow_delta"))
    return balance_score(j).select("city", F.round("balance_score", 4).alias("balance_score"))


QUERIES = {f.__name__: f for f in (rp_region_capacity, rp_border_feasibility, rp_soft_feasibility, rp_engineer_difference, rp_difference_detail, rp_jobs_per_engineer, rp_receipt_changes, df_balance_score)}
_CAP = f"{VISITS_SQL}, {ENGINEERS_SQL}, {_REGIONS}, v AS (SELECT visits.*, regions.region_seq FROM visits JOIN regions USING (postal_code)), u AS (SELECT service_month, region_seq, count(DISTINCT receipt_no) + count(*) FILTER (WHERE is_heavy) AS units FROM v GROUP BY 1, 2), h AS (SELECT service_month, v.region_seq, count(DISTINCT v.engineer_code) * 2 AS headcount FROM v JOIN engineers e ON e.engineer_code = v.engineer_code AND e.region_seq = v.region_seq GROUP BY 1, 2), cap AS (SELECT u.service_month, u.region_seq, units, coalesce(headcount, 0) AS headcount, coalesce(headcount, 0) * 4 AS capacity, coalesce(headcount, 0) * 4 - units AS gap, coalesce(headcount, 0) * 4 - units >= 0 AS feasible FROM u LEFT JOIN h ON h.service_month = u.service_month AND h.region_seq = u.region_seq)"
_SIDES = f"{VISITS_SQL}, a AS (SELECT DISTINCT service_month, center_type, engineer_code FROM visits WHERE symptom <> 'A'), b AS (SELECT DISTINCT service_month, center_type, engineer_code FROM visits WHERE symptom <> 'R'), k AS (SELECT service_month, center_type, engineer_code, max(x) AS actual, max(y) AS assigned FROM (SELECT *, 1 AS x, 0 AS y FROM a UNION ALL SELECT *, 0, 1 FROM b) GROUP BY 1, 2, 3)"
SQL = {
    "rp_region_capacity": f"WITH {_CAP} SELECT * FROM cap",
    "rp_border_feasibility": f"WITH {_CAP}, g AS (SELECT service_month, coalesce(max(CASE WHEN region_seq = 1 THEN gap END), 0) AS gap_r1, coalesce(max(CASE WHEN region_seq = 2 THEN gap END), 0) AS gap_r2, coalesce(max(CASE WHEN region_seq = 3 THEN gap END), 0) AS gap_r3 FROM cap GROUP BY 1), d AS (SELECT *, greatest(-gap_r1, 0) AS deficit_r1, greatest(-gap_r2, 0) AS deficit_r2, greatest(gap_r3, 0) AS surplus_r3 FROM g), c AS (SELECT *, least(deficit_r1, 5) AS coverable_r1, least(deficit_r2, 7) AS coverable_r2 FROM d), s AS (SELECT *, least(surplus_r3, coverable_r1) AS support_r1 FROM c), t AS (SELECT *, least(surplus_r3 - support_r1, coverable_r2) AS support_r2 FROM s), r AS (SELECT *, deficit_r1 + deficit_r2 - support_r1 - support_r2 AS remaining FROM t) SELECT *, support_r1 + support_r2 > 0 AND remaining > 0 AS partial_relief, remaining <= 0 AS feasible_after FROM r",
    "rp_soft_feasibility": f"WITH {VISITS_SQL}, v AS (SELECT service_month, count(DISTINCT receipt_no) + count(*) FILTER (WHERE is_heavy) AS weighted, CAST(sum(service_min) AS BIGINT) AS minutes, count(DISTINCT engineer_code) AS headcount, count(DISTINCT CASE WHEN center_type = 'DMS2' THEN engineer_code END) AS dms2, count(*) FILTER (WHERE symptom = 'A') AS tv FROM visits GROUP BY 1) SELECT *, headcount * 4 - weighted AS job_gap, headcount * 480 - minutes AS time_gap, dms2 * 4 - tv AS tv_gap, headcount * 4 >= weighted AND headcount * 480 >= minutes AND dms2 * 4 >= tv AS feasible FROM v",
    "rp_engineer_difference": f"WITH {_SIDES}, x AS (SELECT * FROM k UNION ALL SELECT service_month, 'ALL', engineer_code, actual, assigned FROM k) SELECT service_month, center_type, count(*) FILTER (WHERE actual = 1 AND assigned = 1) AS overlap, count(*) FILTER (WHERE actual = 1 AND assigned = 0) AS actual_only, count(*) FILTER (WHERE actual = 0 AND assigned = 1) AS assigned_only, coalesce(string_agg(CASE WHEN actual = 1 AND assigned = 0 THEN engineer_code END, ', ' ORDER BY engineer_code), '') AS actual_only_codes FROM x GROUP BY 1, 2",
    "rp_difference_detail": f"WITH {_SIDES} SELECT service_month, center_type, engineer_code, CASE WHEN actual = 1 THEN 'actual_only' ELSE 'assigned_only' END AS difference_type FROM k WHERE actual <> assigned",
    "rp_jobs_per_engineer": f"WITH {VISITS_SQL}, a AS (SELECT service_date, CAST(count(DISTINCT receipt_no) AS DOUBLE) / count(DISTINCT engineer_code) AS r FROM visits WHERE symptom <> 'A' GROUP BY 1), b AS (SELECT service_date, CAST(count(DISTINCT receipt_no) AS DOUBLE) / count(DISTINCT engineer_code) AS r FROM visits WHERE symptom <> 'R' GROUP BY 1) SELECT coalesce(a.service_date, b.service_date) AS service_date, round(a.r, 4) AS actual, round(b.r, 4) AS assigned, round(b.r - a.r, 4) AS difference FROM a FULL OUTER JOIN b ON a.service_date = b.service_date",
    "rp_receipt_changes": f"WITH {VISITS_SQL}, w AS (SELECT receipt_no, engineer_code, l_linenumber, min(l_linenumber) OVER (PARTITION BY receipt_no) AS lo, max(l_linenumber) OVER (PARTITION BY receipt_no) AS hi FROM visits), k AS (SELECT receipt_no, min(CASE WHEN l_linenumber = lo THEN engineer_code END) AS engineer_a, max(CASE WHEN l_linenumber = hi THEN engineer_code END) AS engineer_b FROM w GROUP BY 1) SELECT * FROM k WHERE engineer_a <> engineer_b",
    "df_balance_score": f"WITH {VISITS_SQL}, {ENGINEERS_SQL}, v AS (SELECT v.city, symptom, sum(round({haversine_sql('home_lat', 'home_lon', 'latitude', 'longitude')}, 6)) AS d, CAST(count(DISTINCT receipt_no) AS DOUBLE) AS n, CAST(sum(service_min) AS DOUBLE) AS m, stddev_pop(service_min) AS s, CAST(count(DISTINCT v.engineer_code) AS DOUBLE) AS e, CAST(count(*) FILTER (WHERE is_heavy) AS DOUBLE) AS o FROM visits v JOIN engineers e ON e.engineer_code = v.engineer_code GROUP BY 1, 2), j AS (SELECT a.city, (b.d - a.d) / a.d * 100 AS d, (b.n - a.n) / a.n * 100 AS n, (b.m - a.m) / a.m * 100 AS m, (b.s - a.s) / nullif(a.s, 0) * 100 AS s, (b.e - a.e) / a.e * 100 AS e, b.o - a.o AS o FROM v a JOIN v b ON a.city = b.city AND a.symptom = 'A' AND b.symptom = 'R') SELECT city, round(CAST(0.35 AS DOUBLE) * greatest(d, 0) + CAST(0.35 AS DOUBLE) * greatest(m, 0) + CAST(0.20 AS DOUBLE) * greatest(s, 0) + CAST(0.10 AS DOUBLE) * greatest(n, 0) - CAST(0.20 AS DOUBLE) * abs(least(e, 0)) + CAST(0.5 AS DOUBLE) * greatest(o, 0), 4) AS balance_score FROM j",
}
