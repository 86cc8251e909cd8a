"""Queries of aggregations and window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldroute.operators import relational as R
from fieldroute.session import cut, table, wide_tasks
from fieldroute.sources.adapter import ENGINEERS_SQL, VISITS_SQL, engineers, visits


def region_of(postal_code: str):
    return (F.col(postal_code).cast("int") % 3 + 1).cast("int")


def regions(spark, sf):
    """Postal code to region."""
    return visits(spark, sf).select("postal_code").distinct().withColumn("region_seq", region_of("postal_code"))


_REGIONS = "regions AS (SELECT DISTINCT postal_code, CAST(CAST(postal_code AS INTEGER) % 3 + 1 AS INTEGER) AS region_seq FROM visits)"


def ag_daily_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct receipts a day, then sum, mean, maximum and days by city."""
    daily = visits(spark, sf).groupBy("city", "service_date").agg(F.countDistinct("receipt_no").alias("n"))
    return daily.groupBy("city").agg(F.sum("n").alias("total"), F.round(F.avg("n"), 4).alias("mean_daily"), F.max("n").alias("max_daily"), F.countDistinct("service_date").alias("days"))


def postal_months(lines: DataFrame, tasks: int) -> DataFrame:
    """Months of a postal code, added up over its days: receipts in all and at most, days, daily means of coordinates and their number,
    engineers at most, and a bit for each date.

    Lines are dealt once, by city, postal code and month; all else is done in these tasks. Engineers of a day are told by
    their first line, since two distinct counts in one grouping would copy every line.
    """
    month = ["city", "postal_code", "service_month"]
    first = F.row_number().over(Window.partitionBy(*month, "service_date", "engineer_code").orderBy("receipt_no")) == 1
    lines = lines.select(*month, "service_date", "receipt_no", "engineer_code", "latitude", "longitude").repartition(tasks, *month).withColumn("first", first & F.col("engineer_code").isNotNull())
    daily = lines.groupBy(*month, "service_date").agg(F.countDistinct("receipt_no").alias("n"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.count_if("first").alias("e"))
    means = [f(c).alias(a) for c in ("latitude", "longitude") for f, a in ((F.sum, c), (F.count, f"{c}_days"))]
    date = F.bit_or(F.call_function("shiftleft", F.lit(1), F.dayofmonth("service_date") - 1)).alias("dates")
    return daily.groupBy(*month).agg(F.sum("n").alias("total"), F.max("n").alias("max_daily"), F.count(F.lit(1)).alias("days"), *means, F.max("e").alias("engineers"), date)


def ag_postal_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Postal demand: the mean of daily means, and a daily rate that is rounded before zero rates go."""
    months = cut(postal_months(visits(spark, sf), wide_tasks(spark, sf)), "postal-months")
    # A city's dates are the bits that any of its postal codes has in a month.
    days = months.groupBy("city", "service_month").agg(F.bit_count(F.bit_or("dates")).alias("dates")).groupBy("city").agg(F.sum("dates").alias("city_days"))
    mean = lambda c: F.round(F.sum(c) / F.sum(f"{c}_days"), 9).alias(c)
    out = months.groupBy("city", "postal_code").agg(F.sum("total").alias("total"), F.max("max_daily").alias("max_daily"), F.sum("days").alias("days"), mean("latitude"), mean("longitude"), F.max("engineers").alias("engineers"))
    return out.join(days, "city").withColumn("rate", F.round(F.col("total") / F.col("city_days"), 2)).where("rate > 0").drop("city_days")


def ag_capacity(spark: SparkSession, sf: str) -> DataFrame:
    e = engineers(spark, sf).groupBy("city").agg(F.countDistinct("engineer_code").alias("engineers"), F.sum("slot").alias("s"), F.avg("slot").alias("m"), F.median("slot").alias("d"))
    return e.select("city", "engineers", F.coalesce("s", F.lit(0)).alias("slots"), F.round(F.coalesce("m", F.lit(7.0)), 4).alias("mean_slot"), F.coalesce("d", F.lit(7.0)).alias("median_slot"))


def ag_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted centroid, population deviation, exact quantile, conditional counts, mode and joined names by city."""
    work = visits(spark, sf).groupBy("city", "engineer_code", "service_month").agg(F.sum("service_min").alias("minutes"), F.countDistinct("receipt_no").alias("jobs"), F.avg("latitude").alias("lat"), F.min("center_type").alias("center"))
    return work.groupBy("city").agg(F.round(F.sum(F.col("lat") * F.col("jobs")) / F.sum("jobs"), 6).alias("centroid_lat"), F.round(F.stddev_pop("jobs"), 6).alias("jobs_std"), F.round(F.percentile("minutes", 0.95), 4).alias("p95"), F.count_if(F.col("minutes") > 480).alias("overflow"), F.round(F.avg(F.when(F.col("minutes") > 480, 1.0).otherwise(0.0)) * 100, 4).alias("overflow_pct"), F.array_join(F.sort_array(F.collect_set("center")), " | ").alias("centers"))


def ag_mode_and_first(spark: SparkSession, sf: str) -> DataFrame:
    v = visits(spark, sf)
    return v.groupBy("city").agg(F.mode("symptom", True).alias("symptom_mode"), F.min_by("product_group", F.struct("l_orderkey", "l_linenumber", "product_group")).alias("first_group"))


def ag_busiest(spark: SparkSession, sf: str) -> DataFrame:
    """The engineer with most work each month, and the most frequent region of a postal code's engineers."""
    work = visits(spark, sf).groupBy("service_month", "engineer_code").agg(F.sum("service_min").alias("minutes"))
    return R.keep_first(work, ["service_month"], [F.col("minutes").desc(), F.col("engineer_code")])


def ag_most_frequent(spark: SparkSession, sf: str) -> DataFrame:
    return R.most_frequent(visits(spark, sf), "postal_code", "center_type")


def ag_region_workload(spark: SparkSession, sf: str) -> DataFrame:
    v = visits(spark, sf).join(regions(spark, sf), "postal_code")
    return v.groupBy("region_seq").agg(F.sum("service_min").alias("minutes"), F.count_if(F.coalesce("is_heavy", F.lit(False))).alias("heavy"), F.countDistinct("receipt_no").alias("receipts"), F.round(F.avg("latitude"), 9).alias("center_lat")).orderBy(F.col("minutes").desc(), F.col("heavy").desc(), F.col("receipts").desc())


def ag_zip_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return R.overlap_ratio(visits(spark, sf), regions(spark, sf)).withColumn("ratio", F.round("ratio", 4))


def ag_engineer_month(spark: SparkSession, sf: str) -> DataFrame:
    """Roster engineers of all months, with and without work."""
    return R.engineer_day(engineers(spark, sf), visits(spark, sf), "service_month")


def ag_staffing(spark: SparkSession, sf: str) -> DataFrame:
    v = visits(spark, sf).join(regions(spark, sf), "postal_code")
    only = lambda c, k: F.countDistinct(F.when(F.col("center_type") == k, F.col(c)))
    return v.groupBy("region_seq", "service_month").agg(only("engineer_code", "DMS").alias("dms"), only("engineer_code", "DMS2").alias("dms2"), only("receipt_no", "DMS").alias("dms_receipts"), only("receipt_no", "DMS2").alias("dms2_receipts"), F.countDistinct("receipt_no").alias("receipts"))


def ag_profile_counters(spark: SparkSession, sf: str) -> DataFrame:
    e = engineers(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("city").alias("cities"), F.count("slot").alias("with_slot"), F.count_if(F.col("slot").isNull()).alias("without_slot"))
    return e.unpivot([], ["rows", "cities", "with_slot", "without_slot"], "metric", "value")


def ag_null_groups(spark: SparkSession, sf: str) -> DataFrame:
    return engineers(spark, sf).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


def ag_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts by day and the day's quota left of 1000."""
    e = table(spark, sf, "events")
    return e.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("attempts"), F.countDistinct("user_id").alias("users")).withColumn("quota_left", F.greatest(F.lit(1000) - F.col("attempts"), F.lit(0)))


def ag_integrated_area(spark: SparkSession, sf: str) -> DataFrame:
    daily = visits(spark, sf).join(regions(spark, sf), "postal_code").groupBy("city", "region_seq", "service_date").agg(F.countDistinct("receipt_no").alias("n"))
    return daily.groupBy("city", "region_seq").agg(F.sum("n").alias("total"), F.max("n").alias("max_daily"), F.round(F.avg("n"), 2).alias("avg_daily"))


def ag_bucket_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Postal codes in region A and in area B, and those on one side only."""
    v = visits(spark, sf).select("postal_code", "symptom").distinct().join(regions(spark, sf), "postal_code")
    a = v.groupBy("region_seq").agg(F.countDistinct("postal_code").alias("in_region"))
    b = v.groupBy("symptom").agg(F.countDistinct("postal_code").alias("in_bucket"))
    both = v.groupBy("region_seq", "symptom").agg(F.countDistinct("postal_code").alias("both"))
    return both.join(a, "region_seq").join(b, "symptom").select("region_seq", "symptom", "both", (F.col("in_region") - F.col("both")).alias("region_only"), (F.col("in_bucket") - F.col("both")).alias("bucket_only"))


def wn_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    """One line of each receipt: the longest work first, then the first line."""
    v = visits(spark, sf)
    return R.keep_first(v, ["receipt_no"], [F.col("service_min").desc(), F.col("l_linenumber"), F.col("engineer_code")]).select("receipt_no", "l_linenumber", "service_min", "engineer_code")


def wn_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return R.duplicates(visits(spark, sf).select("receipt_no", "engineer_code", "l_linenumber"), ["receipt_no", "engineer_code"])


def wn_job_priority(spark: SparkSession, sf: str) -> DataFrame:
    """Order of a day's jobs: television sets (here the brands that begin with 1), heavy repairs, long work, receipt."""
    v = R.keep_first(visits(spark, sf), ["receipt_no"], [F.col("service_min").desc(), *[F.col(c) for c in ("l_linenumber", "engineer_code", "service_date")]])
    w = Window.partitionBy("city", "service_date").orderBy(F.col("product_group").startswith("Brand#1").desc(), F.col("is_heavy").desc(), F.col("service_min").desc(), F.col("receipt_no"))
    return v.select("city", "service_date", "receipt_no", F.row_number().over(w).alias("priority"))


def wn_fixed_slot(spark: SparkSession, sf: str) -> DataFrame:
    """The n-th visit of a day takes the n-th slot; beyond the list an hour more for each step."""
    v = visits(spark, sf).select("engineer_code", "service_date", "receipt_no").distinct()
    seq = F.row_number().over(Window.partitionBy("engineer_code", "service_date").orderBy("receipt_no"))
    slots = F.array_sort(F.array_distinct(F.array(F.lit(660), F.lit(540), F.lit(600), F.lit(540))))
    at = F.when(F.col("seq") <= F.size(slots), F.try_element_at(slots, F.col("seq"))).otherwise(F.element_at(slots, 1) + (F.col("seq") - 1) * 60)
    return v.withColumn("seq", seq).select("engineer_code", "service_date", "receipt_no", "seq", at.alias("minute"))


def so_latest_request(spark: SparkSession, sf: str) -> DataFrame:
    """The latest event of each user by time and id."""
    e = table(spark, sf, "events")
    return R.keep_first(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


QUERIES = {f.__name__: f for f in (ag_daily_rollup, ag_postal_stats, ag_capacity, ag_distribution, ag_mode_and_first, ag_busiest, ag_most_frequent, ag_region_workload, ag_zip_overlap, ag_engineer_month, ag_staffing, ag_profile_counters, ag_null_groups, ag_attempts, ag_integrated_area, ag_bucket_overlap, wn_keep_first, wn_duplicates, wn_job_priority, wn_fixed_slot, so_latest_request)}
_OVERLAP = "per AS (SELECT engineer_code, region_seq, count(DISTINCT postal_code) AS overlap FROM visits JOIN regions USING (postal_code) GROUP BY 1, 2), tot AS (SELECT engineer_code, count(DISTINCT postal_code) AS total FROM visits GROUP BY 1), o AS (SELECT engineer_code, region_seq, overlap, total, CAST(overlap AS DOUBLE) / total AS ratio FROM per JOIN tot USING (engineer_code))"
_LONGEST = "f AS (SELECT *, row_number() OVER (PARTITION BY receipt_no ORDER BY service_min DESC, l_linenumber, engineer_code, service_date) AS rn FROM visits)"
SQL = {
    "ag_daily_rollup": f"WITH {VISITS_SQL}, d AS (SELECT city, service_date, count(DISTINCT receipt_no) AS n FROM visits GROUP BY 1, 2) SELECT city, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 4) AS mean_daily, max(n) AS max_daily, count(DISTINCT service_date) AS days FROM d GROUP BY 1",
    "ag_postal_stats": f"WITH {VISITS_SQL}, d AS (SELECT city, postal_code, service_date, count(DISTINCT receipt_no) AS n, avg(latitude) AS la, avg(longitude) AS lo, count(DISTINCT engineer_code) AS e FROM visits GROUP BY 1, 2, 3), c AS (SELECT city, count(DISTINCT service_date) AS cd FROM visits GROUP BY 1), s AS (SELECT city, postal_code, CAST(sum(n) AS BIGINT) AS total, max(n) AS max_daily, count(*) AS days, round(avg(la), 9) AS latitude, round(avg(lo), 9) AS longitude, max(e) AS engineers FROM d GROUP BY 1, 2) SELECT s.city, postal_code, total, max_daily, days, latitude, longitude, engineers, round(CAST(total AS DOUBLE) / cd, 2) AS rate FROM s JOIN c ON c.city = s.city WHERE round(CAST(total AS DOUBLE) / cd, 2) > 0",
    "ag_capacity": f"WITH {ENGINEERS_SQL} SELECT city, count(DISTINCT engineer_code) AS engineers, CAST(coalesce(sum(slot), 0) AS BIGINT) AS slots, round(coalesce(avg(slot), 7.0), 4) AS mean_slot, CAST(coalesce(median(slot), 7.0) AS DOUBLE) AS median_slot FROM engineers GROUP BY 1",
    "ag_distribution": f"WITH {VISITS_SQL}, w AS (SELECT city, engineer_code, service_month, sum(service_min) AS minutes, count(DISTINCT receipt_no) AS jobs, avg(latitude) AS lat, min(center_type) AS center FROM visits GROUP BY 1, 2, 3) SELECT city, round(sum(lat * jobs) / sum(jobs), 6) AS centroid_lat, round(stddev_pop(jobs), 6) AS jobs_std, round(quantile_cont(minutes, 0.95), 4) AS p95, count(*) FILTER (WHERE minutes > 480) AS overflow, round(avg(CASE WHEN minutes > 480 THEN 1.0 ELSE 0.0 END) * 100, 4) AS overflow_pct, string_agg(DISTINCT center, ' | ' ORDER BY center) AS centers FROM w GROUP BY 1",
    "ag_mode_and_first": f"WITH {VISITS_SQL}, c AS (SELECT city, symptom, row_number() OVER (PARTITION BY city ORDER BY count(*) DESC, symptom) AS rn FROM visits GROUP BY 1, 2), g AS (SELECT city, product_group, row_number() OVER (PARTITION BY city ORDER BY l_orderkey, l_linenumber, product_group) AS rn FROM visits) SELECT c.city, symptom AS symptom_mode, product_group AS first_group FROM c JOIN g ON c.city = g.city AND c.rn = 1 AND g.rn = 1",
    "ag_busiest": f"WITH {VISITS_SQL}, w AS (SELECT service_month, engineer_code, CAST(sum(service_min) AS BIGINT) AS minutes FROM visits GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY service_month ORDER BY minutes DESC, engineer_code) AS rn FROM w) SELECT service_month, engineer_code, minutes FROM k WHERE rn = 1",
    "ag_most_frequent": f"WITH {VISITS_SQL}, w AS (SELECT postal_code, center_type, count(*) AS n FROM visits GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY postal_code ORDER BY n DESC, center_type) AS rn FROM w) SELECT postal_code, center_type, n FROM k WHERE rn = 1",
    "ag_region_workload": f"WITH {VISITS_SQL}, {_REGIONS} SELECT region_seq, CAST(sum(service_min) AS BIGINT) AS minutes, count(*) FILTER (WHERE is_heavy) AS heavy, count(DISTINCT receipt_no) AS receipts, round(avg(latitude), 9) AS center_lat FROM visits JOIN regions USING (postal_code) GROUP BY 1",
    "ag_zip_overlap": f"WITH {VISITS_SQL}, {_REGIONS}, {_OVERLAP} SELECT engineer_code, region_seq, overlap, total, round(ratio, 4) AS ratio FROM o",
    "ag_engineer_month": f"WITH {VISITS_SQL}, {ENGINEERS_SQL}, d AS (SELECT DISTINCT service_month FROM visits), w AS (SELECT engineer_code, service_month, count(DISTINCT receipt_no) AS jobs, sum(service_min) AS m FROM visits GROUP BY 1, 2) SELECT e.engineer_code, d.service_month, e.center_type, coalesce(jobs, 0) AS job_count, CAST(coalesce(m, 0) AS BIGINT) AS service_min, coalesce(m, 0) > 480 AS overflow_480 FROM engineers e CROSS JOIN d LEFT JOIN w ON w.engineer_code = e.engineer_code AND w.service_month = d.service_month",
    "ag_staffing": f"WITH {VISITS_SQL}, {_REGIONS} SELECT region_seq, service_month, count(DISTINCT CASE WHEN center_type = 'DMS' THEN engineer_code END) AS dms, count(DISTINCT CASE WHEN center_type = 'DMS2' THEN engineer_code END) AS dms2, count(DISTINCT CASE WHEN center_type = 'DMS' THEN receipt_no END) AS dms_receipts, count(DISTINCT CASE WHEN center_type = 'DMS2' THEN receipt_no END) AS dms2_receipts, count(DISTINCT receipt_no) AS receipts FROM visits JOIN regions USING (postal_code) GROUP BY 1, 2",
    "ag_profile_counters": f"WITH {ENGINEERS_SQL} SELECT 'rows' AS metric, count(*) AS value FROM engineers UNION ALL SELECT 'cities', count(DISTINCT city) FROM engineers UNION ALL SELECT 'with_slot', count(slot) FROM engineers UNION ALL SELECT 'without_slot', count(*) - count(slot) FROM engineers",
    "ag_null_groups": f"WITH {ENGINEERS_SQL} SELECT slot, count(*) AS n FROM engineers GROUP BY 1",
    "ag_attempts": "SELECT CAST(ts AS DATE) AS day, count(*) AS attempts, count(DISTINCT user_id) AS users, greatest(1000 - count(*), 0) AS quota_left FROM events GROUP BY 1",
    "ag_integrated_area": f"WITH {VISITS_SQL}, {_REGIONS}, d AS (SELECT city, region_seq, service_date, count(DISTINCT receipt_no) AS n FROM visits JOIN regions USING (postal_code) GROUP BY 1, 2, 3) SELECT city, region_seq, CAST(sum(n) AS BIGINT) AS total, max(n) AS max_daily, round(avg(n), 2) AS avg_daily FROM d GROUP BY 1, 2",
    "ag_bucket_overlap": f"WITH {VISITS_SQL}, {_REGIONS}, v AS (SELECT DISTINCT postal_code, symptom, region_seq FROM visits JOIN regions USING (postal_code)), a AS (SELECT region_seq, count(DISTINCT postal_code) AS n FROM v GROUP BY 1), b AS (SELECT symptom, count(DISTINCT postal_code) AS n FROM v GROUP BY 1), c AS (SELECT region_seq, symptom, count(DISTINCT postal_code) AS n FROM v GROUP BY 1, 2) SELECT c.region_seq, c.symptom, c.n AS both, a.n - c.n AS region_only, b.n - c.n AS bucket_only FROM c JOIN a ON a.region_seq = c.region_seq JOIN b ON b.symptom = c.symptom",
    "wn_keep_first": f"WITH {VISITS_SQL}, {_LONGEST} SELECT receipt_no, l_linenumber, service_min, engineer_code FROM f WHERE rn = 1",
    "wn_duplicates": f"WITH {VISITS_SQL}, k AS (SELECT receipt_no, engineer_code, l_linenumber, count(*) OVER (PARTITION BY receipt_no, engineer_code) AS n FROM visits) SELECT receipt_no, engineer_code, l_linenumber FROM k WHERE n > 1",
    "wn_job_priority": f"WITH {VISITS_SQL}, {_LONGEST} SELECT city, service_date, receipt_no, row_number() OVER (PARTITION BY city, service_date ORDER BY CASE WHEN starts_with(product_group, 'Brand#1') THEN 0 ELSE 1 END, CASE WHEN is_heavy THEN 0 ELSE 1 END, service_min DESC, receipt_no) AS priority FROM f WHERE rn = 1",
    "wn_fixed_slot": f"WITH {VISITS_SQL}, v AS (SELECT DISTINCT engineer_code, service_date, receipt_no FROM visits), k AS (SELECT *, row_number() OVER (PARTITION BY engineer_code, service_date ORDER BY receipt_no) AS seq FROM v) SELECT engineer_code, service_date, receipt_no, seq, 540 + (seq - 1) * 60 AS minute FROM k",
    "so_latest_request": "WITH k AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_id, event_type FROM k WHERE rn = 1",
}
