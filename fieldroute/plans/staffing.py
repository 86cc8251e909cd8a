"""Queries of eligibility, penalties and staffing around regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldroute.functions.geo import MERCATOR_M, haversine_km, haversine_sql, mercator
from fieldroute.functions.penalties import preference_km, soft_region_km
from fieldroute.operators import relational as R
from fieldroute.plans import joins
from fieldroute.plans.aggregates import _OVERLAP, _REGIONS, regions
from fieldroute.session import table
from fieldroute.sources.adapter import ENGINEERS_SQL, VISITS_SQL, engineers, visits


def wn_nearest_engineers(spark: SparkSession, sf: str) -> DataFrame:
    """Three engineers of a city for each region centre: nearest home, most postal codes there, their share, code."""
    o = R.overlap_ratio(visits(spark, sf), regions(spark, sf)).select("engineer_code", F.col("region_seq").alias("anchor_region"), "overlap", "ratio")
    c = joins.centres(spark, sf).withColumnRenamed("region_seq", "anchor_region")
    e = engineers(spark, sf).select("city", "engineer_code", "home_lat", "home_lon").join(c, "city").join(o, ["engineer_code", "anchor_region"], "left").fillna(0, ["overlap", "ratio"])
    e = e.withColumn("km", F.round(haversine_km(F.col("home_lat"), F.col("home_lon"), F.col("latitude"), F.col("longitude")), 6))
    order = [F.col("km"), F.col("overlap").desc(), F.col("ratio").desc(), F.col("engineer_code")]
    return R.top_n(e, ["city", "anchor_region"], order, 3).select("city", "anchor_region", "engineer_code", "overlap", "rank")


def jn_product_skill(spark: SparkSession, sf: str) -> DataFrame:
    """Engineers of a city who may serve each product group: any without skills, all where no product is named, else the skilled.

    Skills are the groups of an engineer's heavy repairs; Brand#11 stands for an unnamed product.
    """
    v = visits(spark, sf)
    wanted = v.select("city", F.when(F.col("product_group") == "Brand#11", "").otherwise(F.col("product_group")).alias("product")).distinct()
    known = v.where("is_heavy").groupBy("engineer_code").agg(F.collect_set("product_group").alias("skills"))
    techs = engineers(spark, sf).select("city", "engineer_code").join(known, "engineer_code", "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))
    may = (F.size("skills") == 0) | (F.col("product") == "") | F.expr("array_contains(skills, product)")
    return wanted.join(techs, "city").groupBy("city", "product").agg(F.count_if(may).alias("eligible"), F.count(F.lit(1)).alias("engineers"))


def sc_penalties(spark: SparkSession, sf: str) -> DataFrame:
    """Preference and soft-region penalty of every service line for the engineer who did it."""
    own = engineers(spark, sf).select("engineer_code", F.col("region_seq").alias("own_region"))
    v = visits(spark, sf).join(regions(spark, sf), "postal_code").join(own, "engineer_code")
    v = v.join(joins.jn_preference(spark, sf).withColumnRenamed("cluster", "region_seq"), ["city", "region_seq"], "left")
    preference = preference_km(F.col("engineer_code"), F.col("primary_code"), F.col("secondary_code"))
    soft = soft_region_km(F.col("center_type"), F.col("own_region"), F.col("region_seq"))
    return v.select("l_orderkey", "l_linenumber", "engineer_code", preference.alias("preference_km"), soft.alias("soft_region_km"))


def ag_attempts_month(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts by month."""
    return table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("attempts"))


def ag_payload_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs, heavy jobs and the distribution of service minutes of each city and date, counted before they are put together."""
    counts = visits(spark, sf).groupBy("city", "service_date", "service_min").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_heavy").alias("heavy"))
    spelt = F.transform(F.sort_array(F.collect_list(F.struct("service_min", "n"))), lambda x: F.concat_ws(":", x["service_min"].cast("string"), x["n"].cast("string")))
    return counts.groupBy("city", "service_date").agg(F.sum("n").alias("jobs"), F.sum("heavy").alias("heavy_jobs"), F.array_join(spelt, ",").alias("minutes"))


def ag_city_overall(spark: SparkSession, sf: str) -> DataFrame:
    """One row a city over engineer-days: rounded mean, 95 % quantile, maximum, share over 480 minutes, the worst engineer."""
    day = visits(spark, sf).groupBy("city", "engineer_code", "service_date").agg(F.sum("service_min").alias("minutes"))
    worst = F.max_by("engineer_code", F.struct("minutes", "engineer_code", "service_date"))
    share = 100.0 * F.count_if(F.col("minutes") > 480) / F.count(F.lit(1))
    return day.groupBy("city").agg(F.round(F.avg("minutes"), 2).alias("mean_minutes"), F.round(F.percentile("minutes", 0.95), 2).alias("p95"), F.max("minutes").alias("longest"), F.round(share, 2).alias("overflow_pct"), worst.alias("worst_engineer"))


def flt_located(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose coordinates did not fail, by source; a row without a source stays."""
    found = joins.jn_overlay(spark, sf).withColumn("source", F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), F.col("source"))))
    return found.where(F.coalesce(F.trim("source"), F.lit("nan")) != "failed").groupBy(F.trim("source").alias("source")).agg(F.count(F.lit(1)).alias("n"))


def _sides(spark, sf):
    """Actual work (no line of symptom A) and assigned work (none of symptom R), with the region of the postal code."""
    v = visits(spark, sf).join(regions(spark, sf), "postal_code")
    return v.where("symptom <> 'A'"), v.where("symptom <> 'R'")


def rp_attendance(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct engineers at work by date, region and type of center."""
    return _sides(spark, sf)[0].groupBy("service_date", "region_seq", "center_type").agg(F.countDistinct("engineer_code").alias("engineers"))


def rp_region_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Actual against assigned engineers by region and date, in all and by type of center; a side without any counts 0."""
    def heads(side, name):
        only = lambda k: F.countDistinct(F.when(F.col("center_type") == k, F.col("engineer_code"))).alias(f"{name}_{k.lower()}")
        return side.groupBy("service_date", "region_seq").agg(F.countDistinct("engineer_code").alias(f"{name}_total"), only("DMS"), only("DMS2"))

    actual, assigned = _sides(spark, sf)
    both = heads(actual, "actual").join(heads(assigned, "assigned"), ["service_date", "region_seq"], "full_outer").fillna(0)
    return both.withColumns({f"gap_{k}": F.col(f"assigned_{k}") - F.col(f"actual_{k}") for k in ("total", "dms", "dms2")})


def rp_region_shortage(spark: SparkSession, sf: str) -> DataFrame:
    """Regions and dates with fewer assigned than actual engineers, with the actual work there, widest gap first."""
    work = _sides(spark, sf)[0].groupBy("service_date", "region_seq").agg(F.countDistinct("receipt_no").alias("jobs"), F.count_if("is_heavy").alias("heavy_lines"), F.sum("service_min").alias("minutes"))
    short = rp_region_gap(spark, sf).where("gap_total < 0").select("service_date", "region_seq", "actual_total", "assigned_total", "gap_total")
    return short.join(work, ["service_date", "region_seq"], "left").orderBy("gap_total", "service_date", "region_seq")


def rp_engineer_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs and minutes of each engineer and date in both scenarios, side by side, with deltas."""
    def work(side, name):
        return side.groupBy("service_date", "engineer_code").agg(F.countDistinct("receipt_no").alias(f"jobs_{name}"), F.sum("service_min").alias(f"minutes_{name}"))

    a, b = _sides(spark, sf)
    both = work(a, "a").join(work(b, "b"), ["service_date", "engineer_code"], "full_outer").fillna(0)
    return both.withColumn("jobs_delta", F.col("jobs_b") - F.col("jobs_a")).withColumn("minutes_delta", F.col("minutes_b") - F.col("minutes_a"))


def df_active_count(spark: SparkSession, sf: str) -> DataFrame:
    """Engineers wanted for each city and date: one for four receipts, at least one, at most those of the city."""
    need = visits(spark, sf).groupBy("city", "service_date").agg(F.countDistinct("receipt_no").alias("receipts"))
    have = engineers(spark, sf).groupBy("city").agg(F.countDistinct("engineer_code").alias("engineers"))
    active = F.greatest(F.lit(1), F.least(F.col("engineers"), F.ceil(F.col("receipts") / 4)))
    return need.join(have, "city").select("city", "service_date", "receipts", active.alias("active"))


def xt_default_technicians(spark: SparkSession, sf: str) -> DataFrame:
    """The engineers of a city's jobs with the master's type of center and the default shift, slots and limit."""
    found = visits(spark, sf).select("city", "engineer_code").distinct()
    master = engineers(spark, sf).where("region_seq <> 3").select("engineer_code", "center_type")
    shift = [F.lit("09:00").alias("shift_start"), F.lit("18:00").alias("shift_end"), F.lit(8).alias("slot_count"), F.lit(8).alias("max_jobs")]
    return found.join(master, "engineer_code", "left").select("city", "engineer_code", F.coalesce("center_type", F.lit("")).alias("center_type"), *shift)


def prj_planned_time(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a readable yyyymmdd date and their planned time, 09:00 where none is stated."""
    key = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select("o_orderkey", F.when(key % 13 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("day"), F.when(key % 3 == 0, "").when(key % 3 == 1, "13:30").alias("at"))
    parsed = raw.withColumn("service_date", F.try_to_timestamp("day", F.lit("yyyyMMdd")).cast("date")).where("service_date is not null")
    at = F.coalesce(F.nullif(F.trim("at"), F.lit("")), F.lit("09:00"))
    return parsed.select("o_orderkey", "service_date", F.concat(F.date_format("service_date", "yyyy-MM-dd"), F.lit("T"), at, F.lit(":00-05:00")).alias("planned"))


def jn_planar_centre(spark: SparkSession, sf: str) -> DataFrame:
    """Postal codes outside the regions (here those that end in 0 or 5) to the nearest centre of their city on the mercator plane, the smaller region on ties."""
    x, y = mercator(F.col("latitude"), F.col("longitude"))
    p = joins._postals(spark, sf).where("right(postal_code, 1) in ('0', '5')").select("city", "postal_code", x.alias("x"), y.alias("y"))
    c = joins.centres(spark, sf).select("city", "region_seq", x.alias("cx"), y.alias("cy"))
    metres = F.round(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")), 3)
    best = p.join(c, "city").groupBy("city", "postal_code").agg(F.min(F.struct(metres.alias("metres"), "region_seq")).alias("b"))
    return best.select("city", "postal_code", "b.region_seq", F.round(F.col("b.metres") / 1000, 3).alias("km"))


def wn_first_input(spark: SparkSession, sf: str) -> DataFrame:
    """Visits without repeated (postal code, product group), the first in input order, which order and line number state."""
    v = visits(spark, sf).select("l_orderkey", "l_linenumber", "engineer_code", "postal_code", "product_group")
    return R.keep_first(v, ["postal_code", "product_group"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("engineer_code")])


def xt_located_split(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with both coordinates and rows without, counted by source."""
    both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return joins.jn_overlay(spark, sf).groupBy(both.alias("located"), "source").agg(F.count(F.lit(1)).alias("n"))


def ag_daily_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """By date: jobs, heavy jobs, engineers at work, minutes and jobs an engineer with deviation, maximum and overflow."""
    v = visits(spark, sf)
    day = v.groupBy("service_date").agg(F.countDistinct("receipt_no").alias("jobs"), F.count_if("is_heavy").alias("heavy_lines"))
    per = v.groupBy("service_date", "engineer_code").agg(F.sum("service_min").alias("m"), F.countDistinct("receipt_no").alias("j"))
    who = per.groupBy("service_date").agg(F.count(F.lit(1)).alias("engineers"), F.sum("m").alias("minutes"), F.round(F.avg("m"), 4).alias("mean_minutes"), F.round(F.stddev_pop("m"), 4).alias("std_minutes"), F.max("m").alias("longest"), F.max("j").alias("most_jobs"), F.min("j").alias("fewest_jobs"), F.round(F.stddev_pop("j"), 4).alias("std_jobs"), F.count_if(F.col("m") > 480).alias("overflow"))
    return day.join(who, "service_date")


QUERIES = {f.__name__: f for f in (wn_nearest_engineers, jn_product_skill, sc_penalties, ag_attempts_month, ag_payload_minutes, ag_city_overall, flt_located, rp_attendance, rp_region_gap, rp_region_shortage, rp_engineer_scenarios, df_active_count, xt_default_technicians, prj_planned_time, jn_planar_centre, wn_first_input, xt_located_split, ag_daily_metrics)}

_SIDES = f"{VISITS_SQL}, {_REGIONS}, w AS (SELECT * FROM visits JOIN regions USING (postal_code))"
_GAP = f"""{_SIDES}, h AS (SELECT service_date, region_seq, count(DISTINCT CASE WHEN symptom <> 'A' THEN engineer_code END) AS actual_total, count(DISTINCT CASE WHEN symptom <> 'R' THEN engineer_code END) AS assigned_total,
 count(DISTINCT CASE WHEN symptom <> 'A' AND center_type = 'DMS' THEN engineer_code END) AS actual_dms, count(DISTINCT CASE WHEN symptom <> 'A' AND center_type = 'DMS2' THEN engineer_code END) AS actual_dms2,
 count(DISTINCT CASE WHEN symptom <> 'R' AND center_type = 'DMS' THEN engineer_code END) AS assigned_dms, count(DISTINCT CASE WHEN symptom <> 'R' AND center_type = 'DMS2' THEN engineer_code END) AS assigned_dms2 FROM w GROUP BY 1, 2),
g AS (SELECT *, assigned_total - actual_total AS gap_total, assigned_dms - actual_dms AS gap_dms, assigned_dms2 - actual_dms2 AS gap_dms2 FROM h)"""

SQL = {
    "wn_nearest_engineers": f"""WITH {VISITS_SQL}, {ENGINEERS_SQL}, {_REGIONS}, {joins._CENTRES}, {_OVERLAP},
k AS (SELECT e.city, c.region_seq AS anchor_region, e.engineer_code, coalesce(o.overlap, 0) AS overlap, row_number() OVER (PARTITION BY e.city, c.region_seq
 ORDER BY round({haversine_sql('e.home_lat', 'e.home_lon', 'c.latitude', 'c.longitude')}, 6), coalesce(o.overlap, 0) DESC, coalesce(o.ratio, 0) DESC, e.engineer_code) AS rank
 FROM engineers e JOIN centres c ON c.city = e.city LEFT JOIN o ON o.engineer_code = e.engineer_code AND o.region_seq = c.region_seq)
SELECT * FROM k WHERE rank <= 3""",
    "jn_product_skill": f"""WITH {VISITS_SQL}, {ENGINEERS_SQL}, w AS (SELECT DISTINCT city, CASE WHEN product_group = 'Brand#11' THEN '' ELSE product_group END AS product FROM visits),
s AS (SELECT DISTINCT engineer_code, product_group FROM visits WHERE is_heavy)
SELECT w.city, w.product, count(*) FILTER (WHERE w.product = '' OR NOT EXISTS (SELECT 1 FROM s WHERE s.engineer_code = e.engineer_code)
 OR EXISTS (SELECT 1 FROM s WHERE s.engineer_code = e.engineer_code AND s.product_group = w.product)) AS eligible, count(*) AS engineers
FROM w JOIN engineers e ON e.city = w.city GROUP BY 1, 2""",
    "sc_penalties": f"""WITH {VISITS_SQL}, {ENGINEERS_SQL}, {_REGIONS}, p AS ({joins.SQL['jn_preference']})
SELECT v.l_orderkey, v.l_linenumber, v.engineer_code,
 CAST(CASE WHEN p.primary_code IS NULL AND p.secondary_code IS NULL THEN 0 WHEN v.engineer_code = p.primary_code THEN 0 WHEN v.engineer_code = p.secondary_code THEN 8 ELSE 28 END AS DOUBLE) AS preference_km,
 CAST(CASE WHEN e.region_seq = r.region_seq THEN 0 WHEN v.center_type = 'DMS' THEN 18 ELSE 8 END AS DOUBLE) AS soft_region_km
FROM visits v JOIN regions r USING (postal_code) JOIN engineers e ON e.engineer_code = v.engineer_code LEFT JOIN p ON p.city = v.city AND p.cluster = r.region_seq""",
    "ag_attempts_month": "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS attempts FROM events GROUP BY 1",
    "ag_payload_minutes": f"""WITH {VISITS_SQL}, c AS (SELECT city, service_date, service_min, count(*) AS n, count(*) FILTER (WHERE is_heavy) AS heavy FROM visits GROUP BY 1, 2, 3)
SELECT city, service_date, CAST(sum(n) AS BIGINT) AS jobs, CAST(sum(heavy) AS BIGINT) AS heavy_jobs, string_agg(service_min || ':' || n, ',' ORDER BY service_min) AS minutes FROM c GROUP BY 1, 2""",
    "ag_city_overall": f"""WITH {VISITS_SQL}, d AS (SELECT city, engineer_code, service_date, CAST(sum(service_min) AS BIGINT) AS minutes FROM visits GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY minutes DESC, engineer_code DESC, service_date DESC) AS rn FROM d)
SELECT city, round(avg(minutes), 2) AS mean_minutes, round(quantile_cont(minutes, 0.95), 2) AS p95, max(minutes) AS longest,
 round(100.0::DOUBLE * count(*) FILTER (WHERE minutes > 480) / count(*), 2) AS overflow_pct, max(engineer_code) FILTER (WHERE rn = 1) AS worst_engineer FROM k GROUP BY 1""",
    "flt_located": f"""WITH f AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE source END AS source FROM ({joins.SQL['jn_overlay']}))
SELECT source, count(*) AS n FROM f WHERE coalesce(source, 'nan') <> 'failed' GROUP BY 1""",
    "rp_attendance": f"WITH {_SIDES} SELECT service_date, region_seq, center_type, count(DISTINCT engineer_code) AS engineers FROM w WHERE symptom <> 'A' GROUP BY 1, 2, 3",
    "rp_region_gap": f"WITH {_GAP} SELECT * FROM g",
    "rp_region_shortage": f"""WITH {_GAP}, k AS (SELECT service_date, region_seq, count(DISTINCT receipt_no) AS jobs, count(*) FILTER (WHERE is_heavy) AS heavy_lines, CAST(sum(service_min) AS BIGINT) AS minutes FROM w WHERE symptom <> 'A' GROUP BY 1, 2)
SELECT g.service_date, g.region_seq, actual_total, assigned_total, gap_total, jobs, heavy_lines, minutes FROM g LEFT JOIN k ON k.service_date = g.service_date AND k.region_seq = g.region_seq WHERE gap_total < 0""",
    "rp_engineer_scenarios": f"""WITH {_SIDES}, k AS (SELECT service_date, engineer_code, count(DISTINCT CASE WHEN symptom <> 'A' THEN receipt_no END) AS jobs_a, CAST(coalesce(sum(service_min) FILTER (WHERE symptom <> 'A'), 0) AS BIGINT) AS minutes_a,
 count(DISTINCT CASE WHEN symptom <> 'R' THEN receipt_no END) AS jobs_b, CAST(coalesce(sum(service_min) FILTER (WHERE symptom <> 'R'), 0) AS BIGINT) AS minutes_b FROM w GROUP BY 1, 2)
SELECT *, jobs_b - jobs_a AS jobs_delta, minutes_b - minutes_a AS minutes_delta FROM k""",
    "df_active_count": f"""WITH {VISITS_SQL}, {ENGINEERS_SQL}, n AS (SELECT city, service_date, count(DISTINCT receipt_no) AS receipts FROM visits GROUP BY 1, 2), h AS (SELECT city, count(DISTINCT engineer_code) AS c FROM engineers GROUP BY 1)
SELECT n.city, service_date, receipts, CAST(greatest(1, least(c, (receipts + 3) // 4)) AS BIGINT) AS active FROM n JOIN h ON h.city = n.city""",
    "xt_default_technicians": f"""WITH {VISITS_SQL}, {ENGINEERS_SQL}, v AS (SELECT DISTINCT city, engineer_code FROM visits)
SELECT v.city, v.engineer_code, coalesce(e.center_type, '') AS center_type, '09:00' AS shift_start, '18:00' AS shift_end, 8 AS slot_count, 8 AS max_jobs FROM v LEFT JOIN engineers e ON e.engineer_code = v.engineer_code AND e.region_seq <> 3""",
    "prj_planned_time": """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS service_date, strftime(o_orderdate, '%Y-%m-%d') || 'T' || CASE WHEN o_orderkey % 3 = 1 THEN '13:30' ELSE '09:00' END || ':00-05:00' AS planned FROM orders WHERE o_orderkey % 13 <> 0""",
    "jn_planar_centre": f"""WITH {VISITS_SQL}, {ENGINEERS_SQL}, {joins._CENTRES}, {joins._POSTALS},
k AS (SELECT p.city, p.postal_code, c.region_seq, round(sqrt(pow({MERCATOR_M}::DOUBLE * (radians(p.longitude) - radians(c.longitude)), 2)
 + pow({MERCATOR_M}::DOUBLE * (ln(tan(pi() / 4 + radians(p.latitude) / 2)) - ln(tan(pi() / 4 + radians(c.latitude) / 2))), 2)), 3) AS metres
 FROM postals p JOIN centres c ON c.city = p.city WHERE right(p.postal_code, 1) IN ('0', '5')),
r AS (SELECT *, row_number() OVER (PARTITION BY city, postal_code ORDER BY metres, region_seq) AS rn FROM k)
SELECT city, postal_code, region_seq, round(metres / 1000, 3) AS km FROM r WHERE rn = 1""",
    "wn_first_input": f"""WITH {VISITS_SQL}, k AS (SELECT l_orderkey, l_linenumber, engineer_code, postal_code, product_group, row_number() OVER (PARTITION BY postal_code, product_group ORDER BY l_orderkey, l_linenumber, engineer_code) AS rn FROM visits)
SELECT l_orderkey, l_linenumber, engineer_code, postal_code, product_group FROM k WHERE rn = 1""",
    "xt_located_split": f"SELECT latitude IS NOT NULL AND longitude IS NOT NULL AS located, source, count(*) AS n FROM ({joins.SQL['jn_overlay']}) GROUP BY 1, 2",
    "ag_daily_metrics": f"""WITH {VISITS_SQL}, d AS (SELECT service_date, count(DISTINCT receipt_no) AS jobs, count(*) FILTER (WHERE is_heavy) AS heavy_lines FROM visits GROUP BY 1),
p AS (SELECT service_date, engineer_code, CAST(sum(service_min) AS BIGINT) AS m, count(DISTINCT receipt_no) AS j FROM visits GROUP BY 1, 2),
w AS (SELECT service_date, count(*) AS engineers, CAST(sum(m) AS BIGINT) AS minutes, round(avg(m), 4) AS mean_minutes, round(stddev_pop(m), 4) AS std_minutes, max(m) AS longest, max(j) AS most_jobs, min(j) AS fewest_jobs, round(stddev_pop(j), 4) AS std_jobs, count(*) FILTER (WHERE m > 480) AS overflow FROM p GROUP BY 1)
SELECT * FROM d JOIN w USING (service_date)""",
}
