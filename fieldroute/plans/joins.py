"""Queries of joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldroute.functions.geo import haversine_km, haversine_sql
from fieldroute.operators import relational as R
from fieldroute.session import table
from fieldroute.sources.adapter import ENGINEERS_SQL, VISITS_SQL, engineers, visits


def centres(spark, sf):
    return engineers(spark, sf).groupBy("city", "region_seq").agg(F.avg("home_lat").alias("latitude"), F.avg("home_lon").alias("longitude"))


_CENTRES = "centres AS (SELECT city, region_seq, avg(home_lat) AS latitude, avg(home_lon) AS longitude FROM engineers GROUP BY 1, 2)"


def _postals(spark, sf):
    return _places(visits(spark, sf))


def _places(lines: DataFrame) -> DataFrame:
    return lines.groupBy("city", "postal_code").agg(F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude"))


_POSTALS = "postals AS (SELECT city, postal_code, min(latitude) AS latitude, min(longitude) AS longitude FROM visits GROUP BY 1, 2)"


def jn_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Receipt coordinates win over cached ones; rows with neither fail."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey"), F.col("o_custkey"))
    own = rows.where("o_orderkey % 7 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") * 0.5).alias("latitude"), (F.col("o_orderkey") * 0.25).alias("longitude"))
    cache = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") * 0.5).alias("latitude"), (F.col("c_custkey") * 0.125).alias("longitude"))
    return R.lookup_with_override(rows, own, cache, "o_orderkey", "o_custkey").select("o_orderkey", F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"), "source")


def jn_nearest_centre(spark: SparkSession, sf: str) -> DataFrame:
    """Each postal code of a city to its nearest region centre."""
    got = R.nearest_centre(_postals(spark, sf), centres(spark, sf), ["city", "postal_code"], "city")
    return got.select("city", "postal_code", "region_seq", F.round("km", 4).alias("km"))


def jn_border_band(spark: SparkSession, sf: str) -> DataFrame:
    """Postal codes of regions 1 and 2 that region 3 may serve: within 15 km more and 1.35 times the own distance."""
    return border_band(visits(spark, sf), spark, sf)


def border_band(lines: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """The band of the postal codes of service lines."""
    own = centres(spark, sf).where("region_seq in (1, 2)").select("city", F.col("region_seq").alias("target_region"), F.col("latitude").alias("a"), F.col("longitude").alias("b"))
    other = centres(spark, sf).where("region_seq = 3").select("city", F.col("latitude").alias("c"), F.col("longitude").alias("d"))
    p = _places(lines).join(own, "city").join(other, "city")
    p = p.withColumn("own_km", haversine_km(F.col("latitude"), F.col("longitude"), F.col("a"), F.col("b"))).withColumn("source_km", haversine_km(F.col("latitude"), F.col("longitude"), F.col("c"), F.col("d")))
    near = (F.col("source_km") <= F.col("own_km") + 15) & (F.col("source_km") <= F.greatest(F.col("own_km") * 1.35, F.col("own_km") + 1))
    return p.where(near).select("city", "target_region", "postal_code", F.round("own_km", 4).alias("own_km"), F.round("source_km", 4).alias("source_km"))


def jn_distance_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Kilometres and minutes between the stops of one engineer-day."""
    v = visits(spark, sf).select("engineer_code", "service_date", "receipt_no", "latitude", "longitude").distinct()
    other = v.select("engineer_code", "service_date", F.col("receipt_no").alias("to_receipt"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"))
    km = haversine_km(F.col("latitude"), F.col("longitude"), F.col("lat2"), F.col("lon2"))
    pairs = v.join(other, ["engineer_code", "service_date"]).where("receipt_no <> to_receipt")
    return pairs.select("engineer_code", "service_date", "receipt_no", "to_receipt", F.round(km, 4).alias("km"), F.round(km / 50 * 60, 4).alias("minutes"))


def jn_skill(spark: SparkSession, sf: str) -> DataFrame:
    """Engineers who may do a day's work in their city: heavy work in one group needs the flag."""
    v = visits(spark, sf).groupBy("city", "service_month", "is_heavy").agg(F.countDistinct("receipt_no").alias("receipts"))
    # Counted by city before the join: a month meets one row, not its engineers.
    e = engineers(spark, sf).groupBy("city", "engineer_code").agg(F.max(F.col("ref_heavy") == "Y").alias("flag")).groupBy("city").agg(F.count("engineer_code").alias("all"), F.count(F.when(F.col("flag"), F.col("engineer_code"))).alias("flagged"))
    eligible = F.when(~F.col("is_heavy"), F.col("all")).otherwise(F.col("flagged"))
    return v.join(e, "city").withColumn("eligible", eligible).where("eligible > 0").select("city", "service_month", "is_heavy", "eligible", "receipts")


def jn_preference(spark: SparkSession, sf: str) -> DataFrame:
    """First and second engineer of each region centre: same region first, then nearest home, then code."""
    c = centres(spark, sf).withColumnRenamed("region_seq", "cluster")
    e = engineers(spark, sf).join(c, "city").withColumn("km", haversine_km(F.col("home_lat"), F.col("home_lon"), F.col("latitude"), F.col("longitude")))
    order = [(F.col("region_seq") == F.col("cluster")).desc(), F.round("km", 6), F.col("engineer_code")]
    ranked = R.top_n(e, ["city", "cluster"], order, 2)
    return ranked.groupBy("city", "cluster").agg(F.max(F.when(F.col("rank") == 1, F.col("engineer_code"))).alias("primary_code"), F.max(F.when(F.col("rank") == 2, F.col("engineer_code"))).alias("secondary_code"))


SERVICE = """
SELECT c.c_custkey, c.c_name, o.o_orderkey, l.l_linenumber, coalesce(nullif(trim(n.n_name), ''), '*****') AS customer_city, s.s_name, p.p_brand,
 CASE WHEN o.o_orderpriority LIKE '1%' THEN n.n_name ELSE coalesce(r.r_name, '*****') END AS place
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN part p ON p.p_partkey = l.l_partkey
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS latest FROM orders GROUP BY o_custkey) t ON t.o_custkey = c.c_custkey
WHERE t.latest >= o.o_orderkey AND c.c_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND p.p_size > 20"""


def jn_service_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The service extract as SQL text: inner and outer joins, a derived table and an IN subquery."""
    names = ("orders", "lineitem", "customer", "supplier", "part", "nation", "region")
    text = SERVICE
    for n in names:
        text = text.replace(f" {n} ", " {%s} " % n)
    return spark.sql(text, **{n: table(spark, sf, n) for n in names})


def jn_pending_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without an urgent order above 200 000, the first 50 by key."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return c.join(table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").orderBy("c_custkey").limit(50)


def st_union_priority(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("key"), F.lit("census").alias("source"), F.col("s_name").alias("address"))
    c = table(spark, sf, "customer").select((F.col("c_custkey") % 40).cast("int").alias("key"), F.lit("other").alias("source"), F.col("c_name").alias("address"))
    return R.union_by_priority([s, c], ["key"])


def st_coverage_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Intersection, differences and union of two sets of postal codes."""
    p = visits(spark, sf).select("postal_code", "symptom")
    a, b = p.where("symptom = 'A'").select("postal_code"), p.where("symptom = 'R'").select("postal_code")
    tag = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("which"), "n")
    return tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "first only")).unionByName(tag(b.subtract(a), "second only")).unionByName(tag(a.union(b).distinct(), "any"))


def st_fill_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Visible codes and the manual ones that are not visible, with their source."""
    seen = visits(spark, sf).where("city < 'J'").select("postal_code").distinct().withColumn("source", F.lit("visible"))
    manual = table(spark, sf, "customer").select(F.lpad((F.col("c_custkey") % 1100).cast("string"), 5, "0").alias("postal_code")).distinct()
    return seen.unionByName(manual.join(seen, "postal_code", "left_anti").withColumn("source", F.lit("manual")))


def snk_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Replace by key: anti join of what is there, union of what is new."""
    old = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    new = old.where("c_custkey % 4 = 0").select(F.col("c_custkey") * 2, F.lit("NEW").alias("c_mktsegment")).toDF("c_custkey", "c_mktsegment")
    return R.upsert(old, new, ["c_custkey"])


QUERIES = {f.__name__: f for f in (jn_overlay, jn_nearest_centre, jn_border_band, jn_distance_matrix, jn_skill, jn_preference, jn_service_sql, jn_pending_addresses, st_union_priority, st_coverage_sets, st_fill_missing, snk_upsert)}
_KM = haversine_sql("p.latitude", "p.longitude", "c.latitude", "c.longitude")
SQL = {
    "jn_overlay": """WITH own AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * CAST(0.5 AS DOUBLE) END AS la, o_orderkey * CAST(0.25 AS DOUBLE) AS lo FROM orders WHERE o_orderkey % 7 = 0), cache AS (SELECT c_custkey, c_custkey * CAST(0.5 AS DOUBLE) AS la, c_custkey * CAST(0.125 AS DOUBLE) AS lo FROM customer WHERE c_custkey % 3 <> 0)
SELECT o.o_orderkey, CASE WHEN own.la IS NOT NULL THEN own.la ELSE cache.la END AS latitude, CASE WHEN own.la IS NOT NULL THEN own.lo ELSE cache.lo END AS longitude, CASE WHEN own.la IS NOT NULL THEN 'override' WHEN cache.la IS NOT NULL THEN 'cache' ELSE 'failed' END AS source FROM orders o LEFT JOIN own ON own.o_orderkey = o.o_orderkey LEFT JOIN cache ON cache.c_custkey = o.o_custkey""",
    "jn_nearest_centre": f"WITH {VISITS_SQL}, {ENGINEERS_SQL}, {_CENTRES}, {_POSTALS}, d AS (SELECT p.city, p.postal_code, c.region_seq, {_KM} AS km FROM postals p JOIN centres c ON c.city = p.city), k AS (SELECT *, row_number() OVER (PARTITION BY city, postal_code ORDER BY km, region_seq) AS rn FROM d) SELECT city, postal_code, region_seq, round(km, 4) AS km FROM k WHERE rn = 1",
    "jn_border_band": f"WITH {VISITS_SQL}, {ENGINEERS_SQL}, {_CENTRES}, {_POSTALS}, d AS (SELECT p.city, a.region_seq AS target_region, p.postal_code, {haversine_sql('p.latitude', 'p.longitude', 'a.latitude', 'a.longitude')} AS own_km, {haversine_sql('p.latitude', 'p.longitude', 'b.latitude', 'b.longitude')} AS source_km FROM postals p JOIN centres a ON a.city = p.city AND a.region_seq IN (1, 2) JOIN centres b ON b.city = p.city AND b.region_seq = 3) SELECT city, target_region, postal_code, round(own_km, 4) AS own_km, round(source_km, 4) AS source_km FROM d WHERE source_km <= own_km + 15 AND source_km <= greatest(own_km * CAST(1.35 AS DOUBLE), own_km + 1)",
    "jn_distance_matrix": f"WITH {VISITS_SQL}, v AS (SELECT DISTINCT engineer_code, service_date, receipt_no, latitude, longitude FROM visits), d AS (SELECT a.engineer_code, a.service_date, a.receipt_no, b.receipt_no AS to_receipt, {haversine_sql('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS k FROM v a JOIN v b ON a.engineer_code = b.engineer_code AND a.service_date = b.service_date AND a.receipt_no <> b.receipt_no) SELECT engineer_code, service_date, receipt_no, to_receipt, round(k, 4) AS km, round(k / 50 * 60, 4) AS minutes FROM d",
    "jn_skill": f"WITH {VISITS_SQL}, {ENGINEERS_SQL}, v AS (SELECT city, service_month, is_heavy, count(DISTINCT receipt_no) AS receipts FROM visits GROUP BY 1, 2, 3) SELECT v.city, service_month, is_heavy, count(DISTINCT engineer_code) AS eligible, max(receipts) AS receipts FROM v JOIN engineers e ON v.city = e.city AND (NOT is_heavy OR ref_heavy = 'Y') GROUP BY 1, 2, 3",
    "jn_preference": f"WITH {ENGINEERS_SQL}, {_CENTRES}, k AS (SELECT e.city, c.region_seq AS cluster, engineer_code, row_number() OVER (PARTITION BY e.city, c.region_seq ORDER BY CASE WHEN e.region_seq = c.region_seq THEN 0 ELSE 1 END, round({haversine_sql('home_lat', 'home_lon', 'c.latitude', 'c.longitude')}, 6), engineer_code) AS rank FROM engineers e JOIN centres c ON c.city = e.city) SELECT city, cluster, max(CASE WHEN rank = 1 THEN engineer_code END) AS primary_code, max(CASE WHEN rank = 2 THEN engineer_code END) AS secondary_code FROM k WHERE rank <= 2 GROUP BY 1, 2",
    "jn_service_sql": SERVICE,
    "jn_pending_addresses": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000) ORDER BY c_custkey LIMIT 50",
    "st_union_priority": "WITH u AS (SELECT s_nationkey AS key, 'census' AS source, s_name AS address, 0 AS p FROM supplier UNION ALL SELECT CAST(c_custkey % 40 AS INTEGER), 'other', c_name, 1 FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p, source, address) AS rn FROM u) SELECT key, source, address FROM k WHERE rn = 1",
    "st_coverage_sets": f"WITH {VISITS_SQL}, a AS (SELECT DISTINCT postal_code FROM visits WHERE symptom = 'A'), b AS (SELECT DISTINCT postal_code FROM visits WHERE symptom = 'R') SELECT 'both' AS which, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'second only', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)",
    "st_fill_missing": f"WITH {VISITS_SQL}, s AS (SELECT DISTINCT postal_code FROM visits WHERE city < 'J'), m AS (SELECT DISTINCT lpad(CAST(c_custkey % 1100 AS VARCHAR), 5, '0') AS postal_code FROM customer) SELECT postal_code, 'visible' AS source FROM s UNION ALL SELECT postal_code, 'manual' FROM m WHERE postal_code NOT IN (SELECT postal_code FROM s)",
    "snk_upsert": "WITH n AS (SELECT c_custkey * 2 AS c_custkey FROM customer WHERE c_custkey % 4 = 0) SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT c_custkey, 'NEW' FROM n",
}
