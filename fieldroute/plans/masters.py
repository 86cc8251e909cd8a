"""Queries that fill, replace and check the master tables, and look names up in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldroute.operators import geocode as G
from fieldroute.operators import masters as M
from fieldroute.operators.relational import keep_first
from fieldroute.plans.aggregates import _REGIONS, regions
from fieldroute.session import table, wide_tasks
from fieldroute.sources.adapter import ENGINEERS_SQL, VISITS_SQL, engineers, visits

OWN = "own"
#: Addresses that may be asked for in a run.
QUOTA = 1000


def xt_technicians(spark: SparkSession, sf: str) -> DataFrame:
    """Technicians from suppliers, addresses from customers of the same number and digits, homes from their coordinates."""
    staff = engineers(spark, sf)
    slots = staff.select(F.lit(OWN).alias("subsidiary_name"), F.col("city").alias("strategic_city_name"), F.col("engineer_code").alias("employee_code"), F.concat(F.lit(" "), "engineer_name").alias("employee_name"), F.lower("center_type").alias("center_type"))
    people = table(spark, sf, "customer").where("c_acctbal > 0").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    addresses = people.select(F.col("c_custkey").cast("string").alias("employee_code"), F.regexp_replace("c_name", "Customer", "Supplier").alias("employee_name"), F.col("c_mktsegment").alias("home_address"), F.col("n_name").alias("home_city"), F.lit("nan").alias("home_state"), F.concat(F.lpad(F.col("c_custkey").cast("string"), 5, "0"), F.lit(".0")).alias("home_postal_code"))
    homes = staff.where("slot is not null").select(F.col("engineer_code").alias("employee_code"), F.col("home_lat").alias("home_latitude"), F.col("home_lon").alias("home_longitude"))
    return M.technicians(slots, addresses, homes)


def _products(spark, sf):
    v = visits(spark, sf)
    group = F.when(F.col("product_group") < "Brand#3", "REF").otherwise("TV")
    return v.select(F.lit(OWN).alias("subsidiary_name"), F.col("city").alias("strategic_city_name"), F.col("engineer_code").alias("employee_code"), group.alias("product_group_code"), F.col("product").alias("product_code"), F.when(F.col("is_heavy"), "f").otherwise("t").alias("repair_flag"), F.col("symptom").alias("area_product_flag"))


def xt_capabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Who may repair what, from the lines that an engineer had."""
    return M.capabilities(_products(spark, sf), wide_tasks(spark, sf))


def _region_rows(spark, sf):
    v = visits(spark, sf)
    named = regions(spark, sf).join(v.select("postal_code", "city").distinct(), "postal_code")
    named = named.select(F.lit(OWN).alias("subsidiary_name"), F.col("city").alias("strategic_city_name"), "postal_code", "region_seq", F.concat(F.lit("Region "), "region_seq").alias("region_name"))
    return M.region_rows(named, v.withColumn("latitude", F.when(F.col("l_linenumber") < 7, F.col("latitude"))))


def xt_region_master(spark: SparkSession, sf: str) -> DataFrame:
    """Regions by postal code with the mean place of their services."""
    return _region_rows(spark, sf).withColumns({c: F.round(c, 6) for c in ("region_center_latitude", "region_center_longitude")})


def xt_heavy_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct codes of product group, product and symptom; every part of size 50 has none."""
    p = table(spark, sf, "part")
    return M.heavy_rules(p.select(F.concat("p_brand", F.lit(" ")).alias("product_group_code"), F.col("p_type").alias("product_code"), F.when(F.col("p_size") < 50, F.col("p_size").cast("string")).alias("detailed_symptom_code")))


def _jobs(spark, sf, prefix: str, source: str, line):
    v = keep_first(visits(spark, sf), ["receipt_no", "city"], [line, F.col("engineer_code"), F.col("service_date")])
    day = F.date_format("service_date", "yyyy-MM-dd")
    record = F.concat_ws("-", F.lit(prefix), "receipt_no", "city").alias("record_id")
    return v.select(record, F.lit(OWN).alias("subsidiary_name"), F.col("city").alias("strategic_city_name"), F.col("engineer_code").alias("svc_engineer_code"), F.col("receipt_no").alias("gsfs_receipt_no"), day.alias("promise_date"), "postal_code", F.lit(source).alias("source"), "l_linenumber")


def xt_job_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Receipts by their first line up to the third, then by their last from the second on written over them: a receipt keeps its record and first stamp."""
    old, new = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")
    held = M.put(None, _jobs(spark, sf, "a", "file", F.col("l_linenumber")).where("l_linenumber <= 3"), "job", old)
    done = M.put(held, _jobs(spark, sf, "b", "form", F.col("l_linenumber").desc()).where("l_linenumber >= 2"), "job", new)
    return done.select("record_id", "strategic_city_name", "gsfs_receipt_no", "svc_engineer_code", "promise_date", "source", F.month("created_at").alias("created"), F.month("updated_at").alias("updated"))


def xt_master_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that break a rule of the job table, of visits as they come: a record a receipt, no date in March."""
    v = visits(spark, sf)
    raw = v.select(F.col("receipt_no").alias("record_id"), F.lit(OWN).alias("subsidiary_name"), F.col("city").alias("strategic_city_name"), F.col("receipt_no").alias("gsfs_receipt_no"), F.when(F.month("service_date") != 3, F.col("service_date").cast("string")).alias("promise_date"))
    return M.violations(raw, "job")


def _product_master(spark, sf):
    p = table(spark, sf, "part")
    named = {"product_group_name": F.upper("p_brand"), "product_group_code": F.col("p_brand"), "product_name": F.lower("p_type"), "product_code": F.col("p_type"), "symptom_name": F.col("p_name"), "symptom_code": F.lit("s"), "symptom_type_name": F.when(F.col("p_size") > 25, "large"), "symptom_type_code": F.lit("t"), "detailed_symptom_name": F.concat(F.lit(" size "), "p_size"), "detailed_symptom_code": F.when(F.col("p_size") % 7 > 0, (F.col("p_size") % 5).cast("string"))}
    return M.product_master(p.select(*[x.alias(c) for c, x in named.items()]))


def xt_store_display(spark: SparkSession, sf: str) -> DataFrame:
    """Every service line with the names of its product and symptom."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 6).cast("string").alias("detailed_symptom_code"), "l_partkey")
    jobs = lines.join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("product_group_code"), F.col("p_type").alias("product_code")), "l_partkey").drop("l_partkey")
    return M.with_product_names(jobs, _product_master(spark, sf))


def jn_engineer_master(spark: SparkSession, sf: str) -> DataFrame:
    """Engineers with region, slots and flag; a home of their own or that of the customer with their number, whichever is first."""
    staff = engineers(spark, sf)
    own = staff.select("engineer_code", "home_lat", "home_lon")
    other = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("engineer_code"), (F.lit(33.0) + F.col("c_nationkey") / 100).alias("home_lat"), F.lit(-84.0).alias("home_lon"))
    rows = staff.select("engineer_code", F.lower("center_type").alias("center_type"), F.when(F.col("slot") == 9, "n/a").otherwise(F.concat(F.col("slot").cast("string"), F.lit(".0"))).alias("slot"), F.col("region_seq").cast("string").alias("region_seq"), F.when(F.col("ref_heavy") == "N", "n").alias("ref_heavy"))
    return M.engineer_master(rows, own.unionByName(other), contractors=False).withColumns({c: F.round(c, 4) for c in ("home_lat", "home_lon")})


def _geocoded(spark, sf):
    """Service lines by postal code and city; the cache knows regions 2 and 3, the geocoder all codes but those that end with 7."""
    v = visits(spark, sf).withColumn("address_key", F.concat_ws("|", "postal_code", "city")).select("l_orderkey", "l_linenumber", "address_key", "postal_code", *G.PLACE)
    place = v.groupBy("address_key").agg(F.first("postal_code").alias("postal_code"), *[F.min(c).alias(c) for c in G.PLACE])
    cache = place.join(regions(spark, sf).where("region_seq > 1"), "postal_code").select("address_key", *G.PLACE)
    answers = place.where("postal_code not like '%7'").select("address_key", *G.PLACE)
    return G.geocode_run(v.drop(*G.PLACE), cache, lambda batch: batch.join(answers, "address_key"), QUOTA)


def xt_geocode_report(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of a run within the daily quota, with the rows and addresses it located."""
    run = _geocoded(spark, sf)
    return run["report"].join(F.broadcast(G.place_counts(run["located"])))


QUERIES = {f.__name__: f for f in (xt_technicians, xt_capabilities, xt_region_master, xt_heavy_rules, xt_job_upsert, xt_master_rules, xt_store_display, jn_engineer_master, xt_geocode_report)}

_MASTER = """m AS (SELECT DISTINCT upper(p_brand) AS product_group_name, p_brand AS product_group_code, lower(p_type) AS product_name, p_type AS product_code, trim(p_name) AS symptom_name, CASE WHEN p_size > 25 THEN 'large' ELSE '' END AS symptom_type_name,
 'size ' || p_size AS detailed_symptom_name, CAST(p_size % 5 AS VARCHAR) AS detailed_symptom_code FROM part WHERE p_size % 7 > 0)"""
_LINES = "row_number() OVER (PARTITION BY receipt_no, city ORDER BY l_linenumber{}, engineer_code, service_date)"
SQL = {
    "xt_technicians": f"""WITH {ENGINEERS_SQL}, a AS (SELECT CAST(c_custkey AS VARCHAR) AS code, replace(c_name, 'Customer', 'Supplier') AS name, c_mktsegment AS seg, n_name AS town FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0)
SELECT 'own' AS subsidiary_name, city AS strategic_city_name, engineer_code AS employee_code, engineer_name AS employee_name, center_type, coalesce(seg, '') AS home_address, coalesce(town, '') AS home_city, '' AS home_state, 'USA' AS home_country,
 coalesce(code, '') AS home_postal_code, CASE WHEN slot IS NOT NULL THEN home_lat END AS home_latitude, CASE WHEN slot IS NOT NULL THEN home_lon END AS home_longitude, true AS active_flag FROM engineers LEFT JOIN a ON code = engineer_code AND name = engineer_name""",
    "xt_capabilities": f"""WITH {VISITS_SQL}, r AS (SELECT city, engineer_code, CASE WHEN product_group < 'Brand#3' THEN 'REF' ELSE 'TV' END AS g, product, min(CASE WHEN is_heavy THEN 'f' || symptom ELSE 't' || symptom END) AS f FROM visits GROUP BY 1, 2, 3, 4)
SELECT 'own' AS subsidiary_name, city AS strategic_city_name, engineer_code AS employee_code, g AS product_group_code, product AS product_code, f[1] = 't' AS repair_allowed, NOT (g = 'REF' AND f[2:] = 'N') AS heavy_repair_allowed, 100 AS priority_score FROM r""",
    "xt_region_master": f"""WITH {VISITS_SQL}, {_REGIONS}, k AS (SELECT DISTINCT city, postal_code, region_seq FROM visits JOIN regions USING (postal_code)),
c AS (SELECT k.city, k.region_seq, avg(latitude) AS la, avg(longitude) AS lo FROM k JOIN visits v ON v.postal_code = k.postal_code WHERE l_linenumber < 7 GROUP BY 1, 2)
SELECT 'own' AS subsidiary_name, k.city AS strategic_city_name, postal_code, k.region_seq, 'Region ' || k.region_seq AS region_name, round(la, 6) AS region_center_latitude, round(lo, 6) AS region_center_longitude FROM k LEFT JOIN c ON c.city = k.city AND c.region_seq = k.region_seq""",
    "xt_heavy_rules": "SELECT DISTINCT p_brand AS product_group_code, p_type AS product_code, CAST(p_size AS VARCHAR) AS detailed_symptom_code FROM part WHERE p_size < 50",
    "xt_job_upsert": f"""WITH {VISITS_SQL}, k AS (SELECT *, {_LINES.format('')} AS first, {_LINES.format(' DESC')} AS last FROM visits), a AS (SELECT * FROM k WHERE first = 1 AND l_linenumber <= 3), b AS (SELECT * FROM k WHERE last = 1 AND l_linenumber >= 2)
SELECT CASE WHEN a.city IS NULL THEN 'b-' ELSE 'a-' END || receipt_no || '-' || city AS record_id, city AS strategic_city_name, receipt_no AS gsfs_receipt_no, coalesce(b.engineer_code, a.engineer_code) AS svc_engineer_code,
 strftime(coalesce(b.service_date, a.service_date), '%Y-%m-%d') AS promise_date, CASE WHEN b.city IS NULL THEN 'file' ELSE 'form' END AS source, CASE WHEN a.city IS NULL THEN 2 ELSE 1 END AS created, CASE WHEN b.city IS NULL THEN 1 ELSE 2 END AS updated FROM a FULL JOIN b USING (receipt_no, city)""",
    "xt_master_rules": f"""WITH {VISITS_SQL}, k AS (SELECT sum(n) AS n FROM (SELECT count(*) AS n FROM visits GROUP BY receipt_no HAVING count(*) > 1)), u AS (SELECT sum(n) AS n FROM (SELECT count(*) AS n FROM visits GROUP BY receipt_no, city HAVING count(*) > 1))
SELECT 'not null ' || c AS rule, CAST(0 AS BIGINT) AS broken FROM (VALUES ('record_id'), ('subsidiary_name'), ('strategic_city_name'), ('gsfs_receipt_no')) t(c) UNION ALL SELECT 'not null promise_date', count(*) FILTER (WHERE month(service_date) = 3) FROM visits
UNION ALL SELECT 'key', CAST(coalesce(n, 0) AS BIGINT) FROM k UNION ALL SELECT 'unique', CAST(coalesce(n, 0) AS BIGINT) FROM u""",
    "xt_store_display": f"""WITH {_MASTER}, p1 AS (SELECT product_group_code AS g, product_code AS p, min(product_group_name) AS product_group_name, min(product_name) AS product_name FROM m GROUP BY 1, 2),
s1 AS (SELECT product_group_code AS g, product_code AS p, detailed_symptom_code AS d, min((detailed_symptom_name, symptom_name, symptom_type_name)) AS s FROM m GROUP BY 1, 2, 3),
l AS (SELECT l_orderkey, l_linenumber, CAST(CAST(trunc(l_quantity) AS INTEGER) % 6 AS VARCHAR) AS d, p_brand AS g, p_type AS p FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, l.d AS detailed_symptom_code, l.g AS product_group_code, l.p AS product_code, product_group_name, product_name, s[1] AS detailed_symptom_name, s[2] AS symptom_name, s[3] AS symptom_type_name
FROM l LEFT JOIN p1 ON p1.g = l.g AND p1.p = l.p LEFT JOIN s1 ON s1.g = l.g AND s1.p = l.p AND s1.d = l.d""",
    "jn_engineer_master": f"""WITH {ENGINEERS_SQL}, h AS (SELECT engineer_code AS code, home_lat AS la, home_lon AS lo FROM engineers UNION ALL SELECT CAST(c_custkey AS VARCHAR), CAST(33.0 AS DOUBLE) + c_nationkey / CAST(100 AS DOUBLE), CAST(-84.0 AS DOUBLE) FROM customer),
f AS (SELECT code, la, lo, row_number() OVER (PARTITION BY code ORDER BY la, lo) AS rn FROM h)
SELECT engineer_code, center_type, CASE WHEN slot IS NULL OR slot = 9 THEN 8 ELSE slot END AS slot, region_seq, CASE WHEN ref_heavy = 'N' THEN 'N' ELSE 'Y' END AS ref_heavy, round(la, 4) AS home_lat, round(lo, 4) AS home_lon
FROM engineers LEFT JOIN f ON code = engineer_code AND rn = 1 WHERE center_type = 'DMS'""",
    "xt_geocode_report": f"""WITH {VISITS_SQL}, {_REGIONS}, k AS (SELECT postal_code || '|' || city AS a, any_value(postal_code) AS p, count(*) AS n FROM visits GROUP BY 1), s AS (SELECT k.*, region_seq > 1 AS known FROM k JOIN regions ON p = postal_code),
b AS (SELECT a FROM s WHERE NOT known ORDER BY a LIMIT {QUOTA}), x AS (SELECT s.*, b.a IS NOT NULL AS asked, b.a IS NOT NULL AND p NOT LIKE '%7' AS got FROM s LEFT JOIN b ON b.a = s.a)
SELECT count(*) AS unique_addresses, count(*) FILTER (WHERE known) AS already_cached, count(*) FILTER (WHERE NOT known) AS pending_before, count(*) FILTER (WHERE asked) AS attempted, count(*) FILTER (WHERE got) AS geocoded,
 count(*) FILTER (WHERE asked AND NOT got) AS failed, count(*) FILTER (WHERE NOT known AND NOT got) AS remaining, CAST(coalesce(sum(n) FILTER (WHERE known OR got), 0) AS BIGINT) AS located_rows, CAST(coalesce(sum(n) FILTER (WHERE NOT known AND NOT got), 0) AS BIGINT) AS failed_rows,
 count(*) FILTER (WHERE known OR got) AS located_addresses, count(*) FILTER (WHERE NOT known AND NOT got) AS failed_addresses FROM x""",
}
