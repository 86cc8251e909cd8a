"""Queries of filters, projections, cleansing and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldroute.functions import text as T
from fieldroute.functions.geo import haversine_km, haversine_sql, mercator, travel_minutes
from fieldroute.session import table
from fieldroute.sources.adapter import ENGINEERS_SQL, VISITS_SQL, engineers, visits


def flt_city_centers(spark: SparkSession, sf: str) -> DataFrame:
    """A NOT IN that keeps nulls."""
    e = engineers(spark, sf).withColumn("kind", F.when(F.col("slot").isNull(), None).otherwise(F.col("center_type")))
    return e.where(F.coalesce(~F.col("kind").isin("DMS2"), F.lit(True))).select("engineer_code", "city", "kind")


def prj_postal_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Postal, country, slug, boolean, date and address-key cleansing over variants of customer keys."""
    k = F.col("c_custkey")
    raw = F.when(k % 5 == 0, F.concat(F.lit("0"), k.cast("string"), F.lit("-1234"))).when(k % 5 == 1, F.concat(k.cast("string"), F.lit(".0"))).when(k % 5 == 2, F.lit(None).cast("string")).when(k % 5 == 3, F.concat(F.lit(" "), k.cast("string"))).otherwise(F.lit("nan"))
    place = F.when(k % 3 == 0, "united states").when(k % 3 == 1, "us").otherwise(F.lit(" Canada  East "))
    flag = F.when(k % 4 == 0, "Yes").when(k % 4 == 1, "n").when(k % 4 == 2, None).otherwise("other")
    day = F.when(k % 2 == 0, "2026-01-20").otherwise("2026-1")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", raw.alias("raw"), place.alias("place"), flag.alias("flag"), day.alias("day"))
    key = T.postal_key(F.col("raw"))
    return c.select("c_custkey", T.blank_null_words(F.coalesce("raw", F.lit(""))).alias("blanked"), key.alias("postal_key"), T.postal_padded(key).alias("postal_padded"), T.country(F.col("place")).alias("country"), T.slug(F.concat_ws("--", "c_name", "c_mktsegment")).alias("slug"), T.boolean(F.col("flag")).alias("flag"), T.digits_date(F.col("day")).alias("promise_date"), T.address_key(F.col("c_name"), F.col("c_mktsegment"), key, F.lit("USA")).alias("address_key"))


def _rules(spark, sf):
    p = table(spark, sf, "part").where("p_size > 40")
    return p.select(F.trim("p_brand").alias("product_group"), F.trim("p_type").alias("product")).distinct().withColumn("symptom", F.lit("R"))


def prj_heavy_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Exact rule triples: a left join on three keys and a flag."""
    v = visits(spark, sf).select("l_orderkey", "l_linenumber", "product_group", "product", "symptom")
    flagged = v.join(_rules(spark, sf).withColumn("hit", F.lit(True)), ["product_group", "product", "symptom"], "left")
    heavy = F.coalesce("hit", F.lit(False))
    return flagged.select("l_orderkey", "l_linenumber", heavy.alias("heavy"), F.when(heavy, 100).otherwise(45).alias("minutes"), F.when(heavy, 2.0).otherwise(1.0).alias("weight"))


def prj_heavy_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Prefix rules: the type itself, its first five and its first three letters are candidates."""
    rules = table(spark, sf, "part").where("p_size > 45").select(F.upper(F.substring("p_type", 1, 3)).alias("candidate"), F.upper("p_brand").alias("grp")).distinct()
    parts = table(spark, sf, "part").select("p_partkey", F.upper("p_brand").alias("grp"), F.upper("p_type").alias("t"))
    asked = parts.select("p_partkey", "grp", F.explode(F.array_distinct(F.array(F.col("t"), F.substring("t", 1, 5), F.substring("t", 1, 3)))).alias("candidate"))
    hit = asked.join(rules, ["candidate", "grp"], "left_semi").select("p_partkey").distinct().withColumn("hit", F.lit(True))
    return parts.select("p_partkey").join(hit, "p_partkey", "left").select("p_partkey", F.coalesce("hit", F.lit(False)).alias("heavy"))


def prj_center_bucket(spark: SparkSession, sf: str) -> DataFrame:
    """Engineer-days with one receipt at most count as ASC."""
    v = visits(spark, sf)
    n = F.size(F.collect_set("receipt_no").over(Window.partitionBy("engineer_code", "service_date")))
    return v.withColumn("n", n).groupBy(F.when(F.col("n") <= 1, "ASC").otherwise(F.col("center_type")).alias("bucket"), "city").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("receipt_no").alias("receipts"))


def prj_engineer_label(spark: SparkSession, sf: str) -> DataFrame:
    e = engineers(spark, sf).withColumn("engineer_name", F.concat(F.lit("E"), (F.col("engineer_code").cast("int") % 700).cast("string")))
    n = F.count(F.lit(1)).over(Window.partitionBy("engineer_name"))
    return e.select("engineer_code", F.when(n > 1, F.concat("engineer_name", F.lit(" ("), "engineer_code", F.lit(")"))).otherwise(F.col("engineer_name")).alias("label"))


def sc_scalars(spark: SparkSession, sf: str) -> DataFrame:
    """Haversine, minutes, mercator, clock text and safe division."""
    e = engineers(spark, sf)
    km = haversine_km(F.col("home_lat"), F.col("home_lon"), F.lit(33.5), F.lit(-84.5))
    x, y = mercator(F.col("home_lat"), F.col("home_lon"))
    minutes = F.col("engineer_code").cast("int") % 1440
    return e.select("engineer_code", F.round(km, 4).alias("km"), F.round(travel_minutes(km), 4).alias("minutes"), F.round(x, 1).alias("x"), F.round(y, 1).alias("y"), T.clock_text(minutes).alias("clock"), T.clock_minutes(T.clock_text(minutes), 540).alias("back"), (F.lit(1.0) / F.nullif(F.col("slot"), F.lit(5))).alias("share"))


_VARIANTS = """SELECT c_custkey, c_name, c_mktsegment,
 CASE WHEN c_custkey % 5 = 0 THEN '0' || CAST(c_custkey AS VARCHAR) || '-1234' WHEN c_custkey % 5 = 1 THEN CAST(c_custkey AS VARCHAR) || '.0' WHEN c_custkey % 5 = 2 THEN NULL WHEN c_custkey % 5 = 3 THEN ' ' || CAST(c_custkey AS VARCHAR) ELSE 'nan' END AS raw,
 CASE WHEN c_custkey % 4 = 0 THEN 'Yes' WHEN c_custkey % 4 = 1 THEN 'n' WHEN c_custkey % 4 = 2 THEN NULL ELSE 'other' END AS flag FROM customer"""

QUERIES = {f.__name__: f for f in (flt_city_centers, prj_postal_keys, prj_heavy_flag, prj_heavy_prefix, prj_center_bucket, prj_engineer_label, sc_scalars)}
SQL = {
    "flt_city_centers": f"WITH {ENGINEERS_SQL} SELECT engineer_code, city, CASE WHEN slot IS NULL THEN NULL ELSE center_type END AS kind FROM engineers WHERE slot IS NULL OR center_type <> 'DMS2'",
    "prj_postal_keys": f"""WITH c AS ({_VARIANTS}), k AS (SELECT *, regexp_replace(upper(split_part(trim(coalesce(raw, '')), '-', 1)), '\\.0+$', '') AS head FROM c),
 p AS (SELECT *, CASE WHEN regexp_matches(head, '^[0-9]+$') THEN CAST(CAST(head AS BIGINT) AS VARCHAR) ELSE head END AS postal_key FROM k)
SELECT c_custkey, CASE WHEN coalesce(raw, '') = 'nan' THEN '' ELSE coalesce(raw, '') END AS blanked, postal_key, CASE WHEN length(postal_key) >= 5 THEN postal_key ELSE lpad(postal_key, 5, '0') END AS postal_padded,
 CASE WHEN c_custkey % 3 = 2 THEN 'CANADA EAST' ELSE 'USA' END AS country, regexp_replace(regexp_replace(lower(c_name || '--' || c_mktsegment), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
 flag IS NOT NULL AND flag <> 'n' AS flag, CASE WHEN c_custkey % 2 = 0 THEN '20260120' ELSE '' END AS promise_date, upper(c_name) || '|' || upper(c_mktsegment) || '|' || upper(trim(postal_key)) || '|USA' AS address_key FROM p""",
    "prj_heavy_flag": f"WITH {VISITS_SQL}, r AS (SELECT DISTINCT trim(p_brand) AS g, trim(p_type) AS p FROM part WHERE p_size > 40) SELECT l_orderkey, l_linenumber, r.g IS NOT NULL AS heavy, CASE WHEN r.g IS NOT NULL THEN 100 ELSE 45 END AS minutes, CAST(CASE WHEN r.g IS NOT NULL THEN 2.0 ELSE 1.0 END AS DOUBLE) AS weight FROM visits LEFT JOIN r ON r.g = product_group AND r.p = product AND symptom = 'R'",
    "prj_heavy_prefix": "WITH r AS (SELECT DISTINCT upper(substr(p_type, 1, 3)) AS c, upper(p_brand) AS g FROM part WHERE p_size > 45) SELECT p_partkey, EXISTS (SELECT 1 FROM r WHERE r.g = upper(p_brand) AND r.c IN (upper(p_type), substr(upper(p_type), 1, 5), substr(upper(p_type), 1, 3))) AS heavy FROM part",
    "prj_center_bucket": f"WITH {VISITS_SQL}, n AS (SELECT engineer_code, service_date, count(DISTINCT receipt_no) AS n FROM visits GROUP BY 1, 2) SELECT CASE WHEN n.n <= 1 THEN 'ASC' ELSE center_type END AS bucket, city, count(*) AS rows, count(DISTINCT receipt_no) AS receipts FROM visits JOIN n USING (engineer_code, service_date) GROUP BY 1, 2",
    "prj_engineer_label": "WITH e AS (SELECT CAST(s_suppkey AS VARCHAR) AS engineer_code, 'E' || CAST(s_suppkey % 700 AS VARCHAR) AS n FROM supplier) SELECT engineer_code, CASE WHEN count(*) OVER (PARTITION BY n) > 1 THEN n || ' (' || engineer_code || ')' ELSE n END AS label FROM e",
    "sc_scalars": f"WITH {ENGINEERS_SQL}, k AS (SELECT *, {haversine_sql('home_lat', 'home_lon', '33.5::DOUBLE', '-84.5::DOUBLE')} AS d, CAST(engineer_code AS INTEGER) % 1440 AS m FROM engineers) SELECT engineer_code, round(d, 4) AS km, round(d / 50 * 60, 4) AS minutes, round(radians(home_lon) * 6378137.0::DOUBLE, 1) AS x, round(ln(tan(0.7853981633974483::DOUBLE + radians(home_lat) / 2)) * 6378137.0::DOUBLE, 1) AS y, lpad(CAST(m // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') AS clock, m AS back, 1.0::DOUBLE / nullif(slot, 5) AS share FROM k",
}
