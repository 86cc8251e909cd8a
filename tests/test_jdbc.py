from datetime import datetime

from pyspark.sql import functions as F

from fieldroute.operators import masters as M
from fieldroute.sources.jdbc import put_jdbc, read_jdbc, write_jdbc

URL = "jdbc:derby:memory:fieldroute;create=true"
OPTIONS = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_ranges_and_pushed_filters(spark):
    rows = spark.range(100).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), (F.col("id") * 2).alias("v"))
    write_jdbc(rows, URL, "numbers", "overwrite", **OPTIONS)
    back = read_jdbc(spark, URL, "numbers", split="K", parts=4, **OPTIONS)
    assert back.rdd.getNumPartitions() == 4
    assert sorted((r.k or 0, r.v) for r in back.collect()) == [(i, 2 * i) for i in range(100)]
    some = back.where("v >= 190").select("v")
    assert sorted(r.v for r in some.collect()) == [190, 192, 194, 196, 198]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(V,190)" in plan and "ReadSchema: struct<V:" in plan
    write_jdbc(rows.where("k is null"), URL, "numbers", "overwrite", **OPTIONS)
    empty = read_jdbc(spark, URL, "numbers", split="K", **OPTIONS)
    assert empty.rdd.getNumPartitions() == 1 and [tuple(r) for r in empty.collect()] == [(None, 0)]


def test_put(spark):
    row = lambda *r: spark.createDataFrame(list(r), "subsidiary_name string, strategic_city_name string, postal_code string, region_seq int, region_name string")
    first, later = datetime(2024, 1, 1), datetime(2024, 2, 1)
    stamp = lambda t: F.lit(t).cast("timestamp")
    write_jdbc(M.put(None, row(("s", "c", "00001", 1, "A"), ("s", "c", "00002", 2, "B")), "region", stamp(first)), URL, "region_master", "overwrite", **OPTIONS)
    n = put_jdbc(spark, row(("s", "c", "00002", 3, "C"), ("s", "c", "00003", 3, "C")), URL, "region_master", "region", stamp(later), **OPTIONS)
    got = sorted((r.postal_code, r.region_seq, r.created_at, r.updated_at) for r in read_jdbc(spark, URL, "region_master", **OPTIONS).collect())
    assert n == 3 and got == [("00001", 1, first, first), ("00002", 3, first, later), ("00003", 3, later, later)]
