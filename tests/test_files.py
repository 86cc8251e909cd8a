import os

from fieldroute.sources.files import CACHE_COLUMNS, backfill, keep_last, newest_valid, read_geocode_cache, read_route_cache, read_sniffed_csv, read_trip_cache, service_query


def test_backfill(spark):
    schema = "id int, name string, fixed boolean"
    assert backfill(None, spark, schema).columns == ["id", "name", "fixed"]
    rows = backfill(spark.createDataFrame([("1", "yes"), ("2", "0")], "id string, fixed string"), spark, schema, ["fixed"]).collect()
    assert sorted((r.id, r.name, r.fixed) for r in rows) == [(1, None, True), (2, None, False)]


def test_newest_valid(spark, tmp_path):
    for k, (name, head) in enumerate([("S_1_g.csv", "a,b"), ("S_2_g.csv", '﻿"a", b,c'), ("S_3_g.csv", "a,c"), ("other.csv", "a,b")]):
        (tmp_path / name).write_text(head + "\n1,2,3\n", encoding="utf-8")
        os.utime(tmp_path / name, (1_700_000_000 + k, 1_700_000_000 + k))
    assert newest_valid(spark, str(tmp_path), "S_*_g.csv", ["a", "b"]).endswith("S_2_g.csv")
    assert newest_valid(spark, str(tmp_path), "S_*_g.csv", ["z"]) is None
    # A data row that looks like the header is none.
    (tmp_path / "S_4_g.csv").write_text("foo,bar\na,b\n")
    os.utime(tmp_path / "S_4_g.csv", (1_700_000_009, 1_700_000_009))
    assert newest_valid(spark, str(tmp_path), "S_*_g.csv", ["a", "b"]).endswith("S_2_g.csv")


def test_caches(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"cache_key":"k","distance_km":1.5,"duration_min":2,"coords":[[1.0,2.0]]}\nnot json\n{"distance_km":1}\n')
    assert [(r.cache_key, r.coords) for r in read_route_cache(spark, str(tmp_path / "r.jsonl")).collect()] == [("k", [[1.0, 2.0]])]
    (tmp_path / "t.csv").write_text("cache_key,distance_km,duration_min\na,1.5,2\nb,x,2\nc\n")
    assert [r.cache_key for r in read_trip_cache(spark, str(tmp_path / "t.csv")).collect()] == ["a"]
    old, new = (spark.createDataFrame(x, "k string, v int") for x in ([("a", 1), ("b", 1)], [("b", 2), ("c", 2)]))
    assert sorted(map(tuple, keep_last(old, new, ["k"], "v").collect())) == [("a", 1), ("b", 2), ("c", 2)]
    again = spark.createDataFrame([("b", 1), ("b", 5), ("b", 2)], "k string, v int")
    for rows in (again, again.orderBy("v"), again.orderBy(again["v"].desc())):
        assert sorted(map(tuple, keep_last(old, rows, ["k"], "v").collect())) == [("a", 1), ("b", 5)]


def test_sniffed_csv(spark, tmp_path):
    (tmp_path / "u.csv").write_text("a;b,c;d\n1;;NA\n")
    r = read_sniffed_csv(spark, str(tmp_path / "u.csv"))
    assert r.columns == ["a", "b,c", "d"] and [tuple(x) for x in r.collect()] == [("1", "", "NA")]


def test_service_query(spark):
    spark.createDataFrame([("1", "20260101"), ("2", "20260102"), ("1", "20260201")], "postal_code string, day string").createOrReplaceTempView("services_t")
    out = service_query(spark, "select * from services_t where day between :first_day and :last_day", "20260101", "20260131", spark.createDataFrame([("1",), ("1",)], "postal_code string"))
    assert [tuple(r) for r in out.collect()] == [("1", "20260101")]


def test_geocode_cache_repairs_keys(spark, tmp_path):
    path = tmp_path / "cache.csv"
    path.write_text("\ufeffaddress_key,address_line1,city,state,postal_code,country_name,longitude,extra\nKEPT|KEY, 1  Main St ,Atlanta,GA,30301.0,usa,-84.5,x\nnan,\"2  Oak St, Atlanta GA 30301\", Atlanta ,GA,30301.0,usa,-84.1,x\n,,,,,,,\n", encoding="utf-8")
    rows = read_geocode_cache(spark, str(path))
    assert rows.columns == list(CACHE_COLUMNS)
    kept, made, blank = sorted(rows.collect(), key=lambda r: ("KEPT" not in r.address_key, r.city == ""))
    assert (kept.address_key, kept.postal_code, kept.source) == ("KEPT|KEY", "30301.0", "")
    assert (made.address_key, made.address_line1, made.city, made.postal_code, made.country_name, made.longitude) == ("2 OAK ST|ATLANTA|GA|30301|USA", "2 Oak St", "Atlanta", "30301", "USA", "-84.1")
    assert blank.address_key == "||||" and blank.latitude == ""
    every = {r.address_key: r for r in read_geocode_cache(spark, str(path), True).collect()}
    assert set(every) == {"1 MAIN ST|ATLANTA|GA|30301|USA", "2 OAK ST|ATLANTA|GA|30301|USA", "||||"}
    assert every["1 MAIN ST|ATLANTA|GA|30301|USA"].postal_code == "30301.0"
