from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fieldroute.operators import masters as M
from fieldroute.sources.files import read_config

T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1)


def at(t):
    return F.lit(t).cast("timestamp")


def jobs(spark, rows):
    return spark.createDataFrame(rows, "record_id string, subsidiary_name string, strategic_city_name string, gsfs_receipt_no string, promise_date string, source string, row int")


def test_put_keeps_record_and_first_stamp(spark):
    held = M.put(None, jobs(spark, [("r1", "s", "c", "1", "d1", "file", 1), ("r2", "s", "c", "2", "d1", "file", 1)]), "job", at(T1))
    new = [("r9", "s", "c", "2", "d2", None, 5), ("r8", "s", "c", "3", "d2", "form", 5), ("r7", "s", "c", "3", "d2", "form", 5)]
    for rows in (new, new[::-1]):
        done = M.put(held, jobs(spark, rows), "job", at(T2))
        got = {r.gsfs_receipt_no: (r.record_id, r.promise_date, r.source, r.created_at, r.updated_at) for r in done.collect()}
        # A null of the new row replaces a value; of new rows with one key the first stays.
        assert got == {"1": ("r1", "d1", "file", T1, T1), "2": ("r2", "d2", None, T1, T2), "3": ("r7", "d2", "form", T2, T2)}
    assert "row" not in done.columns and done.columns[-2:] == ["created_at", "updated_at"]
    again = M.put(done, jobs(spark, new), "job", at(T2))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, done.collect()), key=str)
    assert sorted(map(tuple, M.put(done, jobs(spark, []), "job").collect()), key=str) == sorted(map(tuple, done.collect()), key=str)


def test_put_defaults_and_nulls(spark):
    rules = spark.createDataFrame([("g", "p", "d"), ("g", "p", "d")], "product_group_code string, product_code string, detailed_symptom_code string")
    assert [tuple(r) for r in M.put(rules, rules, "heavy_rule").collect()] == [("g", "p", "d")]
    staff = spark.createDataFrame([("s", "c", "e1", "Ann", "x", None), ("s", "c", "e2", "Bob", "33.5", False)], "subsidiary_name string, strategic_city_name string, employee_code string, employee_name string, home_latitude string, active_flag boolean")
    got = {r.employee_code: (r.home_latitude, r.active_flag) for r in M.put(None, staff, "technician", at(T1)).collect()}
    assert got == {"e1": (None, True), "e2": (33.5, False)}
    with pytest.raises(Exception, match="promise_date is null"):
        M.put(None, jobs(spark, [("r1", "s", "c", "1", None, "file", 1)]), "job").collect()


def test_violations(spark):
    rows = jobs(spark, [("r1", "s", "c", "1", "d", "", 1), ("r1", "s", "c", "2", None, "", 1), ("r3", "s", "c", "2", "d", "", 1), (None, "s", "x", "2", "d", "", 1)])
    got = {r.rule: r.broken for r in M.violations(rows, "job").collect()}
    assert got == {"not null record_id": 1, "not null subsidiary_name": 0, "not null strategic_city_name": 0, "not null gsfs_receipt_no": 0, "not null promise_date": 1, "key": 2, "unique": 2}
    assert {r.broken for r in M.violations(jobs(spark, []), "job").collect()} == {0}
    assert not [r for r in M.violations(M.conform(jobs(spark, []), "heavy_rule"), "heavy_rule").collect() if r.broken]


def test_technicians(spark):
    slots = spark.createDataFrame([("s", "c", " e1", "Ann ", "dms"), ("s", "c", "e2", "Bob", None), ("s", "d", "e3", "Cy", "DMS2")], "subsidiary_name string, strategic_city_name string, employee_code string, employee_name string, center_type string")
    address = spark.createDataFrame([("e1", "Ann", "2 B St", "Town", "nan", "00123.0"), ("e1", "Ann", "1 A St", "Town", "GA", "30301-22"), ("e2", "Someone", "9 Z St", "", "", "1")], "employee_code string, employee_name string, home_address string, home_city string, home_state string, home_postal_code string")
    homes = spark.createDataFrame([("e1", 33.0, -84.0), ("e3", None, None)], "employee_code string, home_latitude double, home_longitude double")
    got = {r.employee_code: r for r in M.technicians(slots, address, homes).collect()}
    assert (got["e1"].home_address, got["e1"].home_state, got["e1"].home_postal_code, got["e1"].home_latitude, got["e1"].center_type) == ("1 A St", "GA", "30301", 33.0, "DMS")
    assert (got["e2"].home_address, got["e2"].home_postal_code, got["e2"].home_latitude, got["e2"].center_type) == ("", "", None, "")
    assert got["e3"].home_latitude is None and all(r.active_flag and r.home_country == "USA" for r in got.values()) and len(got) == 3


def test_capabilities_and_regions(spark):
    rows = [("s", "c", "e", "REF", "p", "t", "n"), ("s", "c", "e", "REF", "p", "T", None), ("s", "c", "e", "REF", "q", "T", "n"), ("s", "c", "e", "TV", "q", None, "N")]
    products = spark.createDataFrame(rows, "subsidiary_name string, strategic_city_name string, employee_code string, product_group_code string, product_code string, repair_flag string, area_product_flag string")
    got = sorted((r.product_group_code, r.product_code, r.repair_allowed, r.heavy_repair_allowed) for r in M.capabilities(products).collect())
    assert got == [("REF", "p", True, True), ("REF", "q", True, False), ("TV", "q", False, True)]
    regions = spark.createDataFrame([("s", "c", "123", 1, "A"), ("s", "c", "00123", 2, "B"), ("s", "c", "00200", 2, "B"), ("s", "c", "00300", 3, "C")], "subsidiary_name string, strategic_city_name string, postal_code string, region_seq int, region_name string")
    services = spark.createDataFrame([("123.0", 1.0, 2.0), ("00123", 3.0, 2.0), ("00200", 8.0, 5.0), ("00300", None, 1.0)], "postal_code string, latitude double, longitude double")
    got = {r.postal_code: (r.region_seq, r.region_name, r.region_center_latitude, r.region_center_longitude) for r in M.region_rows(regions, services).collect()}
    assert got == {"00123": (1, "A", 2.0, 2.0), "00200": (2, "B", 4.0, 3.0), "00300": (3, "C", None, None)}


def test_capabilities_in_given_tasks(spark):
    """A key's first row is found in as many tasks as given, after one exchange, and no row is sorted before it."""
    lines = spark.range(2000).selectExpr("'s' AS subsidiary_name", "'c' AS strategic_city_name", "cast(id % 50 AS string) AS employee_code", "if(id % 7 = 0, ' REF ', 'REF') AS product_group_code", "cast(id % 3 AS string) AS product_code", "if(id % 4 = 0, 't', 'u') AS repair_flag", "if(id % 8 < 4, 'N', 'A') AS area_product_flag")
    got = M.capabilities(lines, 9)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and ", 9)" in plan and "Sort" not in plan[plan.index("Exchange") :]
    first = {}
    for r in lines.collect():
        k = (r.employee_code, r.product_code)
        first[k] = min(first.get(k, ("z", "z")), (r.repair_flag, r.area_product_flag))
    assert {(r.employee_code, r.product_code): (r.repair_allowed, r.heavy_repair_allowed) for r in got.collect()} == {k: (f == "t", a != "N") for k, (f, a) in first.items()}


def test_product_names(spark):
    columns = ", ".join(f"{c} string" for c in M.PRODUCT_COLUMNS)
    raw = spark.createDataFrame([("Fridge ", " R", "Big", "1", "S", "s", "T", "t", "hums", "d"), ("Fridge", "R", "Big", "1", "S", "s", "T", "t", "hums", "d"), ("Cold", "R", "Big", "1", "S", "s", None, "t", "drips", "d"), ("x", None, "Big", "1", "S", "s", "T", "t", "n", "d")], columns)
    master = M.product_master(raw)
    assert master.count() == 2
    work = spark.createDataFrame([("R", "1", "d", "own"), ("R", "1", "z", "own"), ("Q", "1", None, "own")], "product_group_code string, product_code string, detailed_symptom_code string, note string")
    got = sorted(((r.product_group_code, r.detailed_symptom_code, r.product_group_name, r.detailed_symptom_name, r.symptom_type_name, r.note) for r in M.with_product_names(work, master).collect()), key=str)
    assert got == [("Q", None, None, None, None, "own"), ("R", "d", "Cold", "drips", "", "own"), ("R", "z", "Cold", None, None, "own")]


def test_config(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"defaults": {"subsidiary_name": "s", "strategic_city_name": "c"}, "routing_seed": {"service_time_per_job_min": 60, "max_work_min_per_sm_day": "none", "urls": {"c": "u"}}}')
    config = read_config(spark, str(path))
    assert config["routing_seed"]["urls"] == {"c": "u"} and read_config(spark, str(tmp_path / "none.json")) == {}
    row = M.put(None, M.config_row(spark, config), "routing_config", at(T1)).collect()[0]
    assert (row.service_time_per_job_min, row.max_work_min_per_sm_day, row.timezone_offset, row.created_at) == (60, None, "-04:00", T1)
    held = M.put(None, M.config_row(spark, config), "routing_config")
    assert M.in_context(held, "s", "c").count() == 1 and M.in_context(held, "s", "d").count() == 0


def test_engineer_master(spark):
    staff = spark.createDataFrame([("e1", "dms", "x", "2.0", None), ("e2", "DMS2", "5", "n", "y"), ("e3", None, None, None, None)], "engineer_code string, center_type string, slot string, region_seq string, ref_heavy string")
    homes = spark.createDataFrame([("e1", 2.0, 0.0), ("e1", 1.0, 5.0)], "engineer_code string, home_lat double, home_lon double")
    got = {r.engineer_code: (r.center_type, r.slot, r.region_seq, r.ref_heavy, r.home_lat, r.home_lon) for r in M.engineer_master(staff, homes).collect()}
    assert got == {"e1": ("DMS", 8, 2, "Y", 1.0, 5.0), "e2": ("DMS2", 5, None, "Y", None, None), "e3": (None, 8, None, "Y", None, None)}
    assert [r.engineer_code for r in M.engineer_master(staff, homes, contractors=False).collect()] == ["e1"]
