import math
import random

import pytest
from pyspark.sql import functions as F

from fieldroute.functions import text as T
from fieldroute.functions.geo import haversine_km
from fieldroute.functions.routes import coordinate_key, insertion_delta, nearest_neighbour, path_km, timeline, weighted_chunks


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(max(h, 0), 1)))


def greedy(stops):
    left, path, total = list(stops[1:]), [stops[0]], 0.0
    while left:
        nxt = min(left, key=lambda s: km(path[-1], s))
        total += km(path[-1], nxt)
        path.append(nxt)
        left.remove(nxt)
    return path, total


@pytest.fixture(scope="module")
def days(spark):
    rng = random.Random(4)
    rows = [(i, [(-84 - rng.random(), 33 + rng.random()) for _ in range(n)]) for i, n in enumerate([1, 2, 3, 7, 12, 12, 30])]
    return rows, spark.createDataFrame(rows, "id int, stops array<struct<lon:double,lat:double>>")


def test_nearest_neighbour(days):
    rows, df = days
    got = {r.id: r.route for r in df.select("id", nearest_neighbour(F.col("stops")).alias("route")).collect()}
    for i, stops in rows:
        path, total = greedy(stops)
        assert [tuple(p) for p in got[i].path] == path and math.isclose(got[i].km, total, abs_tol=1e-9)


def test_path_and_insertion(days):
    rows, df = days
    extra = (-84.5, 33.5)
    stop = F.struct(F.lit(extra[0]).alias("lon"), F.lit(extra[1]).alias("lat"))
    for r in df.select("id", path_km(F.col("stops")).alias("km"), insertion_delta(F.col("stops"), stop).alias("delta")).collect():
        stops = rows[r.id][1]
        assert math.isclose(r.km, sum(km(a, b) for a, b in zip(stops, stops[1:])), abs_tol=1e-9)
        deltas = [km(s, extra) + (km(extra, stops[i + 1]) - km(s, stops[i + 1]) if i + 1 < len(stops) else 0) for i, s in enumerate(stops)]
        assert math.isclose(r.delta, max(0, min(deltas)), abs_tol=1e-9)


def test_timeline_has_one_lunch(spark):
    df = spark.createDataFrame([([(0.0, 150.0), (0.0, 60.0), (50.0, 45.0)],), ([(0.0, 500.0)],), ([(125.0, 45.0), (0.0, 45.0)],)], "jobs array<struct<km:double,minutes:double>>")
    got = [[(x.start, x.end, x.lunch) for x in r.rows] for r in df.select(timeline(F.col("jobs")).alias("rows")).collect()]
    assert got[0] == [(540, 690, True), (750, 810, False), (870, 915, False)]
    assert got[1] == [(540, 1040, False)]
    assert got[2] == [(750, 795, True), (795, 840, False)]


def test_weighted_chunks(spark):
    df = spark.createDataFrame([([1.0] * 6, 3), ([5.0, 1.0, 1.0], 3), ([1.0, 2.0], 1), ([], 2)], "w array<double>, k int")
    assert [list(r.c) for r in df.select(weighted_chunks(F.col("w"), F.col("k")).alias("c")).collect()] == [[0, 0, 1, 1, 2, 2], [0, 1, 2], [0, 0], []]


def test_coordinate_key_ignores_order(spark):
    df = spark.createDataFrame([([(1.0, 2.0), (3.0, 4.0)],), ([(3.0, 4.0), (1.0, 2.0)],)], "s array<struct<lon:double,lat:double>>")
    assert len({r.k for r in df.select(coordinate_key(F.col("s")).alias("k")).collect()}) == 1


def test_text(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(T.collapse(F.lit(" a \r\n b  c "))) == "a b c"
    assert [value(T.postal_key(F.lit(x))) for x in ("07001-1234", "7001.0", "07001", "ab1-2", "12.5", "1e3", " 7 x")] == ["7001", "7001", "7001", "AB1", "12", "1000", "7 X"]
    assert [value(T.postal_padded(F.lit(x))) for x in ("7001", "123456")] == ["07001", "123456"]
    assert [value(T.boolean(F.lit(x))) for x in ("Yes", "0", "what", "")] == [True, False, True, False]
    assert value(T.clock_minutes(F.lit("09:30"), 540)) == 570 and value(T.clock_minutes(F.lit("9:30"), 540)) == 540
    assert value(T.slug(F.lit("Los Angeles, CA!"))) == "los_angeles_ca"
    assert value(haversine_km(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0))) == 0.0


def test_street_takes_any_place_name(spark):
    rows = [("1 Main St, Odd\\Etown, GA 30301", "Odd\\Etown", "GA", "30301", "1 Main St"), ("5 A.B*C Rd (x), A.B*C GA 1", "A.B*C", "GA", "1", "5 A.B*C Rd (x)"), ("7 Q St \\Q", "\\Q", "GA", "2", "7 Q St \\Q")]
    df = spark.createDataFrame(rows, "line string, city string, state string, code string, want string")
    assert [r.got for r in df.select(T.street(F.col("line"), F.col("city"), F.col("state"), F.col("code"), F.lit("USA")).alias("got")).collect()] == [r[4] for r in rows]


def test_short_days_need_no_fold(spark):
    """Routes of up to two points and timelines of one job are plain branches beside the fold, with its results."""
    assert "CASE WHEN" in str(nearest_neighbour(F.col("p"))) and "CASE WHEN" in str(timeline(F.col("j")))
    point = "struct<lon:double,lat:double>"
    rows = spark.createDataFrame([([],), ([(-84.0, 33.0)],), ([(-84.0, 33.0), (-84.5, 33.5)],), ([(-84.0, 33.0), (-84.5, 33.5), (-84.1, 33.0)],)], f"p array<{point}>")
    got = [(r.r.path, r.r.km) for r in rows.select(nearest_neighbour(F.col("p")).alias("r")).collect()]
    assert [len(path) for path, _ in got] == [1, 1, 2, 3] and got[0][1] == got[1][1] == 0.0
    a = math.sin(math.radians(0.25)) ** 2 * (1 + math.cos(math.radians(33)) * math.cos(math.radians(33.5)))
    assert got[2][1] == pytest.approx(2 * 6371 * math.asin(math.sqrt(a))) and [p.lon for p in got[3][0]] == [-84.0, -84.1, -84.5]
    one = spark.createDataFrame([([(100.0, 45.0)],), ([(100.0, 45.0), (0.0, 45.0)],)], "j array<struct<km:double,minutes:double>>").select(timeline(F.col("j")).alias("t")).collect()
    assert one[0].t[0] == one[1].t[0]
