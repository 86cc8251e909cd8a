from pyspark.sql import functions as F

from fieldroute.operators.geocode import geocode_run, place_counts, remaining_quota

SCHEMA = "address_key string, latitude double, longitude double"


def answer(spark, rows):
    return lambda batch: batch.join(spark.createDataFrame(rows, SCHEMA), "address_key")


def test_runs_until_nothing_is_pending(spark):
    services = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, None), (6, " "), (7, "d"), (8, "e")], "id int, address_key string")
    cache = spark.createDataFrame([("a", 1.0, 2.0), ("a", None, 2.0), ("z", 9.0, 9.0)], SCHEMA)
    ask = answer(spark, [("b", 3.0, 4.0), ("b", 2.0, 9.0), ("c", None, None), ("d", 5.0, 6.0), ("a", 0.0, 0.0)])
    run = geocode_run(services, cache, ask, 2)
    assert tuple(run["report"].first()) == (5, 1, 4, 2, 2, 0, 2)
    got = {r.id: (r.latitude, r.source) for r in run["located"].collect()}
    assert got == {1: (1.0, "cache"), 2: (2.0, "new"), 3: (2.0, "new"), 4: (None, "failed"), 5: (None, "failed"), 6: (None, "failed"), 7: (None, "failed"), 8: (None, "failed")}
    assert tuple(place_counts(run["located"]).first()) == (3, 5, 2, 4)
    # The next run goes on with the rest: an answer without a place is not asked for again, a key without an answer is.
    second = geocode_run(services, run["cache"], ask, 2)
    assert tuple(second["report"].first()) == (5, 3, 2, 2, 1, 1, 1)
    assert {r.address_key for r in second["cache"].collect()} == {"a", "b", "c", "d", "z"}
    third = geocode_run(services, second["cache"], ask, 0)
    assert tuple(third["report"].first()) == (5, 4, 1, 0, 0, 0, 1)


def test_empty_and_quota(spark):
    none = spark.createDataFrame([], "id int, address_key string")
    run = geocode_run(none, spark.createDataFrame([], SCHEMA), answer(spark, []), 5)
    assert tuple(run["report"].first()) == (0, 0, 0, 0, 0, 0, 0) and run["located"].isEmpty()
    log = spark.createDataFrame([("2024-01-01", 4), ("2024-01-01", 3), ("2024-01-02", 1)], "run_date string, n int")
    assert [remaining_quota(log, F.lit(d), 6) for d in ("2024-01-01", "2024-01-02", "2024-01-03")] == [0, 5, 6]
