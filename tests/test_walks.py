from statistics import mean, pstdev

import numpy as np

from fieldroute.plans import domain, walks
from fieldroute.operators.attendance import replacements
from fieldroute.queries import QUERIES
from fieldroute.sources.adapter import visits

from .test_operators import plain_units


def test_attendance_row_for_row(spark):
    """Every date by a loop: those present, then for each of the others the best who is left."""
    sf = "/root/testdata/sf0.01"  # cities of several engineers
    roster, actual = {}, {}
    for r in walks._roster(spark, sf).collect():
        roster.setdefault(r.city, {})[r.engineer_code] = r
    for r in walks._actual(spark, sf).collect():
        actual.setdefault((r.city, r.service_date), []).append(r)
    got = {}
    for r in QUERIES["df_attendance"](spark, sf).collect():
        got.setdefault((r.city, r.service_date), set()).add((r.engineer_code, r.role, r.stands_for))
    replaced = 0
    for key, rows in actual.items():
        staff = roster.get(key[0], {})
        want = {(r.engineer_code, "present", None) for r in rows if r.engineer_code in staff}
        left = [c for c in staff if c not in {r.engineer_code for r in rows}]
        for r in sorted(rows, key=lambda r: r.turn):
            if r.engineer_code in staff or not left:
                continue
            rank = lambda c: (staff[c].center_type == r.want_center, staff[c].region_seq == r.want_region, staff[c].anchor_region == r.want_region, staff[c].overlap or 0, staff[c].ratio or 0)  # noqa: E731,B023
            top = max(rank(c) for c in left)
            best = min(c for c in left if rank(c) == top)
            left.remove(best)
            want.add((best, "replacement", r.engineer_code))
            replaced += 1
        assert got.pop(key, set()) == want, key
    assert not got and replaced > 20


def test_units_row_for_row(spark, sf):
    days = {}
    for r in QUERIES["df_integrated_units"](spark, sf).collect():
        days.setdefault((r.city, r.region, r.service_date), []).append(r)
    assert any(len(rows) > 1 for rows in days.values())
    for key, rows in days.items():
        rows = sorted(rows, key=lambda r: r.receipt_no)
        want = plain_units(np.array([[r.latitude, r.longitude] for r in rows]))
        assert [[a.unit == b.unit for a in rows] for b in rows] == [[a == b for a in want] for b in want], key


def summaries(routes):
    """Day by city from (city, date, jobs, km) of routes, then means by city."""
    days = {}
    for city, date, jobs, km in routes:
        days.setdefault((city, date), []).append((jobs, km))
    daily = {}
    for key, rows in days.items():
        n, total = len(rows), sum(km for _, km in rows)
        daily[key] = {"deployed": n, "jobs": sum(j for j, _ in rows), "distance_km": total, "duration_min": sum(round(km * 1.2, 2) for _, km in rows), "jobs_std": pstdev([j for j, _ in rows]), "distance_per_unit": round(total / n, 2)}
    cities = {}
    for (city, _), day in daily.items():
        cities.setdefault(city, []).append(day)
    return daily, {city: {c: mean(d[c] for d in own) for c in own[0]} for city, own in cities.items()}


def test_flagship_and_its_parts_by_plain_sums(spark, sf):
    """Daily, city and overall summaries from the routes' own rows; those rows are held against SQL and loops elsewhere."""
    city_of = {r.engineer_code: r.city for r in visits(spark, sf).select("engineer_code", "city").distinct().collect()}
    routes = [(city_of[r.engineer_code], r.service_date, r.job_count, r.distance_km) for r in QUERIES["df_engineer_day_routes"](spark, sf).collect()]
    daily, now = summaries(routes)
    got = {(r.city, r.service_date): r for r in QUERIES["df_current_daily"](spark, sf).collect()}
    assert set(got) == set(daily)
    for key, want in daily.items():
        assert all(abs(got[key][c] - x) < 0.011 for c, x in want.items()), key
    city = {r.city: r for r in QUERIES["df_city_summary"](spark, sf).collect()}
    assert set(city) == set(now) and all(abs(city[k][c] - x) < 0.011 for k, want in now.items() for c, x in want.items())

    units = {}
    for r in QUERIES["df_integrated_units"](spark, sf).orderBy("l_orderkey", "l_linenumber").collect():
        units.setdefault((r.city, r.service_date, r.region, r.unit), []).append((r.latitude, r.longitude))
    from .test_queries import km

    def greedy(points):
        left = list(dict.fromkeys(points))
        at, total = left.pop(0), 0.0
        while left:
            near = min(left, key=lambda p: km(at, p))
            total, at = total + km(at, near), near
            left.remove(near)
        return round(total, 3)

    _, then = summaries([(c, d, len(p), greedy(p)) for (c, d, _, _), p in units.items()])
    rows = {r.city: r for r in QUERIES["flagship_routing_compare"](spark, sf).collect()}
    assert set(rows) == set(now) | set(then) | {"ALL"}
    for k in set(now) & set(then):
        for c in domain.MEASURES:
            assert abs(rows[k][f"{c}_current"] - now[k][c]) < 0.02 and abs(rows[k][f"{c}_integrated"] - then[k][c]) < 0.02, (k, c)
            assert abs(rows[k][f"{c}_delta"] - (then[k][c] - now[k][c])) < 0.03
    for c in domain.MEASURES:
        assert abs(rows["ALL"][f"{c}_current"] - mean(rows[k][f"{c}_current"] for k in now)) < 0.011


def test_sweep_read_outs(spark, sf):
    rows = [("a", 1, 5.0, None), ("a", 2, 3.0, None), ("a", 3, 3.0, None), ("b", 1, 1.0, False), ("b", 2, 9.0, True)]
    best = {r.city: r.best_regions for r in walks.best_counts(spark.createDataFrame(rows, "city string, regions int, balance_score double, is_best boolean")).collect()}
    assert best == {"a": 2, "b": 2}
    sweep = {(r.city, r.regions): r for r in QUERIES["df_region_sweep"](spark, sf).collect()}
    for r in QUERIES["xt_best_count"](spark, sf).collect():
        own = {k: x for (c, k), x in sweep.items() if c == r.city}
        assert own[r.best_regions].is_best and r.balance_score == min(x.balance_score for x in own.values())
        assert r.tried == ",".join(map(str, sorted(own)))
    table = QUERIES["xt_candidate_table"](spark, sf).collect()
    current = {r.city: r for r in QUERIES["df_city_summary"](spark, sf).collect()}
    assert len(table) == len(sweep) + len({r.city for r in table})
    for r in table:
        if r.scenario == "current":
            assert abs(r.deployed - current[r.city].deployed) < 0.011 and r.balance_score is None
        else:
            x = sweep[r.city, int(r.scenario[2:])]
            assert r.balance_score == x.balance_score and r.is_best == x.is_best
            base = next(t for t in table if t.city == r.city and t.scenario == "current")
            if base.deployed:
                assert abs((r.deployed - base.deployed) / base.deployed * 100 - x.headcount_pct) < 0.01


def test_replacements_of_a_large_city(spark):
    """A day of 400 absent engineers takes the best 400 of 4 000, each once, without ranking all of them for each."""
    import time

    days = "explode(sequence(date'2024-01-01', date'2024-01-20')) as service_date"
    actual = spark.range(400).selectExpr("'c' city", days, "concat('x', lpad(id, 4, '0')) engineer_code", "'DMS' want_center", "cast(id % 3 + 1 as int) want_region", "cast(id as int) turn")
    roster = spark.range(4000).selectExpr("'c' city", "concat('e', lpad(id, 4, '0')) engineer_code", "'DMS' center_type", "cast(id % 3 + 1 as int) region_seq", "cast(id % 3 + 1 as int) anchor_region", "cast(if(id % 2 = 0, null, id) as int) overlap", "cast(null as double) ratio")
    began = time.time()
    got = replacements(actual, roster, ["city", "service_date"]).collect()
    assert time.time() - began < 15
    assert len(got) == len({(r.service_date, r.engineer_code) for r in got}) == 8000
    assert min(int(r.engineer_code[1:]) for r in got if int(r.stands_for[1:]) < 3) >= 3997 - 3


def test_units_keep_their_jobs(spark, sf, monkeypatch):
    """Routes of units come from the task that batched them, as from the rows of df_integrated_units, and lines are joined once for jobs and once for demand."""
    made, visits = [], domain.visits
    monkeypatch.setattr(domain, "visits", lambda *a: made.append(1) or visits(*a))
    units = domain.df_integrated_units(spark, sf)
    assert len(made) == 2
    keys = ["city", "region", "service_date"]
    jobs = units.drop("unit")
    packed = domain.routed(domain.batch_stops(jobs, keys, domain.ORDINALS), [*keys, "unit"])
    plain = domain.route_groups(units, [*keys, "unit"])
    assert plain.count() == packed.count() and plain.exceptAll(packed).count() == 0
