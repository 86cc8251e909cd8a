from collections import Counter, defaultdict
from datetime import date
from statistics import pstdev

import pytest

from fieldroute.operators.profiles import synced_profile
from fieldroute.plans import actuals, dispatch

from .plain_assignment import km

D = date(2024, 3, 1)


def test_engineer_days_with_odd_rows(spark):
    rows = [
        ("r1", 1, "e1", "DMS", 2, 33.0, -84.0, False, 45), ("r1", 2, "e1", "DMS", 2, 33.2, -84.1, True, 100), ("r2", 1, "e1", "dms", 1, 33.0, -84.0, False, 45), ("r3", 1, "e1", "DMS", 1, None, -84.0, False, 45),
        ("r4", 1, "e2", "DMS2", None, 33.4, -84.4, True, 300), ("r5", 1, "e2", "DMS2", None, 33.9, -84.9, True, 150), ("r6", 1, "e3", "OTHER", 1, 33.0, -84.0, False, 45), ("r7", 1, "e4", "DMS", 3, None, None, False, 45), ("r8", 1, None, "DMS", 3, 33.0, -84.0, False, 45),
    ]
    jobs = spark.createDataFrame([(r[0], int(r[0][1:]), *r[1:], D) for r in rows], "receipt_no string, l_orderkey long, l_linenumber int, engineer_code string, center_type string, region_seq int, latitude double, longitude double, is_heavy boolean, service_min int, service_date date")
    homes = spark.createDataFrame([("e1", 33.1, -84.0), ("e1", 33.1, -84.0), ("e2", None, -84.0), ("e9", 1.0, 1.0)], "engineer_code string, home_lat double, home_lon double")
    got = {r.engineer_code: r for r in actuals.actual_days(jobs, homes).collect()}
    assert set(got) == {"e1", "e2", "e4", None}
    first = got["e1"]
    # From home the nearest is (33.0, -84.0), 11.1 km off; regions 1 and 2 are level, so the smaller.
    way = km((33.1, -84.0), (33.0, -84.0)) + km((33.0, -84.0), (33.2, -84.1))
    assert (first.region_seq, first.job_count, first.units, first.service_min) == (1, 3, 5, 235) and abs(first.km - way) < 0.006
    second = got["e2"]
    assert second.region_seq is None and abs(second.km - km((33.4, -84.4), (33.9, -84.9))) < 0.006
    assert second.overflow_480 and abs(second.total_min - 450 - second.travel_min) < 1e-9
    assert (got["e4"].km, got["e4"].total_min, got["e4"].overflow_480) == (0.0, 45.0, False)
    assert actuals.actual_days(jobs.limit(0), homes).count() == 0


def test_profile_sync_against_loop(spark):
    coverage = [("30301", "ATL", "DMS", "A1", "Area 1", "e1"), ("30301", "ATL", "DMS", "A2", "Area 2", "e2"), (" 30301", "ATL ", "DMS", "A2", "Area 2", "e1"), ("301", "ATL", "DMS", "B", "Area b", "e3"), ("301", "ATL", "DMS", "A", "Area a", "e3"), ("30305", "ATL", "DMS2", None, None, None)]
    slots = [("S", "e1", "One", 5, "ATL"), ("R", "e1", "One", 6, "ATL"), ("S", "e7", "Seven", 4, "ATL"), ("S", "e2", None, None, "ATL")]
    services = [("e1", "One", "30301", "ATL", "DMS"), ("e1", "One", "30301", "ATL", "DMS"), ("e2", "Two", "301", "ATL", "DMS"), ("e5", "Five", "99999", "ATL", "DMS"), ("e5", "Cinq", "30305", "ATL", "DMS2"), ("e8", "Eight", "30301", "ATL", "ASC"), ("", "Blank", "30301", "ATL", "DMS"), (None, "Null", "30301", "ATL", "DMS"), ("e9", "Nine", "", "ATL", "DMS")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    c = frame([(*r[:5], "ST", "D", r[5]) for r in coverage], "postal_code string, city string, center_type string, area_code string, area_name string, ship_to string, department string, engineer_code string")
    s = frame(slots, "ship_to string, engineer_code string, engineer_name string, slot int, city string")
    v = frame(services, "engineer_code string, engineer_name string, postal_code string, city string, center_type string")
    out = synced_profile(c, s, v)
    assert sorted((r.postal_code, r.area_name, r.engineer_code) for r in out["coverage"].collect()) == [("00301", "Area a", "e2"), ("30301", "Area 2", "e1"), ("30305", "", "e5")]
    assert sorted((r.engineer_code, r.ship_to, r.engineer_name, r.slot) for r in out["slots"].collect()) == [("e1", "R", "One", 6), ("e2", "S", "", None), ("e5", "", "Cinq", 7)]
    assert out["unmatched"].count() == 0
    # The blank code of the last coverage row counts as an engineer that is no longer there.
    assert {r.metric: r.value for r in out["summary"].collect()} == {"active_engineers": 3, "coverage_rows": 3, "coverage_engineers": 3, "primary_area_postals": 3, "slot_rows": 3, "slots_added": 1, "coverage_engineers_removed": 2, "slot_engineers_removed": 1, "engineers_unmatched": 0}
    empty = synced_profile(c.limit(0), s.limit(0), v.limit(0))
    assert [empty[k].count() for k in ("coverage", "slots", "unmatched")] == [0, 0, 0] and {r.value for r in empty["summary"].collect()} == {0}


def test_actual_against_plan_against_loop(spark, sf):
    got = {(r.city, r.service_date): r for r in actuals.rp_actual_against_plan(spark, sf).collect()}
    jobs = {r.receipt_no: r for r in dispatch.day_jobs(spark, sf).collect()}
    homes = {r.engineer_code: (r.home_lat, r.home_lon) for r in dispatch.roster(spark, sf).collect()}
    plan = {r.receipt_no: r.engineer_code for r in dispatch.df_assignment(spark, sf).collect()}
    for name, who in (("actual", {k: r.current_code for k, r in jobs.items()}), ("plan", plan)):
        days, lines = defaultdict(lambda: defaultdict(list)), Counter()
        for receipt, code in who.items():
            if code is not None:
                days[jobs[receipt].city, jobs[receipt].service_date][code].append(receipt)
        for key, staff in days.items():
            km_sum, totals, counts = 0.0, [], []
            for code, receipts in staff.items():
                left, at, way = list(dict.fromkeys((jobs[r].latitude, jobs[r].longitude) for r in sorted(receipts))), homes[code], 0.0
                while left:
                    near = min(left, key=lambda p: km(at, p))
                    way, at = way + km(at, near), near
                    left.remove(near)
                km_sum += round(way, 2)
                totals.append(sum(jobs[r].service_min for r in receipts) + way / 50 * 60)
                counts.append(len(receipts))
            r = got[key].asDict()
            assert (r[f"engineers_{name}"], r[f"jobs_{name}"]) == (len(staff), sum(counts))
            assert r[f"km_{name}"] == pytest.approx(km_sum, abs=0.02 * len(staff)) and r[f"longest_{name}"] == pytest.approx(max(totals), abs=0.02)
            assert r[f"jobs_std_{name}"] == pytest.approx(pstdev(counts), abs=1e-3) and r[f"overflow_480_{name}"] == sum(t > 480 for t in totals)
            lines[name] += 1
        assert lines[name] == sum(getattr(r, f"jobs_{name}") is not None for r in got.values()) > 0
