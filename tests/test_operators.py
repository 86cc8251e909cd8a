import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldroute.operators import regions as G
from fieldroute.operators import relational as R
from fieldroute.sources import files


def test_regions_cover_and_balance():
    rng = np.random.default_rng(1)
    points, weights = rng.random((60, 2)) + [33, -84], rng.integers(1, 9, 60).astype(float)
    for k in (1, 3, 7):
        labels = G.balanced_regions(points, weights, k)
        load = np.bincount(labels, weights, k)
        assert len(load) == k and (load > 0).all() and load.max() <= 2.5 * load.mean()
        assert len(np.unique(G.weighted_kmeans(points, weights, k))) <= k


def test_growth_follows_its_formula():
    """Labels of a plain version, one score at a time."""
    rng = np.random.default_rng(3)
    for n, k in ((12, 2), (30, 3), (40, 5), (5, 5), (1, 1), (9, 1)):
        points, weights = rng.random((n, 2)) + [33, -84], rng.integers(1, 9, n).astype(float)
        got = G.balanced_regions(points, weights, k)
        if k <= 1 or k >= n:
            assert got.tolist() == (list(range(n)) if k >= n > 1 else [0] * n)
            continue
        gap = lambda i, c: float(G.distances(points[i : i + 1], np.array([c]))[0, 0])
        first = [max(range(n), key=lambda i: weights[i])]
        while len(first) < k:
            first.append(max((i for i in range(n) if i not in first), key=lambda i: min(gap(i, points[j]) for j in first) * weights[i]))
        centre = np.average(points, axis=0, weights=weights)
        spread = [gap(i, centre) for i in range(n) for _ in range(int(weights[i]))]
        limit = max(15.0, float(np.percentile(spread, 85)) / k**0.5 * 1.8)
        target, centres, labels = weights.sum() / k, [points[i] for i in first], None
        for _ in range(20):
            now, load, reach = {i: c for c, i in enumerate(first)}, [weights[i] for i in first], [0.0] * k
            for i in sorted((i for i in range(n) if i not in first), key=lambda i: -weights[i]):
                cost = [gap(i, centres[c]) + 120 * ((load[c] + weights[i] - target) / max(target, 1)) ** 2 + 40 * max(0, (max(reach[c], gap(i, centres[c])) - limit) / max(limit, 1)) ** 2 for c in range(k)]
                c = now[i] = cost.index(min(cost))
                load[c], reach[c] = load[c] + weights[i], max(reach[c], gap(i, centres[c]))
            centres = [np.average([points[i] for i in range(n) if now[i] == c], axis=0, weights=[weights[i] for i in range(n) if now[i] == c]) for c in range(k)]
            if now == labels:
                break
            labels = now
        assert got.tolist() == [labels[i] for i in range(n)]


def test_single_jobs_are_absorbed():
    points = np.array([[33.0, -84.0], [33.01, -84.0], [33.02, -84.0], [35.0, -80.0], [33.0, -84.01]])
    labels = G.absorb_singles(points, np.full(5, 45.0), np.array([0, 0, 1, 2, 3]))
    assert labels[0] == labels[1] and len(set(labels[[0, 1, 2, 4]])) <= 2 and (np.bincount(labels[[0, 1, 2, 4]]) != 1).all()
    assert (labels == labels[3]).sum() == 1  # too far for a day's work
    assert G.absorb_singles(points, np.full(5, 300.0), np.arange(5)).tolist() == [0, 1, 2, 3, 4]


def test_a_cluster_of_four_takes_in_a_single():
    """Four jobs are not too many to take in a fifth; five are."""
    points = np.array([[33 + i * 0.001, -84.0] for i in range(6)])
    assert G.absorb_singles(points[:5], np.full(5, 60.0), np.array([0, 0, 0, 0, 1])).tolist() == [0] * 5
    assert G.absorb_singles(points, np.full(6, 60.0), np.array([0, 0, 0, 0, 0, 1])).tolist() == [0, 0, 0, 0, 0, 1]


def test_region_count_by_demand(spark):
    rows = [(2.4, 5.0, 90, 1), (26.0, 5.0, 90, 2), (26.0, 0.0, 90, 1), (200.0, 4.0, 3, 3), (0.0, 7.0, 5, 1)]
    got = spark.createDataFrame(rows, "daily double, slot double, postals int, want int").withColumn("n", G.region_count(F.col("daily"), F.col("slot"), F.col("postals")))
    assert all(r.n == r.want for r in got.collect())


def plain_units(points, per_unit=4, job_min=60.0, cap=4):
    """Units of one day by loops: growth by its formula, limits cluster by cluster, single jobs joined until nothing moves."""
    n = len(points)
    gap = G.distances(points, points)

    def path(own):
        left, at, total = list(own[1:]), own[0], 0.0
        while left:
            near = min(left, key=lambda j: gap[at, j])
            total, at = total + gap[at, near], near
            left.remove(near)
        return total

    for k in range(max(1, -(-n // per_unit)), n + 1):
        labels = G.balanced_regions(points, np.ones(n), k).tolist()
        paths = [(path(own), len(own)) for own in ([j for j in range(n) if labels[j] == c] for c in set(labels))]
        if all(km <= 120 and km * 1.2 <= 240 and km * 1.2 + job_min * m <= 480 for km, m in paths):
            break
    while True:
        moved, sizes = False, {c: labels.count(c) for c in set(labels)}
        for single in sorted(c for c, m in sizes.items() if m == 1):
            own = [j for j in range(n) if labels[j] == single]
            if not own:
                continue
            choices = []
            for other in sorted(sizes):
                theirs = [j for j in range(n) if labels[j] == other]
                if other != single and theirs and sizes[other] <= cap:
                    both = sorted(own + theirs)
                    km = path(both)
                    if km * 1.2 + job_min * len(both) <= 480:
                        choices.append((km, km * 1.2 + job_min * len(both), min(gap[own[0], j] for j in theirs), other))
            if choices:
                for j in own:
                    labels[j] = min(choices)[-1]
                moved = True
        if not moved:
            return labels


def test_batches_against_loops(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for d in range(40):
        points = rng.random((int(rng.integers(1, 16)), 2)) * rng.choice([0.05, 0.5, 1.5]) + [33, -84]
        date = f"2024-0{d % 3 + 1}-{d // 3 + 1:02d}"
        rows += [("c", date, f"r{i:02d}", float(p[0]), float(p[1])) for i, p in enumerate(points)]
        want[date] = plain_units(points)
    jobs = spark.createDataFrame(rows, "city string, day string, receipt_no string, latitude double, longitude double").withColumn("service_date", F.to_date("day"))
    got = {}
    for r in G.batch_days(jobs, ["city", "service_date"]).collect():
        got.setdefault(str(r.service_date), {})[r.receipt_no] = r.unit
    for date, labels in want.items():
        units = [got[date][f"r{i:02d}"] for i in range(len(labels))]
        assert [[a == b for a in units] for b in units] == [[a == b for a in labels] for b in labels], date
    long = G.batch_days(jobs, ["city", "service_date"], most_jobs=4).collect()
    assert len(long) == len(rows) and max(r.unit for r in long) >= 8
    assert max(r["count"] for r in spark.createDataFrame(long).groupBy("service_date", "unit").count().collect()) <= 4


def test_day_batches_hold_the_limits():
    rng = np.random.default_rng(2)
    points, minutes = rng.random((25, 2)) * 0.3 + [33, -84], np.full(25, 45.0)
    labels = G.day_batches(points, minutes, 5)
    for c in range(labels.max() + 1):
        own = labels == c
        length = G.path_length(points[own]) if own.any() else 0
        assert minutes[own].sum() + length / 50 * 60 <= 480 and length <= 120


def test_upsert_and_priority(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, R.upsert(a, b, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, R.union_by_priority([a, b], ["k"]).select("k", "v").collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name,city\nÉva,\n".encode())
    (tmp_path / "b.csv").write_bytes("name,city\nÉva,Köln\n".encode("latin-1"))
    a, b = files.read_csv(spark, str(tmp_path / "a.csv")), files.read_csv(spark, str(tmp_path / "b.csv"), encodings=("UTF-8", "ISO-8859-1"))
    assert a.columns == ["name", "city"] and a.first().name == "Éva" and b.first().city == "Köln"
    with pytest.raises(ValueError):
        files.read_csv(spark, "x.pdf")


def test_sinks(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    base.write.parquet(str(tmp_path / "t"))
    files.replace_by_key(spark.createDataFrame([(2, "x")], "k int, v string"), str(tmp_path / "t"), ["k"], str(tmp_path / "u"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "u")).collect())) == [(1, "a"), (2, "x")]
    with pytest.raises(Exception, match="duplicate key"):
        files.require_unique(base.union(base), ["k"])


def test_days_side_by_side(monkeypatch):
    """Many days are batched as each alone, in steps that do not grow with the number of days."""
    rng = np.random.default_rng(9)
    days = [np.round(rng.random((int(rng.integers(2, 40)), 2)) * rng.choice([0.02, 0.3, 2.0]), int(rng.integers(1, 6))) + [33, -84] for _ in range(60)]
    minutes, calls, plain = [np.full(len(d), 60.0) for d in days], [], G.distances
    side = G.Side(days)
    labels = G.batches(side, minutes, 4)
    got = [G.absorb(side, i, minutes[i], x) for i, x in enumerate(labels)]
    for points, mine, first in zip(days, got, labels):
        assert [[a == b for a in mine] for b in mine] == [[a == b for a in x] for x in [plain_units(points)] for b in x]
        assert first.tolist() == G.balanced_regions(points, np.ones(len(points)), int(first.max()) + 1).tolist()
    monkeypatch.setattr(G, "distances", lambda a, b: calls.append(1) or plain(a, b))
    counts = []
    for some in (days[:1] * 2, days[:1] * 40):
        calls.clear()
        G.batches(G.Side(some), [np.full(len(d), 60.0) for d in some], 4)
        counts.append(len(calls) - len(some))  # a radius a day
    assert counts[0] == counts[1]


def test_a_month_of_single_jobs():
    """A group whose days have one job each has nothing to batch."""
    assert G.batches(G.Side([]), [], 4) == []
