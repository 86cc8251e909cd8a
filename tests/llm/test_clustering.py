import hashlib
import math

import numpy as np
import pytest

from fieldroute.llm.clustering import Tree, clusters, distances, whole_vectors
from fieldroute.session import table


def plain(rows, k, rounds, dims, scale=64):
    """Every distance of every round, in Python's whole numbers."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [v for i, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda v: min(range(len(centroids)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, centroids[j])), j))
    for _ in range(rounds):
        of = [near(v) for _, v in kept]
        for j in set(of):
            own = [v for (_, v), o in zip(kept, of) if o == j]
            centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    out, inertia = [], {}
    for i, v in kept:
        j = near(v)
        d = sum((a - b) ** 2 for a, b in zip(v, centroids[j]))
        inertia[j] = inertia.get(j, 0) + d
        out.append((i, j, d))
    return sorted([(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, d in out], key=repr)


def held(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_whole_table(spark, sf):
    t = table(spark, sf, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in t.collect()]
    assert held(clusters(t, 16, 3, 64)) == plain(rows, 16, 3, 64)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 10]) for i in range(300)]
    rows += [(900 + i, [1.5, 2.0, -0.25, 0.0]) for i in range(200)]  # copies: balls of radius 0
    rows += [(i % 7, [0.0, 0.0, 0.0, 0.0]) for i in range(40)]  # repeated ids, ties between equal centroids
    rows += [(None, [1.0, 1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (5000, None), (5001, []), (5002, [1.0]), (5003, [1.0, None, 2.0, 3.0]), (5004, [1.0, float("nan"), 2.0, 3.0]), (5005, [float("inf"), 0.0, 2.0, 3.0]), (5006, [1.0] * 5)]
    rows += [(6000, [1e6, -1e6, 2e6, 0.5])]  # beyond what doubles multiply exactly
    frame = spark.createDataFrame([(i, v, "c", 7) for i, v in rows], "vec_id long, embedding array<double>, cluster string, v int")
    assert held(clusters(frame, 16, 3, 4)) == plain(rows, 16, 3, 4)
    assert held(clusters(frame.repartition(1), 5, 2, 4)) == plain(rows, 5, 2, 4)


def test_few_and_none(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert held(clusters(frame, 16, 3, 2)) == plain([(1, [1.0, 2.0]), (2, [3.0, 4.0])], 16, 3, 2)
    assert clusters(frame.limit(0), 16, 3, 2).count() == 0
    assert clusters(frame, 16, 3, 64).count() == 0


def test_numbers_too_large_fail_loudly(spark):
    with pytest.raises(Exception, match="beyond"):
        whole_vectors(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), 2).collect()


def test_balls_are_assigned_whole():
    """Two far heaps: every ball goes to one centroid without a look at its vectors, and a mixed tree agrees with plain distances."""
    rng = np.random.default_rng(1)
    heaps = np.concatenate([rng.integers(-5, 5, (500, 8)), rng.integers(995, 1005, (500, 8))])
    tree, order = Tree.build(heaps)
    centroids = np.array([[0] * 8, [1000] * 8])
    balls, _, rows, _ = tree.assign(centroids)
    assert len(rows) == 0 and len(balls) == 2
    assert (tree.labels(centroids) == distances(heaps, centroids).argmin(1)[order]).all()
    mixed = rng.integers(-200, 200, (1000, 8))
    tree, order = Tree.build(mixed)
    centroids = np.concatenate([mixed[:9], mixed[:2]])  # ties
    assert (tree.labels(centroids) == distances(mixed, centroids).argmin(1)[order]).all()
    count, total = tree.totals(centroids)
    of = distances(mixed, centroids).argmin(1)
    assert count.tolist() == [int((of == j).sum()) for j in range(11)]
    assert total.tolist() == [mixed[of == j].sum(0).tolist() for j in range(11)]
