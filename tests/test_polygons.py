import math
import random

from pyspark.sql import functions as F

from fieldroute.operators.polygons import area, boundary, rings
from fieldroute.operators.route_chain import chained_routes, ordered_key


def trace(cells):
    """Rings of the outline of unit squares, by walking: at a corner of four edges the walk turns left."""
    edges = {}
    for i, j in cells:
        for a, b, other in (((i, j), (i + 1, j), (i, j - 1)), ((i + 1, j), (i + 1, j + 1), (i + 1, j)), ((i + 1, j + 1), (i, j + 1), (i, j + 1)), ((i, j + 1), (i, j), (i - 1, j))):
            if other not in cells:
                edges.setdefault(a, []).append(b)
    out = []
    while edges:
        start = min(edges)
        a, b = start, min(edges[start])
        ring, first = [], (a, b)
        while True:
            ring.append(a)
            edges[a].remove(b)
            if not edges[a]:
                del edges[a]
            if b == first[0] and (b not in edges or first[1] not in edges.get(b, [first[1]])):
                nexts = edges.get(b, [])
                if not nexts:
                    break
            turn = lambda c: math.atan2((b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]), (b[0] - a[0]) * (c[0] - b[0]) + (b[1] - a[1]) * (c[1] - b[1]))  # noqa: E731,B023
            options = edges.get(b, []) + ([first[1]] if b == first[0] else [])
            nxt = max(options, key=turn)
            if b == first[0] and nxt == first[1]:
                break
            a, b = b, nxt
        out.append(ring)
    return out


def test_unions_of_squares(spark):
    """Edges, areas and rings of random sets of squares: holes, heaps that touch at a corner, either direction, closed or open."""
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(12):
        cells = {(rng.randrange(6), rng.randrange(6)) for _ in range(rng.randrange(1, 30))}
        if g == 0:
            cells = {(i, j) for i in range(5) for j in range(5)} - {(2, 2)}  # a hole
        if g == 1:
            cells = {(0, 0), (1, 1), (5, 5)}  # corners that touch
        want[g] = cells
        for i, j in cells:
            ring = [(float(i), float(j)), (i + 1.0, float(j)), (i + 1.0, j + 1.0), (float(i), j + 1.0)]
            ring = ring[::-1] if rng.random() < 0.5 else ring
            rows.append((g, ring + [ring[0]] if rng.random() < 0.5 else ring))
    df = spark.createDataFrame(rows, "g int, ring array<struct<x:double,y:double>>")
    edges = boundary(df, ["g"]).cache()
    sums = {r.g: (r.edges, r.area) for r in area(edges, ["g"]).collect()}
    found = {}
    for r in rings(edges, ["g"]).collect():
        found.setdefault((r.g, r.ring), {})[r.place] = (int(r.point.x), int(r.point.y))
    for g, cells in want.items():
        traced = trace(cells)
        assert sums[g] == (sum(map(len, traced)), len(cells))
        mine = [[x[k] for k in range(len(x))] for (own, _), x in found.items() if own == g]
        turned = lambda ring: min(tuple(ring[k:] + ring[:k]) for k in range(len(ring)))
        assert sorted(map(turned, mine)) == sorted(map(turned, traced)), g
    assert len([k for k in found if k[0] == 0]) == 2 and len([k for k in found if k[0] == 1]) == 3


def test_flat_and_empty_polygons(spark):
    df = spark.createDataFrame([(1, []), (1, [(0.0, 0.0), (1.0, 1.0)]), (2, None)], "g int, ring array<struct<x:double,y:double>>")
    assert boundary(df, ["g"]).count() == 0 and rings(boundary(df, ["g"]), ["g"]).count() == 0


def test_chain_of_sources(spark):
    stops = "stops array<struct<lon:double,lat:double>>"
    days = spark.createDataFrame([(k, [(float(k % 3), 0.0), (1.0, 1.0)]) for k in range(6)] + [(9, [])], f"id int, {stops}")
    key = {r.id: r.k for r in days.select("id", ordered_key(F.col("stops")).alias("k")).collect()}
    assert key[0] == key[3] and len(set(key.values())) == 4
    cache = spark.createDataFrame([(key[0], 5.0, 6.0), (key[0], 4.0, 9.0), (key[1], None, 1.0)], "cache_key string, distance_km double, duration_min double")
    service = spark.createDataFrame([(key[0], 1.0, 1.0), (key[1], 7.0, 8.0)], "cache_key string, distance_km double, duration_min double")
    routes, new = chained_routes(days, {"cache": cache, "service": service})
    got = {r.id: (r.source, r.distance_km) for r in routes.collect()}
    assert got[0] == got[3] == ("cache", 4.0) and got[1] == got[4] == ("service", 7.0)
    assert got[2][0] == "haversine" and got[2] == got[5] and 150 < got[2][1] < 160 and got[9] == ("haversine", 0.0)
    assert sorted(r.cache_key for r in new.collect()) == sorted({key[1], key[2], key[9]})
    # Once the new routes are in the cache, it answers all.
    again, fresh = chained_routes(days, {"cache": cache.unionByName(new), "service": service})
    assert {r.source for r in again.collect()} == {"cache"} and fresh.count() == 0
