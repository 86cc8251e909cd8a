"""Routes and timelines as higher-order folds over an array of stops; no Python in the tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldroute.functions.geo import haversine_km, travel_minutes

#: Fixed values, in minutes: day start, lunch window and lunch length.
DAY_START, LUNCH_FROM, LUNCH_TO, LUNCH = 540, 690, 810, 60
STOP = "struct<lon:double,lat:double>"
STATE = f"struct<lon:double,lat:double,left:array<{STOP}>,path:array<{STOP}>,km:double>"


def stops(ordinals, lon, lat):
    """Aggregate: distinct complete stops of a group in first-seen order; ordinals is a list of ordering columns."""
    seen = F.collect_list(F.when(lon.isNotNull() & lat.isNotNull(), F.struct(*ordinals, F.struct(lon.alias("lon"), lat.alias("lat")).alias("stop"))))
    return F.array_distinct(F.transform(F.sort_array(seen), lambda x: x["stop"]))


def nearest_neighbour(points, start=None):
    """Greedy open path from the first stop (or from ``start``): struct of path and km. Most days have a stop or two: they need no fold."""
    first = F.get(points, F.lit(0)) if start is None else start
    left = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))) if start is None else points
    begin = F.struct(first["lon"].alias("lon"), first["lat"].alias("lat"), left.alias("left"), F.array(first).cast(f"array<{STOP}>").alias("path"), F.lit(0.0).alias("km")).cast(STATE)

    def step(state, _):
        near = F.array_min(F.transform(state["left"], lambda x, i: F.struct(haversine_km(state["lat"], state["lon"], x["lat"], x["lon"]).alias("km"), i.alias("i"), x.alias("stop"))))
        return F.struct(near["stop"]["lon"].alias("lon"), near["stop"]["lat"].alias("lat"), F.filter(state["left"], lambda x, i: i != near["i"]).alias("left"), F.array_append(state["path"], near["stop"]).alias("path"), (state["km"] + near["km"]).alias("km")).cast(STATE)

    folded = F.aggregate(left, begin, step, lambda s: F.struct(s["path"].alias("path"), s["km"].alias("km")))
    last, route = F.get(left, F.lit(0)), lambda path, km: F.struct(path.cast(f"array<{STOP}>").alias("path"), km.alias("km"))
    leg = haversine_km(first["lat"], first["lon"], last["lat"], last["lon"])
    return F.when(F.size(left) == 0, route(F.array(first), F.lit(0.0))).when(F.size(left) == 1, route(F.array(first, last), leg)).otherwise(folded)


def best_start(points):
    """The shortest greedy path over all starts, the first of equals; up to two stops stay as they are."""

    def rooted(i):
        others = F.filter(points, lambda x, j: j != i)
        return nearest_neighbour(F.concat(F.slice(points, i + 1, F.lit(1)), others))

    tried = F.transform(F.sequence(F.lit(0), F.greatest(F.size(points) - 1, F.lit(0))), lambda i: F.struct(F.round(rooted(i)["km"], 9).alias("km"), i.alias("start")))
    return F.when(F.size(points) <= 2, F.struct(path_km(points).alias("km"), F.lit(0).alias("start"))).otherwise(F.array_min(tried))


def path_km(points):
    """Length of a path in the given order."""
    legs = F.transform(points, lambda x, i: F.when(i == 0, 0.0).otherwise(haversine_km(F.get(points, i - 1)["lat"], F.get(points, i - 1)["lon"], x["lat"], x["lon"])))
    return F.aggregate(legs, F.lit(0.0), lambda a, x: a + x)


def insertion_delta(points, stop):
    """Least extra km of putting a stop into a path, never below 0; after the last stop there is no next leg."""

    def extra(x, i):
        to = haversine_km(x["lat"], x["lon"], stop["lat"], stop["lon"])
        after = F.get(points, i + 1)
        between = haversine_km(stop["lat"], stop["lon"], after["lat"], after["lon"]) - haversine_km(x["lat"], x["lon"], after["lat"], after["lon"])
        return to + F.when(after.isNull(), 0.0).otherwise(between)

    return F.greatest(F.array_min(F.transform(points, extra)), F.lit(0.0))


TIMELINE = "struct<clock:double,ate:boolean,rows:array<struct<start:double,end:double,lunch:boolean>>>"


def timeline(jobs):
    """Start and end minute of each job (struct of km from the one before and minutes of work): one lunch, when an arrival or the end of a job falls in its window."""
    begin = F.struct(F.lit(float(DAY_START)).alias("clock"), F.lit(False).alias("ate"), F.array().cast("array<struct<start:double,end:double,lunch:boolean>>").alias("rows")).cast(TIMELINE)

    def done(clock, ate, job):
        """Clock, whether lunch is over, and the row of a job begun at this clock."""
        arrival = clock + travel_minutes(job["km"])
        lunch = ~ate & (arrival >= LUNCH_FROM) & (arrival <= LUNCH_TO)
        start = arrival + F.when(lunch, float(LUNCH)).otherwise(0.0)
        end = start + job["minutes"]
        after = ~ate & ~lunch & (end >= LUNCH_FROM) & (end <= LUNCH_TO)
        return end + F.when(after, float(LUNCH)).otherwise(0.0), ate | lunch | after, F.struct(start.alias("start"), end.alias("end"), (lunch | after).alias("lunch"))

    def step(state, job):
        clock, ate, row = done(state["clock"], state["ate"], job)
        return F.struct(clock.alias("clock"), ate.alias("ate"), F.array_append(state["rows"], row).alias("rows")).cast(TIMELINE)

    # A day of one job needs no fold.
    alone = F.array(done(F.lit(float(DAY_START)), F.lit(False), F.get(jobs, F.lit(0)))[2]).cast("array<struct<start:double,end:double,lunch:boolean>>")
    return F.when(F.size(jobs) == 1, alone).otherwise(F.aggregate(jobs, begin, step, lambda s: s["rows"]))


def weighted_chunks(weights, k):
    """Chunk number of each weight: a run closes at total/k, and later chunks keep a row each while there are rows."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    kind = "struct<sum:double,chunk:int,at:int,out:array<int>>"
    begin = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("chunk"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")).cast(kind)

    def step(s, w):
        reached, rows_left, chunks_left = s["sum"] + w, F.size(weights) - s["at"] - 1, k - s["chunk"] - 1
        close = (chunks_left > 0) & ((reached >= total / k) | (rows_left <= chunks_left))
        return F.struct(F.when(close, 0.0).otherwise(reached).alias("sum"), F.when(close, s["chunk"] + 1).otherwise(s["chunk"]).alias("chunk"), (s["at"] + 1).alias("at"), F.array_append(s["out"], s["chunk"]).alias("out")).cast(kind)

    return F.aggregate(weights, begin, step, lambda s: s["out"])


def coordinate_key(points):
    """SHA-1 of the sorted coordinates at six decimals: equal stop sets share a key."""
    return F.sha1(F.array_join(F.array_sort(F.transform(points, lambda p: F.format_string("%.6f,%.6f", p["lon"], p["lat"]))), "|"))
