"""Unions of polygons that share borders, as joins and folds over their edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldroute.session import cut

POINT = "struct<x:double,y:double>"


def shoelace(ring):
    """Twice the signed area of a ring of points; positive where it runs against the clock."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.aggregate(F.arrays_zip(ring.alias("a"), after.alias("b")), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])


def boundary(polygons: DataFrame, keys: list[str], ring: str = "ring") -> DataFrame:
    """Edges (keys, a, b) of the union of the polygons of each key: an edge and its reverse cancel.

    Rings are arrays of points x and y, closed or not, in either direction; polygons of a key may touch but not overlap, with
    common corners in common coordinates. Edges are counted by their two ends with a sign for the direction, so the
    cancelling is one sum that combines before the shuffle.
    """
    points = F.col(ring).cast(f"array<{POINT}>")
    opened = F.when(F.get(points, F.lit(0)) == F.get(points, F.size(points) - 1), F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0)))).otherwise(points)
    rows = polygons.select(*keys, opened.alias("r")).where(F.size("r") >= 3)
    rows = rows.select(*keys, F.when(shoelace(F.col("r")) < 0, F.reverse("r")).otherwise(F.col("r")).alias("r"))
    edges = rows.select(*keys, F.explode(F.transform("r", lambda p, i: F.struct(p.alias("a"), F.get("r", (i + 1) % F.size("r")).alias("b")))).alias("e"))
    low, high = F.least("e.a", "e.b"), F.greatest("e.a", "e.b")
    net = edges.where("e.a != e.b").groupBy(*keys, low.alias("low"), high.alias("high")).agg(F.sum(F.when(F.col("e.a") == low, 1).otherwise(-1)).alias("net")).where("net <> 0")
    ahead = F.col("net") > 0
    return net.select(*keys, F.when(ahead, F.col("low")).otherwise(F.col("high")).alias("a"), F.when(ahead, F.col("high")).otherwise(F.col("low")).alias("b"))


def area(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, edges and the enclosed area, holes left out."""
    cross = F.col("a.x") * F.col("b.y") - F.col("b.x") * F.col("a.y")
    return edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("edges"), (F.sum(cross) / 2).alias("area"))


def rings(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ring, place, point): the closed rings of a boundary, each from its least edge on.

    At a corner that several rings pass, a ring goes on by the edge that turns most to the left, so that areas which
    only touch there stay apart. An edge points to the next; pointers are doubled until every edge knows the
    least edge of its ring and how far on that is: as many joins as a ring's length has bits.
    """
    on = edges.select(*keys, F.col("a").alias("b"), F.col("b").alias("c"))
    both = edges.join(on, [*keys, "b"])
    turn = F.atan2((F.col("b.x") - F.col("a.x")) * (F.col("c.y") - F.col("b.y")) - (F.col("b.y") - F.col("a.y")) * (F.col("c.x") - F.col("b.x")), (F.col("b.x") - F.col("a.x")) * (F.col("c.x") - F.col("b.x")) + (F.col("b.y") - F.col("a.y")) * (F.col("c.y") - F.col("b.y")))
    first = Window.partitionBy(*keys, "a", "b").orderBy(F.round(turn, 9).desc(), "c")
    # An edge is known by its ends; state: the edge, where its pointer is, the least edge on the way and the steps to it.
    chain = both.withColumn("_k", F.row_number().over(first)).where("_k = 1").select(*keys, F.struct("a", "b").alias("id"), F.struct(F.col("b").alias("a"), F.col("c").alias("b")).alias("at"), F.lit(1).cast("long").alias("hops"))
    state = cut(chain.select("*", F.col("id").alias("least"), F.lit(0).cast("long").alias("away")), "rings")
    while True:
        ahead = state.select(*keys, F.col("id").alias("at"), F.col("at").alias("next"), F.col("hops").alias("more"), F.col("least").alias("other"), F.col("away").alias("far"))
        better = F.col("other") < F.col("least")
        joined = state.join(ahead, [*keys, "at"]).select(*keys, "id", F.col("next").alias("at"), (F.col("hops") + F.col("more")).alias("hops"), F.when(better, F.col("other")).otherwise(F.col("least")).alias("least"), F.when(better, F.col("hops") + F.col("far")).otherwise(F.col("away")).alias("away"), better.alias("_moved"))
        joined = cut(joined, "rings")
        state = joined.drop("_moved")
        if joined.where("_moved").isEmpty():
            break
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "least"))
    return state.withColumn("n", size).select(*keys, F.col("least").alias("ring"), ((F.col("n") - F.col("away")) % F.col("n")).cast("int").alias("place"), F.col("id.a").alias("point"))
