"""Centroid clustering (exact integer k-means) by ball-tree filtering.

Vectors become integers once and are packed into metric trees, each over some thousand vectors
of one partition: a node is a ball with a centre, a radius, a count and the integer sum of
its vectors. A round sends the centroids, k short vectors, to the trees. By the triangle
inequality a centroid that is farther from a ball's centre than the nearest one by more than
two radii is nearest to none of its vectors; a ball with one candidate left is assigned
as a whole, by its count and sum, others are opened, down to leaves whose vectors are
compared exactly. Per centroid, partitions send one count and sum, which Spark adds up.

All that decides is integer arithmetic: balls are only dropped with a margin beyond
rounding, so the result is that of plain k-means, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldroute.session import cut, ship

SCALE = 64
TREE_ROWS, LEAF_ROWS = 2_048, 24
#: Components beyond this are refused: squared distances would not fit a long.
MOST = 1 << 27
#: Up to this, sums of products are whole numbers that doubles hold exactly.
EXACT = 1 << 19
TREES = "ids array<long>, vectors binary, first binary, last binary, child binary, radius binary, sums binary"
_TREES = pa.schema([("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("first", pa.binary()), ("last", pa.binary()), ("child", pa.binary()), ("radius", pa.binary()), ("sums", pa.binary())])


def whole_vectors(rows: DataFrame, dims: int, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): integer vectors of the rows with exactly ``dims`` components, none null or non-finite; other rows have no vector and are left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    sound = (F.size(vector_col) == dims) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    kept = rows.where(F.col(vector_col).isNotNull()).where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))
    fits = F.forall("v", lambda c: F.abs(c) <= MOST)
    return kept.select("vec_id", F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {MOST}"))).cast("array<int>").alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the k smallest SHA-256 of ``seed:id``; equal ids go by vector, rows without an id come last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select("v").orderBy(key.asc_nulls_last(), "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64)


class Tree:
    """A metric tree over some vectors: nodes in breadth-first order, the root first; children are neighbours."""

    @classmethod
    def build(cls, vectors: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree and the order its vectors are kept in."""
        order = np.arange(len(vectors))
        first, last, child, radius, sums = [0], [len(vectors)], [0], [], []
        node = 0
        while node < len(first):
            a, b = first[node], last[node]
            own = vectors[order[a:b]].astype(np.float64)
            total = vectors[order[a:b]].sum(0, dtype=np.int64)
            away = ((own - total / (b - a)) ** 2).sum(1)
            radius.append(float(np.sqrt(away.max())))
            sums.append(total)
            if b - a > LEAF_ROWS and away.max() > 0:
                # Halves along the line from the vector farthest from the centre to the one farthest from that.
                one = own[away.argmax()]
                two = own[((own - one) ** 2).sum(1).argmax()]
                along = own @ (two - one)
                order[a:b] = order[a:b][np.argsort(along, kind="stable")]
                child[node] = len(first)
                middle = (a + b) // 2
                first += [a, middle]
                last += [middle, b]
                child += [0, 0]
            node += 1
        tree = cls(vectors[order].astype(np.int32), *(np.array(x, np.int32) for x in (first, last, child)), np.array(radius), np.array(sums, np.int64).reshape(len(sums), -1))
        return tree, order

    def __init__(self, vectors, first, last, child, radius, sums):
        self.vectors, self.first, self.last, self.child, self.radius, self.sums = vectors, first, last, child, radius, sums

    @classmethod
    def unpack(cls, row: dict, dims: int) -> Tree:
        shaped = lambda name, kind: np.frombuffer(row[name], kind)
        return cls(shaped("vectors", np.int32).reshape(-1, dims), shaped("first", np.int32), shaped("last", np.int32), shaped("child", np.int32), shaped("radius", np.float64), shaped("sums", np.int64).reshape(-1, dims))

    def pack(self, ids: list) -> dict:
        parts = {name: np.ascontiguousarray(getattr(self, name)).tobytes() for name in ("vectors", "first", "last", "child", "radius", "sums")}
        return {"ids": ids, **parts}

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, their centroid): balls assigned as a whole; (rows, their centroid): vectors compared one by one."""
        centres = self.sums / (self.last - self.first)[:, None]
        c = centroids.astype(np.float64)
        away = np.sqrt(np.maximum((centres**2).sum(1)[:, None] - 2 * centres @ c.T + (c**2).sum(1), 0))
        # Rounding of the distances, generously: relative to the numbers that were subtracted.
        slack = 1e-6 * (1 + np.abs(centres).max() + np.abs(c).max()) * np.sqrt(centres.shape[1])
        nodes, live = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
        balls, ball_of, rows, leaf_live = [], [], [], []
        while len(nodes):
            d = np.where(live, away[nodes], np.inf)
            live = live & (d <= d.min(1)[:, None] + 2 * self.radius[nodes][:, None] + slack)
            whole = live.sum(1) == 1
            balls.append(nodes[whole])
            ball_of.append(live[whole].argmax(1))
            leaf = ~whole & (self.child[nodes] == 0)
            sizes = (self.last - self.first)[nodes[leaf]]
            rows.append(np.repeat(self.first[nodes[leaf]] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum())))
            leaf_live.append(np.repeat(live[leaf], sizes, axis=0))
            opened = ~whole & ~leaf
            nodes = (self.child[nodes[opened]][:, None] + np.arange(2)).reshape(-1).astype(np.int64)
            live = np.repeat(live[opened], 2, axis=0)
        rows = np.concatenate(rows).astype(np.int64)
        d = distances(self.vectors[rows], centroids)
        d[~np.concatenate(leaf_live)] = np.iinfo(np.int64).max
        return np.concatenate(balls), np.concatenate(ball_of), rows, d.argmin(1) if len(rows) else rows

    def labels(self, centroids: np.ndarray) -> np.ndarray:
        """The centroid of every vector."""
        balls, ball_of, rows, row_of = self.assign(centroids)
        out = np.zeros(len(self.vectors), np.int64)
        for node, j in zip(balls.tolist(), ball_of.tolist(), strict=True):
            out[self.first[node] : self.last[node]] = j
        out[rows] = row_of
        return out

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and integer sum of the vectors of every centroid."""
        balls, ball_of, rows, row_of = self.assign(centroids)
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        np.add.at(count, ball_of, (self.last - self.first)[balls])
        np.add.at(total, ball_of, self.sums[balls])
        np.add.at(count, row_of, 1)
        for j in np.unique(row_of):
            total[j] += self.vectors[rows[row_of == j]].sum(0, dtype=np.int64)
        return count, total


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v**2).sum(1)[:, None] - 2 * (v @ c.T) + (c**2).sum(1)).astype(np.int64)
    v = vectors.astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)


def plant(vectors: DataFrame, dims: int) -> DataFrame:
    """The vectors as a written table of trees."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, TREE_ROWS):
                part = b.slice(i, TREE_ROWS)
                own = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                tree, order = Tree.build(own)
                ids = part.column(0).to_pylist()
                yield pa.RecordBatch.from_pylist([tree.pack([ids[j] for j in order.tolist()])], schema=_TREES)

    ship(vectors.sparkSession)
    return cut(vectors.mapInArrow(build, TREES), "trees")


def refine(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every vector to its nearest centroid, then each non-empty centroid to the floor of its vectors' mean."""
    k, dims = centroids.shape

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            for row in b.to_pylist():
                own = Tree.unpack(row, dims).totals(centroids)
                count, total = count + own[0], total + own[1]
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(used, pa.int32()), "n": pa.array(count[used]), "total": pa.array(total[used].tolist(), pa.list_(pa.int64()))})

    sums = trees.drop("ids").mapInArrow(totals, "cluster int, n long, total array<long>").select("cluster", "n", F.posexplode("total").alias("at", "x"))
    # k times dims rows, whatever the number of vectors.
    added = sums.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out = centroids.copy()
    for r in added:
        out[r["cluster"], r["at"]] = int(r["x"]) // r["n"]
    return out


def clusters(rows: DataFrame, k: int, rounds: int, dims: int, seed: int = 1, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per sound vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors are floor(scale * x) of each component. Nearest centroids go by squared distance, ties
    to the smaller number. With fewer than ``k`` vectors each is a centroid; without any the
    result is empty. Rows whose vector is null, of another length, or has null or non-finite
    components are no vectors. Repeated rows and ids are vectors each; a null id stays null
    and is a first centroid only where ids are too few. A component beyond 2^27 after scaling
    fails the job. Columns other than the two named are ignored, whatever their names.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, dims, scale, id_col, vector_col)
    trees = plant(vectors, dims)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = refine(trees, centroids)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                tree = Tree.unpack(row, dims)
                of = tree.labels(centroids)
                away = ((tree.vectors.astype(np.int64) - centroids[of]) ** 2).sum(1)
                yield pa.RecordBatch.from_pydict({"vec_id": pa.array(row["ids"], pa.int64()), "cluster": pa.array(of, pa.int32()), "distance": pa.array(away)})

    found = cut(trees.mapInArrow(last, "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    total, spelt = sum(inertia.values()), [",".join(map(str, c)) for c in centroids.tolist()]
    about = [(j, d, total, hashlib.sha256(spelt[j].encode()).hexdigest()) for j, d in inertia.items()]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
