"""Packing of documents into windows by non-negative least squares.

Full windows of a long document stand alone; what is left of each document has
a length below the window. Combinations of two or three such lengths that fill a
window exactly are the columns of a 0/1/2/3 matrix A; repeat counts x >= 0
minimise |Ax - h|^2 against the histogram h, are rounded and clipped to what there
is. What no combination takes is packed greedily end to end, cut where a
window ends. The histogram has as many rows as the window has tokens, so the
driver's share does not grow with the data.

A document's place follows from its rank among those of its length: ranks come from a
count per input split and length plus a row number within, so no length is
one group.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldroute.llm.tokens import id_type, tokenise, vocabulary_size
from fieldroute.session import cut

WINDOW = 2048
STEPS = 150
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def combinations(present: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c, of present lengths that sum to the window; c is 0 for two lengths."""
    have = np.zeros(window + 1, bool)
    have[present] = True
    have[0] = True
    found = []
    for a in np.flatnonzero(have[1:window]) + 1:
        b = np.arange(max(1, (window - a + 1) // 2), min(a, window - a) + 1)
        c = window - a - b
        ok = have[b] & have[c] & (c <= b)
        if ok.any():
            found.append(np.stack([np.full(int(ok.sum()), a), b[ok], c[ok]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def solve(histogram: np.ndarray, combos: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts by multiplicative updates, which keep x >= 0 and lower |Ax - h|^2 at every step."""
    if not len(combos):
        return np.zeros(0, np.int64)
    h = histogram.astype(np.float64).copy()
    h[0] = 0
    weight = (combos > 0).astype(np.float64)

    def up(y):  # A'y
        return (y[combos] * weight).sum(1)

    def down(x):  # Ax
        return sum(np.bincount(combos[:, j], x * weight[:, j], minlength=len(h)) for j in range(3))

    target = up(h)
    x = target / np.maximum(up(down(np.ones(len(combos)))), 1)
    for _ in range(steps):
        x *= target / np.maximum(up(down(x)), 1e-12)
    left, repeats = h.astype(np.int64), np.zeros(len(combos), np.int64)
    for k in np.argsort(-x, kind="stable"):
        want = int(x[k] + 0.5)
        if not want:
            break
        lengths = [int(v) for v in combos[k] if v]
        room = min(left[v] // lengths.count(v) for v in lengths)
        repeats[k] = n = min(want, int(room))
        for v in lengths:
            left[v] -= n
    return repeats


class Layout:
    """Where the rank-th document of each length goes, given the histogram of lengths below the window."""

    def __init__(self, histogram: np.ndarray, full_windows: int, window: int = WINDOW):
        self.window = window
        combos = combinations(np.flatnonzero(histogram), window)
        repeats = solve(histogram, combos)
        slots: dict[int, list[tuple[int, int, int]]] = {}
        used = np.zeros(window + 1, np.int64)
        sequence = full_windows
        for k in np.flatnonzero(repeats):
            n, offset = int(repeats[k]), 0
            for v in (int(v) for v in combos[k] if v):
                slots.setdefault(v, []).append((int(used[v]), sequence, offset))
                used[v] += n
                offset += v
            sequence += n
        self.slots = {v: tuple(map(list, zip(*rows, strict=True))) for v, rows in slots.items()}
        self.used = used
        rest = (histogram - used[: len(histogram)]) * np.arange(len(histogram))
        self.base = np.cumsum(rest) - rest  # of each length, in the end-to-end stream
        self.stream = int(rest.sum())
        self.first_stream_sequence = sequence

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, length) of its pieces, in order."""
        if rank < self.used[length]:
            first, sequence, offset = self.slots[length]
            k = bisect_right(first, rank) - 1
            return [(sequence[k] + rank - first[k], offset[k], length)]
        at = int(self.base[length]) + (rank - int(self.used[length])) * length
        out = []
        while length:
            begin, end = self.sequence_around(at)
            n = min(length, end - at)
            out.append((self.first_stream_sequence + begin[0], at - begin[1], n))
            at, length = at + n, length - n
        return out

    def sequence_around(self, at: int) -> tuple[tuple[int, int], int]:
        """((number, first token), end) of the stream's sequence at a token; the last, short window is split into powers of two, which need no padding."""
        number, tail = at // self.window, self.stream % self.window
        begin = number * self.window
        if begin + self.window <= self.stream:
            return (number, begin), begin + self.window
        bit = 1 << (tail.bit_length() - 1)
        while True:
            if tail & bit:
                if at < begin + bit:
                    return (number, begin), begin + bit
                number, begin = number + 1, begin + bit
            bit >>= 1


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and its ids (little-endian unsigned 32-bit).

    A null or empty text is the end id alone. Repeated rows and null ids are packed
    as rows of their own; an empty table gives no piece. Other columns are ignored.
    """
    spark = docs.sparkSession
    dtype = id_type(vocabulary_size(tokenizer_path))
    tokens = tokenise(docs, tokenizer_path, end_id).withColumn("tail", (F.col("n_tokens") % window).cast("int")).withColumn("full", F.floor(F.col("n_tokens") / window))
    tokens = cut(tokens, "ids")
    counts = cut(tokens.groupBy("tail", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")), "lengths")

    totals = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).orderBy("tail").toPandas()  # a row per length below the window
    histogram = np.zeros(window, np.int64)
    histogram[totals["tail"]] = totals["n"]
    histogram[0] = 0
    fulls = np.zeros(window, np.int64)
    fulls[totals["tail"]] = totals["full"]
    layout = Layout(histogram, int(fulls.sum()), window)
    shared = spark.sparkContext.broadcast((layout, np.cumsum(fulls) - fulls))

    earlier = Window.partitionBy("tail").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("tail", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank_base"), F.coalesce(F.sum("full").over(earlier), F.lit(0)).alias("full_base"))
    group = Window.partitionBy("chunk", "tail").orderBy("doc_id", "n_tokens")
    ranked = tokens.withColumn("rank", F.row_number().over(group) - 1).withColumn("before", F.sum("full").over(group.rowsBetween(Window.unboundedPreceding, 0)) - F.col("full"))
    ranked = ranked.join(bases, ["chunk", "tail"]).select("doc_id", "n_tokens", "ids", "tail", "full", (F.col("rank") + F.col("rank_base")).alias("rank"), (F.col("before") + F.col("full_base")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, full_base = shared.value
        for batch in batches:
            out: list[tuple] = []
            for i in range(0, batch.num_rows, 256):
                for r in batch.slice(i, 256).to_pylist():
                    first, n, tail = int(full_base[r["tail"]]) + r["before"], r["n_tokens"], r["tail"]
                    places = [(first + k, 0, window) for k in range(r["full"])] + (layout.place(tail, r["rank"]) if tail else [])
                    ids, at = np.frombuffer(r["ids"], dtype).astype("<u4"), 0
                    for sequence, offset, length in places:
                        out.append((r["doc_id"], at, length, n, sequence, offset, ids[at : at + length].tobytes()))
                        at += length
                if len(out) >= 2000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    return ranked.mapInArrow(run, PIECES)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True))
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
