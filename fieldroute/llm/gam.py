"""Quality classifier: an additive model with pairwise interactions.

Each feature has a lookup table over its quantile bins, each chosen pair a table
over coarser bins. Rounds of cyclic boosting visit the features in turn and
add a shallow tree, written straight into the table; then the pairs
that explain most of what is left are boosted alike. A score is a sum of looked-up bins.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldroute.llm.labelled import held_out, training_rows
from fieldroute.session import ship

#: Bounds of the labelled sample the model is fitted on: documents, and bytes of the texts that tasks measure for it.
TRAIN_ROWS, TRAIN_BYTES = 20_000, 1 << 30
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE, LEAST_ROWS = 120, 40, 0.15, 1.0, 5
CUT = 0.3
NAMES = ("log_bytes", "upper", "symbols", "marks", "digits", "punctuation", "stops", "wide_bytes", "word_length", "distinct_words", "doubled_words", "copied_lines", "line_words", "breaks", "repeated_marks", "entropy", "compressed")
SYMBOLS, PUNCTUATION = list(b"#*$%&<>@^_~|\\/+="), list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
#: A punctuation mark that follows itself.
REPEATED = re.compile(rb"([!-/:-@\[-`{-~])\1")


def measure(text: bytes | None) -> list[float]:
    """The features of one whole text, from counts of its bytes, words and lines; all zero for one without words."""
    if not text or not (words := text.split()):
        return [0.0] * len(NAMES)
    n, w = len(text), len(words)
    at = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, wide = int(at[65:91].sum()), int(at[97:123].sum()), int(at[128:].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    doubled = sum(map(eq, words, words[1:]))
    share = at[at > 0] / n
    return [
        np.log(n), upper / (upper + lower + 1), int(at[SYMBOLS].sum()) / n, int(at[33] + at[63]) / w, int(at[48:58].sum()) / n, int(at[PUNCTUATION].sum()) / n, int(at[46]) / w, wide / n,
        (n - int(at[[9, 10, 11, 12, 13, 32]].sum())) / w, len(set(words)) / w, doubled / w, 1 - len(set(lines)) / len(lines), np.log(w / len(lines)), len(lines) / w,
        len(REPEATED.findall(text)) / w, float(-(share * np.log2(share)).sum()), len(zlib.compress(text, 1)) / n,
    ]


class Gam:
    def __init__(self, edges: list[np.ndarray], bias: float):
        self.edges, self.bias = edges, bias
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.coarse = [e[np.linspace(0, len(e) - 1, min(PAIR_BINS - 1, len(e))).astype(int)] if len(e) else e for e in edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def coarse_bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.coarse)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for table, b in zip(self.tables, self.bins(x), strict=True):
            total += table[b]
        if self.pairs:
            b = self.coarse_bins(x)
            for i, j, table in self.pairs:
                total += table[b[i], b[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(g, h):
    return -g / (h + RIDGE)


def _gain(g, h):
    return g * g / (h + RIDGE)


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray, a: int, b: int) -> int | None:
    """The best cut of bins a..b, or none."""
    gl, hl, nl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1], np.cumsum(n[a:b])[:-1]
    if not len(gl):
        return None
    gain = _gain(gl, hl) + _gain(g[a:b].sum() - gl, h[a:b].sum() - hl) - _gain(g[a:b].sum(), h[a:b].sum())
    gain[(nl < LEAST_ROWS) | (n[a:b].sum() - nl < LEAST_ROWS)] = -1
    k = int(gain.argmax())
    return a + k + 1 if gain[k] > 1e-6 else None


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A tree of depth two over ordered bins, as the value of each bin."""
    out, parts = np.zeros(len(g)), [(0, len(g))]
    for _ in range(2):
        cuts = [(a, _split(g, h, n, a, b), b) for a, b in parts]
        parts = [x for a, c, b in cuts for x in ([(a, c), (c, b)] if c else [(a, b)])]
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of one cut along each axis: its gain and the value of each cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, at = 0.0, None
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            parts = [(cg[i, j], ch[i, j]), (cg[i, -1] - cg[i, j], ch[i, -1] - ch[i, j]), (cg[-1, j] - cg[i, j], ch[-1, j] - ch[i, j]), (cg[-1, -1] - cg[i, -1] - cg[-1, j] + cg[i, j], ch[-1, -1] - ch[i, -1] - ch[-1, j] + ch[i, j])]
            gain = sum(_gain(*p) for p in parts) - _gain(cg[-1, -1], ch[-1, -1])
            if gain > best:
                best, at = gain, (i, j, [_leaf(*p) for p in parts])
    out = np.zeros(g.shape)
    if at:
        i, j, (a, b, c, d) = at
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = a, b, c, d
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of the features, then of the strongest pairs."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Gam(edges, float(np.log(rate / (1 - rate))))
    if len(set(y.tolist())) < 2:
        return model
    bins, total = model.bins(x), np.full(len(x), model.bias)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slopes()
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(b, g, minlength=size), np.bincount(b, h, minlength=size), np.bincount(b, minlength=size))
            model.tables[j] += step
            total = total + step[b]

    coarse = model.coarse_bins(x)
    shape = [len(e) + 1 for e in model.coarse]

    def cells(i, j):
        g, h = slopes()
        at = coarse[i] * shape[j] + coarse[j]
        return [np.bincount(at, v, minlength=shape[i] * shape[j]).reshape(shape[i], shape[j]) for v in (g, h)]

    ranked = sorted(((_quadrants(*cells(i, j))[0], i, j) for i in range(len(shape)) for j in range(i)), reverse=True)[:PAIRS]
    model.pairs = [(i, j, np.zeros((shape[i], shape[j]))) for gain, i, j in ranked if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            step = RATE * _quadrants(*cells(i, j))[1]
            table += step
            total = total + step[coarse[i], coarse[j]]
    return model


FEATURES = "doc_id long, held_out boolean, x array<double>"


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, x (the features) and the extra columns."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield part.set_column(2, "x", pa.array([measure(t) for t in part.column(2).to_pylist()], pa.list_(pa.float64())))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("x"), *extra)
    return rows.mapInArrow(run, ", ".join([FEATURES, *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in extra)]))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Gam:
    """The model of a bounded sample of labelled documents; without labels of both kinds every score is the smoothed share of good ones."""
    found = measured(training_rows(docs, labels, "quality", rows, most_bytes), extra=("y",)).select("x", "y").toArrow()
    x = np.array(found.column("x").to_pylist(), np.float64).reshape(-1, len(NAMES))
    return fit(x, found.column("y").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (score at least CUT).

    An empty or null text has all features zero and a score like any other.
    Rows are scored one by one; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # a few small tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                x = np.array([measure(t) for t in part.column(2).to_pylist()], np.float64).reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shared.value.score(x))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))
