"""Toxicity by multiple-instance learning.

Only documents have labels; sentences are the instances. A sentence's score is a
logistic function of hashed word and word-head features, a document's is the
noisy-or of its sentences, and the document labels train both. The sentence
scores then tell where a document offends.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldroute.llm.labelled import held_out, training_rows
from fieldroute.llm.recent import Recent
from fieldroute.session import ship

DIMENSIONS = 1 << 18
HEADS = (5, 7)
#: Bounds of the labelled sample the model is fitted on: documents, and bytes of their texts.
TRAIN_ROWS, TRAIN_BYTES = 8_000, 48 << 20
STEPS, RATE, SHRINK = 120, 0.5, 2e-5
BIAS = -5.0
OFFENDS = 0.5
WORDS_BYTES = 48 << 20
_EDGES = b".,;:!?\"'()|*#$%&<>"


def features(word: bytes) -> tuple[int, ...]:
    """Buckets of a lower-cased word: itself and its heads."""
    bare = word.lower().strip(_EDGES)
    if not bare:
        return ()
    return (zlib.crc32(bare) % DIMENSIONS, *(zlib.crc32(b"%d:" % n + bare[:n]) % DIMENSIONS for n in HEADS if len(bare) >= n))


def split_words(text: bytes) -> list[bytes]:
    """Words; a line break becomes a full stop of its own."""
    return text.replace(b"\n", b" . ").split()


def noisy_or(log_none: np.ndarray) -> np.ndarray:
    return -np.expm1(log_none)


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def word(self, word: bytes) -> tuple[float, bool]:
        return sum(float(self.weights[i]) for i in features(word)), word[-1:] in (b".", b"!", b"?")


def sentence_scores(scored: list[tuple[float, bool]], bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the sentences of one document and the place of each one's first word."""
    if not scored:
        return np.zeros(0), np.zeros(0, np.int64)
    weight = np.array([s[0] for s in scored])
    ends = np.array([s[1] for s in scored], bool)
    first = np.flatnonzero(np.r_[True, ends[:-1]])
    total = np.add.reduceat(weight, first) + bias
    return 1 / (1 + np.exp(-np.clip(total, -30, 30))), first


def slopes(at: np.ndarray, feature: np.ndarray, doc_of: np.ndarray, positive: np.ndarray, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Gradient of the mean negative log-likelihood by weights and bias, from (sentence, feature) pairs."""
    n = len(doc_of)
    s = np.clip(np.bincount(at, w[feature], minlength=n) + bias, -30, 30)
    p = 1 / (1 + np.exp(-s))
    none = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(positive))
    some = np.maximum(noisy_or(none), 1e-9)
    g = p * np.where(positive, -(1 - some) / some, 1.0)[doc_of] / len(positive)
    return np.bincount(feature, g[at], minlength=len(w)), g.sum()


def fit(texts: list[bytes], y: np.ndarray) -> Model:
    """Adagrad on the noisy-or likelihood, in plain arrays of (sentence, feature) pairs."""
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(DIMENSIONS, np.float32), BIAS)
    known = Recent(WORDS_BYTES, lambda _: 160)
    told = lambda words: [(features(w), w[-1:] in (b".", b"!", b"?")) for w in words]
    at, feature, doc_of = [], [], []
    n = 0
    for d, text in enumerate(texts):
        fresh = True
        for found, ends in known.look_up(split_words(text), told):
            if fresh:
                doc_of.append(d)
                n += 1
                fresh = False
            feature.extend(found)
            at.extend([n - 1] * len(found))
            fresh = ends
    at, feature, doc_of = np.array(at, np.int32), np.array(feature, np.int32), np.array(doc_of, np.int32)
    used, feature = np.unique(feature, return_inverse=True)
    w, bias = np.zeros(len(used)), BIAS
    seen, seen_bias = np.full(len(used), 1e-3), 1e-3
    positive = y > 0
    for _ in range(STEPS):
        grad, total = slopes(at, feature, doc_of, positive, w, bias)
        seen += grad**2 * 1e4
        w -= RATE * grad * 100 / np.sqrt(seen)
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * SHRINK * 100 / np.sqrt(seen), 0)
        seen_bias += total**2 * 1e4
        bias -= 0.3 * total * 100 / np.sqrt(seen_bias)
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[used] = w
    return Model(weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """The model of a bounded sample of labelled documents; without labels of both kinds all weights are 0 and a sentence scores by the bias alone."""
    found = training_rows(docs, labels, "toxic", rows, most_bytes).select(F.col("text").cast("binary").alias("text"), "y").toArrow()
    return fit([t or b"" for t in found.column("text").to_pylist()], found.column("y").to_numpy())


SENTENCES = "array<struct<words:int,first_word:int,score:double>>"


def score(docs: DataFrame, model: Model, with_sentences: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; and the offending sentences where asked for.

    Null and empty texts have no sentence and score 0. Rows are scored one by one:
    repeated rows and null ids each get a row; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.bias))  # DIMENSIONS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        known, model = Recent(WORDS_BYTES, lambda _: 96), Model(weights, bias)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                scores, found = [], []
                for text in part.column(2).to_pylist():
                    words = split_words(text or b"")
                    p, first = sentence_scores(known.look_up(words, lambda new: list(map(model.word, new))), bias)
                    scores.append(float(noisy_or(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0)
                    if with_sentences:
                        size = np.diff(np.r_[first, len(words)])
                        found.append([{"words": int(size[k]), "first_word": int(first[k]), "score": float(p[k])} for k in np.flatnonzero(p >= OFFENDS)])
                columns = [part.column(0), part.column(1), pa.array(scores, pa.float64())]
                names = ["doc_id", "held_out", "score"]
                if with_sentences:
                    columns.append(pa.array(found, pa.list_(pa.struct([("words", pa.int32()), ("first_word", pa.int32()), ("score", pa.float64())]))))
                    names.append("sentences")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double" + f", sentences {SENTENCES}" * with_sentences)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
