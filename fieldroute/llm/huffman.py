"""Token ids in blocks of canonical, length-limited Huffman code.

Code lengths come from global counts (package-merge, at most ``LIMIT`` bits), so
the code book is a list of lengths. A file is a folder: ``book`` has the
lengths, ``blocks`` has one row for each block of whole documents in ascending
doc_id order with its payload, its documents' lengths and a bit offset for every
``STRIDE`` ids. Blocks decode alone; within a block all checkpoints are
decoded side by side, one table lookup a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldroute.llm.tokens import flat, id_type, tokenise, vocabulary_size
from fieldroute.session import cut, ship, shuffle_width

LIMIT = 18
STRIDE = 128
BLOCK_IDS = 1 << 19
BLOCKS = "part int, block int, local_start long, n_ids long, doc_ids array<long>, doc_lengths array<long>, checkpoints binary, payload binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most ``limit`` bits by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, items = [], leaves
    for level in range(limit):
        if level:
            packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
            both = np.concatenate([leaves, packages])
            rank = np.argsort(both, kind="stable")
            items, is_leaf = both[rank], rank < len(leaves)
        else:
            is_leaf = np.ones(len(leaves), bool)
        levels.append(is_leaf)
    take, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


class Book:
    """Canonical codes of the given lengths, and the decoding table."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        self.width = int(self.lengths.max()) if len(used) else 1
        # In canonical order each code starts where the one before ends, on a grid of 2**width.
        spans = 1 << (self.width - self.lengths[order])
        starts = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (starts >> (self.width - self.lengths[order])).astype(np.uint64)
        self.symbol = np.zeros(1 << self.width, np.uint32)
        self.symbol[: int(spans.sum())] = np.repeat(order, spans)

    def pack(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bit offset of every STRIDE-th id, and the bits in big-endian words of 32."""
        if not len(ids):
            return np.zeros(0, np.uint64), b""
        bits = self.lengths[ids]
        at = np.cumsum(bits) - bits
        word, shift = at >> 5, (at & 31).astype(np.uint64)
        wide = self.codes[ids] << (np.uint64(64) - shift - bits.astype(np.uint64))
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])  # every word has a start: no code is longer than 32
        packed = np.zeros(int(word[-1]) + 3, np.uint64)
        packed[word[first]] += np.add.reduceat(wide >> np.uint64(32), first)
        packed[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
        return at[::STRIDE].astype(np.uint64), packed.astype(">u4").tobytes()

    def unpack(self, n: int, checkpoints: np.ndarray, payload: bytes) -> np.ndarray:
        words = np.frombuffer(payload, ">u4").astype(np.uint64)
        lanes = len(checkpoints)
        out, at = np.zeros((STRIDE, lanes), np.uint32), checkpoints.astype(np.int64)
        for step in range(min(STRIDE, n)):
            live = lanes if step < n - (lanes - 1) * STRIDE else lanes - 1
            at = at[:live]
            word, shift = at >> 5, (at & 31).astype(np.uint64)
            pair = (words[word] << np.uint64(32)) | words[word + 1]
            code = (pair << shift) >> np.uint64(64 - self.width)
            out[step, :live] = ids = self.symbol[code]
            at = at + self.lengths[ids]
        return out.T.reshape(-1)[:n]


def global_counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs; one row per id and task is shuffled."""
    dtype = id_type(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                total += np.bincount(flat(batch.column(0).slice(i, 1024), dtype)[0], minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
    out = np.zeros(vocabulary, np.int64)
    out[rows["id"]] = rows["n"]
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Tokenise every document and write the folder ``path`` (book, blocks) in ascending doc_id order; null ids come first.

    A null or empty text is the end id alone. Rows are documents each, repeated ones too; rows of one id
    go by their ids. An empty table gives files without blocks. Other columns are not stored.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary_size(tokenizer_path)
    dtype = id_type(vocabulary)
    tokens = cut(tokenise(docs, tokenizer_path, end_id).drop("chunk"), "ids")
    lengths = code_lengths(global_counts(tokens, vocabulary))
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "id int, bits int").coalesce(1).write.parquet(f"{path}/book")
    shared = spark.sparkContext.broadcast(lengths)  # one byte an id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        book, part = Book(shared.value), TaskContext.get().partitionId()
        start = block = 0
        names: list = []
        texts: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            checkpoints, payload = book.pack(np.concatenate(texts))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start]), pa.array([held]), pa.array([names], pa.list_(pa.int64())), pa.array([[len(x) for x in texts]], pa.list_(pa.int64())), pa.array([checkpoints.tobytes()], pa.binary()), pa.array([payload], pa.binary())],
                names=["part", "block", "local_start", "n_ids", "doc_ids", "doc_lengths", "checkpoints", "payload"],
            )

        for batch in batches:
            data, ends = flat(batch.column(1), dtype)
            begins = [0, *ends[:-1].tolist()]
            for name, a, b in zip(batch.column(0).to_pylist(), begins, ends.tolist(), strict=True):
                names.append(name)
                texts.append(data[a:b])
                held += b - a
                if held >= BLOCK_IDS:
                    yield close()
                    start, block, names, texts, held = start + held, block + 1, [], [], 0
        if names:
            yield close()

    ordered = tokens.select("doc_id", "ids").repartitionByRange(shuffle_width(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary, little-endian unsigned 32-bit), a row for every one that was written."""
    ship(spark)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    book = spark.read.schema("id int, bits int").parquet(f"{path}/book").toPandas()  # the vocabulary
    lengths = np.zeros(len(book), np.uint8)
    lengths[book["id"]] = book["bits"]
    shared = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Book(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                ids = book.unpack(row["n_ids"], np.frombuffer(row["checkpoints"], np.uint64), row["payload"]).astype("<u4")
                n = np.array(row["doc_lengths"], np.int64)
                ends = np.cumsum(n)
                start = row["local_start"] + ends - n
                offsets = np.append(0, 4 * ends).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(n), pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])],
                    names=["part", "doc_id", "start", "n_tokens", "ids"],
                )

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row a part
    read = blocks.mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids binary").join(F.broadcast(bases), "part")
    return read.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids")
