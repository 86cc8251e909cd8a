"""Exact dedup by content sort.

Sampled splitters range-partition the normalised bytes, each partition is
sorted (externally, by Spark), equal texts end up adjacent and every row is
compared in full with its neighbour. The largest ``doc_id`` of a run stays.

The range key is (first 64 bytes, SHA-256, doc_id descending): the sampled
keys stay small however long the texts are, and doc_id lets one hot text spread
over several partitions. Runs that touch a partition's edge are joined
afterwards through the edge rows, of which each partition has two at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldroute.session import cut, ship, shuffle_width

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_BYTES = 64

RUNS = "doc_id long, text_sha256 string, head long, size long, part int, edge int, edge_text binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("head", pa.int64()), ("size", pa.int64()), ("part", pa.int32()), ("edge", pa.int32()), ("edge_text", pa.binary())])


def normalise(text):
    """Null counts as empty; only A-Z are lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition to rows with their run's head and size.

    ``edge`` is 1 for the partition's first run, 2 for its last, 3 when one run
    fills it, 0 otherwise; ``edge_text`` is set on one row of each edge run.
    A run's ids are held until it ends: at most the ids of one partition.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    ids: list = []
    text = sha = None
    first = True

    def done(last: bool) -> pa.RecordBatch:
        edge = (1 if first else 0) | (2 if last else 0)
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([sha] * n), pa.array([ids[0]] * n, pa.int64()), pa.array([n] * n), pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.int32()), pa.array([text if edge and i == 0 else None for i in range(n)], pa.binary())],
            schema=_ARROW,
        )

    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        doc, texts, shas = batch.column(0), batch.column(1), batch.column(2)
        for i in range(batch.num_rows):
            own = texts[i].as_py()
            if ids and own != text:  # the full comparison of neighbours
                waiting.append(done(False))
                held += len(ids)
                first = False
                ids = []
            if not ids:
                text, sha = own, shas[i].as_py()
            ids.append(doc[i].as_py())
            if held >= 10_000:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting, held = [], 0
    if ids:
        waiting.append(done(True))
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts equal empty ones. A null id never wins over a number; when a whole
    group has null ids, keep_id is null. Of repeated rows with the same id and
    text, every one is marked kept if that id is its group's largest. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    n = partitions or shuffle_width(spark)
    text = normalise(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("norm")).withColumn("sha", F.sha2("norm", 256))
    key = [F.substring("norm", 1, PREFIX_BYTES), F.col("sha"), F.col("doc_id").desc_nulls_last()]
    ordered = rows.repartitionByRange(n, *key).sortWithinPartitions(F.substring("norm", 1, PREFIX_BYTES), "sha", "norm", F.col("doc_id").desc_nulls_last())
    runs = cut(ordered.mapInArrow(_runs, RUNS), "exact-runs")

    # Edge runs: two rows a partition at most. A run goes on in the next partition that has rows when the texts are equal.
    edges = runs.where("edge_text is not null")
    parts = edges.groupBy("part").agg(F.max("edge").alias("any")).select("part").withColumn("next_part", F.lead("part").over(Window.orderBy("part")))
    tail = edges.where("edge >= 2").select("part", F.col("edge_text").alias("tail_text"), "edge").join(F.broadcast(parts), "part")
    head = edges.where("edge in (1, 3)").select(F.col("part").alias("next_part"), F.col("edge_text").alias("head_text"))
    joined = tail.join(head, "next_part").where("tail_text = head_text").select("next_part", F.lit(1).alias("joins"))
    pieces = edges.select("part", "edge", "head", "size").join(joined.withColumnRenamed("next_part", "part"), "part", "left")
    # A piece opens a chain unless it is its partition's first and the partition joins the one before.
    opens = F.when((F.col("edge").isin(1, 3)) & F.col("joins").isNotNull(), 0).otherwise(1)
    chain = F.sum(opens).over(Window.orderBy("part", "edge").rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy("chain")
    chains = pieces.withColumn("chain", chain).select("part", "edge", F.max("head").over(whole).alias("chain_head"), F.sum("size").over(whole).alias("chain_size"))
    out = runs.drop("edge_text").join(F.broadcast(chains), ["part", "edge"], "left")
    keep = F.coalesce("chain_head", "head")
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("chain_size", "size").alias("group_size"), F.coalesce(F.col("doc_id") == keep, keep.isNull()).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """Documents without their exact copies; of each group the row with the largest doc_id stays, with all its columns.

    What stays is chosen by id and text together, so an id that comes with several texts keeps each of
    them that no larger id has. Rows alike in id and text become one row, any one of them. A group whose
    ids are all null keeps one row. Input columns may have any names.
    """
    # The id as two columns that are never null, so that rows without one meet like all others.
    same_id = lambda c: [F.coalesce(c, F.lit(0)).alias("id"), c.isNull().alias("nameless")]
    keep = exact_groups(docs).where("kept").select(*same_id(F.col("doc_id")), F.unhex("text_sha256").alias("sha")).distinct()
    own = F.unhex(F.sha2(normalise(F.col("text")).cast("binary"), 256)).alias("sha")
    rows = docs.select(F.struct("*").alias("row"), *same_id(F.col("doc_id").cast("long")), own)
    key = ["id", "nameless", "sha"]
    return rows.join(keep, key, "left_semi").dropDuplicates(key).select("row.*")
