"""Labelled rows for the trained operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text is a multiple of FOLDS; a null id is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int) -> DataFrame:
    """doc_id, text and y of labelled documents outside the held-out fold: at most ``rows`` of them and ``most_bytes`` of text.

    The bound is on documents that the table has, whatever else is labelled. They are taken
    in the order of a hash of the id; one whose text no longer fits is passed over. An id labelled several times
    has its largest label, one with several texts that of the least hash. Labels other than 0 and 1 say nothing.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    known = labels.where(~held_out()).where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    own = docs.where(~held_out()).select("doc_id", F.struct(F.xxhash64(text).alias("h"), F.octet_length(text).alias("size")).alias("t"))
    found = own.join(known, "doc_id").groupBy("doc_id", "y").agg(F.min("t").alias("t")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    room, sample = most_bytes, []
    for r in found.select("doc_id", "y", "t.h", "t.size").collect():  # ids and sizes of at most ``rows`` rows
        if r["size"] <= room:
            room -= r["size"]
            sample.append((r["doc_id"], r["h"], r["y"]))
    sample = docs.sparkSession.createDataFrame(sample, "doc_id long, h long, y int")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return read.join(F.broadcast(sample), ["doc_id", "h"]).drop("h").dropDuplicates(["doc_id"])
