"""The corpus pipeline: quality rules, exact dedup, near-duplicate dedup, repeated-string removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents; what a stage rejects is gone for those after it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldroute.llm.exact_dedup import drop_exact_copies
from fieldroute.llm.minhash import drop_near_copies
from fieldroute.llm.packing import pack
from fieldroute.llm.quality_rules import quality
from fieldroute.llm.queries import END_ID
from fieldroute.llm.suffix_dedup import drop_repeats
from fieldroute.session import cut, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, every row judged for itself; one without a text has no words and goes."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    return quality(rows, table(spark, sf_dir, "labels"), columns=["row"]).where("kept").select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text (A-Z lower-cased): that of the largest id, or without ids any one."""
    return drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id; rows without an id stay."""
    return drop_near_copies(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose repeated strings and n_chars follows; a document of which nothing is left goes."""
    return drop_repeats(docs).where("text is null or text <> ''").withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document in one piece of a sequence; rows without an id are packed too."""
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("repeated strings", repeats_stage), ("packing", packing_stage)]

#: The quality verdict and tokenising are not expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
