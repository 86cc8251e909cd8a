"""Tables of a relational database as sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldroute.operators.masters import put
from fieldroute.session import cut


def read_jdbc(spark: SparkSession, url: str, table: str, split: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table or ``(query) alias``; filters and columns chosen on the result go to the database.

    With ``split``, a numeric column, ``parts`` tasks read ranges of it between its least and largest value, found by one
    row; nulls are in the first range. Without it, or when the table has no value there, one task reads the table.
    Names come in lower case.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if split:
        ends = reader.option("dbtable", f"(SELECT MIN({split}) AS lo, MAX({split}) AS hi FROM {table}) ends").load().first()
        if ends[0] is not None:
            reader = reader.option("partitionColumn", split).option("lowerBound", int(ends[0])).option("upperBound", int(ends[1]) + 1).option("numPartitions", parts)
    rows = reader.option("dbtable", table).load()
    return rows.withColumnsRenamed({c: c.lower() for c in rows.columns})


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", parts: int = 8, **options: str) -> None:
    """Rows into a table by at most ``parts`` connections; ``overwrite`` empties a table that is there and keeps its columns and rules."""
    names = [c.upper() for c in df.columns] if url.startswith("jdbc:derby") else df.columns
    df.toDF(*names).write.format("jdbc").option("url", url).option("dbtable", table).option("truncate", True).option("numPartitions", parts).options(**options).mode(mode).save()


def put_jdbc(spark: SparkSession, new: DataFrame, url: str, table: str, name: str, now=None, **options: str) -> int:
    """New rows of the master ``name`` put into its database table; returns the rows it then has.

    The result is written in the shared folder first, so a write that a lost task breaks off can be done again from there.
    """
    done = cut(put(read_jdbc(spark, url, table, **options), new, name, now), f"jdbc-{name}")
    write_jdbc(done, url, table, "overwrite", **options)
    return done.agg(F.count(F.lit(1))).first()[0]
