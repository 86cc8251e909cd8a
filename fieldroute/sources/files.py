"""File sources and sinks."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldroute.functions.text import address_key, blank_null_words, boolean, collapse, country, postal_key, street
from fieldroute.operators.relational import keep_first, upsert

#: Encodings in the order in which they are tried.
GENERAL_ENCODINGS = ("UTF-8", "x-windows-949", "ISO-8859-1")
WINDOWS_ENCODINGS = ("windows-1252", "ISO-8859-1", "x-windows-949", "UTF-8")
BOM = "\ufeff"

#: The columns of a geocode cache in their order, and words that stand for a missing key.
CACHE_COLUMNS = (
    "address_key", "address_line1", "city", "state", "postal_code", "country_name", "matched_address", "match_indicator", "match_type", "longitude",
    "latitude", "tiger_line_id", "tiger_line_side", "census_state_fips", "census_county_fips", "census_tract", "census_block", "geocoded_date", "source",
)
MISSING_KEYS = ("", "nan", "None", "none", "NaN")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, encodings: Sequence[str] = GENERAL_ENCODINGS) -> DataFrame:
    """CSV with a header in the first of the encodings that has no unmappable character; every column is text without a schema.

    The probe is one scan that stops at the first bad row. A byte order mark does
    not reach the first column's name, and blank text stays blank.
    """
    if not path.lower().rstrip("/").endswith((".csv", ".txt")):
        raise ValueError(f"not a CSV file: {path}")
    for k, encoding in enumerate(encodings):
        text = spark.read.option("encoding", encoding).text(path)
        if k == len(encodings) - 1 or text.where(F.col("value").contains("\ufffd") | ~F.is_valid_utf8("value")).isEmpty():
            break
    reader = spark.read.option("header", True).option("encoding", encoding).option("emptyValue", "").option("enforceSchema", True)
    out = (reader.schema(schema) if schema else reader).csv(path)
    return out.withColumnsRenamed({c: c.lstrip(BOM) for c in out.columns if c.startswith(BOM)}).drop(*[c for c in out.columns if c.startswith("Unnamed:")])


def backfill(df: DataFrame | None, spark: SparkSession, schema: str, flags: Sequence[str] = ()) -> DataFrame:
    """The columns of ``schema`` in its order, null where ``df`` lacks one; empty without ``df``. Text flags become booleans."""
    wanted = spark.createDataFrame([], schema)
    if df is None:
        return wanted
    df = df.withColumns({c: boolean(F.col(c).cast("string")) for c in flags if c in df.columns})
    return wanted.unionByName(df.select(*[F.col(f.name).cast(f.dataType) for f in wanted.schema if f.name in df.columns]), allowMissingColumns=True)


def read_config(spark: SparkSession, path: str) -> dict:
    """The one JSON object of a configuration file, from any store that Spark reads; empty without the file."""
    try:
        rows = spark.read.option("wholetext", True).text(path).take(1)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    return json.loads(rows[0].value.lstrip(BOM)) if rows else {}


def newest_valid(spark: SparkSession, folder: str, pattern: str, required: Sequence[str]) -> str | None:
    """Path of the newest CSV file that fits the pattern and whose header has the required columns.

    Files are listed by their metadata, contents unread; headers are read from the newest on until one fits.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    for r in files.orderBy(F.col("modificationTime").desc(), F.col("path").desc()).toLocalIterator():
        if r.path.lower().endswith((".csv", ".txt")):
            names = {c.lstrip(BOM).strip(' "') for c in spark.read.option("header", True).csv(r.path).columns}
            if names >= set(required):
                return r.path
    return None


def read_route_cache(spark: SparkSession, path: str) -> DataFrame:
    """One JSON route a line; lines that are none are skipped, repeated keys stay."""
    schema = "cache_key string, distance_km double, duration_min double, coords array<array<double>>"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("cache_key is not null")


def geocode_cache(df: DataFrame, every_key: bool = False) -> DataFrame:
    """The columns of a geocode cache as text, blank where ``df`` lacks one or is null, with keys repaired from the address.

    A row without a key gets cleaned address parts and the key they make. With ``every_key`` all rows get a
    key and a cleaned street line anew, and their other parts stay as they are.
    """
    have = set(df.columns)
    rows = df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c) for c in CACHE_COLUMNS])
    rows = rows.withColumn("address_key", F.trim("address_key"))
    tidy = lambda c: blank_null_words(collapse(F.col(c)))
    clean = {"city": tidy("city"), "state": tidy("state"), "postal_code": postal_key(F.col("postal_code")), "country_name": country(F.col("country_name"))}
    line = street(F.col("address_line1"), *clean.values())
    broken = F.lit(True) if every_key else F.col("address_key").isin(*MISSING_KEYS)
    made = {"address_line1": line, "address_key": address_key(line, *clean.values())} | ({} if every_key else clean)
    return rows.withColumns({c: F.when(broken, x).otherwise(F.col(c)) for c, x in made.items()})


def read_geocode_cache(spark: SparkSession, path: str, every_key: bool = False) -> DataFrame:
    """A geocode cache from CSV; see ``geocode_cache``."""
    return geocode_cache(read_csv(spark, path, encodings=("UTF-8",)), every_key)


def read_trip_cache(spark: SparkSession, path: str) -> DataFrame:
    """cache_key, km and minutes; malformed rows are skipped."""
    schema = "cache_key string, distance_km double, duration_min double"
    rows = spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").csv(path)
    return rows.where("cache_key is not null and distance_km is not null and duration_min is not null")


def read_sniffed_csv(spark: SparkSession, path: str, delimiters: str = ",;\t|") -> DataFrame:
    """CSV whose delimiter is the one met most often in its header; blank text stays blank."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0].value if first else ""
    sep = max(delimiters, key=line.count)
    out = spark.read.option("header", True).option("sep", sep).option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    return out.fillna("").withColumnsRenamed({c: c.lstrip(BOM) for c in out.columns if c.startswith(BOM)})


def keep_last(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Cache rows with the new ones in place of those that share their keys; of new rows with one key that with the largest ``order`` stays."""
    return upsert(existing, keep_first(new, keys, [F.col(order).desc_nulls_last()]), keys)


def service_query(spark: SparkSession, sql: str, first_day: str, last_day: str, postals: DataFrame, postal_col: str = "postal_code") -> DataFrame:
    """A query with the named parameters :first_day and :last_day, limited to the postal codes of a table by a semi join."""
    return spark.sql(sql, args={"first_day": first_day, "last_day": last_day}).join(postals.select(postal_col), postal_col, "left_semi")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def replace_by_key(new: DataFrame, path: str, keys: list[str], out: str) -> None:
    """The table at ``path`` with the rows of ``new`` in place of those that share their keys, written to ``out``."""
    upsert(new.sparkSession.read.parquet(path), new, keys).write.mode("overwrite").parquet(out)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_requests(df: DataFrame, path: str) -> None:
    """One JSON document a row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows, failing as soon as a key occurs twice."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).select(F.raise_error(F.lit(f"duplicate key {keys}")).alias("_n"))
    counted.collect()
    return df


def columns_present(df: DataFrame, required: Sequence[str]) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def read_workbook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Sheets of a workbook by name; needs an installed Excel reader."""
    import pandas as pd

    return {name: spark.createDataFrame(frame.astype(object).where(frame.notna(), None).astype("string")) for name, frame in pd.read_excel(path, sheet_name=None, dtype=str).items()}
