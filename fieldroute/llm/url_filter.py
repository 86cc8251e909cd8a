"""URL rules as a sort-merge range join, in DataFrame operations only.

A rule covers its host, every subdomain and every path that starts with its
own. Written as ``reversed.host/path`` a rule is a prefix, so it is the interval
from its key to its key followed by byte FF; intervals of one host nest or lie
apart. Each url contributes one key for each suffix of its host that has
rules. Openings, closings and url keys are sorted together; a running sum of
+1 and -1 is the depth of the stack of active rules, and the rule on top is
the last one that was opened at the current depth.

Rows of one host suffix are salted by their count, with that suffix's
rules in every salt, so a hot host is no hot task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldroute.llm.exact_dedup import normalise

ROWS_PER_SALT = 50_000


def split_url(url) -> tuple:
    """Host and path columns. Null, or no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return normalise(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(action, host, path) triples as a table."""
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def _key(host, path):
    reversed_host = F.array_join(F.reverse(F.split(host, r"\.")), ".")
    return F.concat(reversed_host, F.lit("/"), path).cast("binary")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """Every input column, then host, path, rule and verdict; one row per input row.

    The longest fitting rule wins (host and path together, then the longer
    host). Two rules alike in host and path: ``block`` wins over ``allow``. No
    fitting rule: rule is null and the verdict ``default``. A null url has an empty
    host and path; repeated rows are judged each. Input columns named host, path,
    rule or verdict are replaced; no other name clashes.
    """
    host, path = split_url(F.col(url_col))
    others = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(F.struct(*others).alias("page"), host.alias("host"), path.alias("path"))
    rules = rules.select(F.coalesce("host", F.lit("")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "action").groupBy("rule_host", "rule_path").agg(F.max("action").alias("action"))

    # One key for each url and each suffix of its host that has rules.
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    urls = parsed.select("host", "path").distinct()
    keys = urls.withColumn("rule_host", F.explode(suffixes)).join(rules.select("rule_host").distinct(), "rule_host", "left_semi")
    salts = keys.groupBy("rule_host").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_SALT).cast("int").alias("salts"))

    asked = keys.join(salts, "rule_host").select("rule_host", F.pmod(F.xxhash64("host", "path"), F.col("salts")).cast("int").alias("salt"), _key(F.col("rule_host"), F.col("path")).alias("key"), F.lit(1).alias("kind"), F.lit(0).alias("step"), "host", "path", F.lit(None).cast("string").alias("rule_path"), F.lit(None).cast("string").alias("action"))
    spread = rules.join(salts, "rule_host").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    key = _key(F.col("rule_host"), F.col("rule_path"))
    none = F.lit(None).cast("string")
    opened = spread.select("rule_host", "salt", key.alias("key"), F.lit(0).alias("kind"), F.lit(1).alias("step"), none.alias("host"), none.alias("path"), "rule_path", "action")
    closed = spread.select("rule_host", "salt", F.concat(key, F.unhex(F.lit("FF"))).alias("key"), F.lit(2).alias("kind"), F.lit(-1).alias("step"), none.alias("host"), none.alias("path"), none.alias("rule_path"), none.alias("action"))

    sweep = Window.partitionBy("rule_host", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy("rule_host", "salt", "depth").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    top = F.last(F.when(F.col("kind") == 0, F.struct("rule_host", "rule_path", "action")), ignorenulls=True).over(level)
    swept = opened.unionByName(closed).unionByName(asked).withColumn("depth", F.sum("step").over(sweep))
    found = swept.where("kind = 1 or kind = 0").where("depth > 0").withColumn("top", top).where("kind = 1 and top is not null")
    best = found.groupBy("host", "path").agg(F.max_by("top", F.struct(F.length("top.rule_host") + F.length("top.rule_path"), F.length("top.rule_host"))).alias("best"))
    best = best.select("host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), F.col("best.action").alias("action"))
    out = parsed.join(best, ["host", "path"], "left")
    return out.select("page.*", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
