"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, in DataFrame operations only.

The ratio compares two multinomials over hashed word 1- and 2-grams: one of the trusted
target documents, one of the whole raw corpus. Both are counted over every document, in
two halves dealt by a hash of the id, and a document is scored by the half it is not in: so its own
counts never speak for it, however small the table is. The score is the mean log ratio of its
n-grams, moved so that a stated quantile of the same table's trusted documents lies at the threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldroute.session import cut

#: Between words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BUCKETS = 1 << 18
MIN_WORDS = 50
THRESHOLD = -0.45
#: Share of trusted documents that would fall below the threshold if they had not been trusted.
QUANTILE = 0.005
#: Bins of a pass of the exact quantile.
QUANTILE_BINS = 4_096
SMOOTHING = 0.5
HALVES = 2
#: Up to this many trusted ids, some 100 MB, are sent to every executor.
BROADCAST_IDS = 4_000_000


def with_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds _text, _words and _hashes (a 64-bit hash of each word)."""
    out = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumn("_words", F.array_remove(F.split("_text", WORD_SPLIT), ""))
    return out.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))


def _windows(array: str, width: int, make):
    """make(first, index) for each window of that width."""
    heads = F.slice(F.col(array), 1, F.greatest(F.size(array) - (width - 1), F.lit(0)))
    return F.transform(heads, make)


def base_counts(worded: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.col("_text")
    out = worded.withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    out = out.withColumn("n_symbols", F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.ltrim(x, F.lit(SEPARATORS)) != ""))
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))

    # Windows of three words. Their hashes show whether any is repeated at all; only then are hashes with their places in
    # the low bits sorted, and only windows whose hash is met again are spelt out and compared.
    out = out.withColumn("_tri", _windows("_hashes", 3, lambda h, i: F.xxhash64(h, F.get("_hashes", i + 1), F.get("_hashes", i + 2))))
    out = out.withColumn("_bits", F.length(F.bin(F.size("_tri"))))
    placed = F.transform("_tri", lambda h, i: F.call_function("shiftleft", h, F.col("_bits")).bitwiseOR(i.cast("long")))
    out = out.withColumn("_keys", F.when(F.size(F.array_distinct("_tri")) < F.size("_tri"), F.sort_array(placed)))
    head = lambda k: F.call_function("shiftright", k, F.col("_bits"))
    alike = F.filter("_keys", lambda k, j: F.coalesce(F.when(j > 0, head(F.get("_keys", j - 1))) == head(k), F.lit(False)) | F.coalesce(head(F.get("_keys", j + 1)) == head(k), F.lit(False)))
    place = lambda k: k.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1).cast("int")
    out = out.withColumn("_places", F.transform(alike, place))
    spelt = F.transform("_places", lambda p: F.struct(F.concat_ws(" ", F.get("_words", p), F.get("_words", p + 1), F.get("_words", p + 2)).alias("g"), p.alias("p")))
    out = out.withColumn("_sorted", F.sort_array(spelt))
    out = out.withColumn("_at", F.sort_array(F.transform(F.filter("_sorted", lambda x, i: F.coalesce(F.when(i > 0, F.get("_sorted", i - 1)["g"]) == x["g"], F.lit(False)) | F.coalesce(F.get("_sorted", i + 1)["g"] == x["g"], F.lit(False))), lambda x: x["p"])))
    steps = F.transform("_at", lambda p, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), p - F.coalesce(F.get("_at", F.greatest(i - 1, F.lit(0))), F.lit(0)))))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    return out.drop("_lines", "_tri", "_bits", "_keys", "_places", "_sorted", "_at")


def _uni(h, buckets: int):
    """Bucket of a word; ``buckets`` is a power of two."""
    return h.bitwiseAND(F.lit(buckets - 1)).cast("int")


def _bi(h, after, buckets: int):
    """Bucket of two words, null without the second: other bits of its hash tell it from the first."""
    return _uni(h.bitwiseXOR(F.shiftright(after, 20)), buckets)


def _buckets(buckets: int):
    uni = F.transform("_hashes", lambda h: _uni(h, buckets))
    return F.concat(uni, _windows("_hashes", 2, lambda h, i: _bi(h, F.get("_hashes", i + 1), buckets)))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled good; the table grows with the labels."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def with_trusted(docs: DataFrame, trusted: DataFrame, how: str) -> DataFrame:
    """Documents joined to the trusted ids. These are sent around up to BROADCAST_IDS of them; beyond, both sides are shuffled."""
    few = trusted.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(trusted) if few else trusted, "doc_id", how)


def _half():
    return F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(HALVES)).cast("int")


def gram_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, half, raw, target) for every bucket and half: n-grams of all documents, and of all trusted ones."""
    marked = with_trusted(docs.select("doc_id", "text"), trusted.withColumn("_good", F.lit(1)), "left")
    grams = with_words(marked).select(_half().alias("half"), F.coalesce("_good", F.lit(0)).alias("good"), F.explode(_buckets(buckets)).alias("bucket"))
    counts = grams.groupBy("bucket", "half").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("target"))
    every = docs.sparkSession.range(buckets * HALVES).select(F.floor(F.col("id") / HALVES).cast("int").alias("bucket"), (F.col("id") % HALVES).cast("int").alias("half"))
    every = every.join(counts, ["bucket", "half"], "left")
    return cut(every.select("bucket", "half", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")), "grams")


def ratios(counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: for each half and bucket (at half * buckets + bucket) the log of what the other half counted in the target over what its raw counts lead to expect.

    Where the other half has no n-gram or no trusted document at all, every ratio is 0.
    """
    whole = Window.partitionBy("bucket")
    sums = counts.groupBy("half").agg(F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    total = sums.agg(F.sum("n_raw").alias("all_raw"), F.sum("n_target").alias("all_target"))
    other = sums.crossJoin(total).select("half", (F.col("all_raw") - F.col("n_raw")).alias("n_raw"), (F.col("all_target") - F.col("n_target")).alias("n_target"))  # HALVES rows
    rest = counts.select("bucket", "half", (F.sum("raw").over(whole) - F.col("raw")).alias("raw"), (F.sum("target").over(whole) - F.col("target")).alias("target"))
    expected = F.col("raw") * F.col("n_target") / F.greatest("n_raw", F.lit(1))
    ratio = F.log((F.col("target") + SMOOTHING) / (expected + SMOOTHING))
    named = rest.join(F.broadcast(other), "half").select((F.col("half") * buckets + F.col("bucket")).alias("at"), ratio.cast("float").alias("ratio"))
    return named.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "ratio"))), lambda x: x["ratio"]).alias("ratios"))


def with_ratio(worded: DataFrame, table: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds _ratio: the mean of the looked-up log ratios of a document's 1- and 2-grams; 0 without any."""
    out = worded.withColumn("_ratios", table.scalar()).withColumn("_base", _half() * buckets)

    def both(h, i):
        one, two = (F.get("_ratios", F.col("_base") + b).cast("double") for b in (_uni(h, buckets), _bi(h, F.get("_hashes", i + 1), buckets)))
        return one + F.coalesce(two, F.lit(0.0))

    total = F.aggregate(F.transform("_hashes", both), F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("_ratio", F.when(F.size("_hashes") > 0, total / (2 * F.size("_hashes") - 1)).otherwise(F.lit(0.0)))


def exact_quantile(values: DataFrame, share: float, bins: int = QUANTILE_BINS) -> float | None:
    """The value of rank ceil(share * rows) of the only column of a written table; None without rows.

    Each pass counts what lies between two values in ``bins`` bins and goes on inside the bin that holds the rank, until
    all that is left is one value: so the result is exact and the same at any size and in any order of rows.
    """
    x = F.col(values.columns[0])
    n, low, high = values.agg(F.count(x), F.min(x), F.max(x)).first()
    if not n:
        return None
    rank = max(1, math.ceil(share * n))
    while low < high:
        at = F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1))
        for r in values.where(x.between(low, high)).groupBy(at.alias("at")).agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).orderBy("at").collect():  # at most ``bins`` rows
            if rank <= r["n"]:
                low, high = r["low"], r["high"]
                break
            rank -= r["n"]
    return low


def shift(scored: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> float:
    """What brings the QUANTILE of the trusted documents' ratios to ``threshold``; 0 without any. Documents too short for the base rules are left out."""
    known = with_trusted(scored.where(F.col("n_words") >= MIN_WORDS).select("doc_id", "_ratio"), trusted, "inner")
    found = exact_quantile(cut(known.select("_ratio"), "trusted-ratios"), QUANTILE)
    return 0.0 if found is None else threshold - found


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, columns: list[str] | None = None) -> DataFrame:
    """The named input columns (all by default), then the base counts, base_failed, score and kept.

    Counts and ratios are written once, with the named columns: the threshold is found on
    what was written, and no text is read a third time. Who needs no texts back names the others.

    A null text has no words and fails the base rules. A document without
    n-grams has a ratio of 0. Rows are judged one by one: repeated rows and null ids each
    get their own verdict. Without trusted documents the shift is 0 and
    the verdict still defined. Columns named like the added ones are replaced; no other name clashes.
    """
    trusted = cut(trusted_ids(labels), "trusted")
    table = cut(ratios(gram_counts(docs, trusted, buckets), buckets), "ratios")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    added = [*counts, "base_failed", "score", "kept"]
    back = [c for c in columns or docs.columns if c not in added]
    out = base_counts(with_words(docs.select(F.struct(*back).alias("_in"), "doc_id", "text")))
    scored = cut(with_ratio(out, table, buckets).select("_in", "doc_id", *counts, "_ratio"), "scored")
    out = scored.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = out.withColumn("score", F.col("_ratio") + shift(scored, trusted, threshold))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    return out.select(*[F.col("_in")[c].alias(c) for c in back], *added)
