"""Interaction audit of filters: what each filter removes in every order they can be applied in.

A document fails some of the filters: a bit mask. Per part the masks are counted,
2^n numbers whatever the number of documents, and a zeta transform over subsets turns
them into survivors: ``alive[S]`` is the number of documents that fail no filter of S. What a
filter removes after those of S is alive[S] - alive[S + filter], so a step of an order is
the difference of two neighbouring subsets, and no order is ever run over documents. The same
transform over labelled documents gives what is lost of them.

All of it is DataFrame functions; after the masks, tables have one row a part.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldroute.session import cut

WORD_SPLIT = r"[\x20\x09-\x0D]+"


def short(text: Column, words: Column) -> Column:
    """Under 200 words."""
    return F.size(words) < 200


def repetitive(text: Column, words: Column) -> Column:
    """Less than half of the words are different."""
    return 100 * F.size(F.array_distinct(words)) < 50 * F.size(words)


def shouting(text: Column, words: Column) -> Column:
    """More than 2 in 100 code points are capitals A-Z."""
    return 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text)


def marked(text: Column, words: Column) -> Column:
    """Holds a mark of code or markup."""
    return text.rlike("[#$%&*|]")


#: Failure conditions by letter; a filter given as None fails rows whose text a smaller id has.
FILTERS: dict[str, Callable[[Column, Column], Column] | None] = {"A": short, "B": repetitive, "C": shouting, "D": marked, "E": None}


def masks(docs: DataFrame, filters: dict = FILTERS, part_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(part, doc_id, mask, n): rows by part, id and failed filters, written once.

    A null text is empty, a null part the empty string. A row copies another when its text is
    that of a smaller id anywhere in the table: rows of one id do not copy each other, and
    rows without an id neither copy nor are copied.
    """
    raw = docs.select(F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    worded = raw.withColumn("words", F.array_remove(F.split("text", WORD_SPLIT), ""))
    bits = [F.when(fails(F.col("text"), F.col("words")), 1 << i).otherwise(0) for i, fails in enumerate(filters.values()) if fails]
    own = sum(bits, F.lit(0))
    rows = cut(worded.select("part", "doc_id", own.cast("int").alias("own"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha")), "audit-rows")
    copying = sum(1 << i for i, fails in enumerate(filters.values()) if fails is None)
    if not copying:
        return rows.groupBy("part", "doc_id", F.col("own").alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    # The smallest id of each text is found with a map-side minimum; rows meet it by text and id, so a text
    # that a third of all rows share is spread by its ids.
    named = rows.where("doc_id is not null").groupBy("part", "doc_id", "own", "sha").agg(F.count(F.lit(1)).alias("n"))
    firsts = rows.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copies = F.when(F.col("first").isNull(), copying).otherwise(0)
    judged = named.join(firsts, ["sha", "doc_id"], "left").select("part", "doc_id", (F.col("own") + copies).cast("int").alias("mask"), "n")
    nameless = rows.where("doc_id is null").groupBy("part", "doc_id", F.col("own").alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    return judged.unionByName(nameless)


def part_counts(masked: DataFrame, labels: DataFrame, n_filters: int) -> DataFrame:
    """(part, docs, good, toxic): arrays with the count of each mask, all documents and those labelled so.

    An id is good (toxic) if any of its label rows says 1; a null label says nothing.
    """
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    named = masked.where("doc_id is not null").join(known, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    nameless = masked.where("doc_id is null").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    counted = named.unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    # At most 2^n rows a part from here on.
    found = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("docs", "good", "toxic")))).alias("by_mask"))
    every = F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))
    dense = lambda name: F.transform(every, lambda m: F.coalesce(F.col("by_mask")[m][name], F.lit(0).cast("long"))).alias(name)
    return found.select("part", dense("docs"), dense("good"), dense("toxic"))


def survivors(counts: DataFrame, n_filters: int) -> DataFrame:
    """Adds alive, good_alive and toxic_alive: at index S, documents of the part that fail no filter of the subset S.

    The zeta transform sums an array over every mask's subsets: one pass a filter, each adding the neighbour without its bit.
    """

    def added(name: str, bit: int) -> Column:
        return F.transform(name, lambda x, m: F.when(m.bitwiseAND(F.lit(bit)) > 0, x + F.get(F.col(name), m.bitwiseXOR(F.lit(bit)))).otherwise(x))

    out = counts
    for name, source in (("alive", "docs"), ("good_alive", "good"), ("toxic_alive", "toxic")):
        out = out.withColumn(name, F.col(source))
        for i in range(n_filters):
            out = out.withColumn(name, added(name, 1 << i))
        # Survivors of S have masks inside its complement, which is the array from its other end.
        out = out.withColumn(name, F.reverse(name))
    return out


def audit(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS, part_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per part, order of the filters and step, with document counts of the part.

    part, filter_order, step (from 1), then kept (after the step), removed (here),
    redundant (fails the step's filter but is gone already), unique_fails (fails that filter
    only), good_lost and toxic_lost (removed here, labelled so) and shapley (what the filter
    removes, summed over all orders). Parts are those of the table, so an empty table has no
    rows; steps that remove nothing have zeros. Repeated rows count each. Input columns
    other than the three named are ignored, whatever their names.
    """
    letters, n = list(filters), len(filters)
    whole = (1 << n) - 1
    alive = survivors(part_counts(masks(docs, filters, part_col, text_col, id_col), labels, n), n)
    steps = [F.struct(F.lit("".join(o)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(1 << letters.index(o[k])).alias("own"), F.lit(sum(1 << letters.index(x) for x in o[:k])).alias("before")) for o in permutations(letters) for k in range(n)]
    # How many orders have exactly the filters of a subset before a given one.
    weights = F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)).cast("long") for k in range(n)])
    subsets = F.sequence(F.lit(0), F.lit(whole))

    def share(bit: int) -> Column:
        losses = F.transform(F.filter(subsets, lambda s: s.bitwiseAND(F.lit(bit)) == 0), lambda s: F.get(weights, F.bit_count(s)) * (F.get("alive", s) - F.get("alive", s.bitwiseOR(F.lit(bit)))))
        return F.aggregate(losses, F.lit(0).cast("long"), lambda a, x: a + x)

    shares = alive.withColumn("shares", F.map_from_arrays(F.array(*[F.lit(1 << i) for i in range(n)]), F.array(*[share(1 << i) for i in range(n)])))
    out = shares.withColumn("s", F.explode(F.array(*steps))).select("part", "s.*", "alive", "good_alive", "toxic_alive", "shares")
    after = F.col("before").bitwiseOR(F.col("own"))
    others = F.lit(whole).bitwiseXOR(F.col("own"))
    lost = lambda c: F.get(c, F.col("before")) - F.get(c, after)
    failing = F.get("alive", F.lit(0)) - F.get("alive", F.col("own"))
    return out.select(
        "part", "filter_order", "step", F.get("alive", after).alias("kept"), lost("alive").alias("removed"), (failing - lost("alive")).alias("redundant"),
        (F.get("alive", others) - F.get("alive", F.lit(whole))).alias("unique_fails"), lost("good_alive").alias("good_lost"), lost("toxic_alive").alias("toxic_lost"), F.col("shares")[F.col("own")].alias("shapley"),
    )
