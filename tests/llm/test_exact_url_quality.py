import pytest
from pyspark.sql import functions as F

from fieldroute.llm.exact_dedup import drop_exact_copies, exact_groups
from fieldroute.llm.quality_rules import base_counts, exact_quantile, gram_counts, quality, ratios, trusted_ids, with_ratio, with_words
from fieldroute.llm.queries import URL_RULES
from fieldroute.llm.url_filter import judge_urls, rules_frame
from fieldroute.session import table

from . import brute

ODD = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (4, "a B"), (None, "a b"), (5, "Ä"), (6, "ä"), (7, "x" * 200_000), (8, "X" * 200_000), (None, "only"), (None, "only")]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_exact_odd_rows(spark, parts):
    docs = spark.createDataFrame([(d, t, "z") for d, t in ODD * 3], "doc_id long, text string, kept string")
    got = sorted(map(tuple, exact_groups(docs, partitions=parts).collect()), key=repr)
    assert got == sorted(brute.exact(ODD * 3), key=repr)
    left = drop_exact_copies(docs).collect()
    assert sorted(str(r.doc_id) for r in left) == sorted(["2", "4", "5", "6", "8", "None"])


def test_an_id_with_several_texts_keeps_each(spark):
    """What stays is a text, not an id: neither may a text be lost nor a copy stay, in any order of rows."""
    rows = [(5, "beta", "b1"), (5, "alpha", "a"), (9, "BETA", "b2"), (9, "beta", "b3"), (7, "x", "x1"), (7, "y", "y"), (None, "x", "x2"), (None, "z", "z1"), (None, "z", "z2")]
    for order in (rows, rows[::-1], sorted(rows, key=str)):
        docs = spark.createDataFrame([(*r, 1, 2) for r in order], "doc_id long, text string, row string, sha int, _id int")
        left = drop_exact_copies(docs)
        assert left.columns == docs.columns
        assert sorted(((r.doc_id, r.text.lower()) for r in left.collect()), key=str) == sorted([(5, "alpha"), (9, "beta"), (7, "x"), (7, "y"), (None, "z")], key=str)


def test_exact_table_and_empty(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, exact_groups(docs).collect())) == sorted(brute.exact(rows))
    assert exact_groups(docs.limit(0)).count() == 0


def test_hot_text_spans_partitions(spark):
    rows = [(i, "same text") for i in range(400)] + [(1000 + i, f"own {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, exact_groups(docs, partitions=9).collect())) == sorted(brute.exact(rows))


def test_urls(spark, sf):
    urls = [r.url for r in table(spark, sf, "pages").collect()]
    urls += [None, "", "no scheme", "a://", "A://COM/en/", "x://com", "x://com/en", "x://sub.Example.com/en/7?q", "x://example.com/en/7#a", "x://notexample.com/en/7", "x://a.b.net/de/8", "x://example.net/de/8/é", "://org/es/", "x://org?/es/", "x://.com/en/", "x://com./en/"] * 3
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rules_frame(spark, URL_RULES)).collect()}
    assert got == {i: brute.url(u, URL_RULES) for i, u in enumerate(urls)}
    assert judge_urls(pages.limit(0), rules_frame(spark, URL_RULES)).count() == 0


def test_urls_take_any_column(spark):
    names = ["_host", "_path", "_action", "page", "step", "kind", "rule_host", "best", "key", "host", "path", "rule", "verdict"]
    pages = spark.createDataFrame([(i, u, *[f"{c}{i}" for c in names]) for i, u in enumerate(["x://a.com/en/1", None, "x://a.com/en/1"])], ["page_id", "url", *names])
    got = judge_urls(pages, rules_frame(spark, URL_RULES))
    assert got.columns == ["page_id", "url", *names]
    for r in got.collect():
        want = brute.url(r.url, URL_RULES)
        assert tuple(r) == (r.page_id, r.url, *[f"{c}{r.page_id}" for c in names[:9]], *want)


@pytest.mark.parametrize("share", [0.0, 0.005, 0.3, 1.0])
def test_quantile_is_exact_at_any_size(spark, share):
    import math
    import random

    rng = random.Random(5)
    for values in ([1.5], [2.0, 2.0, -1.0], [rng.gauss(0, 1) for _ in range(5000)], [5e-324, 0.0, -5e-324, 1e300, -1e300, 1.0, 1.0 + 2**-52] * 3):
        frame = spark.createDataFrame([(v,) for v in values], "x double")
        assert exact_quantile(frame, share, bins=7) == sorted(values)[max(1, math.ceil(share * len(values))) - 1]
    assert exact_quantile(spark.createDataFrame([], "x double"), share) is None


def test_deeply_nested_rules(spark):
    rules = [("block", "com", ""), ("allow", "com", "/a"), ("block", "com", "/a/b"), ("allow", "com", "/a/b/c"), ("block", "x.com", "/a"), ("allow", "com", "/b"), ("block", "x.com", "/ab")]
    urls = [f"h://{h}{p}" for h in ("com", "x.com", "y.x.com", "net") for p in ("", "/", "/a", "/ab", "/a/b", "/a/b/c/d", "/b", "/c")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rules_frame(spark, rules)).collect()}
    assert got == {i: brute.url(u, rules) for i, u in enumerate(urls)}


def test_base_counts(spark, sf):
    texts = [r.text for r in table(spark, sf, "documents").collect()]
    texts += [None, "", " \n\t", "a a a a", "a b c a b c", "a b c\n\na b c\n \nx", "a\u00a0b # <>\x0bq", "x y z " * 500, "a b c d a b c e b c d", "q r s " + " ".join(f"w{i}" for i in range(9000)) + " q r s w1 w2 w3 w4"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r.doc_id: tuple(r[c] for c in cols) for r in base_counts(with_words(docs)).collect()}
    assert got == {i: brute.base(t)[:5] for i, t in enumerate(texts)}


def test_quality_keeps_clean_and_rejects_junk(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = quality(docs, labels).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg({"kept": "count"}, ).collect()
    assert len(got) == 2
    kept = {(r.quality, r.kept): r["count"] for r in quality(docs, labels).where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    clean = kept.get((1, True), 0) / (kept.get((1, True), 0) + kept.get((1, False), 0))
    assert clean > 0.97
    assert quality(docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("name,trusted", [("sf0.001", None), ("sf0.01", None), ("sf0.01", 30)])
def test_quality_keeps_clean_unlabelled_text_at_any_size(spark, name, trusted):
    """The labels of every fifth good document are hidden; few of these may go, and of all unlabelled ones no more than junk explains."""
    sf = f"/root/testdata/{name}"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").where("quality is not null")
    hidden = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    known = labels.where((F.col("quality") == 0) | ~hidden)
    if trusted:
        known = known.orderBy(F.xxhash64("doc_id")).where("quality = 1").limit(trusted)
    rows = quality(docs, known).where("not base_failed").join(labels, "doc_id", "left").join(known.select("doc_id", F.lit(1).alias("told")), "doc_id", "left").select("quality", "told", "kept").collect()
    held = [r.kept for r in rows if r.quality == 1 and not r.told]
    unlabelled = [r.kept for r in rows if r.quality is None]
    assert len(held) >= 10 and sum(held) >= 0.75 * len(held)
    assert sum(unlabelled) >= 0.75 * len(unlabelled)


def test_quality_counts_every_trusted_document(spark):
    """More good labels than the sample once held: all of them count in the target."""
    docs = spark.range(25_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    counts = gram_counts(docs, trusted_ids(labels)).agg(F.sum("raw"), F.sum("target")).first()
    assert tuple(counts) == (25_000, 25_000)


def test_own_counts_say_nothing(spark):
    """A text whose words no other document has is neither good nor bad, and its repeats do not change that."""
    odd = " ".join(f"q{i % 40}" for i in range(120))
    docs = spark.createDataFrame([(i, ("a b c d " if i < 40 else "u v w x ") * 30) for i in range(80)] + [(99, odd)], "doc_id long, text string")
    counts = gram_counts(docs, docs.where("doc_id < 20").select("doc_id"), 1 << 16)
    got = {r.doc_id: r._ratio for r in with_ratio(with_words(docs), ratios(counts, 1 << 16), 1 << 16).collect()}
    assert abs(got[99]) < 1e-9 and got[8] > 0.1 and got[70] < -0.1


@pytest.mark.parametrize("threshold", [-0.45, 0.1])
def test_score_and_verdict_by_brute_force(spark, sf, threshold):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, "a b c"), (None, None), (7, "again " * 60)]
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    want = brute.likelihood(rows, good, 1 << 12, threshold)
    frame = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, score string, _words string")
    got = quality(frame, labels, threshold, 1 << 12)
    assert got.columns[:3] == ["doc_id", "text", "_words"] and got.where("_words = 'y'").count() == len(rows)
    key = lambda d, t: (d is None, d or 0, t or "")
    found = sorted(((r.doc_id, r.text, r.score, r.kept) for r in got.collect()), key=lambda r: key(r[0], r[1]))
    assert len(found) == len(want)
    for (d, t, score, kept), (e, u, expected) in zip(found, sorted(want, key=lambda r: key(r[0], r[1])), strict=True):
        assert (d, t) == (e, u) and abs(score - expected) < 1e-4
        if abs(expected - threshold) > 1e-4:
            assert kept == (not brute.base(t)[5] and expected >= threshold)


def test_quality_takes_clashing_and_untyped_columns(spark):
    docs = spark.createDataFrame([(1, "a b c " * 30, "x", 5), (1, None, "y", 6), (None, "", None, 7)], "doc_id long, text string, _ratio string, n_words int")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    rows = quality(docs.withColumn("_text", F.lit("q")).withColumn("_in", F.lit(1)).withColumn("nothing", F.lit(None)), labels).collect()
    assert sorted((r.n_words, r["_ratio"] or "", r["_text"], r["_in"], r.nothing, r.kept) for r in rows) == [(0, "", "q", 1, None, False), (0, "y", "q", 1, None, False), (90, "x", "q", 1, None, False)]
    slim = quality(docs, labels, columns=["doc_id"])
    assert slim.columns[0] == "doc_id" and "text" not in slim.columns and slim.count() == 3
