import zlib

import numpy as np
from pyspark.sql import functions as F

from fieldroute.llm import gam, toxicity
from fieldroute.llm.labelled import training_rows
from fieldroute.session import table

SF = "/root/testdata/sf0.01"


def results(scored, labels, label):
    rows = scored.where("held_out").join(labels, "doc_id").select("score", "predicted", label).collect()
    return np.array([r.score for r in rows]), np.array([r.predicted for r in rows]), np.array([r[label] for r in rows])


def test_toxicity_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model, with_sentences=True)
    _, predicted, y = results(scored, labels, "toxic")
    assert (predicted == y).mean() > 0.9
    rows = scored.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = []
    for r in (r for r in rows if r.sentences):
        words = toxicity.split_words(texts[r.doc_id].encode())
        found += [b" ".join(words[s.first_word : s.first_word + s.words]).decode() for s in r.sentences]
    assert sum("idiot" in x or "moron" in x or "stupid" in x for x in found) >= 5


def test_quality_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scored = gam.score(docs, gam.train(docs, labels))
    _, predicted, y = results(scored, labels, "quality")
    assert (predicted == y).mean() > 0.93


def test_sample_is_of_documents_that_are_there(spark):
    """Labels of other ids take no place in the sample; it is bounded in rows and in bytes, and has one text an id."""
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("c").alias("y"), F.lit("c").alias("h"))
    docs = docs.unionByName(docs.where("doc_id < 50").withColumn("text", F.concat(F.lit("other "), F.col("doc_id")))).unionByName(docs.where("doc_id < 50"))
    labels = spark.range(200_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"), F.lit(1).alias("text"))
    usable = {d for d in range(1000) if zlib.crc32(str(d).encode()) % 5}
    rows = training_rows(docs, labels, "toxic", 5000, 1 << 20).collect()
    assert {r.doc_id for r in rows} == usable and len(rows) == len(usable)
    assert all(r.y == r.doc_id % 2 and r.text.endswith(f" {r.doc_id}") for r in rows)
    few = training_rows(docs, labels, "toxic", 100, 1 << 20).collect()
    assert len(few) == 100 and {tuple(r) for r in few} <= {tuple(r) for r in rows}
    assert sum(len(r.text) for r in training_rows(docs, labels, "toxic", 5000, 900).collect()) in range(800, 901)
    assert training_rows(docs.limit(0), labels, "toxic", 10, 10).count() == 0


def plain_measure(text):
    """The features again, by loops over characters and words."""
    import collections
    import math

    words = text.split()
    if not words:
        return [0.0] * len(gam.NAMES)
    n, w = len(text), len(words)
    count = lambda of: sum(1 for b in text if of(b))
    upper, lower = count(lambda b: 65 <= b <= 90), count(lambda b: 97 <= b <= 122)
    punctuation = lambda b: 33 <= b < 127 and not chr(b).isalnum()
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated, i = 0, 0
    while i < n - 1:
        hit = punctuation(text[i]) and text[i] == text[i + 1]
        repeated, i = repeated + hit, i + 1 + hit
    return [
        math.log(n), upper / (upper + lower + 1), count(lambda b: chr(b) in "#*$%&<>@^_~|\\/+=") / n, count(lambda b: chr(b) in "!?") / w, count(lambda b: 48 <= b <= 57) / n, count(punctuation) / n, count(lambda b: b == 46) / w, count(lambda b: b > 127) / n,
        count(lambda b: b not in (9, 10, 11, 12, 13, 32)) / w, len(set(words)) / w, sum(a == b for a, b in zip(words, words[1:])) / w, 1 - len(set(lines)) / len(lines), math.log(w / len(lines)), len(lines) / w,
        repeated / w, -sum(c / n * math.log2(c / n) for c in collections.Counter(text).values()), len(zlib.compress(text, 1)) / n,
    ]


def test_quality_query_by_brute_force(spark, sf):
    """Every row of the query: features by loops, the score as a sum of looked-up bins."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = gam.train(docs, labels)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()] + [(-1, b""), (-2, b" \n"), (-3, "!!! ??? ## \u00e9\u00e9 __a__".encode())]
    frame = spark.createDataFrame([(d, t.decode(), 0.5, "c") for d, t in rows], "doc_id long, text string, score double, x string")
    got = {r.doc_id: r for r in gam.score(frame, model).collect()}
    assert len(got) == len(rows) and gam.score(frame, model).columns == ["doc_id", "held_out", "score", "predicted"]
    for d, text in rows:
        x = plain_measure(text)
        assert np.allclose(gam.measure(text), x, atol=1e-12)
        x = gam.measure(text)
        total = model.bias + sum(t[sum(e <= v for e in edges)] for t, edges, v in zip(model.tables, model.edges, x, strict=True))
        total += sum(t[sum(e <= x[i] for e in model.coarse[i]), sum(e <= x[j] for e in model.coarse[j])] for i, j, t in model.pairs)
        assert abs(got[d].score - 1 / (1 + np.exp(-total))) < 1e-9
        assert got[d].predicted == (got[d].score >= 0.3) and got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)


def test_noisy_or_and_sentences():
    p, first = toxicity.sentence_scores([(1.0, False), (2.0, True), (0.0, False)], 0.0)
    assert first.tolist() == [0, 2] and np.allclose(p, [1 / (1 + np.exp(-3)), 0.5])
    assert np.isclose(toxicity.noisy_or(np.log1p(-p).sum()), 1 - (1 - p[0]) * (1 - p[1]))
    assert toxicity.sentence_scores([], 0.0)[0].size == 0


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.9


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "a b. c"), (3, "x" * 300_000), (3, "x" * 300_000), (4, "\n\n"), (5, "é. é!")]
    docs = spark.createDataFrame([(*r, 1, "s", 2.0, True) for r in docs], "doc_id long, text string, x int, score string, y double, held_out boolean")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for scored in (toxicity.score(docs, toxicity.train(docs, none)), gam.score(docs, gam.train(docs, none))):
        rows = scored.collect()
        assert len(rows) == 7 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert all(r.held_out for r in rows if r.doc_id is None)
    assert toxicity.score(docs.limit(0), toxicity.train(docs, none)).count() == 0


def test_noisy_or_gradient_by_finite_differences():
    rng = np.random.default_rng(3)
    doc_of = np.sort(rng.integers(0, 8, 25)).astype(np.int32)
    at, feature = rng.integers(0, 25, 90).astype(np.int32), rng.integers(0, 12, 90)
    positive, w, bias = np.arange(8) % 2 == 0, rng.normal(size=12), -0.7

    def loss(w, bias):
        total = 0.0
        for d in range(8):
            none = 1.0
            for k in np.flatnonzero(doc_of == d):
                none *= 1 - 1 / (1 + np.exp(-(sum(w[f] for f in feature[at == k]) + bias)))
            total -= (np.log(max(1 - none, 1e-9)) if positive[d] else np.log(none)) / 8
        return total

    grad, by_bias = toxicity.slopes(at, feature, doc_of, positive, w, bias)
    step = np.eye(12) * 1e-6
    assert np.allclose(grad, [(loss(w + e, bias) - loss(w - e, bias)) / 2e-6 for e in step], atol=1e-6)
    assert np.isclose(by_bias, (loss(w, bias + 1e-6) - loss(w, bias - 1e-6)) / 2e-6, atol=1e-6)


def test_toxicity_score_against_a_loop(spark):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in toxicity.score(docs, model, with_sentences=True).collect():
        none, total, start, offends = 1.0, model.bias, 0, []
        words = texts[r.doc_id].replace(b"\n", b" . ").split()
        for k, word in enumerate(words):
            total += sum(float(model.weights[i]) for i in toxicity.features(word))
            if word.endswith((b".", b"!", b"?")) or k == len(words) - 1:
                p = 1 / (1 + np.exp(-min(max(total, -30), 30)))
                none *= 1 - min(p, 1 - 1e-12)
                offends += [(start, k + 1 - start)] if p >= 0.5 else []
                total, start = model.bias, k + 1
        assert abs(r.score - (1 - none)) < 1e-6
        assert [(s.first_word, s.words) for s in r.sentences] == offends


def test_gam_score_is_a_sum_of_bins():
    rng = np.random.default_rng(1)
    x = rng.random((600, 4)).round(2)
    model = gam.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float))
    for row, got in zip(x[:60], model.score(x[:60]), strict=True):
        total = model.bias + sum(t[sum(e <= v for e in edges)] for t, edges, v in zip(model.tables, model.edges, row, strict=True))
        total += sum(t[sum(e <= row[i] for e in model.coarse[i]), sum(e <= row[j] for e in model.coarse[j])] for i, j, t in model.pairs)
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-9


def test_gam_split_against_every_cut():
    rng = np.random.default_rng(2)
    for _ in range(30):
        g, h, n = rng.normal(size=12), rng.random(12) + 0.1, rng.integers(0, 9, 12)
        best, at = 1e-6, None
        for c in range(1, 12):
            if min(n[:c].sum(), n[c:].sum()) < gam.LEAST_ROWS:
                continue
            gain = sum(v.sum() ** 2 / (k.sum() + gam.RIDGE) for v, k in ((g[:c], h[:c]), (g[c:], h[c:]))) - g.sum() ** 2 / (h.sum() + gam.RIDGE)
            if gain > best:
                best, at = gain, c
        assert gam._split(g, h, n, 0, 12) == at
