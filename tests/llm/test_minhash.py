import random

import numpy as np

from fieldroute.llm import minhash
from fieldroute.llm.components import components
from fieldroute.llm.minhash import drop_near_copies, least_matches, matches, minima, _packed, near_groups, shingles, word_names
from fieldroute.session import table

from . import brute


def as_dict(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in frame.collect()}


def test_table(spark, sf):
    docs = table(spark, sf, "documents")
    assert as_dict(near_groups(docs)) == brute.near([(r.doc_id, r.text) for r in docs.collect()])


def family(seed, copies, edits, n=200):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    out = []
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_families_and_odd_rows(spark):
    texts = [t for s in range(6) for t in family(s, 25, 9)]
    passage = " ".join(f"p{i}" for i in range(100))
    texts += [passage + " " + family(100 + s, 1, 0, 80)[0] for s in range(60)]  # similar, yet below the threshold
    texts += [None, "", " \n", "a b", "A  B", "a b c", "a b c d e", "É x", "é x", "a b"] * 2
    rng = random.Random(5)
    ids = rng.sample(range(10**6), len(texts))
    docs = spark.createDataFrame([(i, t, 0) for i, t in zip(ids, texts)], "doc_id long, text string, root int")
    want = brute.near(list(zip(ids, texts)))
    assert as_dict(near_groups(docs)) == want
    assert {r.doc_id for r in drop_near_copies(docs).collect()} == {d for d, x in want.items() if x[2]}
    assert near_groups(docs.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_groups(docs).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("None", None, True)]


def mixed(least):
    return (least * np.uint32(0x9E3779B1)) >> np.uint32(28)


def test_small_sets_differ_in_their_bits():
    """Different minima of short texts agree in their four bits about once in sixteen lanes, so the corrected bound holds there too."""
    same = total = 0
    for k in range(60):
        a, b = (minima(shingles([b"%d" % i for i in range(1000 * k + j, 1000 * k + j + 8)], word_names())) for j in (0, 500))
        same, total = same + int(np.sum(mixed(a) == mixed(b))), total + len(a)
    assert 0.04 < same / total < 0.09


def test_recall_at_the_threshold(spark):
    """Pairs just at and just below 0.75, of short and long texts: all of the first are linked, none of the second."""
    rng, rows, linked = random.Random(8), [], []
    for k in range(400):
        shingle_count = rng.choice([8, 16, 40, 120, 400])
        shared = -(-6 * shingle_count // 7)  # n + n - s in the union: s / (2n - s) >= 0.75 from s = 6n/7 on
        shared -= k % 2
        base = [f"a{k}x{i}" for i in range(2 * shingle_count + 8)]
        first, second = base[: shingle_count + 4], base[shingle_count - shared : 2 * shingle_count - shared + 4]
        rows += [(2 * k, " ".join(first)), (2 * k + 1, " ".join(second))]
        linked.append(4 * shared >= 3 * (2 * shingle_count - shared))
    got = as_dict(near_groups(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[2 * k + 1][1] == 2 * k for k in range(400)] == linked and 150 < sum(linked) < 250


def test_bit_counts(spark):
    a, b = (minima(shingles([b"%d" % i for i in range(k, k + 300)], word_names())) for k in (0, 40))
    df = spark.createDataFrame([(_packed(a).tolist(), _packed(b).tolist())], "x array<long>, y array<long>")
    assert df.select(matches("x", "y")).first()[0] == int(np.sum(mixed(a) == mixed(b)))
    assert 0.65 * 384 < least_matches() < 0.766 * 384


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + rng.randrange(200), 1000 + rng.randrange(200)) for _ in range(90)] + [(5000, 5000 + i) for i in range(1, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(top)}
    assert np.all(np.diff(sorted(got)) > 0)


def test_an_id_with_several_texts_is_one_document(spark):
    """Whatever the order of rows, the links are those of one stated text, and no row is lost."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (5, a + " x"), (5, b), (7, b + " y"), (5, a + " x")]
    results = []
    for order in (rows, rows[::-1]):
        out = near_groups(spark.createDataFrame([(*r, "c", 1) for r in order], "doc_id long, text string, same string, node int")).collect()
        results.append(sorted(tuple(r) for r in out))
        assert len(out) == 5
    assert results[0] == results[1]


def test_hot_buckets_and_classes_change_nothing(spark, monkeypatch):
    """Every key of two rows and more counted as hot, and every bucket dealt by single rows: the same groups."""
    texts = [t for s in range(4) for t in family(s, 30, 9)] + ["one text that many rows have in common"] * 40 + [None, "", " "] * 5
    docs = list(enumerate(texts)) + [(None, texts[0]), (None, None)]
    want = brute.near([d for d in docs if d[0] is not None])
    for rows, share in ((1, 10**9), (1, 50), (1 << 14, 10_000)):
        monkeypatch.setattr(minhash, "HOT_ROWS", rows)
        monkeypatch.setattr(minhash, "HOT_SHARE", share)
        got = as_dict(near_groups(spark.createDataFrame(docs, "doc_id long, text string")))
        assert got.pop(None)[1:] == (None, True)
        assert got == want
