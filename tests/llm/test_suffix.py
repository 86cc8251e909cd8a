import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldroute.llm.suffix_dedup import drop_repeats, rank_windows, remove_repeats
from fieldroute.session import table

from . import brute


def as_dict(frame):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept_bytes).hexdigest()) for r in frame.collect()}


def test_table(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    assert as_dict(remove_repeats(docs)) == brute.repeats([(r.doc_id, r.text) for r in docs.collect()])


def odd_rows(seed):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefgh ij\n") for _ in range(n))
    passages = [noise(n) for n in (49, 50, 51, 80, 200)] + ["é" * 40, "a" * 300, "ab" * 90]
    out = [None, "", "x" * 49, "x" * 50, "x" * 51, "x" * 400, noise(300)]
    out += [noise(rng.randrange(60)) + rng.choice(passages) + noise(rng.randrange(60)) + rng.choice(passages)[: rng.randrange(30, 300)] + noise(9) for _ in range(90)]
    out += [out[-1], out[-1], passages[4] * 3, passages[3], passages[3][1:], passages[0]]
    return list(zip(rng.sample(range(-500, 500), len(out)), out))


@pytest.mark.parametrize("seed,hot", [(1, 48), (2, 1), (3, 0)])
def test_odd_rows(spark, seed, hot):
    rows = odd_rows(seed)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_bytes int").repartition(3)
    assert as_dict(remove_repeats(docs, hot_batches=hot)) == brute.repeats(rows)


def test_very_long_texts(spark):
    """Texts of several pieces and batches, of which parts repeat."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[60_000:61_000])), (3, "own " + " ".join(words[:50_000]) + " end"), (4, "z" * 600_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_dict(remove_repeats(docs)) == brute.repeats(rows)


def test_repeated_null_and_empty(spark):
    long = "0123456789" * 8 + "abc"
    docs = spark.createDataFrame([(1, long), (1, long), (None, long), (2, long), (3, "zz" + long[5:] + "yy")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in remove_repeats(docs).collect())
    assert got == [("1", 0), ("1", 0), ("2", 83), ("3", 78), ("None", 0)]
    assert remove_repeats(docs.limit(0)).count() == 0
    assert {r.text for r in drop_repeats(docs).collect()} == {long, "", "zzyy"}


def test_any_column_and_repeated_ids(spark):
    """Other columns come back as they were, whatever their names; rows of one id with different texts take nothing from each other."""
    long = "0123456789" * 8 + "abc"
    rows = [(1, long), (1, "q" + long), (2, long + "r"), (None, long), (None, "s" + long)]
    names = ["_batch", "_hash", "_blob", "kept_bytes", "n_bytes", "batch", "row", "id", "hash", "blob"]
    docs = spark.createDataFrame([(d, t, *[f"{c}{i}" for c in names]) for i, (d, t) in enumerate(rows)], ["doc_id", "text", *names]).withColumn("nothing", F.lit(None).cast("string"))
    left = drop_repeats(docs)
    assert left.columns == docs.columns
    got = {r.row: r for r in left.collect()}
    assert [got[f"row{i}"].text for i in range(5)] == [long, "q" + long, "r", long, "s" + long]
    assert all(got[f"row{i}"][c] == f"{c}{i}" for i in range(5) for c in names)
    kept = remove_repeats(docs)
    assert {r._batch: r.n_removed for r in kept.collect()} == {"_batch0": 0, "_batch1": 0, "_batch2": 83, "_batch3": 0, "_batch4": 0}
    assert kept.columns == ["doc_id", *[c for c in names if c not in ("kept_bytes", "n_bytes")], "nothing", "n_bytes", "n_removed", "n_spans", "kept_bytes"]


def test_ranks_are_exact():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 4000, np.uint8).tobytes()
    data = data + data[100:400] + b"q" + data[:70]
    starts = np.arange(len(data) - 49)
    rank = rank_windows(data, starts)
    seen = {}
    for i in starts:
        seen.setdefault(data[i : i + 50], []).append(i)
    for places in seen.values():
        assert len({rank[i] for i in places}) == 1
    assert len({rank[p[0]] for p in seen.values() if len(p) > 1}) == sum(len(p) > 1 for p in seen.values())
