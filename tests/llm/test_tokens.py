import base64
import random

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldroute.llm.bpe import TextEncoder, decode, encode, load
from fieldroute.llm.huffman import STRIDE, Book, code_lengths, read_tokens, write_tokens
from fieldroute.llm.packing import Layout, combinations, pack, solve
from fieldroute.llm.tokens import WordIds
from fieldroute.session import table

from . import brute

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n \t", "a" * 5000, " " * 3000 + "x", "ab" * 3000, "don't  we'll x 123456", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "é É İ ΣΑΣ", "日本語テキスト😀😀", "a\x0bb\x0cc\x1cd\x85e f", "!!!!????" * 300, "the the"]


def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_OWN = reference_encoding()
_ENCODER = TextEncoder(load(RANKS), public_tokenizers.PATTERN, True)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeinorst hlé\n1!", max_size=300))
def test_tree_equals_direct(text):
    bpe = load(RANKS)
    data = text.encode()
    assert bpe.tree(data) == bpe.merge(data)
    assert bpe.merges([data[:16], data[16:32], b"x"]) == [bpe.merge(data[:16]), bpe.merge(data[16:32]), bpe.merge(b"x")]
    assert bpe.decode(np.array(bpe.tree(data), np.int32)) == data


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aebn 1!\n\t'sd\u00a0\x1cé", max_size=30), max_size=4))
def test_texts_in_parts(texts):
    """Texts that fall apart at spaces, with white space of all kinds around, are what the pattern gives."""
    got = _ENCODER.encode(texts)
    assert [np.frombuffer(x, np.int32).tolist() for x in got] == [_OWN.encode_ordinary(t) for t in texts]


def test_bpe_query_rows(spark, sf):
    own = reference_encoding()
    texts = [r.text for r in table(spark, sf, "documents").collect()] + ODD
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts in (False, True):
        got = {r.doc_id: (r.ids, bytes(r.decoded)) for r in decode(encode(docs, RANKS, public_tokenizers.PATTERN, space_starts_match=parts), RANKS).collect()}
        assert got == {i: (own.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts)}
    assert encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_odd_rows(spark):
    """Null ids, repeated rows and clashing column names."""
    docs = spark.createDataFrame([(None, "a b", "x"), (1, "a b", "x"), (1, "a b", "x"), (2, None, "y")], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in decode(encode(docs, RANKS, public_tokenizers.PATTERN, space_starts_match=True), RANKS).collect()), key=repr)
    ids = _OWN.encode_ordinary("a b")
    assert got == sorted([(None, ids, b"a b"), (1, ids, b"a b"), (1, ids, b"a b"), (2, [], b"")], key=repr)


def whole(texts):
    return [_TOKENIZER.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_word_ids():
    known = WordIds(WORDS)
    got = [np.frombuffer(x, known.dtype).tolist() + [1] for x in known.encode([None if t is None else t.encode() for t in ODD])]
    assert got == whole(ODD) and known.by_parts


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAzéÉßñÑçœŒİıſĳΣς.,!'*<|>_-1½ \u0301\u0307日가", max_size=40))
def test_word_parts(text):
    known = _KNOWN
    assert np.frombuffer(known.encode([text.encode()])[0], known.dtype).tolist() == whole([text])[0][:-1]


_KNOWN = WordIds(WORDS)
_TOKENIZER = Tokenizer.from_file(WORDS)


def test_huffman_book():
    rng = np.random.default_rng(1)
    for counts in ([5], [0, 3, 0], [1, 1], [2**i for i in range(40)], rng.integers(0, 50, 3000), np.r_[10**9, rng.integers(0, 3, 60_000)]):
        counts = np.array(counts, np.int64)
        lengths = code_lengths(counts)
        used = lengths[counts > 0].astype(int)
        assert (lengths[counts == 0] == 0).all() and (2.0**-used).sum() <= 1 and used.max() <= 18
        book = Book(lengths)
        for n in (0, 1, STRIDE, STRIDE + 1, 5000):
            ids = rng.choice(np.flatnonzero(counts), n)
            at, data = book.pack(ids)
            assert book.unpack(n, at, data).tolist() == ids.tolist()


def test_lengths_are_optimal_without_limit():
    import heapq

    rng = random.Random(3)
    for _ in range(20):
        counts = [rng.randint(1, 99) for _ in range(rng.randint(2, 40))]
        heap, cost = list(counts), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            cost += x
            heapq.heappush(heap, x)
        assert (np.array(counts) * code_lengths(np.array(counts))).sum() == cost


def test_token_files(spark, sf, tmp_path):
    texts = [r.text for r in table(spark, sf, "documents").collect()] + ODD
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    write_tokens(docs, str(tmp_path / "f"), WORDS, 1)
    got = {r.doc_id: (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in read_tokens(spark, str(tmp_path / "f")).collect()}
    want, start = {}, 0
    for (d, _), ids in sorted(zip(rows, whole(texts)), key=lambda x: x[0][0]):
        want[d] = (start, len(ids), ids)
        start += len(ids)
    assert got == want
    write_tokens(docs.limit(0), str(tmp_path / "e"), WORDS, 1)
    assert read_tokens(spark, str(tmp_path / "e")).count() == 0


def check_pieces(pieces, texts):
    """Each id in exactly one piece, sequences gapless, and how much is padded."""
    ids = dict(enumerate(whole(texts)))
    seen = {d: 0 for d in ids}
    rows = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == seen[p.doc_id] and p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
        assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.doc_id][p.start : p.start + p.length]
        seen[p.doc_id] += p.length
        rows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert seen == {d: len(x) for d, x in ids.items()}
    padding = 0
    for parts in rows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_packing(spark, sf):
    texts = [r.text for r in table(spark, sf, "documents").collect()] + ODD + ["word " * 2047, "word " * 2048, "word " * 4095] + ["same " * 1500] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert check_pieces(pack(docs, WORDS, 1).collect(), texts) == 0
    assert pack(docs.limit(0), WORDS, 1).count() == 0
    one = spark.createDataFrame([(0, "a b c", 1)], "doc_id long, text string, tail int")
    assert check_pieces(pack(one, WORDS, 1).collect(), ["a b c"]) == 0


def test_layout_uses_combinations():
    h = np.zeros(2048, np.int64)
    h[[1000, 1048, 500, 1548, 600, 848]] = [900, 900, 400, 400, 300, 300]
    h[600] += 1
    layout = Layout(h, 0)
    assert layout.used.sum() >= 0.95 * h.sum()
    assert set(map(tuple, combinations(np.array([1024, 2047, 1]), 2048))) == {(1024, 1024, 0), (2047, 1, 0)}
    assert (solve(h, combinations(np.flatnonzero(h), 2048)) >= 0).all()
