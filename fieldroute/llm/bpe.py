"""Byte-level BPE as a monoid tree reduction.

A piece is encoded by encoding its halves and joining the two token lists. The
join re-encodes a window of tokens around the seam and widens it until the
tokens outside provably stay: a token list is the encoding of its bytes
exactly when every adjacent pair is the encoding of its own bytes, because the
first merge that crosses a boundary would cross it in that pair alone too.
Both lists hold already, so only the two pairs at the window's ends need a look.
Decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldroute.llm.recent import Recent
from fieldroute.session import ship

LEAF_BYTES = 12
PIECES_BYTES, PARTS_BYTES = 32 << 20, 64 << 20
NEVER = (1 << 31) - 1
#: Byte strings up to this length are merged side by side.
WIDE = 16
DECODE_LEAF = 4096


class Ranks:
    """Ranks of byte strings, as tiktoken has them, and the pairs that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.count = max(ranks.values(), default=-1) + 1
        tokens = [self.bytes_of.get(i, b"") for i in range(self.count)]
        self.sizes = np.array([len(b) for b in tokens], np.int64)
        self.flat, self.begins = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(self.sizes) - self.sizes
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        pairs = [(a * self.count + b, i) for t, i in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None]
        found = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pair, self.merged = np.append(found[:, 0], 1 << 62), np.append(found[:, 1], NEVER).astype(np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, NEVER where they do not merge or one is -1."""
        key = np.where((a < 0) | (b < 0), -1, a.astype(np.int64) * self.count + b)
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.merged[at], NEVER)


@lru_cache(1)
def _ranks(path: str) -> Ranks:
    with open(path, "rb") as f:
        return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class TreeBPE:
    """The whole piece first, else merges by lowest rank, leftmost of ties: found by tree reduction, level by level for many pieces."""

    def __init__(self, ranks: Ranks):
        self.r, self.ranks, self.bytes_of = ranks, ranks.ranks, ranks.bytes_of

    def spell(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Merges on one short byte string."""
        rank, parts = self.ranks.get, [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while pairs and (best := min(pairs)) != NEVER:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], NEVER)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], NEVER)
        return tuple([self.ranks[p] for p in parts])

    def merges(self, strings: list[bytes]) -> list[tuple[int, ...]]:
        """``merge`` of many strings of at most WIDE bytes, a row each: every round merges each row's best pair."""
        size = np.array([len(s) for s in strings])
        width = max(1, int(size.max()))
        raw = np.frombuffer(b"".join([s.ljust(width, b"\0") for s in strings]), np.uint8).reshape(-1, width)
        token = np.full((len(raw), width + 1), -1, np.int32)
        token[:, :-1] = np.where(np.arange(width) < size[:, None], self.r.single[raw], -1)
        rank = self.r.rank(token[:, :-1], token[:, 1:])
        # A merged token stays at its first byte's place; the places of its neighbours are linked.
        after = np.tile(np.arange(1, width + 2, dtype=np.int32), (len(raw), 1))
        before = after - 2
        live = np.arange(len(raw))
        while len(live):
            at = rank[live].argmin(1)
            best = rank[live, at]
            go = best != NEVER
            live, at, best = live[go], at[go], best[go]
            right = after[live, at]
            beyond = after[live, right]
            token[live, at], token[live, right] = best, -1
            after[live, at], before[live, beyond] = beyond, at
            rank[live, right] = NEVER
            rank[live, at] = self.r.rank(best, token[live, beyond])
            left = before[live, at]
            some = left >= 0
            live_left, left = live[some], left[some]
            rank[live_left, left] = self.r.rank(token[live_left, left], best[some])
        kept = token >= 0
        flat, ends = token[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def encodings(self, strings: list[bytes]) -> list[tuple[int, ...]]:
        """Short strings side by side, longer ones one by one."""
        out = [None if len(s) <= WIDE else self.merge(s) for s in strings]
        short = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(short, self.merges([strings[i] for i in short]) if short else (), strict=True):
            out[i] = ids
        return out

    def spelt(self, windows: list[tuple[int, ...]]) -> dict:
        """What the tokens of each window spell, encoded anew."""
        different = list(set(windows))
        return dict(zip(different, self.encodings([self.spell(w) for w in different]), strict=True))

    def joins(self, pairs: list[tuple]) -> list[tuple[int, ...]]:
        """The monoid's operation on many pairs of encodings."""
        out: list = [left or right if not (left and right) else None for left, right in pairs]
        open_ = [(k, 1, 1) for k, x in enumerate(out) if x is None]
        while open_:
            asked = []
            for k, i, j in open_:
                left, right = pairs[k]
                asked.append((k, max(0, len(left) - i), min(len(right), j), i, j))
            windows = [pairs[k][0][a:] + pairs[k][1][:b] for k, a, b, _, _ in asked]
            encoded = self.spelt(windows)
            middles = [encoded[w] for w in windows]
            ends = []
            for (k, a, b, _, _), m in zip(asked, middles, strict=True):
                left, right = pairs[k]
                ends.append(((left[a - 1], m[0]) if a else None, (m[-1], right[b]) if b < len(right) else None))
            encoded = self.spelt([e for two in ends for e in two if e is not None])
            open_ = []
            for (k, a, b, i, j), m, (before, after) in zip(asked, middles, ends, strict=True):
                holds_left = before is None or encoded[before] == before
                holds_right = after is None or encoded[after] == after
                if holds_left and holds_right:
                    out[k] = pairs[k][0][:a] + m + pairs[k][1][b:]
                else:
                    open_.append((k, i if holds_left else 2 * i, j if holds_right else 2 * j))
        return out

    def trees(self, strings: list[bytes]) -> list[tuple[int, ...]]:
        """The encoding of each string: leaves of at most LEAF_BYTES, then neighbours are joined until one list is left."""
        nodes: list[list] = []
        for s in strings:
            parts = [s]
            while max(map(len, parts)) > LEAF_BYTES:
                parts = [x for p in parts for x in (p[: len(p) // 2], p[len(p) // 2 :])]
            nodes.append(parts)
        different = list({p for parts in nodes for p in parts})
        leaves = dict(zip(different, self.encodings(different), strict=True))
        nodes = [[leaves[p] for p in parts] for parts in nodes]
        while many := [k for k, x in enumerate(nodes) if len(x) > 1]:
            joined = iter(self.joins([(nodes[k][i], nodes[k][i + 1]) for k in many for i in range(0, len(nodes[k]), 2)]))
            for k in many:
                nodes[k] = [next(joined) for _ in range(len(nodes[k]) // 2)]
        return [x[0] for x in nodes]

    def tree(self, data: bytes) -> tuple[int, ...]:
        return self.trees([data])[0]

    def encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        whole = [self.ranks.get(p) for p in pieces]
        made = iter(self.trees([p for p, w in zip(pieces, whole, strict=True) if w is None]))
        return [next(made) if w is None else (w,) for w in whole]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids: leaves by one gather each, then concatenation up the tree."""
        if len(ids) <= DECODE_LEAF:
            sizes = self.r.sizes[ids]
            ends = np.cumsum(sizes)
            return self.r.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.r.begins[ids] - ends + sizes, sizes)].tobytes()
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def load(path: str) -> TreeBPE:
    return TreeBPE(_ranks(path))


class _Touched(Exception):
    """Parts between spaces that more white space touches, as in two spaces side by side."""

    def __init__(self, parts: set[str]):
        self.parts = parts


class TextEncoder:
    """Ids of texts as bytes of int32; each match of ``pattern`` is encoded separately.

    ``space_starts_match`` promises that a space between two characters that are not white
    space always starts a match and that matches on either side do not look across it.
    Then texts fall apart there, and the parts, which recur, are remembered.
    """

    def __init__(self, bpe: TreeBPE, pattern: str, space_starts_match: bool = False):
        import regex

        self.bpe, self.splits = bpe, space_starts_match
        self.find = regex.compile(pattern).findall
        self.pieces, self.parts = Recent(PIECES_BYTES), Recent(PARTS_BYTES)

    def _ids(self, pieces: list[str]) -> list[bytes]:
        return [array("i", ids).tobytes() for ids in self.bpe.encode([p.encode() for p in pieces])]

    def _pieces(self, found: list[list[str]]) -> list[bytes]:
        ids = self.pieces.look_up([p for f in found for p in f], self._ids)
        return _joined(ids, map(len, found))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") if self.splits else [t] for t in texts]
        try:
            return self._parts(split)
        except _Touched as e:
            apart = [e.parts.isdisjoint(s[1:]) and not _ends_white(s) for s in split]
            whole = iter(self._pieces([self.find(t) for t, a in zip(texts, apart, strict=True) if not a]))
            parts = iter(self._parts([s for s, a in zip(split, apart, strict=True) if a]))
            return [next(parts) if a else next(whole) for a in apart]

    def _parts(self, split: list[list[str]]) -> list[bytes]:
        def make(parts: list[str]) -> list[bytes]:
            if touched := {p for p in parts if not p or p[0].isspace() or p[-1].isspace()}:
                raise _Touched(touched)
            return self._pieces([self.find(" " + p) for p in parts])

        if any(map(_ends_white, split)):
            raise _Touched({p for s in split for p in s[1:] if not p or p[0].isspace() or p[-1].isspace()})
        heads = self._pieces([self.find(s[0]) for s in split])
        ids = self.parts.look_up([p for s in split for p in s[1:]], make)
        return [a + b for a, b in zip(heads, _joined(ids, [len(s) - 1 for s in split]), strict=True)]


def _ends_white(split: list[str]) -> bool:
    """Whether white space is left of the first of several parts' end."""
    return len(split) > 1 and (not split[0] or split[0][-1].isspace())


def _joined(values: list[bytes], counts) -> list[bytes]:
    """Runs of the given lengths, each joined."""
    out, at = [], 0
    for n in counts:
        out.append(b"".join(values[at : at + n]))
        at += n
    return out


def _lists(values: list[bytes]) -> pa.Array:
    """Byte strings of int32 as a list column."""
    ends = np.cumsum([0] + [len(v) // 4 for v in values]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(values), np.int32)))


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", space_starts_match: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of every row, in no particular order.

    Each match of ``pattern`` is encoded separately; no special tokens. Null or
    empty text: an empty array. Repeated rows and null ids stay as they are;
    other columns are ignored. ``space_starts_match``: see ``TextEncoder``.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(load(ranks_path), pattern, space_starts_match)
        for batch in batches:
            for part in _slices(batch):
                ids = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids)], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids and the decoded bytes; null ids decode to nothing."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path)
        for batch in batches:
            for part in _slices(batch):
                column = part.column(1).fill_null([])
                flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                texts = [bpe.decode(flat[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
