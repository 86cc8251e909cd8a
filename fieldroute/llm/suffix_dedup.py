"""Removal of repeated byte strings by distributed prefix doubling.

Suffixes are ranked by prefixes of growing length; a suffix whose rank is unique
drops out, and doubling stops at the threshold of 50 bytes. Ranking every byte of
a corpus would shuffle some hundred bytes for each, so the rounds work on
suffixes that can still be repeated:

1. Of the 27 suffixes inside any 50-byte window, the one whose 24-byte prefix has
   the least name is sampled (equal windows sample equal prefixes). Spark
   deals the sampled names into buckets, where they are sorted; names met in one
   document only are unique and end here.
2. The windows around surviving samples go, by that name, to buckets. Prefixes of 8 bytes
   are ranked exactly, then rank pairs at offsets 8 and 16 are sorted and reranked,
   windows with a unique rank drop out, and a last pair at offset 18 reaches
   50 bytes. Each class of equal windows learns its smallest document.
3. Documents drop the bytes of windows that a smaller document has.

Names (64-bit) only choose candidates; what is removed rests on exact ranks.
Documents travel in batches dealt by id and text; within a batch equal windows
are sent once, so a hot passage counts once a batch. The windows of a name met in many
batches are dealt by their own content, so its many contexts never meet in one group. A whole text that a smaller
document repeats is found by its hash beforehand and takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from fieldroute.llm.recent import give_back
from fieldroute.session import ship, shuffle_width

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1
BATCH_BYTES, BUCKET_BYTES = 4 << 20, 64 << 20
PIECE = 1 << 18
#: Names met in more batches than this are hot: their windows are dealt one by one, by their own content. A batch
#: has some hundred contexts of a name at most, 76 bytes each: below this, a name takes a few MB of its bucket.
HOT_BATCHES = 256
SALTS = 16
LOW = np.uint64((1 << 39) - 1)
HOT = np.uint64(1 << 39)

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
NOTES = "batch int, tag int, number int, body binary, more binary"
_NOTES = pa.schema([("batch", pa.int32()), ("tag", pa.int32()), ("number", pa.int32()), ("body", pa.binary()), ("more", pa.binary())])
COPIES, SHARED, HITS = 0, 1, 2


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _M1) ^ (b + (a >> np.uint64(29)))
    h = h * _M2
    return h ^ (h >> np.uint64(32))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every position as one number."""
    a = data.astype(np.uint64)
    for step in (1, 2, 4):
        a = a[:-step] | (a[step:] << np.uint64(8 * step))
    return a


def sampled(data: np.ndarray, begin: int) -> np.ndarray:
    """For each 50-byte window the least name of its 24-byte prefixes, with that prefix's place, modulo 64, in the low bits."""
    f = eights(data)
    least = _mix(_mix(f[:-16], f[8:-8]), f[16:])
    least = (least & ~np.uint64(63)) | (np.arange(begin, begin + len(least), dtype=np.uint64) & np.uint64(63))
    n, step = len(least) - SPAN + 1, 1
    while 2 * step <= SPAN:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    return np.minimum(least[:n], least[SPAN - step : SPAN - step + n])


class Batch:
    """The texts of one batch end to end, ordered by id, and the sampled suffixes of their windows."""

    def __init__(self, table: pa.Table, notes: pa.Table):
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        self.ids = table.column("id").to_pylist()
        texts, hashes = [unzip(x) for x in table.column("blob").to_pylist()], table.column("hash").to_pylist()
        self.texts = texts
        copies = {x for tag, b in zip(notes.column("tag").to_pylist(), notes.column("body").to_pylist(), strict=True) if tag == COPIES for x in map(tuple, np.frombuffer(b, np.int64).reshape(-1, 2).tolist())}
        self.copy = [d is not None and (d, h) in copies for d, h in zip(self.ids, hashes, strict=True)]
        self.rows = sorted((i for i, d in enumerate(self.ids) if d is not None and not self.copy[i]), key=lambda i: (self.ids[i], texts[i]))
        self.data = b"".join(texts[i] for i in self.rows)
        sizes = np.array([len(texts[i]) for i in self.rows], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self._sample(sizes)

    def _sample(self, sizes: np.ndarray) -> None:
        """Segments: windows lo..hi of one document with one sampled suffix, and its name."""
        n = len(self.data)
        self.lo = self.hi = np.zeros(0, np.int64)
        self.name, self.doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if n < LENGTH:
            return
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        data, found = np.frombuffer(self.data, np.uint8), []
        # Piece by piece, so that a few numbers a byte exist for one piece only; a segment that a piece's end cuts is two.
        for begin in range(0, n - LENGTH + 1, PIECE):
            windows = min(PIECE, n - LENGTH + 1 - begin)
            least = sampled(data[begin : begin + windows + LENGTH - 1], begin)
            window = np.arange(begin, begin + windows, dtype=np.uint64)
            anchor = window + ((least - window) & np.uint64(63))
            own = owner[begin : begin + windows]
            valid = own == owner[begin + LENGTH - 1 : begin + LENGTH - 1 + windows]
            new, last = valid.copy(), valid.copy()
            new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
            last[:-1] &= (anchor[1:] != anchor[:-1]) | ~valid[1:]
            lo = np.flatnonzero(new)
            found.append((lo + begin, np.flatnonzero(last) + begin, least[lo] >> np.uint64(6), own[lo].astype(np.int64)))
        self.lo, self.hi, self.name, self.doc = (np.concatenate(x) for x in zip(*found, strict=True))

    def doc_ids(self) -> np.ndarray:
        return np.array([self.ids[i] for i in self.rows], np.int64)

    def keep_shared(self, notes: pa.Table, buckets: int) -> None:
        own = np.sort(np.concatenate([np.zeros(0, np.uint64)] + [_wide(b) | np.uint64(n << 40) for tag, n, b in zip(notes.column("tag").to_pylist(), notes.column("number").to_pylist(), notes.column("body").to_pylist(), strict=True) if tag == SHARED]))
        bucket, low = _place(self.name, buckets)
        code = (bucket.astype(np.uint64) << np.uint64(40)) | low
        plain, hot = own[own & HOT == 0], own[own & HOT > 0] & ~HOT
        shared, spread = _among(code, plain), _among(code, hot)
        cool = tuple(x[shared] for x in (self.lo, self.hi, self.name, self.doc))
        # A hot name's windows become segments of their own, named by their whole content: equal ones still
        # meet, while the many different contexts of a common passage lie in different buckets.
        lo, hi, doc = self.lo[spread], self.hi[spread], self.doc[spread]
        many = hi - lo + 1
        at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        alone = (at, at, self._content(at), np.repeat(doc, many))
        self.lo, self.hi, self.name, self.doc = (np.concatenate([a, b]) for a, b in zip(cool, alone, strict=True))
        order = np.argsort(self.doc, kind="stable")
        self.lo, self.hi, self.name, self.doc = self.lo[order], self.hi[order], self.name[order], self.doc[order]

    def _content(self, at: np.ndarray) -> np.ndarray:
        """Names, of 58 bits like the sampled ones, of whole windows."""
        data, out = np.frombuffer(self.data, np.uint8), np.zeros(len(at), np.uint64)
        for i in range(0, len(at), PIECE):
            part, name = at[i : i + PIECE], np.zeros(len(at[i : i + PIECE]), np.uint64)
            for offset in (*range(0, LENGTH - 8, 8), LENGTH - 8):
                name = _mix(name, eights(data[part[:, None] + (offset + np.arange(8))].reshape(-1))[::8])
            out[i : i + PIECE] = name >> np.uint64(6)
        return out

    def contexts(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct window runs, first segment of each, and each segment's run; documents ascend, so the first has the smallest id."""
        data, seen = self.data, {}
        runs = [seen.setdefault(data[a:b], len(seen)) for a, b in zip(self.lo.tolist(), (self.hi + LENGTH).tolist(), strict=True)]
        runs = np.array(runs, np.int64)
        first = np.unique(runs, return_index=True)[1] if len(runs) else runs
        return list(seen), first, runs


def _among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which codes are in the sorted array."""
    return np.zeros(len(codes), bool) if not len(known) else known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes


def _place(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return ((names >> np.uint64(39)) % np.uint64(buckets)).astype(np.int64), names & LOW


def _narrow(low: np.ndarray) -> bytes:
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _wide(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _by(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, its places) for every key."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(keys[part[0]]), part


def _notes(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NOTES, strict=True)], schema=_NOTES)


def rank_windows(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Exact ranks of the 50-byte windows at ``starts`` by prefix doubling; -1 where a shorter prefix is unique already."""
    rank = np.unique(eights(np.frombuffer(data + b"\0" * 64, np.uint8)), return_inverse=True)[1].astype(np.uint64)
    for offset in (8, 16):
        pair = rank[:-offset] * np.uint64(len(rank) + 1) + rank[offset:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
    heads = rank[starts]
    count = np.bincount(heads.astype(np.int64))
    live = count[heads.astype(np.int64)] > 1
    out = np.full(len(starts), -1, np.int64)
    pair = heads[live] * np.uint64(len(rank) + 1) + rank[starts[live] + (LENGTH - 32)]
    out[live] = np.unique(pair, return_inverse=True)[1]
    return out


ADDED = ("n_bytes", "n_removed", "n_spans", "kept_bytes")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_batches: int = HOT_BATCHES) -> DataFrame:
    """Every input column but the text, then n_bytes, n_removed, n_spans and kept_bytes.

    A byte goes when a 50-byte string covers it that also starts in a document with a
    smaller id. Null text is empty. Rows with a null id lose nothing and take
    nothing from others; rows with one id take nothing from each other, be their texts alike or not.
    Texts below 50 bytes stay whole. An empty table gives an empty result. Input columns
    with the names of the added ones are replaced; no other name clashes.
    """
    left = judged(docs, id_col, text_col, hot_batches)
    back = [F.col("row")[c].alias(c) for c in docs.columns if c not in (text_col, *ADDED)]
    return left.select(*back, *ADDED)


def judged(docs: DataFrame, id_col: str, text_col: str, hot_batches: int = HOT_BATCHES) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept_bytes): ``row`` has every input column but the text."""
    spark = docs.sparkSession
    ship(spark)
    width = shuffle_width(spark)
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    batches, buckets = max(width, total // BATCH_BYTES), max(width, total // BUCKET_BYTES)
    # Dealt by id and text, so that rows without an id, or with one id, are dealt too.
    batch = F.pmod(F.xxhash64(id_col, raw), F.lit(batches)).cast("int")

    # Whole texts that a smaller document repeats.
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("d"), F.sha2(raw, 256).alias("sha"), F.xxhash64(raw).alias("h"), batch.alias("batch"))
    firsts = named.groupBy("sha").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last")
    # A text with very many copies is spread by the copies' ids.
    named, firsts = named.withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALTS)).cast("int")), firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = named.join(firsts, ["sha", "salt"]).where("d > first").select("batch", "d", "h")

    def copy_notes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = np.stack([b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)], 1).astype(np.int64)
            yield from _notes([(k, COPIES, 0, pairs[part].tobytes(), None) for k, part in _by(b.column(0).to_numpy(zero_copy_only=False))]).to_batches()

    copies = copies.mapInArrow(copy_notes, NOTES)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield part.set_column(part.num_columns - 1, "blob", pa.array([zip_(x) for x in part.column(part.num_columns - 1).to_pylist()], pa.binary()))

    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(raw).alias("hash"), batch.alias("batch"), raw.alias("blob"))
    rows = rows.mapInArrow(compress, rows.schema)

    def names(left: pa.Table, right: pa.Table) -> pa.Table:
        """Round 1: the batch's distinct names by bucket; bit 39 tells that two documents of the batch have it."""
        if not left.num_rows:
            return _notes([])
        own, number = Batch(left, right), left.column("batch")[0].as_py()
        order = np.lexsort((own.doc, own.name))
        name, doc = own.name[order], own.doc_ids()[own.doc[order]] if len(own.doc) else own.doc
        first = np.flatnonzero(np.r_[len(name) > 0, name[1:] != name[:-1]]) if len(name) else np.zeros(0, np.int64)
        many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
        bucket, low = _place(name[first], buckets)
        low = low | (many.astype(np.uint64) << np.uint64(39))
        return _notes([(number, SHARED, k, _narrow(low[part]), None) for k, part in _by(bucket)])

    def shared(table: pa.Table) -> pa.Table:
        """A bucket's names are sorted; those of one document only are unique and drop out."""
        numbers = table.column("batch").to_pylist()
        parts = [_wide(b) for b in table.column("body").to_pylist()]
        low = np.concatenate(parts)
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        many, low = low >> np.uint64(39) > 0, low & LOW
        order = np.argsort(low, kind="stable")
        low, of, many = low[order], of[order], many[order]
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        count = np.diff(np.r_[first, len(low)])
        keep = np.repeat((count > 1) | np.logical_or.reduceat(many, first), count)
        bucket = table.column("number")[0].as_py()
        hot = np.repeat(count > hot_batches, count)
        low = low | np.where(hot, HOT, np.uint64(0))
        low, of = low[keep], of[keep]
        return _notes([(numbers[k], SHARED, bucket, _narrow(low[part]), None) for k, part in _by(of)])

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        """Round 2: runs of windows around shared names, by bucket."""
        import zstandard

        if not left.num_rows:
            return _notes([])
        own, number = Batch(left, right), left.column("batch")[0].as_py()
        own.keep_shared(right, buckets)
        runs, first, _ = own.contexts()
        if not runs:
            return _notes([])
        bucket, low = _place(own.name[first], buckets)
        doc, sub = own.doc_ids()[own.doc[first]], (low & np.uint64(255)).astype(np.int64)
        zip_ = zstandard.ZstdCompressor(level=3).compress
        out = []
        for k, part in _by(bucket):
            head = np.stack([part, doc[part], sub[part], np.array([len(runs[i]) for i in part])], 1).astype(np.int64)
            out.append((number, SHARED, k, zip_(b"".join([runs[i] for i in part])), zip_(np.ascontiguousarray(head.T).tobytes())))
        return _notes(out)

    def hits(table: pa.Table) -> pa.Table:
        """A bucket's windows are ranked; a run learns which of its windows a smaller document has."""
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        numbers = table.column("batch").to_pylist()
        data = b"".join(unzip(x) for x in table.column("body").to_pylist())
        heads = [np.frombuffer(unzip(x), np.int64).reshape(4, -1) for x in table.column("more").to_pylist()]
        of = np.repeat(np.arange(len(heads)), [h.shape[1] for h in heads])
        run, doc, sub, size = np.concatenate(heads, 1)
        end = np.cumsum(size)
        found_of, found_run, found_mask = [], [], []
        for _, part in _by(sub):
            text = b"".join([data[e - s : e] for e, s in zip(end[part].tolist(), size[part].tolist(), strict=True)])
            n = size[part] - LENGTH + 1
            begin = np.cumsum(size[part]) - size[part]
            owner = np.repeat(np.arange(len(part)), n)
            bit = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            rank = rank_windows(text, begin[owner] + bit)
            live = np.flatnonzero(rank >= 0)
            if not len(live):
                continue
            least = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, rank[live], doc[part][owner[live]])
            hit = live[least[rank[live]] < doc[part][owner[live]]]
            if len(hit):
                mask = np.zeros(len(part), np.int64)
                np.bitwise_or.at(mask, owner[hit], np.int64(1) << bit[hit])
                some = np.flatnonzero(mask)
                found_of.append(of[part][some])
                found_run.append(run[part][some])
                found_mask.append(mask[some])
        if not found_of:
            return _notes([])
        of, pairs = np.concatenate(found_of), np.stack([np.concatenate(found_run), np.concatenate(found_mask)], 1)
        return _notes([(numbers[k], HITS, 0, np.ascontiguousarray(pairs[part]).tobytes(), None) for k, part in _by(of)])

    counts = [StructField(c, LongType()) for c in ADDED[:3]]
    kept_schema = StructType([rows.schema["row"], *counts, StructField("kept_bytes", BinaryType())])

    def with_counts(table: pa.Table, columns: list[list]) -> pa.Table:
        out = table.select(["row"])
        for name, values in zip(ADDED, columns, strict=True):
            out = out.append_column(name, pa.array(values, pa.binary() if name == "kept_bytes" else pa.int64()))
        return out

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return with_counts(left, [[]] * 4)
        own = Batch(left, right)
        own.keep_shared(right, buckets)
        _, first, runs = own.contexts()
        gone = np.zeros(len(own.data) + 1, bool)
        if len(runs):
            mask = np.zeros(len(first), np.int64)
            for tag, b in zip(right.column("tag").to_pylist(), right.column("body").to_pylist(), strict=True):
                if tag == HITS:
                    pairs = np.frombuffer(b, np.int64).reshape(-1, 2)
                    mask[pairs[:, 0]] = pairs[:, 1]
            ids = own.doc_ids()
            later = ids[own.doc] > ids[own.doc[first]][runs]  # the run's first document in this batch is smaller
            bits = np.where(later, -1, mask[runs])
            step = np.zeros(len(own.data) + LENGTH + 1, np.int32)
            for j in range(int((own.hi - own.lo).max()) + 1):
                at = own.lo[((bits >> j) & 1 == 1) & (own.lo + j <= own.hi)] + j
                np.add.at(step, at, 1)
                np.add.at(step, at + LENGTH, -1)
            gone = np.cumsum(step)[: len(own.data) + 1] > 0
        n = len(own.ids)
        removed, spans, kept = [0] * n, [0] * n, list(own.texts)
        for i in range(n):
            if own.copy[i] and len(own.texts[i]) >= LENGTH:
                removed[i], spans[i], kept[i] = len(own.texts[i]), 1, b""
        data = np.frombuffer(own.data, np.uint8)
        for i, a, b in zip(own.rows, own.starts.tolist(), own.ends.tolist(), strict=True):
            mark = gone[a:b]
            if mark.any():
                removed[i], spans[i], kept[i] = int(mark.sum()), int(mark[0]) + int((mark[1:] & ~mark[:-1]).sum()), data[a:b][~mark].tobytes()
        return with_counts(left, [[len(x) for x in own.texts], removed, spans, kept])

    def with_batch(notes: DataFrame, work, schema) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = work(left, right)
            give_back()  # a batch's arrays are large, and workers wait beside other stages
            return out

        return rows.groupBy("batch").cogroup(notes.groupBy("batch")).applyInArrow(run, schema)

    def by_bucket(notes: DataFrame, work) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            out = work(table)
            give_back()
            return out

        return notes.groupBy("number").applyInArrow(run, NOTES)

    repeated = copies.unionByName(by_bucket(with_batch(copies, names, NOTES), shared))
    found = by_bucket(with_batch(repeated, windows, NOTES), hits)
    return with_batch(repeated.unionByName(found), remove, kept_schema)


def kept_text(data: bytes) -> str:
    """Removed runs may cut a character; its remaining bytes go."""
    return data.decode("utf-8", "ignore")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """Documents with the repeated bytes removed from their texts, with all their columns; texts that nothing is left of stay as empty ones, and so do null ones."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array([kept_text(x) for x in b.column("text").to_pylist()], pa.string()))

    left = judged(docs, "doc_id", "text")
    text = F.col("kept_bytes").alias("text")
    return left.select(*[text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]).mapInArrow(decode, docs.schema)
