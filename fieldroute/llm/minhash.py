"""Near-duplicate detection by b-bit MinHash.

Every text becomes 384 minima over its distinct five-word shingles. Bands of
five full minima give candidates; four mixed bits of all minima, packed in
24 longs, give a collision-corrected similarity by bit counts; what passes is
confirmed on the full shingle sets.

Texts with one word sequence form a class and only its smallest id goes
further. A bucket is first compared with its smallest member only, then, where it
holds several components, with a few others in turn: that joins large families
without pairing them off. What is left is compared in cells of two blocks: only
pairs of different components that pass the bit count, there with 2048 more lanes,
leave a cell, each once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldroute.llm.components import components
from fieldroute.llm.recent import Recent, releasing
from fieldroute.session import cut, ship, shuffle_width

SHINGLE = 5
LANES, BITS = 384, 4
LONGS = LANES * BITS // 64
FINE_LANES = 2048
FINE_LONGS = FINE_LANES * BITS // 64
BAND_ROWS, BANDS = 5, 38
LEAST_PERCENT = 75
BLOCK_ROWS = 512
STAR_TURNS = 2
WORDS_BYTES = 48 << 20
#: Rows of one key that a task takes in a join, and the share of all rows from which on a key is dealt over all tasks.
HOT_ROWS, HOT_SHARE = 1 << 14, 10_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_RNG = np.random.default_rng(20_24)
_A = (_RNG.integers(0, 1 << 32, LANES, np.uint32) | np.uint32(1))[:, None]
_B = _RNG.integers(0, 1 << 32, LANES, np.uint32)[:, None]
_FINE_A = (_RNG.integers(0, 1 << 32, FINE_LANES, np.uint32) | np.uint32(1))[:, None]
_FINE_B = _RNG.integers(0, 1 << 32, FINE_LANES, np.uint32)[:, None]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _M1) ^ (b + (a >> np.uint64(29)))
    h = h * _M2
    return h ^ (h >> np.uint64(32))


def word_names() -> Recent:
    """64-bit names of words, for one task."""
    return Recent(WORDS_BYTES, lambda _: 32)


def _named(words: list[bytes]) -> list[int]:
    import xxhash

    return list(map(xxhash.xxh3_64_intdigest, words))


def shingles(words: list[bytes], known: Recent, n: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit names of the n-word shingles; of the whole sequence if it is shorter; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(known.look_up(words, _named), np.uint64)
    width = min(n, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out, h[i : len(words) - width + 1 + i])
    return np.unique(out)


def minima(names: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    x = (names ^ (names >> np.uint64(32))).astype(np.uint32)
    out, step = np.full(len(a), 0xFFFFFFFF, np.uint32), 1024 * LANES // len(a)
    for i in range(0, len(x), step):
        np.minimum(out, (a * x[None, i : i + step] + b).min(1), out=out)
    return out


def _bands(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(BAND_ROWS):
        key = _mix(key, rows[:, i])
    return key.view(np.int64)


def _packed(least: np.ndarray) -> np.ndarray:
    # All bits of a minimum go into the four kept: its own low bits follow from the shingle's low bits alone.
    lanes = ((least * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint64).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(lanes, 1).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    known = word_names()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            n, group, sig, bands = [], [], [], []
            for text in part.column(1).to_pylist():
                words = (text or b"").lower().split()  # bytes.lower changes A-Z only, bytes.split knows the six spaces only
                names = shingles(words, known)
                n.append(len(names))
                if len(names):
                    least = minima(names)
                    group.append(hashlib.sha256(b" ".join(words)).digest()[:16])
                    sig.append(_packed(least))
                    bands.append(_bands(least))
                else:
                    group.append(None)
                    sig.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(group, pa.binary()), pa.array(sig, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "same", "sig", "bands"])


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    import zstandard

    zip_ = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            words = [b" ".join((t or b"").lower().split()) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([hashlib.sha256(w).digest()[:16] for w in words], pa.binary()), pa.array([zip_(w) for w in words], pa.binary())], names=["node", "same", "words"])


def _sign_finely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unzip, known = zstandard.ZstdDecompressor().decompress, word_names()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            fine = [_packed(minima(shingles(unzip(w).split(), known), _FINE_A, _FINE_B)) for w in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fine, pa.list_(pa.int64()))], names=["node", "fine"])


def _confirm(least_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip, known = zstandard.ZstdDecompressor().decompress, word_names()
        last, own = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                keep = []
                for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if a != last:
                        last, own = a, shingles(unzip(a).split(), known)
                    other = shingles(unzip(b).split(), known)
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    keep.append(100 * both >= least_percent * (len(own) + len(other) - both))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(keep)), part.column(1).filter(pa.array(keep))], names=["a", "b"])

    return run


def _compare_blocks(need: int, need_fine: int):
    """Pairs of a cell that pass both bit counts, of different components, in the first bucket that both share: every pair comes out once."""
    low = np.uint64(0x1111111111111111)

    def agree(sig: np.ndarray, own: np.ndarray) -> np.ndarray:
        odd = sig ^ own
        odd |= odd >> np.uint64(1)
        odd |= odd >> np.uint64(2)
        return 16 * sig.shape[1] - np.bitwise_count(odd & low).sum(1, dtype=np.int64)

    def run(cell: pa.Table) -> pa.Table:
        wide = lambda name, n: cell.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, n)
        sig, fine, bands = wide("sig", LONGS), wide("fine", FINE_LONGS), wide("bands", BANDS)
        node, root, own = (cell.column(c).to_numpy() for c in ("node", "root", "own"))
        bucket = cell.column("bucket")[0].as_py()
        i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        rows, others = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = [], []
        for x in rows:
            near = others[(root[others] != root[x]) & (node[others] > node[x])] if i == j else others[root[others] != root[x]]
            near = near[agree(sig[near], sig[x]) >= need]
            near = near[agree(fine[near], fine[x]) >= need_fine]
            same = bands[near] == bands[x]
            near = near[bands[x][same.argmax(1)].view(np.int64) == bucket]
            a.append(np.minimum(node[near], node[x]))
            b.append(np.maximum(node[near], node[x]))
        empty = [np.zeros(0, np.int64)]
        return pa.table({"a": np.concatenate(a or empty), "b": np.concatenate(b or empty)})

    return run


def matches(x: str, y: str):
    """Lanes whose low bits agree, counted in the packed longs."""
    total = F.lit(0)
    for i in range(LONGS):
        odd = F.get(F.col(x), F.lit(i)).bitwiseXOR(F.get(F.col(y), F.lit(i)))
        odd = odd.bitwiseOR(F.shiftrightunsigned(odd, 1))
        odd = odd.bitwiseOR(F.shiftrightunsigned(odd, 2))
        total = total + (16 - F.bit_count(odd.bitwiseAND(F.lit(0x1111111111111111))))
    return total


def least_matches(least_percent: int = LEAST_PERCENT, lanes: int = LANES) -> int:
    """Matching lanes, collision-corrected, that a pair at the threshold reaches but for 3 in 100 000 (4 deviations): no more than the bands miss there."""
    c = 2.0**-BITS + (1 - 2.0**-BITS) * least_percent / 100
    return int(lanes * c - 4 * (lanes * c * (1 - c)) ** 0.5)


def with_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Left join with the one row a key of ``groups``, whose column n counts the key's rows; read from a written table.

    At most HOT_SHARE keys have more than that share of all rows, so their row of ``groups`` is broadcast and their
    rows are dealt over all tasks; so are rows without a key. The other keys meet in a shuffle.
    """
    named = [c for c in groups.columns if c != key]
    total = groups.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") > max(HOT_ROWS, total / HOT_SHARE)
    hot = groups.where(is_hot).select(key, F.struct(*named).alias("_hot"))
    cold = groups.where(~is_hot).select(key, F.lit(0).cast("long").alias("_salt"), F.struct(*named).alias("_cold"))
    dealt = F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(shuffle_width(rows.sparkSession))))
    both = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", dealt).join(cold, [key, "_salt"], "left")
    found = F.coalesce("_hot", "_cold")
    return both.select(*rows.columns, *[found[c].alias(c) for c in named])


def with_few(held: DataFrame, few: DataFrame) -> DataFrame:
    """Members joined with the one row a bucket of ``few``; both know the bucket's size n, by which it is dealt over several tasks."""
    width = F.ceil(F.col("n") / HOT_ROWS)
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), width - 1))).drop("n")
    return held.withColumn("_salt", F.pmod(F.xxhash64("node"), width)).join(copies, ["bucket", "_salt"]).drop("_salt")


def near_groups(docs: DataFrame, least_percent: int = LEAST_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Null texts, empty ones and those without words have no shingle and are their own
    component. A null id links with nothing: component_id null, kept true.
    Rows that repeat one id are one document, which has the links of the text whose digest is the
    least of them; each is marked kept if the id is its component's smallest. An empty table
    gives an empty result. Other columns are ignored.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    signed = cut(texts.mapInArrow(releasing(_sign), "doc_id long, n_shingles long, same binary, sig array<long>, bands array<long>"), "signatures")
    linked = signed.where("same is not null and doc_id is not null")
    classes = linked.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    reps = linked.groupBy("same").agg(F.min("doc_id").alias("node"), F.min_by("sig", "doc_id").alias("sig"), F.min_by("bands", "doc_id").alias("bands"))
    reps = cut(reps.groupBy("node").agg(F.min("same").alias("same"), F.min_by("sig", "same").alias("sig"), F.min_by("bands", "same").alias("bands")), "representatives")
    members = reps.select("node", F.explode("bands").alias("bucket"))
    buckets = cut(members.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    members = cut(with_groups(members, buckets, "bucket").where("n > 1"), "buckets")
    sigs = reps.select("node", "sig")
    words = texts.where("doc_id is not null").mapInArrow(_compress, "node long, same binary, words binary")
    words = words.join(reps.join(members.select("node").distinct(), "node", "left_semi").select("node", "same"), ["node", "same"], "left_semi").dropDuplicates(["node", "same"])
    words = cut(words.drop("same"), "words")
    need = least_matches(least_percent)

    def confirmed(pairs: DataFrame) -> DataFrame:
        full = pairs.join(words.select(F.col("node").alias("b"), F.col("words").alias("words_b")), "b").join(words.select(F.col("node").alias("a"), F.col("words").alias("words_a")), "a")
        return full.select("a", "b", "words_a", "words_b").mapInArrow(_confirm(least_percent), "a long, b long")

    def passing(pairs: DataFrame) -> DataFrame:
        full = pairs.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b").join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
        return cut(full.where(matches("sig_a", "sig_b") >= need).select("a", "b"), "pairs")

    # Each member with its bucket's smallest.
    tried = passing(members.where("node > leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    roots = cut(components(cut(confirmed(tried), "links")), "roots")

    def mixed(among: DataFrame) -> DataFrame:
        """Members, with their components, of buckets that hold several; a bucket of one component never comes back."""
        held = among.select("bucket", "node", "n").join(roots, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
        several = held.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("n").alias("n")).where("lo < hi").select("bucket", "n")
        return cut(with_few(held, several), "mixed")

    def merged(links: DataFrame) -> DataFrame:
        """Components after more links; only the roots they touch are joined anew."""
        root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        touched = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        new = components(touched).select(F.col("node").alias("old"), F.col("root").alias("new"))
        moved = roots.join(new, roots["root"] == new["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
        fresh = new.join(roots, new["old"] == roots["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
        return cut(moved.unionByName(fresh), "roots")

    # Then with other members, as long as that joins components.
    held = mixed(members)
    for turn in range(STAR_TURNS):
        leaders = held.groupBy("bucket").agg(F.min_by(F.struct("node", "root"), F.xxhash64("node", "bucket", F.lit(turn))).alias("x"), F.max("n").alias("n"))
        leaders = leaders.select("bucket", "n", F.col("x.node").alias("x"), F.col("x.root").alias("root_x"))
        pairs = with_few(held, leaders).where(F.col("root") != F.col("root_x"))
        pairs = pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        pairs = passing(pairs)
        links = cut(confirmed(pairs), "links")
        tried = tried.unionByName(pairs)
        if not links.take(1):
            break
        roots = merged(links)
        held = mixed(held)

    # What is left in buckets with several components: cells of two blocks, each pair of blocks once.
    held = held.withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    fine = cut(words.join(held.select("node").distinct(), "node", "left_semi").mapInArrow(_sign_finely, "node long, fine array<long>"), "fine")
    held = held.join(reps.drop("same"), "node").join(fine, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = held.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "sig", "fine", "bands")
    pairs = cells.groupBy("bucket", "i", "j").applyInArrow(_compare_blocks(need, least_matches(least_percent, FINE_LANES)), "a long, b long").join(tried, ["a", "b"], "left_anti")
    links = cut(confirmed(cut(pairs, "pairs")), "links")
    if links.take(1):
        roots = merged(links)

    rooted = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("same", "n", F.coalesce("root", "rep").alias("component"))
    named = with_groups(signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("same")).alias("same")), cut(rooted, "classes"), "same")
    component = F.coalesce("component", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """Documents of which one of each near-duplicate group stays: the smallest doc_id, with every row and column it has. Rows without an id stay."""
    gone = near_groups(docs).where("not kept").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(gone, "id", "left_anti").select("row.*")
