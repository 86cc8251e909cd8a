"""Whole documents to token ids with a file of the tokenizers library."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from string import punctuation
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldroute.llm.recent import Recent, releasing
from fieldroute.session import ship

SLICE_ROWS = 2048
WORDS_BYTES, PARTS_BYTES, MARKS_BYTES = 72 << 20, 24 << 20, 2 << 20
_LATIN = 0x250
_MARKS = punctuation.encode()
_WORD_PROBES = ("erer", "Erer.", "THE!!", "leau\u00e9,", "\u00c9t\u00e9", "\u00f1o***", "\u0130x", "a", "z\u00df;")
_TEXT_PROBES = (" the cat\n\nsat.  on\tit ", "Of of\x0b the , x 12 3\r\n", "\u00e9t\u00e9 \u00c9 a.b c")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 is itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class WordIds:
    """Ids, as bytes of ``dtype``, of texts; words met lately are remembered.

    Where probes show that the tokenizer drops white space, so that no token spans two
    words, a text's ids are its words' ids one after another; else texts are encoded whole. Where
    probes show that it also lower-cases and splits letters from marks, a word of
    letters and trailing ASCII marks is the ids of both parts, and letters
    already met in another case or before other marks are not encoded again.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.dtype = id_type(self.tokenizer.get_vocab_size(True))
        self.letters = byte_letters()
        self.words, self.parts, self.marks = Recent(WORDS_BYTES), Recent(PARTS_BYTES), Recent(MARKS_BYTES)
        self.by_words, self.by_parts = True, False
        self.by_words = all(b"".join(self._make([w.encode() for w in t.split()])) == self._whole([t])[0] for t in _TEXT_PROBES)
        try:
            self.by_parts = True
            self.by_parts = all(self._make([w.encode()]) == self._whole([w]) for w in _WORD_PROBES)
        except Exception:  # a model without single-word tokenising
            self.by_parts = False

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, parts: list[bytes]) -> list[bytes]:
        kind, tokenise = "H" if self.dtype.itemsize == 2 else "I", self.tokenizer.model.tokenize
        spelt = [p.decode() if p.isascii() else "".join([self.letters[b] for b in p]) for p in parts]
        return [array(kind, [t.id for t in tokenise(x)]).tobytes() for x in spelt]

    @staticmethod
    def _small(core: bytes) -> bytes | None:
        """The lower-cased letters of a word without its marks; none for words of another shape or of letters beyond Latin."""
        if core.isalpha():  # ASCII letters
            return core.lower()
        letters = core.decode()
        if not letters.isalpha() or max(letters) >= chr(_LATIN) or not is_normalized("NFC", letters):
            return None
        small = letters.lower()
        return small.encode() if len(small) == len(letters) else None  # not so: a letter that becomes a letter and a mark

    def _make(self, words: list[bytes]) -> list[bytes]:
        if not self.by_parts:
            return self._whole([w.decode() for w in words])
        cores = [w.rstrip(_MARKS) for w in words]
        small = list(map(self._small, cores))
        parts = iter(self.parts.look_up([x for x in small if x is not None], self._letters))
        tails = [None if x is None else w[len(c) :] for w, c, x in zip(words, cores, small, strict=True)]
        marks = iter(self.marks.look_up([t for t in tails if t], lambda new: self._whole([m.decode() for m in new])))
        others = iter(self._whole([w.decode() for w, t in zip(words, tails, strict=True) if t is None]))
        return [next(others) if t is None else next(parts) + next(marks) if t else next(parts) for t in tails]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        if not self.by_words:
            return self._whole([(t or b"").decode() for t in texts])
        split = [(t or b"").split() for t in texts]
        ids, out, at = self.words.look_up([w for s in split for w in s], self._make), [], 0
        for n in map(len, split):
            out.append(b"".join(ids[at : at + n]))
            at += n
        return out


    def encode_column(self, texts: pa.Array, end: bytes) -> pa.Array:
        """Ids of each text of a binary column, null as an empty one, and ``end`` after them.

        Words are split and told apart by Arrow, so that each different one of the column is looked up
        once, and the ids of a text are gathered by its words' numbers.
        """
        if not self.by_words:
            return pa.array([x + end for x in self.encode(texts.to_pylist())], pa.binary())
        split = pc.ascii_split_whitespace(pc.fill_null(texts, b"").view(pa.string()))
        words = split.flatten().dictionary_encode()
        known = words.dictionary.view(pa.binary()).to_pylist()
        # Nothing stands before the first or after the last white space.
        ids = iter(self.words.look_up([w for w in known if w], self._make))
        values = pa.array([*(next(ids) if w else b"" for w in known), end], pa.binary())
        ends = split.offsets.to_numpy()[1:].astype(np.int64)
        order = np.insert(words.indices.to_numpy(), ends, len(known))
        gathered = values.take(pa.array(order))
        at = np.frombuffer(gathered.buffers()[1], np.int32)[: len(order) + 1]
        offsets = np.append(np.int32(0), at[ends + np.arange(1, len(ends) + 1)])
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), gathered.buffers()[2]])


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


def load(path: str):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return Tokenizer.from_file(path)


def vocabulary_size(path: str) -> int:
    return load(path).get_vocab_size(True)


def flat(column: pa.Array, dtype: np.dtype = np.dtype(np.uint8)) -> tuple[np.ndarray, np.ndarray]:
    """The contents of a binary column end to end, and the end of each value, in items of ``dtype``."""
    if not len(column):
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), dtype), (offsets[1:] - offsets[0]) // dtype.itemsize


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary, the smallest unsigned width that holds the vocabulary) and chunk (the input split).

    ``end_id`` ends every document, so a null or empty text is that id alone.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, chunk = WordIds(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], known.dtype).tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                ids = known.encode_column(part.column(1), end)
                n = pc.divide(pc.binary_length(ids).cast(pa.int64()), known.dtype.itemsize)
                yield pa.RecordBatch.from_arrays([part.column(0), n, ids, pa.array([chunk] * len(ids), pa.int32())], names=["doc_id", "n_tokens", "ids", "chunk"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(releasing(run), "doc_id long, n_tokens long, ids binary, chunk int")
