"""Memory of tasks: a cache for values that follow from their key alone, bounded in bytes, and giving memory back.

A cache belongs to the task that makes it: it dies with the task's iterator, so
that reused Python workers hold none while they wait. What it took goes back to
the system, since other stages of an executor run beside workers that wait.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Freed memory that allocators still hold, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The same task, which gives its memory back when it ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task

#: What a dict entry and the two objects' headers take beside their contents.
ENTRY_BYTES = 170


class Recent(dict):
    """When full, the values become the older half, which those in use leave again."""

    def __init__(self, most_bytes: int, size: Callable = len):
        super().__init__()
        self.half, self.size = most_bytes // 2, size
        self.room, self.old = self.half, {}

    def keep(self, keys, values) -> None:
        self.room -= ENTRY_BYTES * len(keys) + sum(map(len, keys)) + sum(map(self.size, values))
        if self.room < 0:
            self.room, self.old = self.half, {}
            self.old = dict(self)
            self.clear()
        self.update(zip(keys, values, strict=True))

    def look_up(self, keys: list, make_many: Callable) -> list:
        """The value of every key; ``make_many`` makes those of the distinct keys not met lately."""
        found = list(map(self.get, keys))
        if None in found:
            missing = list(dict.fromkeys(k for k, x in zip(keys, found, strict=True) if x is None))
            old = list(map(self.old.get, missing))
            new = [k for k, x in zip(missing, old, strict=True) if x is None]
            made = iter(make_many(new) if new else ())
            values = [next(made) if x is None else x for x in old]
            self.keep(missing, values)
            own = dict(zip(missing, values, strict=True))
            found = [own[k] if x is None else x for k, x in zip(keys, found, strict=True)]
        return found
