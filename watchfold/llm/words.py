"""Words of whole texts as flat arrays, for use inside tasks.

A word is a maximal run of bytes other than space and 0x09 to 0x0D. Texts come as one Arrow column, so
the UTF-8 bytes of many rows are hashed in one pass without building a Python string per word.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BLOCK = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128-bit digest of a row's id and text, nulls told apart from empty values."""
    number = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(number, F.when(F.col(text).isNull(), ".").otherwise(":"),
                                  F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("binary")))


def worker_store() -> types.ModuleType:
    """A place that lives as long as the Python worker, so that tasks share tables and caches."""
    return sys.modules.setdefault("_watchfold_worker_store", types.ModuleType("_watchfold_worker_store"))


def kept(name: str, make: Callable):
    """The worker's object of this name, made on first use."""
    store = worker_store()
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = getattr(worker_store(), "powers", None)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK)
        up = np.full(size, BASE, dtype=U64)
        down = np.full(size, pow(BASE, -1, 1 << 64), dtype=U64)
        up[0] = down[0] = 1
        have = (np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64))
        if n <= BLOCK:
            worker_store().powers = have
    return have


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def runs_of_rows(offsets: np.ndarray, most: int = 2 * BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer row stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of the first word of each row (rows + 1 values)."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of every word: a polynomial of its bytes, mixed. Works block by block in bounded memory."""
    out = np.empty(len(starts), dtype=U64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, side="right")))
        low = starts[at]
        block = data[low:ends[to - 1]]
        if lower:
            block = _LOWER[block]
        up, down = _powers(len(block) + 1)
        sums = np.zeros(len(block) + 1, dtype=U64)
        np.cumsum((block.astype(U64) + U64(1)) * up[:len(block)], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        at = to
    return out


def hash_windows(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of every ``width`` consecutive values; windows that cross a row are for the caller to leave out."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    step = U64((BASE * (2 * seed + 3)) & 0xFFFFFFFFFFFFFFFF | 1)
    out = np.full(n, seed + 1, dtype=U64)
    for i in range(width):
        out = out * step + words[i:i + n]
    return mix(out)


def hash_spans(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the word sequence of every span [start, end), whatever its length, from prefix sums."""
    up, down = _powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=U64)
    np.cumsum(words * up[:len(words)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))
