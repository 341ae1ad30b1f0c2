"""Vectorised tokenising of Arrow text columns.

Python sees no word here: a column's bytes are classified with a 256-entry
table, word borders come from shifted comparisons, and all words get 64-bit
hashes from one running sum. Work is done in blocks that end at word borders,
so memory follows the block and not the text, however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 20
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are runs of bytes that are none of space, tab, LF, VT, FF, CR.
WHITESPACE_WORDS = np.ones(256, bool)
WHITESPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False

#: Words are runs of ASCII digits, lower-case letters and bytes above 0x7F.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def _power(base: int, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK), base, dtype=U64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * BLOCK:
            _powers[name] = have
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after another, and their n+1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@dataclass
class Tokens:
    """Words of a run of texts: word i is ``data[starts[i]:ends[i]]``; text d has words ``first[d]`` to ``first[d+1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @cached_property
    def hashes(self) -> np.ndarray:
        return mix(self._sums())

    @cached_property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), self.counts)

    def _sums(self) -> np.ndarray:
        out, i, n = np.empty(len(self.starts), U64), 0, len(self.starts)
        while i < n:
            low = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, low + BLOCK, "right")))
            high = self.ends[j - 1]
            run = np.zeros(high - low + 1, U64)
            np.cumsum(_BYTE[self.data[low:high]] * _power(_BASE, "up", high - low), out=run[1:])
            out[i:j] = (run[self.ends[i:j] - low] - run[self.starts[i:j] - low]) * _power(_INVERSE, "down", high - low + 1)[self.starts[i:j] - low]
            i = j
        return out

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def tokenise(column: pa.Array, words: np.ndarray, lower: bool = True) -> Tokens:
    data, at = text_bytes(column)
    if lower:
        data = LOWER[data]
    inside = words[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[at[:-1][at[:-1] < n]] = False
        after[at[1:][at[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return Tokens(data, starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, at))


def sequence_hashes(hashes: np.ndarray, first: np.ndarray, k: int, whole_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words, and their n+1 offsets. A text of fewer words, but not none, has its whole sequence as one."""
    n = np.diff(first)
    runs = np.where(n >= k, n - k + 1, (n > 0) & whole_short)
    offsets = np.concatenate([[0], np.cumsum(runs)])
    begin = np.arange(offsets[-1]) - np.repeat(offsets[:-1], runs) + np.repeat(first[:-1], runs)
    length = np.repeat(np.minimum(n, k), runs)
    total = length.astype(U64) * U64(0xD1342543DE82EF95)
    padded = np.concatenate([hashes, np.zeros(k, U64)])
    for j in range(k):
        factor = U64(pow(0xAF251AF3B0F025B5, j + 1, 1 << 64))
        part = padded[begin + j] * factor
        total += np.where(length > j, part, U64(0)) if whole_short else part
    return mix(total), offsets


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in batches of about ``limit`` bytes of ``column``, one row at least."""
    held: list[pa.RecordBatch] = []
    size = count = 0
    for batch in batches:
        _, at = text_bytes(batch.column(column)) if batch.num_rows else (None, np.zeros(1, np.int64))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit - size, "right")) - 1) if not held or at[i + 1] - at[i] + size <= limit else i
            j = min(j, i + rows - count, batch.num_rows)
            if j > i:
                held.append(batch.slice(i, j - i))
                size, count, i = size + at[j] - at[i], count + j - i, j
            if i < batch.num_rows:
                yield _joined(held)
                held, size, count = [], 0, 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    table = pa.Table.from_batches(held).combine_chunks()
    return table.to_batches()[0]
