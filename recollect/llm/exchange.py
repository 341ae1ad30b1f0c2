"""Packed exchanges: columns of integers travel as compressed blobs, keyed by a part.

A map task sends one row for each part it has something for, not one for each
word or pair; the receiving task gets all rows of a part together, and works
on arrays. Parts are as many as the session's shuffle partitions, so a part
keeps its size as data and cluster grow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "part long, kind int, source long, data array<binary>"
_ARROW = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("source", pa.int64()), ("data", pa.list_(pa.binary()))])
Row = tuple[int, int, list[bytes]]


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers: their bytes by significance, compressed."""
    x = np.ascontiguousarray(x, dtype="<i8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(x).to_bytes(8, "little") + bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), blob[8]
    planes = np.frombuffer(pa.decompress(blob[9:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").ravel()


def pack_hashes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def unpack_hashes(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def pack_doubles(x: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(x, "<f8")
    return len(raw).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpack_doubles(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], n * 8, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<f8").ravel()


def batches(rows: Iterable[tuple[int, int, int, list[bytes]]], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(len, row[3]))
        if size >= limit:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def meet(rows: DataFrame, parts: int, work: Callable[[int, list[Row]], Iterable], schema: str = SCHEMA, to: Callable = batches) -> DataFrame:
    """Calls ``work(part, [(kind, source, data), ...])`` for each part, its rows ordered by kind and source."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator:
            for part, own in by_part(given):
                yield from work(part, own)

        yield from to(results())

    return rows.repartition(parts, "part").sortWithinPartitions("part", "kind", "source").mapInArrow(run, schema)


def by_part(given: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[Row]]]:
    at, held = None, []
    for batch in given:
        part, kind, source, data = (batch.column(c) for c in ("part", "kind", "source", "data"))
        for i in range(batch.num_rows):
            p = part[i].as_py()
            if p != at and held:
                yield at, held
                held = []
            at = p
            held.append((kind[i].as_py(), source[i].as_py(), data[i].as_py()))
    if held:
        yield at, held


def dealt(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by part, and where each part begins in it."""
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))
