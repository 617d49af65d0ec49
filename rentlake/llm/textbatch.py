"""Texts of an Arrow batch as flat numpy arrays: bytes, words and their hashes.

A batch is cut into slices of about ``SLICE_BYTES`` of text (at least one row each), so the
memory of a task is bounded by the slice or the longest single text, not by the batch.
Words are runs of bytes other than the six ASCII white-space characters; a null text is
empty.  Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C17)  # 3 modulo 4
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MULTIPLIERS = np.random.default_rng(20).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_VALUES = np.random.default_rng(21).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; different values stay different."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The last column of this name (extra columns may repeat it in other cases)."""
    return batch.column(batch.schema.get_all_field_indices(name)[-1])


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets between them."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive rows with about ``size`` bytes of text."""
    for batch in batches:
        data, offsets = flat(column(batch, text))
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
            to = min(n, max(to, at + 1), at + 20_000)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run never crosses an offset."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(inside) + 1, bool)
    before[0], before[1:] = False, inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(len(inside) + 1, bool)
    after[-1], after[:-1] = False, inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hash`` takes any span."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power_tables(len(values) + 1)[0][: len(values)], out=sums[1:])
    return sums


def byte_prefix(data: np.ndarray) -> np.ndarray:
    return prefix_hash(_BYTE_VALUES[data])


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes in each span; equal bytes give equal hashes anywhere."""
    shift = _power_tables(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * shift[starts] + (ends - starts).astype(np.uint64) * _MULTIPLIERS[15])


def gram_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive hashes (len - k + 1 of them)."""
    n = max(0, len(hashes) - k + 1)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += hashes[i : i + n] * _MULTIPLIERS[i]
    return mix(total + np.uint64(k))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each row's words begin among them (n + 1)."""
    starts, ends = runs(~SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def owners(bounds: np.ndarray) -> np.ndarray:
    """Row number of each item, from the n + 1 bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sums_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between the bounds; 0 for an empty row."""
    total = np.zeros(len(values) + 1, np.result_type(values, np.int64) if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def keep_rows(docs: DataFrame, text: str, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The rows whose text is wanted, with all their columns; ``wanted`` takes (bytes, offsets)."""

    # plain names inside: a column may be called anything
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    name = f"c{docs.columns.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, name):
            yield rows.filter(pa.array(wanted(data, offsets)))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
