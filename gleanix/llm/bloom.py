"""Two Bloom filters, of hashes seen and of hashes seen again, built in parts and merged."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the bits of a segment, the unit in which filters are shuffled and merged.
SEGMENT = 20
#: log2 of the most bits of a filter: 128 MB, the proven bound of what is broadcast.
MOST = 30
HASHES = 3


def n_slices(n: int, bits_per_row: int = 16, most: int = MOST) -> int:
    """Filters that ``n`` hashes need, of at most ``2**most`` bits each."""
    return max(1, -(-n * bits_per_row // (1 << most)))


def filter_bits(n: int, bits_per_row: int = 16, most: int = MOST) -> int:
    """log2 of the size of a filter of ``n`` hashes."""
    return min(most, max(SEGMENT, int(np.ceil(np.log2(max(1, n) * bits_per_row)))))


def _positions(h: np.ndarray, log_bits: int) -> np.ndarray:
    """HASHES bit positions of each 64-bit hash, all in the hash's one segment; shape (HASHES, n)."""
    h = h.astype(np.uint64)
    mask, low = np.uint64((1 << SEGMENT) - 1), np.uint64(64 - SEGMENT)
    with np.errstate(over="ignore"):
        segment = ((h * np.uint64(0xD6E8FEB86659FD93)) >> low >> np.uint64(2 * SEGMENT - log_bits)) << np.uint64(SEGMENT) if log_bits > SEGMENT else np.zeros_like(h)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        return np.stack([segment | (h >> np.uint64(SEGMENT * i + 2)) & mask for i in range(HASHES)])


def _parts(h: np.ndarray, log_bits: int) -> pa.RecordBatch:
    """A row a segment: the bits that the hashes set, and those that they set more than once."""
    at, counts = np.unique(_positions(h, log_bits), return_counts=True)
    segments, inner = (at >> np.uint64(SEGMENT)).astype(np.int32), (at & np.uint64((1 << SEGMENT) - 1)).astype("<u4")
    keys, starts = np.unique(segments, return_index=True)
    ends = [*starts[1:], len(at)]
    once = [inner[a:b].tobytes() for a, b in zip(starts, ends)]
    again = [inner[a:b][counts[a:b] > 1].tobytes() for a, b in zip(starts, ends)]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(once, pa.binary()), pa.array(again, pa.binary())], names=["segment", "once", "again"])


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


_SCHEMA = "segment INT, once BINARY, again BINARY"


def repeat_filter(hashes: DataFrame, n: int, most: int = MOST) -> tuple[np.ndarray, int]:
    """The filter of hashes seen more than once in the one bigint column of ``hashes``.

    Each partition makes its own two filters, as lists of the bits set in each
    segment; the lists of all partitions are merged by the task that owns the
    segment, never as one whole: a bit is seen again if it was in a partition,
    or is set by two of them.  The driver gets only the merged filter, of at
    most ``2**most`` bits.
    """
    log_bits = filter_bits(n, most=most)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b.column(0).drop_null().to_numpy(zero_copy_only=False))
            size += len(held[-1])
            if size > 2_000_000:
                yield _parts(np.concatenate(held), log_bits)
                held, size = [], 0
        if size:
            yield _parts(np.concatenate(held), log_bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for segment, once, again in zip(*(c.to_pylist() for c in b.columns)):
                o, a = parts.setdefault(segment, (np.zeros(1 << (SEGMENT - 3), np.uint8), np.zeros(1 << (SEGMENT - 3), np.uint8)))
                at = np.frombuffer(once, "<u4").astype(np.int64)
                _set(a, np.frombuffer(again, "<u4").astype(np.int64))
                _set(a, at[_has(o, at)])
                _set(o, at)
        packed = [zlib.compress(a.tobytes(), 1) for _, a in parts.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(packed, pa.binary())], names=["segment", "again"])

    segments = max(1, 1 << (log_bits - SEGMENT))
    merged = hashes.mapInArrow(build, _SCHEMA).repartition(min(segments, 64), "segment").mapInArrow(merge, "segment INT, again BINARY")
    bits = np.zeros(1 << (log_bits - 3), np.uint8)
    width = 1 << (SEGMENT - 3)
    for r in merged.toLocalIterator():
        bits[r.segment * width : (r.segment + 1) * width] = np.frombuffer(zlib.decompress(r.again), np.uint8)
    return bits, log_bits


def possibly_repeated(df: DataFrame, column: str, bits: np.ndarray, log_bits: int) -> Column:
    """Whether a bigint column's value may occur more than once; false is certain.  Null gives false."""
    shared = df.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        bits = shared.value
        at = _positions(h.to_numpy(np.int64), log_bits).astype(np.int64)
        hit = np.ones(len(h), bool)
        for row in at:
            hit &= _has(bits, row)
        return pd.Series(hit)

    # nulls would turn the whole numbers of a batch into floats
    return F.col(column).isNotNull() & test(F.coalesce(column, F.lit(0).cast("bigint")))
