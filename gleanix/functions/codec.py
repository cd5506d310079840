"""Byte-aligned unary and Elias gamma codes of posting lists."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, LongType


def unary_size(tf: str | Column) -> Column:
    """Bytes of a term frequency: as many as hold tf bits, and one more where they are just full."""
    return F.floor(F.col(tf) / 8).cast("bigint") + 1 if isinstance(tf, str) else F.floor(tf / 8).cast("bigint") + 1


def gamma_size(gap: str | Column) -> Column:
    """Bytes of a gap g >= 1: L ones, a zero and the L low bits of g, L = floor(log2 g)."""
    gap = F.col(gap) if isinstance(gap, str) else gap
    return F.ceil((2 * (F.length(F.bin(gap)) - 1) + 1) / 8).cast("bigint")


def _unary(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(codes laid end to end, bytes of each)."""
    if (values < 1).any():
        raise ValueError("unary codes need values of at least 1")
    size = values // 8 + 1
    ones = values - 1
    bits = np.zeros(8 * int(size.sum()), np.uint8)
    bits[_spread(8 * (np.cumsum(size) - size), ones)] = 1
    return np.packbits(bits, bitorder="little").tobytes(), size


def _gamma(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    if (values < 1).any():
        raise ValueError("gamma codes need values of at least 1")
    low = np.frexp(values.astype(np.float64))[1].astype(np.int64) - 1
    low -= np.left_shift(1, low) > values  # where the float was rounded up to a power of two
    size = (2 * low + 8) // 8
    start = 8 * (np.cumsum(size) - size)
    bits = np.zeros(8 * int(size.sum()), np.uint8)
    bits[_spread(start, low)] = 1
    at = _spread(start + low + 1, low)
    shift = np.repeat(low, low) - 1 - _spread(np.zeros_like(low), low)
    bits[at] = np.repeat(values, low) >> shift & 1
    return np.packbits(bits, bitorder="little").tobytes(), size


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... with n[i] numbers for each i."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def unary_encode(values: Iterable[int]) -> bytes:
    """tf - 1 ones and a zero, each value filled up to whole bytes; the lowest bit of a byte comes first."""
    return _unary(np.asarray(list(values), np.int64))[0]


def unary_decode(data: bytes) -> list[int]:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    out, at = [], 0
    while at < len(bits):
        ones = int(np.argmin(bits[at:]))
        out.append(ones + 1)
        at += 8 * ((ones + 1) // 8 + 1)
    return out


def gamma_encode(values: Iterable[int]) -> bytes:
    return _gamma(np.asarray(list(values), np.int64))[0]


def gamma_decode(data: bytes) -> list[int]:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    out, at = [], 0
    while at < len(bits):
        n = int(np.argmin(bits[at:]))
        g = 1
        for b in bits[at + n + 1 : at + 2 * n + 1]:
            g = g << 1 | int(b)
        out.append(g)
        at += 2 * n + 1
        at += -at % 8
    return out


def _over(f, kind: DataType):
    @F.pandas_udf(kind)
    def each(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(v) for v in values], dtype=object)

    return each


def _encoder(f):
    @F.pandas_udf(BinaryType())
    def each(lists: pd.Series) -> pd.Series:
        """All lists of a batch are coded at once and cut apart: a code fills whole bytes."""
        n = np.array([0 if v is None else len(v) for v in lists], np.int64)
        data, size = f(np.concatenate([np.zeros(0, np.int64), *(v for v in lists if v is not None)]).astype(np.int64))
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)]).astype(np.int64)].astype(np.int64)
        return pd.Series([None if v is None else data[i:j] for v, i, j in zip(lists, ends[:-1], ends[1:])], dtype=object)

    return each


encode_tfs = _encoder(_unary)
decode_tfs = _over(unary_decode, ArrayType(LongType()))
encode_gaps = _encoder(_gamma)
decode_gaps = _over(gamma_decode, ArrayType(LongType()))
