"""Bitmaps of fixed size over 64-bit keys, to let most rows without a partner go before a shuffle.

A bitmap has 2**BITS bits whatever the input, so it may be broadcast. Once many
keys are in it, it lets more through; the join behind it decides in any case.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS = 24
_PIECES = 8


def places(keys: np.ndarray) -> np.ndarray:
    """Bits of 64-bit keys."""
    return (keys.astype(np.int64).view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)


def build(keys: DataFrame) -> np.ndarray:
    """The packed bits of the one column (long hashes, no nulls) of ``keys``."""
    size = (1 << BITS) // _PIECES

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITS, bool)
        for batch in batches:
            bits[places(batch.column(0).to_numpy(zero_copy_only=False))] = True
        parts = [(i, zlib.compress(np.packbits(bits[i * size : (i + 1) * size]).tobytes(), 1)) for i in range(_PIECES) if bits[i * size : (i + 1) * size].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=["piece", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bits = np.frombuffer(zlib.decompress(part), np.uint8)
                found[i] = found[i] | bits if i in found else bits
        for i, bits in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["piece", "bits"])

    kind = "piece int, bits binary"
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for x in keys.mapInArrow(mark, kind).repartition(_PIECES, "piece").mapInArrow(join, kind).toLocalIterator():
        at = x["piece"] * size // 8
        out[at : at + size // 8] |= np.frombuffer(zlib.decompress(x["bits"]), np.uint8)
    return out
