"""Fixed-size counter arrays summed over a whole table, in compressed segments."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parchmint.llm.common import released

N_SEGMENTS = 64
SCHEMA = "segment int, counts binary"


def summed(rows: DataFrame, indexes: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """How often each index below 2**bits occurs in all rows, as int64 on the driver.

    Each task counts in an array of its own and sends compressed segments; a second stage adds
    each segment up as a stream. The size is fixed by bits, whatever the input.
    """
    size = 1 << bits
    part = size // N_SEGMENTS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(size, dtype=np.int32), [], 0
        for batch in batches:
            held.append(indexes(batch))
            n += len(held[-1])
            if n >= size // 2:
                add_counts(total, held)
                held, n = [], 0
        if held:
            add_counts(total, held)
        released()
        if total.any():
            yield from packed({k: total[k * part : (k + 1) * part] for k in range(N_SEGMENTS)})

    def add_counts(total: np.ndarray, held: list[np.ndarray]) -> None:
        at, k = np.unique(np.concatenate(held), return_counts=True)
        total[at] += k.astype(np.int32)

    def packed(segments: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, counts in segments.items():
            small = counts.astype(np.int32) if counts.max(initial=0) < 2**31 else counts
            small = small.astype(np.uint8) if small.max(initial=0) < 256 else small
            yield pa.RecordBatch.from_pydict({"segment": pa.array([k], pa.int32()), "counts": pa.array([bytes([small.itemsize]) + zlib.compress(small.tobytes(), 1)], pa.binary())})

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + unpacked(blob)
        yield from packed(total)

    out = np.zeros(size, dtype=np.int64)
    for k, blob in rows.mapInArrow(count, SCHEMA).repartition(N_SEGMENTS, "segment").mapInArrow(add, SCHEMA).collect():
        out[k * part : (k + 1) * part] += unpacked(bytes(blob))
    return out


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob[1:]), dtype={1: np.uint8, 4: np.int32, 8: np.int64}[blob[0]]).astype(np.int64)
