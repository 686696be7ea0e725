"""Bit arrays that pick rows before anything is shuffled by their keys.

An array has about EACH bits for each key, so that few others seem to be in it, and MOST_BITS at most, which bounds what is broadcast. Beyond
that more rows pass, and the joins behind it see them: this costs their shuffle, and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**28 bits are 32 MB.
EACH, LEAST_BITS, MOST_BITS = 8, 1 << 16, 1 << 28
#: Bits that are put together in one task.
SEGMENT = 1 << 16


def marked(keys: DataFrame) -> np.ndarray:
    """The array with a bit for each value of `key`, 64-bit hashes in a stored table."""
    bits = max(LEAST_BITS, min(MOST_BITS, 1 << (EACH * keys.count()).bit_length()))
    segments = bits // SEGMENT

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            places = batch.column(0).to_numpy()
            for s in np.unique(places // SEGMENT).tolist():
                own = parts.setdefault(s, np.zeros(SEGMENT, bool))
                own[places[places // SEGMENT == s] % SEGMENT] = True
        data = [np.packbits(p, bitorder="little").tobytes() for p in parts.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array(data, pa.binary())], names=["s", "data"])

    place = F.col("key").bitwiseAND(F.lit(bits - 1)).alias("p")
    dealt = keys.select(place).repartition(min(segments, 200), F.floor(F.col("p") / SEGMENT))
    out = np.zeros(bits // 8, np.uint8)
    for r in dealt.mapInArrow(build, "s bigint, data binary").collect():  # MOST_BITS bits at most
        out[r.s * SEGMENT // 8 : (r.s + 1) * SEGMENT // 8] = np.frombuffer(r["data"], np.uint8)
    return out


def is_marked(array: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the array may hold each key; never false for one it holds."""
    p = keys.astype(np.int64, copy=False) & (len(array) * 8 - 1)
    return (array[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
