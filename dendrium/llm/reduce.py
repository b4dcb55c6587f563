"""Arrays of fixed size that are made from a whole corpus: histograms and bitmaps, summed in parts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendrium.llm.common import lean

#: Counters in a part of a histogram, bits in a part of a bitmap, and parts that one task adds up.
PART, BIT_PART, FAN_IN = 1 << 14, 1 << 17, 1000


def parts_of(histogram: np.ndarray):
    """An Arrow batch (part, counts) with the parts of a histogram that are not zero."""
    import pyarrow as pa

    rows = histogram.astype("<u4").reshape(-1, PART)
    live = np.flatnonzero(rows.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array([rows[i].tobytes() for i in live], pa.binary())], names=["part", "counts"])


def added(parts: DataFrame, tasks: int, size: int) -> np.ndarray:
    """The sum of all parts (part int, counts binary) that so many tasks have made. At most FAN_IN tasks' parts are added
    up in one place; what comes to the driver is one histogram at the end."""

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
                new = np.frombuffer(counts.as_buffer(), "<u4").astype(np.uint64)
                sums[part] = sums[part] + new if part in sums else new
        if sums:
            capped = [np.minimum(x, 2**32 - 1).astype("<u4").tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(capped, pa.binary())], names=["part", "counts"])

    n_parts = size // PART
    while True:
        salts = -(-tasks // FAN_IN)
        salted = parts.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(salts)))
        parts = salted.repartition(n_parts * salts, "part", "salt").select("part", "counts").mapInArrow(lean(add), "part int, counts binary")
        if salts == 1:
            break
        tasks = salts
    out = np.zeros((n_parts, PART), np.uint64)
    for r in parts.collect():
        out[r.part] += np.frombuffer(r.counts, "<u4")
    return out.reshape(-1)


class Bitmap:
    """Which of a set of 64-bit hashes may be present; false positives only."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h & np.uint64(len(self.bits) * 8 - 1)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap(hashes: DataFrame, column: Column, count: int, most: int = 1 << 27) -> Bitmap:
    """Of a column of 64-bit hashes of which there are about count: 16 bits each, at most `most` bits (16 MB). With more
    hashes it keeps more than it should, up to everything; callers join with the hashes where that matters."""
    size = min(most, max(BIT_PART, 1 << (16 * max(1, count) - 1).bit_length()))

    def gather(batches):
        import pyarrow as pa

        found: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column("at").to_numpy()
            part = at // BIT_PART
            for p in np.unique(part).tolist():
                found.setdefault(p, np.zeros(BIT_PART, bool))[at[part == p] % BIT_PART] = True
        for p, bits in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    at = hashes.select(column.bitwiseAND(F.lit(size - 1)).alias("at"))
    made = at.repartition(max(1, min(size // BIT_PART, 64)), F.floor(F.col("at") / BIT_PART)).mapInArrow(lean(gather), "part long, bits binary")
    out = np.zeros((size // BIT_PART, BIT_PART // 8), np.uint8)
    for r in made.collect():
        out[r.part] |= np.frombuffer(r.bits, np.uint8)
    return Bitmap(out.reshape(-1))
