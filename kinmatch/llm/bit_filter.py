"""A set of hashes as a bit array of fixed size, for passing over what cannot match."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: 4 MB on every worker, whatever the number of keys.  More keys only let more rows pass.
BITS = 1 << 25
_CHUNK = 1 << 16


def _bitmap(t: pa.Table) -> pa.Table:
    bits = np.zeros(_CHUNK, dtype=bool)
    bits[t.column("at").to_numpy()] = True
    return pa.table({"chunk": t.column("chunk")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def bit_filter(keys: DataFrame, key: str, *, bits: int = BITS) -> np.ndarray:
    """The bits ``hash & (bits - 1)`` of the column ``key`` (long), as bytes; ``bits`` is a power of two from 65,536 on.

    Each task packs one chunk of 65,536 bits; the driver gets ``bits / 8`` bytes at most.
    """
    slot = F.col(key).bitwiseAND(F.lit(bits - 1))
    slots = keys.where(F.col(key).isNotNull()).select(slot.alias("s")).distinct()
    chunks = slots.select((F.col("s") / _CHUNK).cast("int").alias("chunk"), (F.col("s") % _CHUNK).cast("int").alias("at"))
    held = np.zeros(bits // 8, dtype=np.uint8)
    for r in chunks.groupBy("chunk").applyInArrow(_bitmap, "chunk int, bits binary").collect():
        held[r["chunk"] * (_CHUNK // 8) : (r["chunk"] + 1) * (_CHUNK // 8)] = np.frombuffer(r["bits"], dtype=np.uint8)
    return held


def passes(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) may be in the set."""
    slot = hashes & np.uint64(len(held) * 8 - 1)
    return (held[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
