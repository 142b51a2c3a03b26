"""A set of 64-bit hashes as a bitmap of bounded size, for use as a filter.

A member's bit is always set; other hashes pass now and then, and more often as
the bitmap fills, so what passes must be checked exactly afterwards.  The size
follows the number of members up to ``MOST`` bits; beyond, more passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 30
_PART = 20


def bitmap(hashes: DataFrame, column: str, per_member: int = 32) -> np.ndarray:
    """Bits by the leading bits of the hashes in ``column``; executors build its parts."""
    n = hashes.count()
    size = min(MOST, max(_PART, int(n * per_member).bit_length()))
    bit = F.shiftrightunsigned(F.col(column), 64 - size)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column("bit").to_numpy()
            for part in np.unique(at >> _PART):
                own = at[at >> _PART == part] & ((1 << _PART) - 1)
                np.bitwise_or.at(parts.setdefault(int(part), np.zeros(1 << (_PART - 3), np.uint8)), own >> 3, np.left_shift(np.uint8(1), (own & 7).astype(np.uint8)))
        for part, bits in parts.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    rows = hashes.select(bit.alias("bit")).repartition(F.shiftright("bit", _PART)).mapInArrow(build, "part long, bits binary")
    out = np.zeros(1 << (size - 3), np.uint8)
    for part, bits in rows.toLocalIterator():
        out[part << (_PART - 3) : (part + 1) << (_PART - 3)] = np.frombuffer(bits, np.uint8)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the uint64 hashes may be members."""
    at = hashes >> np.uint64(64 - int(len(bits) * 8 - 1).bit_length())
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
