"""Bitmaps of hashes: a filter of bounded size that lets all wanted hashes through and few others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.plans.lineage import shuffle_partitions

#: Bits for each hash, in all at least 2**PIECE and at most 2**MOST; a task sends pieces of 2**PIECE bits.
EACH, PIECE, MOST = 16, 16, 30
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Filter:
    """Whether hashes may be among those that the bitmap was made of."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        place = places(hashes, self.bits)
        return (self.packed[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes.astype(np.uint64) * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


def bits_for(count: int) -> int:
    return min(MOST, max(PIECE, (count * EACH).bit_length()))


def filter_of(hashes: DataFrame, count: int) -> Filter:
    """The filter of the bigint column `hash`, about `count` values. Tasks send the pieces that they set bits in, which are
    joined task by task; the driver puts together at most 2**MOST bits."""
    bits = bits_for(count)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, np.ndarray] = {}
        for batch in batches:
            place = np.unique(places(batch.column(0).to_numpy().view(np.uint64), bits))
            cuts = np.flatnonzero(np.diff(place >> PIECE)) + 1
            for part in np.split(place, cuts):
                if len(part):
                    mine.setdefault(int(part[0] >> PIECE), np.zeros(1 << PIECE, bool))[part & ((1 << PIECE) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(mine), pa.int32()), pa.array([np.packbits(x).tobytes() for x in mine.values()], pa.binary())], names=["piece", "bits"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(blob.as_py(), np.uint8)
                mine[n] = mine[n] | part if n in mine else part
        yield pa.RecordBatch.from_arrays([pa.array(list(mine), pa.int32()), pa.array([x.tobytes() for x in mine.values()], pa.binary())], names=["piece", "bits"])

    schema, partitions, width = "piece int, bits binary", shuffle_partitions(hashes.sparkSession), 1 << (PIECE - 3)
    out = np.zeros(1 << (bits - 3), np.uint8)
    met = hashes.select("hash").mapInArrow(pieces, schema).repartitionById(partitions, F.col("piece") % partitions).mapInArrow(together, schema)
    for row in met.toLocalIterator():
        out[row["piece"] * width : (row["piece"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return Filter(bits, out)
