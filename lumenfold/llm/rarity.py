"""How often the elements of bags occur, for those that are frequent."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.words import Bags

#: An element is heavy if at least one in so many texts has it. At most HEAVY times the
#: mean number of words of a text are heavy, whatever the number of texts.
HEAVY = 1000
#: Steps of a squared weight for each doubling of rarity, and the largest weight, which has WEIGHT_BITS bits.
STEPS, WEIGHT_BITS = 1.5, 4


Heavy = tuple[np.ndarray, np.ndarray, int]


def heavy_terms(texts: DataFrame, text: str) -> Heavy:
    """Hashes, sorted, and counts of the elements found in at least a 1/HEAVY of the texts, and the number of texts.

    An element that is so frequent over all texts is so in some partition; the counts are lower bounds.
    """
    found = texts.select(F.lit(None).cast("int").alias("id"), text).mapInArrow(surveyed, "id int, term long, n long")
    return heaviest(found, texts.count())


def surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, text): (id, term, null) with the signature of each text that has words and an id, and in the end (null, term,
    n) for the elements that at least a 1/HEAVY of the texts have."""
    hashes, found, seen, kind = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, pa.null()
    for batch in batches:
        seen += batch.num_rows
        ids, kind = batch.column(0), batch.column(0).type
        bags = Bags(batch.column(1).to_pylist())
        rows = np.flatnonzero(bags.full & ids.is_valid().to_numpy(zero_copy_only=False))
        if len(rows):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(bags.signature[rows].view(np.int64)), pa.nulls(len(rows), pa.int64())], names=["id", "term", "n"])
        own, times = np.unique(bags.elements, return_counts=True)
        both, back = np.unique(np.concatenate((hashes, own[times > 1])), return_inverse=True)
        found = np.bincount(back, np.concatenate((found, times[times > 1])), len(both)).astype(np.int64)
        hashes = both
    keep = found * HEAVY >= seen
    if keep.any():
        yield pa.RecordBatch.from_arrays([pa.nulls(int(keep.sum()), kind), pa.array(hashes[keep].view(np.int64)), pa.array(found[keep])], names=["id", "term", "n"])


def heaviest(found: DataFrame, rows: int) -> Heavy:
    """The heavy terms of what `surveyed` finds in `rows` texts."""
    summed = found.where("id IS NULL").groupBy("term").agg(F.sum("n").alias("n"))
    table = summed.where(F.col("n") * HEAVY >= rows).toArrow()  # at most HEAVY times the mean number of words
    hashes, n = table.column("term").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order], rows


def times_found(elements: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts of the heavy ones among `elements`, 0 for the others."""
    if not len(hashes):
        return np.zeros(len(elements), np.int64)
    at = np.minimum(np.searchsorted(hashes, elements), len(hashes) - 1)
    return np.where(hashes[at] == elements, counts[at], 0)


def squared_weights(times: np.ndarray, rows: int) -> np.ndarray:
    """Squared weights of elements found `times` often: whole numbers of WEIGHT_BITS bits that grow with the logarithm of their rarity.

    Elements that are not heavy weigh alike, as if found in 1/HEAVY of the `rows`.
    """
    often = np.maximum(times, max(1.0, rows / HEAVY))
    return 1 + np.floor(STEPS * np.log2(np.maximum(1.0, rows / often))).astype(np.int64)


def heaviest_first(bags: Bags, heavy: Heavy) -> tuple[np.ndarray, np.ndarray]:
    """Order of the elements of all bags, of each bag the heaviest (rarest) first, and their squared weights in it.

    Equal counts go by the hash of the element, so the order is the same in every bag.
    """
    hashes, often, rows = heavy
    times = times_found(bags.elements, hashes, often)
    order = np.lexsort((bags.elements, times, bags.owner))
    return order, squared_weights(times[order], rows)


def shared_terms(n: int, agreement: float) -> int:
    """How many of its `n` elements a text at least shares with a partner that it agrees with."""
    return max(1, math.ceil(agreement * n - 1e-9))


def needs(bags: Bags, sums: np.ndarray, agreement: float) -> np.ndarray:
    """For each bag the least dot product with a partner that it agrees with: the squared weights of its lightest elements.

    sums: running sums, from 0 on, of the squared weights in the order of `heaviest_first`.
    """
    least = {n: shared_terms(n, agreement) if n else 0 for n in np.unique(bags.count).tolist()}
    end = bags.start + bags.count
    return sums[end] - sums[end - np.array([least[n] for n in bags.count.tolist()], np.int64)] if len(end) else np.zeros(0, np.int64)
