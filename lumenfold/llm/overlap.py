"""Records of evaluation splits that also stand in the training split: a weighted cosine join.

A text is a vector over its elements (word, occurrence); the squared weight of an element
grows with its rarity (`squared_weights`), so a dot product of two texts is the sum of the
squared weights of what they have in common. Two texts that agree have in common a share
of the elements of either, so their dot product is at least that of the lightest elements
of either that make up the share: the need of a text. Terms go into the inverted lists
heaviest first, until the squared norm of the rest is below the need, as a partner that
shares only the rest cannot reach it. Two texts that agree share an indexed term of both.

Every posting carries its text's need and the residual squared norm from its term on.
At the first term that two texts share nothing before is common, so the smaller residual
norm bounds their dot product; pairs that it keeps below a need are dropped. Before that,
the maximum residual norm and the least need of the other side of a list drop postings
that no partner there can save. A parity bitmap of the whole text bounds the common
elements from above. None of this loses a pair; what is left gets its exact dot product
and, for the agreement, the exact number of common elements.

Rarity comes from counts over all texts; only terms in at least 1/HEAVY of the texts
need a place in the order (`rarity`), which bounds what is broadcast. Lists with too many
postings are cut into tiles (`blocks`); exact copies are one vector a side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import blocks
from lumenfold.llm.neardup import agreeing
from lumenfold.llm.rarity import heaviest_first, heavy_terms, needs
from lumenfold.llm.words import Bags
from lumenfold.plans.lineage import cut

POSTING = np.dtype([("key", "<u4"), ("sig", "<u8"), ("low", "<u8"), ("high", "<u8"), ("n", "<u2"), ("need", "<u2"), ("rest", "<u2"), ("side", "u1")])
#: Larger numbers of words, needs and residual norms are not told apart, and nothing is dropped by them.
LARGEST = 65535


def postings(texts: DataFrame, side: str, text: str, agreement: float, heavy: Broadcast) -> DataFrame:
    """Packed postings of the texts; the integer column `side` is 1 for the training side."""
    buckets = blocks.bucket_count(texts)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            sides, bags = batch.column(0).to_numpy(), Bags(batch.column(1).to_pylist())
            if not bags.full.any():
                continue
            _, once = np.unique(bags.signature + sides.astype(np.uint64), return_index=True)
            wanted = np.zeros(len(sides), bool)
            wanted[once] = True
            wanted &= bags.full
            low, high = np.zeros(len(sides), np.uint64), np.zeros(len(sides), np.uint64)
            bit = bags.elements >> np.uint64(57)
            flip, upper = np.uint64(1) << (bit & np.uint64(63)), bit > 63
            low[bags.full] = np.bitwise_xor.reduceat(np.where(upper, np.uint64(0), flip), bags.start[bags.full])
            high[bags.full] = np.bitwise_xor.reduceat(np.where(upper, flip, np.uint64(0)), bags.start[bags.full])
            order, weight = heaviest_first(bags, heavy.value)
            sums = np.concatenate(([0], np.cumsum(weight)))
            need = needs(bags, sums, agreement)
            rest = np.repeat(sums[bags.start + bags.count], bags.count) - sums[:-1]
            # The heaviest terms, until what is left weighs less than is needed.
            keep = (rest >= np.repeat(need, bags.count)) & np.repeat(wanted, bags.count)
            at = order[keep]
            owner = bags.owner[at]
            out = np.empty(len(at), POSTING)
            out["key"], out["sig"], out["low"], out["high"] = bags.elements[at] >> np.uint64(32), bags.signature[owner], low[owner], high[owner]
            out["n"], out["need"], out["side"] = np.minimum(bags.count[owner], LARGEST), np.minimum(need[owner], LARGEST), sides[owner]
            out["rest"] = np.minimum(rest[keep], LARGEST)
            yield out

    return texts.select(F.col(side).cast("int"), text).mapInArrow(lambda b: blocks.packed(entries(b), "key", buckets), blocks.BLOCK_SQL)


def acceptance(agreement: float) -> blocks.Accept:
    """Tells which pairs of postings may be of texts that agree, by residual norms, bitmaps and lengths."""

    def accept(one: blocks.Columns, i: np.ndarray, two: blocks.Columns, j: np.ndarray) -> np.ndarray:
        near = np.minimum(one["rest"][i], two["rest"][j]) >= np.maximum(one["need"][i], two["need"][j])
        at = np.flatnonzero(near)
        i, j = i[at], j[at]
        apart = np.bitwise_count(one["low"][i] ^ two["low"][j]).astype(np.int32) + np.bitwise_count(one["high"][i] ^ two["high"][j])
        n, m = one["n"][i].astype(np.int32), two["n"][j].astype(np.int32)
        longer = np.maximum(n, m)
        near[at] = (longer == LARGEST) | (n + m - apart >= 2 * agreement * longer - 1e-9)
        return near

    return accept


def useful(records: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which postings of each list may have a partner on the other side: by its maximum residual norm and its least need."""
    training = records["side"] == 1
    out = np.zeros(len(records), bool)
    for own in (training, ~training):
        rest = np.maximum.reduceat(np.where(own, 0, records["rest"]).astype(np.int64), begin)
        need = np.minimum.reduceat(np.where(own, LARGEST + 1, records["need"]).astype(np.int64), begin)
        most, least = np.repeat(rest, length), np.repeat(need, length)
        out |= own & (np.minimum(records["rest"], most) >= np.maximum(records["need"], least))
    return out


def candidates(texts: DataFrame, side: str, text: str, agreement: float, heavy: Broadcast) -> DataFrame:
    """(a, b): signatures of an evaluation and a training text that may agree."""
    return blocks.cross_pairs(postings(texts, side, text, agreement, heavy), POSTING, "key", "sig", acceptance(agreement), useful)


def overlapping(texts: DataFrame, side: str = "train", text: str = "text", agreement: float = 0.75) -> DataFrame:
    """(a, b, dot, common, longer): signatures of evaluation texts and of training texts that agree, with their dot product.

    texts: rows with a boolean or integer `side`, 1 for training. Null, empty and wordless
    texts take no part; an empty table gives no rows.
    """
    heavy = texts.sparkSession.sparkContext.broadcast(heavy_terms(texts, text))
    return agreeing(cut(candidates(texts, side, text, agreement, heavy)), texts, text, agreement, heavy)
