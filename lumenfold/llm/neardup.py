"""Near-duplicate texts: candidates by shared rare words, checked by odd sketches, then exactly.

Every text is a bag of words (`words.Bags`). Two bags that agree share one of the heaviest
elements of both, as many as `overlap.postings` indexes, so a posting for each of these
brings all agreeing pairs together and none is lost, whatever words an edit replaced. A
posting carries the odd sketch of the whole bag, a parity bitmap of 128 bits; the one bits
of the XOR of two never exceed the number of elements in which the bags differ, which
drops nearly all accidental pairs on the spot and no agreeing one. What is left is
compared exactly.

Exact copies of a bag are one class from the start, so a text that a third of all rows
repeat is compared once. Postings of a hot element are cut into tiles that no task holds
all of (`blocks`). Pairs to compare grow as the squared length of the postings of one
element, that is with the rows that a vocabulary is spread over.

`samples`, `odd_sketch` and `similarity` estimate the similarity from MinHash samples
instead; candidates by bands of these lost pairs near the bound and are no longer used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import blocks
from lumenfold.llm.bits import Filter, filter_of
from lumenfold.llm.components import components
from lumenfold.llm.rarity import WEIGHT_BITS, heaviest, heaviest_first, needs, surveyed
from lumenfold.llm.words import Bags, mix
from lumenfold.plans.lineage import cut, shuffle_partitions

BANDS, ROWS, BITS = 16, 4, 128
#: Copies of a bag in one tile.
COPIES = 1000
#: Signatures that a task remembers to have sent.
SEEN = 200_000


def samples(bags: Bags, rows: np.ndarray, count: int, weight: np.ndarray) -> np.ndarray:
    """`count` consistent samples of each of the texts `rows` (all with words), one line a sample.

    A sample is the least hash by weight. Weights are rounded to powers of two, which leave
    the fraction of a double as it is, so the fraction tells the element however two texts
    weigh it.
    """
    out = np.empty((count, len(rows)), np.uint64)
    factors = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    starts = bags.start[bags.full]
    where = np.searchsorted(np.flatnonzero(bags.full), rows)
    thin = np.exp2(np.round(-np.log2(weight)))
    for h, factor in enumerate(factors):
        least = np.minimum.reduceat((bags.elements * factor).astype(np.float64) * thin, starts)
        out[h] = least.view(np.uint64)[where] & np.uint64((1 << 52) - 1)
    return out


def odd_sketch(sampled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high half of the parity bitmap of each column of samples."""
    low, high = np.zeros(sampled.shape[1], np.uint64), np.zeros(sampled.shape[1], np.uint64)
    for h, values in enumerate(sampled):
        bit = mix(values ^ np.uint64(h + 1)) >> np.uint64(57)
        flip = np.uint64(1) << (bit & np.uint64(63))
        upper = bit > 63
        low ^= np.where(upper, np.uint64(0), flip)
        high ^= np.where(upper, flip, np.uint64(0))
    return low, high


def similarity(ones: float, count: int = BANDS * ROWS, bits: int = BITS) -> float:
    """The Jaccard similarity that `ones` differing bits of two odd sketches speak for."""
    if ones >= bits / 2:
        return 0.0
    return max(0.0, 1 - math.log(1 - 2 * ones / bits) / math.log(1 - 2 / bits) / (2 * count))


def candidates(texts: DataFrame, text: str, agreement: float, heavy: Broadcast) -> DataFrame:
    """Pairs (a, b) of bag signatures that share an indexed element and whose odd sketches allow the agreement."""
    from lumenfold.llm import overlap  # which needs this module

    postings = overlap.postings(texts.select(text, F.lit(0).alias("side")), "side", text, agreement, heavy)
    return blocks.self_pairs(postings, overlap.POSTING, "key", "sig", overlap.acceptance(agreement))


def bag_members(texts: DataFrame, identity: str, text: str) -> DataFrame:
    """(sig, `identity`) of every row whose text has words and whose identity is not null."""
    kept = texts.where(F.col(identity).isNotNull() & F.col(text).isNotNull()).select(F.col(identity).alias("id"), F.col(text).alias("text"))

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = Bags(batch.column(1).to_pylist())
            rows = np.flatnonzero(bags.full)
            yield pa.RecordBatch.from_arrays([pa.array(bags.signature[rows].view(np.int64)), batch.column(0).take(pa.array(rows))], names=["sig", "id"])

    return kept.mapInArrow(signatures, f"sig long, id {dict(kept.dtypes)['id']}").withColumnRenamed("id", identity)


def survey(texts: DataFrame, identity: str, text: str) -> tuple[DataFrame, Broadcast]:
    """(sig, id) of every row whose text has words and whose identity is not null, once each, and the heavy terms: one pass over the texts."""
    named = texts.select(F.col(identity).alias("id"), F.col(text).alias("text"))
    found = cut(named.mapInArrow(surveyed, f"id {dict(named.dtypes)['id']}, term long, n long"))
    members = found.where("id IS NOT NULL").select(F.col("term").alias("sig"), "id").distinct()
    return members, texts.sparkSession.sparkContext.broadcast(heaviest(found, texts.count()))


def bag_elements(texts: DataFrame, text: str, agreement: float, wanted: Filter, heavy: Broadcast) -> DataFrame:
    """(sig, n, need, elements) of the bags whose signature passes the filter, once each.

    n: the number of words; need: the least dot product with an agreeing bag; elements:
    hashes whose last WEIGHT_BITS bits are the squared weight.
    """

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for batch in batches:
            bags = Bags(batch.column(0).to_pylist())
            _, rows = np.unique(bags.signature, return_index=True)
            rows = rows[bags.full[rows]]
            rows = rows[wanted.passes(bags.signature[rows])]
            rows = rows[~np.isin(bags.signature[rows], seen)]
            seen = np.concatenate((seen, bags.signature[rows]))[-SEEN:]
            order, weight = heaviest_first(bags, heavy.value)
            need = needs(bags, np.concatenate(([0], np.cumsum(weight))), agreement)
            weighed = bags.elements[order] >> np.uint64(WEIGHT_BITS) << np.uint64(WEIGHT_BITS) | weight.astype(np.uint64)
            columns = [pa.array(bags.signature[rows].view(np.int64)), pa.array(bags.count[rows].astype(np.int32)), pa.array(need[rows]), bags.listed(rows, weighed)]
            yield pa.RecordBatch.from_arrays(columns, names=["sig", "n", "need", "elements"])

    found = texts.where(F.col(text).isNotNull()).select(text).mapInArrow(elements, "sig long, n int, need long, elements array<long>")
    return found.repartition(shuffle_partitions(texts.sparkSession), "sig").dropDuplicates(["sig"])


def agreeing(pairs: DataFrame, texts: DataFrame, text: str, agreement: float, heavy: Broadcast) -> DataFrame:
    """The pairs (a, b) of signatures whose bags agree to at least `agreement`, with `dot`, `common` and `longer`.

    dot: the exact dot product, which has to be what either bag needs; common: the number of
    common elements, which decides. pairs is read twice, so it should be cut. Only bags that
    are in some pair are shuffled.
    """
    sides = pairs.select(F.explode(F.array("a", "b")).alias("hash"))
    bags = bag_elements(texts, text, agreement, filter_of(sides, 2 * pairs.count()), heavy)
    a, b = (bags.select(F.col("sig").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "need", "elements"))) for s in "ab")
    met = pairs.join(a, "a").join(b, "b").select("a", "b", F.greatest("need_a", "need_b").alias("need"), F.greatest("n_a", "n_b").alias("longer"), F.array_intersect("elements_a", "elements_b").alias("both"))
    dot = F.aggregate("both", F.lit(0).cast("long"), lambda s, x: s + x.bitwiseAND(F.lit((1 << WEIGHT_BITS) - 1)))
    compared = met.select("a", "b", dot.alias("dot"), "need", F.size("both").alias("common"), "longer").where(F.col("dot") >= F.col("need"))
    return compared.where(F.col("common") >= agreement * F.col("longer") - F.lit(1e-9)).drop("need")


def near_duplicate_bags(texts: DataFrame, text: str, agreement: float, heavy: Broadcast) -> DataFrame:
    """Links (a, b, dot, common, longer) between different bags that agree to at least `agreement`.

    The agreement is the number of common words, with repetition and in any order, by the
    words of the longer text. Null, empty and wordless texts take no part; an empty table
    gives no rows; other columns of `texts` do not matter.
    """
    return agreeing(cut(candidates(texts, text, agreement, heavy)), texts, text, agreement, heavy)


def near_duplicate_pairs(texts: DataFrame, identity: str = "passage_id", text: str = "text", agreement: float = 0.75) -> DataFrame:
    """All pairs (passage_a, passage_b), a < b, of different identities whose texts agree to at least `agreement`.

    A row with a null identity is left out. An identity that comes several times counts
    once: its pairs are those of any of its texts. Rows of one identity are never paired.
    """
    members, heavy = survey(texts, identity, text)
    links = near_duplicate_bags(texts, text, agreement, heavy).select("a", "b")
    tiled, tiles = copy_tiles(members)
    both = linked_copies(links, tiled, tiles).unionByName(own_copies(tiled, tiles)).where("x <> y")
    return both.select(F.least("x", "y").alias("passage_a"), F.greatest("x", "y").alias("passage_b")).distinct()


def copy_tiles(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sig, id, tile) of all members and (sig, tiles) of the bags with several: their copies in tiles of about COPIES each.

    No join below has more than two tiles' rows under one key, however many rows share a bag.
    """
    tiles = cut(members.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1").select("sig", F.ceil(F.col("n") / COPIES).cast("int").alias("tiles")))
    tiled = members.join(tiles.where("tiles > 1"), "sig", "left").select("sig", "id", F.pmod(F.xxhash64("id"), F.coalesce("tiles", F.lit(1))).cast("int").alias("tile"))
    return tiled, tiles


def linked_copies(links: DataFrame, tiled: DataFrame, tiles: DataFrame) -> DataFrame:
    """(x, y): members of either bag of each link (a, b), tile by tile."""
    out = links
    for end in "ab":
        own = tiles.where("tiles > 1").select(F.col("sig").alias(end), F.col("tiles").alias("_t"))
        out = out.join(own, end, "left").withColumn(f"t{end}", F.explode(F.sequence(F.lit(0), F.coalesce("_t", F.lit(1)) - 1))).drop("_t")
    for end, name in (("a", "x"), ("b", "y")):
        out = out.join(tiled.select(F.col("sig").alias(end), F.col("id").alias(name), F.col("tile").alias(f"t{end}")), [end, f"t{end}"])
    return out.select("x", "y")


def own_copies(tiled: DataFrame, tiles: DataFrame) -> DataFrame:
    """(x, y): members of one bag, each pair of tiles under its own key."""
    copies = tiled.join(tiles, "sig")
    left = copies.select("sig", F.col("id").alias("x"), F.col("tile").alias("low"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("high"))
    right = copies.select("sig", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("low"), F.col("tile").alias("high"))
    return left.join(right, ["sig", "low", "high"]).where((F.col("low") < F.col("high")) | (F.col("x") < F.col("y"))).select("x", "y")


def near_duplicate_classes(texts: DataFrame, identity: str = "passage_id", text: str = "text", agreement: float = 0.75) -> DataFrame:
    """(`identity`, class, links): each row's group of texts connected by near-duplicates, and its text's links to other bags.

    Copies are not expanded into pairs: they share their class and links. Rows without words
    or with a null identity are left out; an identity with several texts has a row for each class.
    """
    members, heavy = survey(texts, identity, text)
    links = cut(near_duplicate_bags(texts, text, agreement, heavy).select("a", "b"))
    both = links.select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").agg(F.count("*").alias("links"))
    groups = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("vertex").alias("sig"), "component")
    known = members.join(both.join(groups, "sig"), "sig", "left")
    return known.groupBy(F.col("id").alias(identity), F.coalesce("component", "sig").alias("class")).agg(F.max(F.coalesce("links", F.lit(0))).alias("links"))
