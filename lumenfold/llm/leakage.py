"""Held-out texts inside a corpus: greedy string tiling on words.

Seeds are runs of MINIMUM words that a document shares with an item, found by Karp-Rabin
hashes: one rolling hash over all words of an Arrow batch, looked up in the hashes of the
items. On the documents that have seeds the tiles are taken greedily: the longest match of
unmarked words first, marked in both texts, then the longest of what is left, until none
has MINIMUM words. Tiles may come in any order in the document, so reordered passages add
up to the same coverage of the item.

Items of at most about BLOCK_WORDS words are broadcast, so the corpus is read once and
never shuffled. More items are joined: a bitmap of bounded size lets only those hashes of
the corpus through that items may have, and the texts of pairs that share one are tiled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.bits import Filter, filter_of
from lumenfold.llm.words import coded_words, word_hashes_of

MINIMUM = 13
BLOCK_WORDS = 2_000_000
#: Seeds that are listed at a time.
PORTION = 2_000_000
#: Share of the items' words that `p7_covered` asks for.
COVERED = 0.5
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Length, place in the document and place in the item of each match.
Matches = tuple[np.ndarray, np.ndarray, np.ndarray]


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """The Karp-Rabin hash of the `size` words from each place on, where so many follow."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - size + 1, np.uint64)
    for j in range(size):
        out = out * _BASE + words[j : j + len(out)]
    return out


class Items:
    """The grams of a block of items, sorted by hash, with a bitmap that most foreign grams miss."""

    def __init__(self, ids: list[int], texts: list[str], size: int):
        self.ids = np.asarray(ids, np.int64)
        self.words = [word_hashes_of([t]) for t in texts]
        self.size = size
        found = [grams(w, size) for w in self.words]
        self.gram = np.concatenate([np.zeros(0, np.uint64), *found])
        self.item = np.repeat(np.arange(len(found)), [len(g) for g in found])
        self.place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in found)])
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.item, self.place = self.gram[order], self.item[order], self.place[order]
        bits = max(16, len(self.gram).bit_length() + 5)
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[(self.gram * _BASE) >> self.shift] = True

    def hits(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in `gram` whose hash is here, where its run in self.gram begins, and the length of that."""
        at = np.flatnonzero(self.maybe[(gram * _BASE) >> self.shift])
        low, high = np.searchsorted(self.gram, gram[at], "left"), np.searchsorted(self.gram, gram[at], "right")
        there = high > low
        return at[there], low[there], (high - low)[there]

    def pairs(self, flat: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, Matches]]:
        """(document, item, words, matches) of texts of `count` words each that share grams with items, in portions of PORTION seeds."""
        end = np.cumsum(count)
        at, low, many = self.hits(grams(flat, self.size))
        owner = np.searchsorted(end, at, "right")
        inside = at + self.size <= end[owner] if len(at) else np.zeros(0, bool)
        at, low, many, owner = at[inside], low[inside], many[inside], owner[inside]
        seeds = np.bincount(owner, many, len(end)).astype(np.int64) if len(at) else np.zeros(len(end), np.int64)
        usual = seeds[owner] <= PORTION
        portion = np.cumsum(np.where(seeds <= PORTION, seeds, 0)) // PORTION
        for p in np.unique(portion[owner[usual]]).tolist():
            own = usual & (portion[owner] == p)
            times = many[own]
            i, of = np.repeat(at[own], times), np.repeat(owner[own], times)
            to = np.repeat(low[own], times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
            item = self.item[to]
            order = np.lexsort((item, of))
            i, to, of, item = i[order], to[order], of[order], item[order]
            new = np.ones(len(i), bool)
            new[1:] = (of[1:] != of[:-1]) | (item[1:] != item[:-1])
            begin = np.flatnonzero(new).tolist()
            for x, y in zip(begin, [*begin[1:], len(i)]):
                d, n = int(of[x]), int(item[x])
                start = int(end[d] - count[d])
                words = flat[start : end[d]]
                yield d, n, words, matches_of(words, self.words[n], i[x:y] - start, self.place[to[x:y]], self.size)
        for d in np.unique(owner[~usual]).tolist():  # texts that repeat themselves
            words = flat[end[d] - count[d] : end[d]]
            begin, first = np.unique(low[owner == d], return_index=True)
            some = np.unique(np.concatenate([self.item[x : x + n] for x, n in zip(begin.tolist(), many[owner == d][first].tolist())]))
            for n in some.tolist():
                yield d, n, words, matches_in(words, self.words[n], self.size)


def matches_of(document: np.ndarray, item: np.ndarray, i: np.ndarray, j: np.ndarray, size: int) -> Matches:
    """Length and places in document and item of the longest matches that the seeds (i, j) are in."""
    true = np.ones(len(i), bool)
    for n in range(size):  # hashes may collide, words decide
        true &= document[i + n] == item[j + n]
    i, j = i[true], j[true]
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] - j[1:] != i[:-1] - j[:-1]) | (i[1:] != i[:-1] + 1)
    begin = np.flatnonzero(new)
    return np.diff(np.concatenate((begin, [len(i)]))) + size - 1, i[begin], j[begin]


def matches_in(document: np.ndarray, item: np.ndarray, size: int) -> Matches:
    """As `matches_of`, without a list of all seeds, of which two texts that repeat themselves have the product of their lengths.

    Goes through the item's places and keeps, for each place of the document, how long the
    match that ends there is by now.
    """
    one, two = grams(document, size), grams(item, size)
    found: list[np.ndarray] = []
    run = np.zeros(len(one) + 1, np.int64)  # run[i + 1]: seeds of the match whose last one is at i
    for j in range(len(two) + 1):
        own = np.zeros(len(one), np.int64)
        if j < len(two):
            at = np.flatnonzero(one == two[j])
            for n in range(size):
                at = at[document[at + n] == item[j + n]]
            own[at] = run[at] + 1
        ended = np.flatnonzero((run > 0) & (np.concatenate((own, [0])) == 0))
        found.append(np.stack((run[ended] + size - 1, ended - run[ended], j - run[ended])))
        run[1:] = own
        run[0] = 0
    length, a, b = np.concatenate(found, axis=1)
    return length, a, b


def tiles(document: np.ndarray, item: np.ndarray, matches: Matches, size: int) -> list[tuple[int, int, int]]:
    """Tiles (length, place in the document, place in the item), longest first.

    Ties go to the earlier place in the item, then in the document.
    """
    heap = [(-n, b, a) for n, a, b in zip(*(x.tolist() for x in matches))]
    heapq.heapify(heap)
    marked_a, marked_b = np.zeros(len(document), bool), np.zeros(len(item), bool)
    out = []
    while heap:
        n, b, a = heapq.heappop(heap)
        n = -n
        taken = marked_a[a : a + n] | marked_b[b : b + n]
        if not taken.any():
            marked_a[a : a + n] = marked_b[b : b + n] = True
            out.append((n, a, b))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
        for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if y - x >= size:
                heapq.heappush(heap, (x - y, b + x, a + x))
    return out


def leak_of(document: np.ndarray, item: np.ndarray, matches: Matches, size: int, coverage: float) -> tuple[int, int, float] | None:
    """(longest, tiled, coverage) if the tiles are a leak."""
    found = tiles(document, item, matches, size)
    tiled = sum(t[0] for t in found)
    return (found[0][0], tiled, tiled / len(item)) if found and tiled >= coverage * len(item) else None


LEAKS_SQL = "doc_id long, item_id long, longest int, tiled int, coverage double"


def leak_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "longest", "tiled", "coverage"])


def by_broadcast(documents: DataFrame, items: DataFrame, words: int, coverage: float) -> DataFrame:
    """Leaks of documents (doc_id, text) and few items (item_id, text), which travel with the function: one pass, no shuffle."""
    known = items.toArrow()  # about BLOCK_WORDS at most
    block = Items(known.column(0).to_pylist(), known.column(1).to_pylist(), words)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (hashes, code, count) = batch.column(0).to_pylist(), coded_words(batch.column(1).to_pylist())
            rows = []
            for d, n, own, matches in block.pairs(hashes[code] if len(code) else np.zeros(0, np.uint64), count):
                leak = leak_of(own, block.words[n], matches, words, coverage)
                if leak:
                    rows.append((ids[d], int(block.ids[n]), *leak))
            yield leak_rows(rows)

    return documents.mapInArrow(search, LEAKS_SQL)


def by_join(documents: DataFrame, items: DataFrame, words: int, coverage: float, total: int) -> DataFrame:
    """As `by_broadcast` for any number of items: joined by the hashes of the grams that pass a filter of the items' grams."""

    def grams_of(name: str, wanted: Filter | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, found = [], []
                for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = np.unique(grams(word_hashes_of([text]), words))
                    if wanted is not None:
                        own = own[wanted.passes(own)]
                    found.append(own)
                    ids += [n] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)), pa.array(ids, pa.int64())], names=["gram", name])

        return run

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, text, n, item in zip(*(c.to_pylist() for c in batch.columns)):
                own, count = word_hashes_of([text]), np.zeros(1, np.int64)
                count[0] = len(own)
                block = Items([n], [item], words)
                for _, _, own, matches in block.pairs(own, count):
                    leak = leak_of(own, block.words[0], matches, words, coverage)
                    if leak:
                        rows.append((d, n, *leak))
            yield leak_rows(rows)

    right = items.mapInArrow(grams_of("item_id", None), "gram long, item_id long")
    left = documents.mapInArrow(grams_of("doc_id", filter_of(right.select(F.col("gram").alias("hash")), total)), "gram long, doc_id long")
    candidates = left.join(right, "gram").select("doc_id", "item_id").distinct()
    pairs = candidates.join(documents, "doc_id").join(items.withColumnRenamed("text", "item"), "item_id").select("doc_id", "text", "item_id", "item")
    return pairs.mapInArrow(compared, LEAKS_SQL)


def leaks(documents: DataFrame, items: DataFrame, document_id: str = "doc_id", item_id: str = "item_id", text: str = "text", words: int = MINIMUM, coverage: float = 0.0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, longest, tiled, coverage): the items that a document holds, wholly or partly.

    longest: words of the longest tile; tiled: words in tiles; coverage: tiled by the words
    of the item. A leak has a tile of at least `words` words and at least the `coverage`, in
    whatever order its tiles stand. Rows with a null id or text and texts of fewer words leak
    nothing; an id that comes several times comes out once for each item, with its best row;
    empty tables give no rows. Items of up to about `block_words` words are broadcast, more
    are joined by their grams; the rows are the same.
    """
    kept = documents.where(F.col(document_id).isNotNull() & F.col(text).isNotNull()).select(F.col(document_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).distinct()
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    out = by_broadcast(kept, known, words, coverage) if total <= 3 * block_words else by_join(kept, known, words, coverage, total // 3)
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("tiled", "longest", "coverage")).alias("best")).select("doc_id", "item_id", "best.longest", "best.tiled", "best.coverage")
