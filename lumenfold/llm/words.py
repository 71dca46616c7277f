"""Words, bags of words and their hashes, computed for whole Arrow batches at a time.

A word is a longest run of letters and digits after NFKC and case folding. A text is
compared as a bag: its elements are (word, number of the occurrence), so that counting
common words with repetition is counting common elements of two sets.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import xxhash

WORD = re.compile(r"[^\W_]+")
_MULTIPLY_1, _MULTIPLY_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_GOLDEN, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> _SHIFT)
    x = x * _MULTIPLY_1
    x = x ^ (x >> _SHIFT)
    x = x * _MULTIPLY_2
    return x ^ (x >> _SHIFT)


def fold(text: str) -> str:
    """NFKC and case folding."""
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).casefold()


def words(text: str | None) -> list[str]:
    """The words of `text` in order; none for null."""
    return WORD.findall(fold(text)) if text else []


def hash_strings(values: Sequence[str]) -> np.ndarray:
    """64-bit hashes of `values`."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(v) for v in values), np.uint64, len(values))


def coded_words(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words; of each word of each text, in order, its place there; the number of words of each text."""
    flat: list[str] = []
    counts: list[int] = []
    for text in texts:
        found = words(text)
        counts.append(len(found))
        flat += found
    if not flat:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.asarray(counts, np.int64)
    encoded = pa.array(flat, pa.string()).dictionary_encode()
    return hash_strings(encoded.dictionary.to_pylist()), encoded.indices.to_numpy().astype(np.int64), np.asarray(counts, np.int64)


def word_hashes_of(texts: Iterable[str | None]) -> np.ndarray:
    """The hashes of all words of the texts, in order."""
    hashes, code, _ = coded_words(texts)
    return hashes[code] if len(code) else hashes


class Bags:
    """Bags of words of a batch of texts.

    elements: 64-bit hashes of (word, occurrence), grouped by text; start, count: each
    text's part of them; signature: one 64-bit hash of each text's bag. Texts without
    words have no elements.
    """

    def __init__(self, texts: Iterable[str | None]):
        hashes, code, self.count = coded_words(texts)
        self.start = np.cumsum(self.count) - self.count
        owner = np.repeat(np.arange(len(self.count)), self.count)
        code |= owner << 32
        code.sort()
        fresh = np.ones(len(code), bool)
        fresh[1:] = code[1:] != code[:-1]
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(code)), 0))
        occurrence = (np.arange(len(code)) - first).astype(np.uint64)
        word = hashes[code & 0xFFFFFFFF]
        self.owner = owner
        self.elements = mix(word + occurrence * _GOLDEN)
        self.signature = np.zeros(len(self.count), np.uint64)
        full = self.count > 0
        if full.any():
            self.signature[full] = np.add.reduceat(mix(self.elements ^ _GOLDEN), self.start[full])
        self.full = full

    def listed(self, rows: np.ndarray, elements: np.ndarray) -> pa.Array:
        """list<int64> of the `elements`, given for all texts, of the texts `rows`."""
        count = self.count[rows]
        offsets = np.concatenate(([0], np.cumsum(count)))
        at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], count) + np.repeat(self.start[rows], count)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(elements[at].view(np.int64)))
