"""Byte-level BPE encoding of a corpus with a public vocabulary.

A text is cut into pre-tokens by the vocabulary's pattern, and each pre-token's bytes are
merged pair by pair, lowest rank first and leftmost among equals. The ranks of adjacent
pairs are the leaves of a segment tree whose nodes hold the least (rank, place) below
them: the root names the next merge, and a merge changes two leaves and the nodes above
them. All pre-tokens of an Arrow batch that need the same tree height are merged together,
one step of every pre-token at a time, on arrays of trees; pre-tokens of a height that few
share just make a short array, so a megabyte without a blank is one tree of 2**20 leaves.

Frequent pre-tokens are remembered by each Python worker, up to REMEMBERED of them.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern of byte-level pre-tokens, as the vocabulary's publisher gives it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = os.environ.get("TOKENIZER_FILES", "/opt/tokenizers") + "/byte_bpe_50k.json"
REMEMBERED = 400_000
_NONE = np.int64(1) << 62


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Merges:
    """Pair ranks of a vocabulary as an open-addressing hash table that whole arrays are looked up in."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary = model["vocab"]
        letters = byte_letters()
        self.byte_id = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.byte_id[byte] = vocabulary[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        size = 1 << (len(pairs).bit_length() + 2)
        self.mask = size - 1
        self.key = np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        wanted, ranks = left << 32 | right, np.arange(len(pairs))
        _, first = np.unique(wanted, return_index=True)
        wanted, ranks = wanted[np.sort(first)], ranks[np.sort(first)]
        at = self._slot(wanted)
        self.longest = 1
        while len(wanted):  # of those that want one slot, one gets it
            _, winner = np.unique(at, return_index=True)
            winner = winner[self.key[at[winner]] < 0]
            self.key[at[winner]], self.rank[at[winner]] = wanted[winner], ranks[winner]
            rest = np.ones(len(wanted), bool)
            rest[winner] = False
            wanted, ranks, at = wanted[rest], ranks[rest], (at[rest] + 1) & self.mask
            self.longest += 1

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, _NONE where it does not merge."""
        pair = left << 32 | right
        at = self._slot(pair)
        out = np.full(len(pair), _NONE)
        open_ = np.arange(len(pair))
        for _ in range(self.longest):
            key = self.key[at]
            hit = key == pair
            out[open_[hit]] = self.rank[at[hit]]
            go = ~hit & (key >= 0)
            if not go.any():
                break
            open_, pair, at = open_[go], pair[go], (at[go] + 1) & self.mask
        return out


def merge_all(tokens: np.ndarray, length: np.ndarray, merges: Merges) -> list[np.ndarray]:
    """The ids of pre-tokens: `tokens` has one line of byte ids for each, of which `length` count.

    All lines have the same width, a power of two. A pair's place is its left token's; the
    node value is rank * width + place, so the least value is the leftmost pair of the
    lowest rank.
    """
    words, width = tokens.shape
    token = tokens.copy()
    place = np.arange(width)
    after = np.broadcast_to(place + 1, token.shape).copy()
    before = np.broadcast_to(place - 1, token.shape).copy()
    alive = place < length[:, None]
    tree = np.full((words, 2 * width), _NONE)
    row, col = np.nonzero(place < (length - 1)[:, None])
    rank = merges.ranks(token[row, col], token[row, col + 1])
    tree[row, width + col] = np.where(rank < _NONE, rank * width + col, _NONE)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    active = np.flatnonzero(tree[:, 1] < _NONE)
    while len(active):
        root = tree[active, 1]
        left = root % width
        right = after[active, left]
        token[active, left] = merges.merged[root // width]
        alive[active, right] = False
        beyond = after[active, right]
        after[active, left] = beyond
        has_next = beyond < length[active]
        before[active[has_next], beyond[has_next]] = left[has_next]
        previous = before[active, left]
        has_previous = previous >= 0
        value = np.full((3, len(active)), _NONE)
        x = active[has_next]
        rank = merges.ranks(token[x, left[has_next]], token[x, beyond[has_next]])
        value[0, has_next] = np.where(rank < _NONE, rank * width + left[has_next], _NONE)
        y = active[has_previous]
        rank = merges.ranks(token[y, previous[has_previous]], token[y, left[has_previous]])
        value[2, has_previous] = np.where(rank < _NONE, rank * width + previous[has_previous], _NONE)
        for at, new, which in ((left, value[0], slice(None)), (right, value[1], slice(None)), (previous, value[2], has_previous)):
            rows, node = active[which], width + at[which]
            tree[rows, node] = new[which]
        for at, which in ((left, slice(None)), (right, slice(None)), (previous, has_previous)):
            rows, node = active[which], (width + at[which]) >> 1
            for _ in range(width.bit_length() - 1):
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node = node >> 1
        active = active[tree[active, 1] < _NONE]
    flat, counts = token[alive], alive.sum(axis=1)
    return np.split(flat, np.cumsum(counts)[:-1])


def encode_words(words: list[str], merges: Merges) -> list[list[int]]:
    """The ids of each pre-token."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    out: list[list[int]] = [[]] * len(raw)
    height = np.ceil(np.log2(np.maximum(length, 2))).astype(np.int64)
    for h in np.unique(height).tolist():
        width = 1 << h
        rows = np.flatnonzero(height == h)
        for part in np.array_split(rows, max(1, len(rows) * width >> 19)):
            if not len(part):
                continue
            data = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in part.tolist()), np.uint8).reshape(-1, width)
            for i, ids in zip(part.tolist(), merge_all(merges.byte_id[data], length[part], merges)):
                out[i] = ids.tolist()
    return out


class Encoder:
    """Encodes batches of texts; remembers pre-tokens within its bound."""

    def __init__(self, path: str = VOCABULARY):
        self.merges, self.pattern, self.known = Merges(path), regex.compile(PATTERN), {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = self.pattern.findall
        pieces = [cut(t) if t else [] for t in texts]
        known = self.known
        new = list({w for p in pieces for w in p if w not in known})
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list({w for p in pieces for w in p})
            known.update(zip(new, encode_words(new, self.merges)))
        return [[i for w in p for i in known[w]] for p in pieces]


def encode_texts(documents: DataFrame, identity: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(`identity`, ids): the token ids of every text, without special tokens.

    Strings that look like special tokens are ordinary text. A null and an empty text have
    the empty list. Every row comes out, also with a null or repeated identity. The
    vocabulary file must be at the same path on every executor.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(vocabulary)
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                ids = pa.array(encoder.encode(part.column(1).to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[identity, "ids"])

    rows = documents.select(F.col(identity), F.col(text))
    return rows.mapInArrow(encoded, f"`{identity}` {dict(rows.dtypes)[identity]}, ids array<int>")
