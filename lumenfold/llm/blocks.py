"""Exchange of fixed-width records in packed blocks, and the pairs of records that share a key.

Similarity operators send tens of small records for each row to the task that owns the
record's key. As rows of their own these would cost the JVM more than the comparison
does, so each task packs the records that go to one bucket into one binary value, and
Spark shuffles those. Keys are spread over `BUCKETS_A_PARTITION` buckets for each
shuffle partition, each a partition of its own. Records of one key meet in one bucket.

A hot key (one key may hold a third of all rows) is never held by one task. A writer that
has many records of a key at a time cuts them into tiles of bounded size right away, which
go to any task, and tells the key's bucket so by a mark; the bucket makes tiles of the few
records that came to it one by one. All tiles of a key are numbered, and each is sent to
the cells of a triangle that its number is in, so every pair of tiles meets in some task
that holds just these two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.plans.lineage import broadcast_if_few, cut, shuffle_partitions

BUCKETS_A_PARTITION = 4
#: Records of a key in one bucket from which it is cut into tiles, and the size of those.
HOT = 2048
#: Records of a key, of all that a writer holds, from which the writer makes tiles.
LOCAL = 1024
#: Records that a task gathers before it packs them.
GATHER = 1_500_000
#: Pairs that a task compares at a time.
PORTION = 1 << 19
BLOCK = pa.schema([("bucket", pa.int32()), ("hot", pa.int64()), ("tile", pa.int64()), ("records", pa.binary())])
BLOCK_SQL = "bucket int, hot long, tile long, records binary"


def split(records: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The records of each bucket."""
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    for i, n in zip(*(x.tolist() for x in runs(bucket))):
        yield int(bucket[i]), records[i : i + n]


Row = tuple[int, int | None, int | None, bytes | None]


def blocks(rows: list[Row]) -> pa.RecordBatch:
    """Rows of a bucket's records (hot, tile null), of a tile, or of a mark that a key is hot (tile, records null)."""
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), BLOCK.types)] if rows else [pa.array([], t) for t in BLOCK.types], schema=BLOCK)


def squeeze(records: np.ndarray) -> bytes:
    """The records, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(records).view(np.uint8).reshape(len(records), -1).T
    return len(records).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unsqueeze(blob: bytes, dtype: np.dtype) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], n * dtype.itemsize, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).reshape(-1).view(dtype)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each run of equal values in the sorted `keys`."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    return begin, np.diff(np.concatenate((begin, [len(keys)])))


class Tiles:
    """Rows for the tiles that a task makes, numbered alike whenever it runs."""

    def __init__(self, size: int, stage: int):
        self.size, self.next = size, (stage << 60) | (TaskContext.get().partitionId() << 32)

    def of(self, key: int, records: np.ndarray, partitions: int) -> list[Row]:
        out = []
        for x in range(0, len(records), self.size):
            out.append(((self.next * 0x9E3779B1 >> 7) % partitions, key, self.next, squeeze(records[x : x + self.size])))
            self.next += 1
        return out


def packed(parts: Iterator[np.ndarray], key: str, buckets: int, gather: int = GATHER, compress: bool = False, local: int | None = None, tile: int | None = None) -> Iterator[pa.RecordBatch]:
    """Blocks of the records of `parts`, by the bucket of their key; tiles of keys that `local` records at hand share."""
    held: list[np.ndarray] = []
    size, tiles = 0, Tiles(tile or HOT, 0)

    def flush() -> pa.RecordBatch:
        records = np.concatenate(held)
        held.clear()
        records = records[np.argsort(records[key], kind="stable")]  # sorted keys compress, too
        begin, length = runs(records[key])
        many = length >= (local or LOCAL)
        rows: list[Row] = []
        for i, n in zip(begin[many].tolist(), length[many].tolist()):
            k = int(records[key][i])
            rows += tiles.of(k, records[i : i + n], buckets)
            rows.append((int(bucket_of(records[key][i : i + 1], buckets)[0]), k, None, None))
        if many.any():
            records = records[np.repeat(~many, length)]
        rows += [(b, None, None, squeeze(r) if compress else r.tobytes()) for b, r in split(records, bucket_of(records[key], buckets))]
        return blocks(rows)

    for part in parts:
        if len(part):
            held.append(part)
            size += len(part)
        if size > gather:
            yield flush()
            size = 0
    if held:
        yield flush()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Keys are hashes already; their upper bits may be shared by design, so all bits count."""
    k = keys.astype(np.uint64)
    return (((k ^ (k >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def unique_pairs(pairs: np.ndarray) -> np.ndarray:
    """The distinct records of an array of pairs (a, b), sorted."""
    pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
    once = np.ones(len(pairs), bool)
    once[1:] = (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1])
    return pairs[once]


def neighbours(begin: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of all pairs within the runs, in bounded portions."""
    at = np.repeat(begin, length) + (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))
    end = np.repeat(begin + length, length)
    step = 1
    while True:
        keep = at + step < end
        at, end = at[keep], end[keep]
        if not len(at):
            return
        yield at, at + step
        step += 1


def longs(pairs: np.ndarray) -> pa.RecordBatch:
    """A batch of two bigint columns a, b."""
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[c]).view(np.int64)) for c in ("a", "b")], names=["a", "b"])


def bucket_count(df: DataFrame) -> int:
    return BUCKETS_A_PARTITION * shuffle_partitions(df.sparkSession)


def gathered(batches: Iterator[pa.RecordBatch], dtype: np.dtype, compressed: bool, passed: list[Row], hot: set[int]) -> Iterator[np.ndarray]:
    """The records of each bucket of a partition, after all rows are read; tiles go to `passed`, marked keys to `hot`."""
    by: dict[int, list[bytes]] = {}
    for batch in batches:
        for b, key, tile, blob in zip(*(batch.column(n).to_pylist() for n in range(3)), batch.column(3)):
            if key is None:
                by.setdefault(b, []).append(blob.as_py())
            elif tile is None:
                hot.add(key)
            else:
                passed.append((b, key, tile, blob.as_py()))
    for b in list(by):
        blobs = by.pop(b)
        yield np.concatenate([unsqueeze(x, dtype) for x in blobs]) if compressed else np.frombuffer(b"".join(blobs), dtype)


Within = Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[np.ndarray]]
Across = Callable[[np.ndarray, "np.ndarray | None"], Iterator[np.ndarray]]
Pack = Callable[[list[np.ndarray]], list[tuple[int, bytes]]]


def meetings(entries: DataFrame, dtype: np.dtype, key: str, order: Callable[[np.ndarray], np.ndarray], within: Within, across: Across, pack: Pack, compressed: bool = False, hot: int | None = None, tile: int | None = None) -> DataFrame:
    """Blocks (bucket, records) of what is found among records that share a key.

    entries: blocks made by `packed`. order(records) sorts the records of a bucket by key
    and drops repeats; within(records, begin, length) compares those of each of the runs,
    across(left, right) those of two tiles of a key, and across(left, None) those of one;
    pack(found) makes the rows of a result, by bucket. Found records may repeat.
    """
    buckets, hot, tile = bucket_count(entries), hot or HOT, tile or HOT

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        passed: list[Row] = []
        marked: set[int] = set()
        tiles = Tiles(tile, 1)
        for records in gathered(batches, dtype, compressed, passed, marked):
            if passed:
                yield blocks(passed)
                passed.clear()
            records = order(records)
            begin, length = runs(records[key])
            large = length > hot
            if marked:
                large |= np.isin(records[key][begin], np.fromiter(marked, np.int64, len(marked)))
            for i, n in zip(begin[large].tolist(), length[large].tolist()):
                yield blocks(tiles.of(int(records[key][i]), records[i : i + n], buckets))
            usual = ~large & (length > 1)
            for part in within(records, begin[usual], length[usual]):
                found.append(part)
                if sum(map(len, found)) > GATHER:
                    yield blocks([(b, None, None, r) for b, r in pack(found)])
                    found = []
        if passed:
            yield blocks(passed)
        if found:
            yield blocks([(b, None, None, r) for b, r in pack(found)])

    met = cut(entries.repartitionById(buckets, F.col("bucket")).mapInArrow(meet, BLOCK_SQL))
    small, large = met.where("hot IS NULL").select("bucket", "records"), met.where("hot IS NOT NULL").select("hot", "tile", "records")
    if large.isEmpty():
        return small
    # Tiles are numbered by key without their records.
    by = Window.partitionBy("hot")
    numbered = large.select("hot", "tile").withColumns({"i": F.row_number().over(by.orderBy("tile")) - 1, "tiles": F.count("*").over(by)})
    placed = large.join(broadcast_if_few(numbered), ["hot", "tile"])
    cells = placed.select("hot", "i", "records", F.explode(F.sequence(F.lit(0), (F.col("tiles") - 1).cast("int"))).alias("j"))
    cells = cells.select("hot", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"), (F.col("i") > F.col("j")).alias("second"), "records")
    paired = cells.repartition(buckets, "hot", "low", "high").sortWithinPartitions("hot", "low", "high", "second")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        cell, left = None, None
        for batch in batches:
            for hot_, low, high, second, blob in zip(*(batch.column(n).to_pylist() for n in range(4)), batch.column(4)):
                records = unsqueeze(blob.as_py(), dtype)
                if low == high:
                    parts = across(records, None)
                elif not second:
                    cell, left = (hot_, low, high), records
                    continue
                else:
                    assert cell == (hot_, low, high), "a tile lacks its partner"
                    parts = across(left, records)
                for part in parts:
                    found.append(part)
                    if sum(map(len, found)) > GATHER:
                        yield result(pack(found))
                        found = []
        if found:
            yield result(pack(found))

    def result(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary())], names=["bucket", "records"])

    return small.unionByName(paired.mapInArrow(compare, "bucket int, records binary"))


Columns = dict[str, np.ndarray]
#: accept(one, i, two, j): which pairs of the records at the places i and j may stay.
Accept = Callable[[Columns, np.ndarray, Columns, np.ndarray], np.ndarray]
PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


def distinct_pairs(found: DataFrame) -> DataFrame:
    """(a, b) as bigints, each pair once, of blocks that are routed by their pairs. A task holds its share of the pairs."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for blob in batch.column(1):
                held.append(unsqueeze(blob.as_py(), PAIR))
                size += len(held[-1])
                if size > 2 * GATHER:
                    held = [unique_pairs(np.concatenate(held))]
                    size = len(held[0]) // 2
        if held:
            yield longs(unique_pairs(np.concatenate(held)))

    return found.repartitionById(bucket_count(found), F.col("bucket")).mapInArrow(finish, "a long, b long")


def by_pair(buckets: int) -> Pack:
    def pack(found: list[np.ndarray]) -> list[tuple[int, bytes]]:
        pairs = unique_pairs(np.concatenate(found))
        return [(b, squeeze(r)) for b, r in split(pairs, bucket_of(pairs["a"] * np.uint64(31) ^ pairs["b"], buckets))]

    return pack


def once_each(key: str, *others: str) -> Callable[[np.ndarray], np.ndarray]:
    """Sorts records by key, then the others, and drops repeats of all these."""

    def order(records: np.ndarray) -> np.ndarray:
        records = records[np.lexsort(tuple(records[c] for c in (*reversed(others), key)))]
        once = np.ones(len(records), bool)
        once[1:] = np.logical_or.reduce([records[c][1:] != records[c][:-1] for c in (key, *others)])
        return records[once]

    return order


def columns_of(records: np.ndarray) -> Columns:
    """The fields as arrays of their own, which are faster to pick from than records."""
    return {c: np.ascontiguousarray(records[c]) for c in records.dtype.names}


def chunks(n: int, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places below n and below m, about PORTION at a time."""
    step = max(1, PORTION // max(1, m))
    for i in range(0, n, step):
        part = np.arange(i, min(n, i + step))
        yield np.repeat(part, m), np.tile(np.arange(m), len(part))


def self_pairs(entries: DataFrame, dtype: np.dtype, key: str, identity: str, accept: Accept) -> DataFrame:
    """Distinct pairs (a, b), a < b, of identities that share a key and that `accept` lets through.

    entries: blocks made by `packed`. Identities are 64-bit and come out as bigint, ordered
    as unsigned.
    """

    def kept(one: Columns, i: np.ndarray, two: Columns, j: np.ndarray) -> np.ndarray:
        ok = accept(one, i, two, j)
        x, y = one[identity][i[ok]], two[identity][j[ok]]
        x, y = x[x != y], y[x != y]
        out = np.empty(len(x), PAIR)
        out["a"], out["b"] = np.minimum(x, y), np.maximum(x, y)
        return out

    def within(records: np.ndarray, begin: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
        own = columns_of(records)
        for i, j in neighbours(begin, length):
            for x in range(0, len(i), PORTION):
                yield kept(own, i[x : x + PORTION], own, j[x : x + PORTION])

    def across(left: np.ndarray, right: np.ndarray | None) -> Iterator[np.ndarray]:
        one = columns_of(left)
        two = one if right is None else columns_of(right)
        for i, j in chunks(len(left), len(left if right is None else right)):
            yield kept(one, i, two, j)

    return distinct_pairs(meetings(entries, dtype, key, once_each(key, identity), within, across, by_pair(bucket_count(entries))))


def cross_pairs(entries: DataFrame, dtype: np.dtype, key: str, identity: str, accept: Accept, useful: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Distinct pairs (a, b) of identities of side 0 and of side 1 that share a key and that `accept` lets through.

    As `self_pairs`, for records with a field `side`; equal identities of both sides may be
    paired. useful(records, begin, length) tells of each record whether any record of the
    other side in its run may be accepted with it.
    """

    def kept(one: Columns, i: np.ndarray, two: Columns, j: np.ndarray) -> np.ndarray:
        ok = accept(one, i, two, j)
        out = np.empty(np.count_nonzero(ok), PAIR)
        out["a"], out["b"] = one[identity][i[ok]], two[identity][j[ok]]
        return out

    def within(records: np.ndarray, begin: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
        own = records[np.repeat(begin, length) + (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))]
        if useful is not None and len(own):
            own = own[useful(own, *runs(own[key]))]
        begin, length = runs(own[key])
        ones = np.concatenate(([0], np.cumsum(own["side"])))
        other = (ones[begin + length] - ones[begin]).astype(np.int64)
        mine = length - other
        use = (mine > 0) & (other > 0)
        begin, mine, other = begin[use], mine[use], other[use]
        left = np.repeat(begin, mine) + (np.arange(mine.sum()) - np.repeat(np.cumsum(mine) - mine, mine))
        right, many = np.repeat(begin + mine, mine), np.repeat(other, mine)
        done, columns = np.cumsum(many), columns_of(own)
        cuts = np.searchsorted(done, np.arange(0, done[-1], PORTION)).tolist() if len(done) else []
        for x, y in zip(cuts, [*cuts[1:], len(left)]):
            if x < y:
                times = many[x:y]
                j = np.repeat(right[x:y], times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
                yield kept(columns, np.repeat(left[x:y], times), columns, j)

    def across(left: np.ndarray, right: np.ndarray | None) -> Iterator[np.ndarray]:
        for one, two in [(left, left)] if right is None else [(left, right), (right, left)]:
            own, other = columns_of(one[one["side"] == 0]), columns_of(two[two["side"] == 1])
            for i, j in chunks(len(own["side"]), len(other["side"])):
                yield kept(own, i, other, j)

    return distinct_pairs(meetings(entries, dtype, key, once_each(key, "side", identity), within, across, by_pair(bucket_count(entries))))
