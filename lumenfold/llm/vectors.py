"""The most similar vectors of every vector: multiprobe p-stable hashing, reranking in the bucket.

A table hashes a unit vector by floor((a.x + b)/w) for some random Gaussian a. Every vector
goes into its own bucket and, as a probe, into the buckets it would fall into if it moved
a little: sets of one-step perturbations, in the order of their estimated success, which
grows as the squared distances to the crossed bucket borders shrink. So a close pair is
met if either vector probes the other's bucket in one of the tables. The task of a bucket
takes the cosines of all vectors at home in it with all in it by one matrix product and
keeps each vector's best; the best of all tables are merged.

The coordinates travel with the entries, as multiples of 1/STEPS, byte planes compressed:
cosines are off by some 3e-5. So vectors are shuffled tables x (1 + PROBES) times and not
again for candidate pairs, of which there are far more, but for those that rounding alone
would decide: they are reranked by exact cosines of the vectors (`reranked`). The number of hashes grows with
the logarithm of the number of vectors, so buckets keep their size, and with it the number
of tables (`tables_for`), so recall at the cosine bound stays; crowded buckets are cut
into tiles that all tasks share. Equal vectors (a third of all may be) enter the tables
only with their k + 1 least ids, which is all that anyone's list of k needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm import blocks
from lumenfold.llm.bits import filter_of
from lumenfold.llm.words import mix
from lumenfold.plans.lineage import cut

#: At least so many tables; `tables_for` adds more.
TABLES, PROBES, WIDTH, STEPS, SEED = 4, 1, 1.5, 1 << 14, 7
#: Estimated recall of pairs right at the cosine bound, at every number of hashes, and the sample that estimates it.
RECALL, SAMPLE = 0.98, 1 << 17
#: Cosines of rounded coordinates are off by less, six times their standard error; and how many beyond the k best are kept for the exact order.
DOUBT, SPARE = 1.5e-4, 3
#: Vectors that an average bucket would hold if all were unrelated.
BUCKET = 5000
#: Vectors of a bucket, and of those that a writer holds, from which it is cut into tiles; the size of these; cells of a matrix product.
HOT, LOCAL, TILE, CELLS = 1 << 15, 1 << 13, 1 << 13, 1 << 22
FOUND = np.dtype([("id", "<i8"), ("other", "<i8"), ("cosine", "<f4")])


def entry_type(size: int) -> np.dtype:
    return np.dtype([("key", "<u4"), ("side", "u1"), ("id", "<i8"), ("v", "<i2", (size,))])


def unit_vectors(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the usable rows of a batch (id, v) whose v all have `size` numbers."""
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(-1, size)
    with np.errstate(all="ignore"):
        y = x / np.abs(x).max(axis=1, keepdims=True)
        y /= np.sqrt((y * y).sum(axis=1, keepdims=True))
    good = np.isfinite(y).all(axis=1)
    return batch.column(0).to_numpy()[good], y[good].astype(np.float32)


def hashes_for(rows: int) -> int:
    """So many hashes that unrelated unit vectors (distance about 1.3) fill buckets of about BUCKET."""
    apart = WIDTH / 1.3
    tail = 0.5 * math.erfc(apart / math.sqrt(2))
    same = 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * apart) * (1 - math.exp(-apart * apart / 2))
    return max(2, math.ceil(math.log(max(2.0, rows / BUCKET)) / -math.log(same)))


def met_in_a_table(hashes: int, probes: int, cosine: float) -> float:
    """The share of unit vectors of this cosine that one table brings together, by a seeded simulation.

    Projections of such a pair differ by a Gaussian of their distance, whatever the number of
    dimensions; tables are independent.
    """
    random = np.random.default_rng(SEED)
    one = random.random((SAMPLE, hashes))
    moved = one + random.standard_normal((SAMPLE, hashes)) * (math.sqrt(max(0.0, 2 - 2 * cosine)) / WIDTH)
    cells = np.floor(moved).astype(np.int64)
    met = ~cells.any(axis=1)
    row = np.arange(SAMPLE)
    for into, target in ((one, cells), (moved - cells, -cells)):
        order = np.argsort(np.concatenate((into, 1 - into), axis=1), axis=1)
        for places in perturbations(hashes, probes):
            probe, used = np.zeros_like(cells), np.zeros((SAMPLE, len(places)), np.int64)
            for n, place in enumerate(places):
                crossed = order[:, place]
                used[:, n] = crossed % hashes
                probe[row, used[:, n]] = np.where(crossed < hashes, -1, 1)
            once = np.ones(SAMPLE, bool)
            for i, j in combinations(range(len(places)), 2):
                once &= used[:, i] != used[:, j]
            met |= once & (probe == target).all(axis=1)
    return float(met.mean())


def tables_for(hashes: int, probes: int, cosine: float) -> int:
    """So many tables that pairs at the bound `cosine` are met with an estimated probability of RECALL."""
    met = met_in_a_table(hashes, probes, cosine)
    return TABLES if met >= 1 else max(TABLES, math.ceil(math.log(1 - RECALL) / math.log1p(-max(met, 1e-4))))


def perturbations(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """The `probes` most promising sets of borders to cross, as places in the order of their nearness.

    The borders of a point lie at 2 x hashes distances; by the expected squares of these
    in sorted order, sets of small sums come first. Both borders of one hash never go together;
    that is checked for each point.
    """
    m = hashes
    expected = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    few = range(min(2 * m, 8))
    sets = [s for n in (1, 2, 3) for s in combinations(few, n)]
    return sorted(sets, key=lambda s: (sum(expected[j] for j in s), s))[:probes]


def keys_of(x: np.ndarray, hashes: int, table: int, probes: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The 32-bit key of each vector's own bucket and of each probed bucket (own key where a set cannot be)."""
    random = np.random.default_rng((SEED, table))
    projected = (x @ random.standard_normal((x.shape[1], hashes)).astype(np.float32)) / WIDTH + random.random(hashes).astype(np.float32)
    cell = np.floor(projected).astype(np.int64)
    into = projected - cell
    weights = mix(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(table))
    coded = mix(cell.astype(np.uint64) + weights)
    own = np.bitwise_xor.reduce(coded, axis=1)
    order = np.argsort(np.concatenate((into, 1 - into), axis=1), axis=1)
    row = np.arange(len(x))
    probed = []
    for places in perturbations(hashes, probes):
        key, used = own.copy(), np.zeros((len(x), len(places)), np.int64)
        for n, place in enumerate(places):
            crossed = order[:, place]
            h, step = crossed % hashes, np.where(crossed < hashes, -1, 1)
            used[:, n] = h
            key ^= coded[row, h] ^ mix((cell[row, h] + step).astype(np.uint64) + weights[h])
        twice = np.zeros(len(x), bool)
        for i, j in combinations(range(len(places)), 2):
            twice |= used[:, i] == used[:, j]
        probed.append(np.where(twice, own, key))
    final = lambda k: (mix(k ^ np.uint64(table + 1)) >> np.uint64(32)).astype(np.uint32)
    return final(own), [final(k) for k in probed]


def table_entries(vectors: DataFrame, size: int, hashes: int, tables: int, probes: int) -> DataFrame:
    """Packed entries of all vectors in their own and their probed buckets."""
    buckets = blocks.bucket_count(vectors)
    kind = entry_type(size)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            ids, x = unit_vectors(batch, size)
            steps = np.round(x * STEPS).astype(np.int16)
            for table in range(tables if len(x) else 0):
                own, probed = keys_of(x, hashes, table, probes)
                for side, key in enumerate([own, *probed]):
                    new = np.ones(len(key), bool) if not side else key != own
                    out = np.empty(np.count_nonzero(new), kind)
                    out["key"], out["id"], out["v"], out["side"] = key[new], ids[new], steps[new], side > 0
                    yield out

    return vectors.mapInArrow(lambda b: blocks.packed(entries(b), "key", buckets, 200_000, True, LOCAL, TILE), blocks.BLOCK_SQL)


def best(found: np.ndarray, k: int) -> np.ndarray:
    """Of each id the `k` best distinct others; ties, to five decimals, go to the smaller."""
    if not len(found):
        return found
    found = found[np.lexsort((found["other"], np.round(found["cosine"] * np.float32(-1e5)), found["id"]))]
    found = found[np.concatenate(([True], (found["id"][1:] != found["id"][:-1]) | (found["other"][1:] != found["other"][:-1])))]
    begin, length = blocks.runs(found["id"])
    return found[np.arange(len(found)) - np.repeat(begin, length) < k]


def compare(left: np.ndarray, right: np.ndarray, cosine: float, k: int) -> Iterator[np.ndarray]:
    """Both directions of the pairs of `left` and `right` of at least `cosine`, the k best of each id and portion.

    Single precision, which is off by far less than the rounding of coordinates; `reranked` settles ties.
    """
    a, b = (r["v"].astype(np.float32) for r in (left, right))
    for x in (a, b):
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1)[:, None]
    step = max(1, CELLS // max(1, len(b)))
    for x in range(0, len(a), step):
        dots = a[x : x + step] @ b.T
        i, j = np.nonzero(dots >= cosine)
        dot = dots[i, j]
        one, two = left["id"][i + x], right["id"][j]
        other = one != two
        one, two, dot = one[other], two[other], dot[other]
        out = np.empty(2 * len(dot), FOUND)
        out["id"], out["other"], out["cosine"] = np.concatenate((one, two)), np.concatenate((two, one)), np.tile(dot, 2)
        yield best(out, k)


def met_in_buckets(entries: DataFrame, size: int, cosine: float, k: int) -> DataFrame:
    """(id, other, cosine): a superset of every id's k best among those met; rows may repeat."""
    buckets = blocks.bucket_count(entries)

    def pack(found: list[np.ndarray]) -> list[tuple[int, bytes]]:
        kept = best(np.concatenate(found), k)
        return [(b, blocks.squeeze(r)) for b, r in blocks.split(kept, blocks.bucket_of(kept["id"], buckets))]

    def order(records: np.ndarray) -> np.ndarray:
        return records[np.lexsort((records["side"], records["key"]))]

    def within(records: np.ndarray, begin: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
        looking = np.concatenate(([0], np.cumsum(records["side"])))
        at_home = length - (looking[begin + length] - looking[begin]).astype(np.int64)
        for i, m, n in zip(begin.tolist(), at_home.tolist(), length.tolist()):
            if m:
                yield from compare(records[i : i + m], records[i : i + n], cosine, k)

    def across(left: np.ndarray, right: np.ndarray | None) -> Iterator[np.ndarray]:
        home = left[left["side"] == 0]
        if right is None:
            yield from compare(home, left, cosine, k)
        else:
            yield from compare(home, right, cosine, k)
            yield from compare(left[left["side"] == 1], right[right["side"] == 0], cosine, k)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for blob in batch.column(1):
                held.append(blocks.unsqueeze(blob.as_py(), FOUND))
                size += len(held[-1])
                if size > 2 * blocks.GATHER:
                    held = [best(np.concatenate(held), k)]
                    size = len(held[0]) // 2
        if held:
            found = best(np.concatenate(held), k)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[c])) for c in FOUND.names], names=list(FOUND.names))

    found = blocks.meetings(entries, entry_type(size), "key", order, within, across, pack, True, HOT, TILE)
    return found.repartitionById(buckets, F.col("bucket")).mapInArrow(finish, "id long, other long, cosine float")


def crowds_of(vectors: DataFrame, size: int, k: int) -> DataFrame:
    """(id, ids): members of crowds of more than k + 1 equal vectors, with the crowd's k + 1 least ids."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = unit_vectors(batch, size)
            digests = b"".join(xxhash.xxh3_128_digest(r) for r in x.view(np.uint8).reshape(len(x), -1)) if len(x) else b""
            halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1]))], names=["id", "h1", "h2"])

    members = vectors.mapInArrow(hashed, "id long, h1 long, h2 long")
    large = cut(members.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).drop("n"))
    if large.isEmpty():
        return vectors.sparkSession.createDataFrame([], "id long, ids array<long>")
    inside = cut(members.join(large, ["h1", "h2"], "left_semi").distinct())
    first = inside.withColumn("nth", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("nth") <= k + 1)
    named = first.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return cut(inside.join(named, ["h1", "h2"]).select("id", "ids"))


def similar_vectors(vectors: DataFrame, identity: str = "vec_id", vector: str = "embedding", k: int = 5, cosine: float = 0.9, size: int = 64, tables: int | None = None, probes: int = PROBES) -> DataFrame:
    """(id, neighbour, cosine, place): of every vector its k most similar others with at least `cosine`.

    Null, shorter, longer, all-zero and NaN- or infinity-holding vectors and vectors that
    hold nulls take no part; ties go to the smaller id; of repeated ids each vector counts,
    but an id is no neighbour of itself. Unless `tables` is given, their number follows from
    the number of vectors, `probes` and `cosine`, so that a pair right at the bound is met with
    an estimated probability of RECALL at every size, and nearer ones more surely.
    """
    fit = vectors.where(F.col(identity).isNotNull() & (F.size(vector) == size) & ~F.exists(vector, lambda x: x.isNull()))
    kept = fit.select(F.col(identity).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    crowds = crowds_of(kept, size, k)
    spare = crowds.where(~F.array_contains("ids", F.col("id"))).select("id")
    entered = kept if spare.isEmpty() else kept.join(spare, "id", "left_anti")
    hashes = hashes_for(vectors.count())
    tables = tables or tables_for(hashes, probes, cosine)
    met = met_in_buckets(table_entries(entered, size, hashes, tables, probes), size, cosine - DOUBT, k + SPARE).select("id", F.col("other").alias("neighbour"), F.col("cosine").cast("double").alias("cosine"))
    # Everyone's list in a crowd is its k least other ids.
    crowded = crowds.select("id", F.explode(F.slice(F.array_remove("ids", F.col("id")), 1, k)).alias("neighbour"), F.lit(1.0).alias("cosine"))
    once = met.join(crowds.select("id").distinct(), "id", "left_anti").unionByName(crowded).groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))
    return reranked(once, kept, k, cosine)


def reranked(found: DataFrame, vectors: DataFrame, k: int, cosine: float) -> DataFrame:
    """(id, neighbour, cosine, place): the k best of each id, those that rounding alone decides by exact cosines.

    found: (id, neighbour, cosine), cosines of rounded coordinates, off by less than DOUBT.
    In doubt are pairs that close to the bound, and pairs that close to the k-th place where the
    next one is as close; only these meet their vectors again.
    """
    by = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    whole = Window.partitionBy("id")
    placed = found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k + SPARE)
    last, after = (F.max(F.when(F.col("place") == n, F.col("cosine"))).over(whole) for n in (k, k + 1))
    marked = placed.withColumns({"last": last, "after": after})
    open_ = (F.abs(F.col("cosine") - cosine) < DOUBT) | F.coalesce((F.abs(F.col("cosine") - F.col("last")) < 2 * DOUBT) & (F.col("last") - F.col("after") < 2 * DOUBT), F.lit(False))
    ready = cut(marked.select("id", "neighbour", "cosine", open_.alias("open")))
    doubted = ready.where("open").select("id", "neighbour")
    ends = doubted.select(F.explode(F.array("id", "neighbour")).alias("hash")).distinct()
    wanted = filter_of(ends, ends.count())

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.passes(batch.column(0).to_numpy())))

    own = vectors.mapInArrow(passing, "id long, v array<float>")
    pairs = doubted.join(own.withColumnRenamed("v", "one"), "id").join(own.select(F.col("id").alias("neighbour"), F.col("v").alias("two")), "neighbour")
    exact = pairs.groupBy("id", "neighbour").agg(F.max(F.round(exact_cosine(F.col("one"), F.col("two")), 12)).alias("cosine"))
    settled = ready.where("NOT open").select("id", "neighbour", "cosine").unionByName(exact.where(F.col("cosine") >= cosine))
    return settled.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)


def exact_cosine(one: Column, two: Column) -> Column:
    """The cosine in doubles; scaled by the largest coordinates first, so squares neither overflow nor vanish."""
    once = lambda value, f: F.transform(F.array(value), f)[0]
    scaled = lambda v: once(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))), lambda top: F.transform(v, lambda x: x.cast("double") / top))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return once(scaled(one), lambda a: once(scaled(two), lambda b: dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))))


def similar_pairs(vectors: DataFrame, **options) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: one is among the other's most similar vectors; see `similar_vectors`."""
    found = similar_vectors(vectors, **options)
    return found.select(F.least("id", "neighbour").alias("vec_a"), F.greatest("id", "neighbour").alias("vec_b")).distinct()
