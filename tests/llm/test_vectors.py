"""Similar vectors against all pairs, and at their edges."""

import numpy as np
import pytest

from lumenfold.llm import blocks, vectors

SQL = "vec_id long, embedding array<float>, id string"


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(y) for y in v], "x") for i, v in zip(ids, x)], SQL)


def clustered(n, size, seed, spread=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, size))
    return np.repeat(centres, 8, axis=0) + spread * rng.standard_normal((n // 8 * 8, size))


def exact(ids, x, k, cosine):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    dots = x @ x.T
    out = set()
    for r in range(len(ids)):
        order = sorted((-dots[r, c], ids[c]) for c in range(len(ids)) if c != r and dots[r, c] >= cosine)[:k]
        out |= {(min(ids[r], i), max(ids[r], i)) for _, i in order}
    return out


def found(df):
    return {(r.vec_a, r.vec_b) for r in df.collect()}


def test_recall_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BUCKET", 60)
    x = clustered(1200, 64, 5, 0.25)
    ids = list(range(1, 1201))
    want = exact(ids, x, 5, 0.9)
    got = found(vectors.similar_pairs(frame(spark, ids, x)))
    assert len(want) > 1000
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_recall_at_the_bound_stays_with_more_hashes(spark, monkeypatch):
    rng = np.random.default_rng(11)
    one, other = rng.standard_normal((2, 600, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (other * one).sum(axis=1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    x = np.concatenate((one, 0.905 * one + np.sqrt(1 - 0.905**2) * other))
    for bucket, hashes in ((4, 7), (0.7, 9)):
        monkeypatch.setattr(vectors, "BUCKET", bucket)
        assert vectors.hashes_for(1200) == hashes
        got = found(vectors.similar_pairs(frame(spark, range(1200), x)))
        assert len(got & {(i, i + 600) for i in range(600)}) >= 0.96 * 600


def test_tables_follow_from_the_hashes():
    assert [vectors.tables_for(h, 1, 0.9) for h in (2, 4)] == [4, 4]
    for h in range(4, 12):
        missed = (1 - vectors.met_in_a_table(h, 1, 0.9)) ** vectors.tables_for(h, 1, 0.9)
        assert missed <= 1 - vectors.RECALL + 1e-9


def test_edges(spark):
    base = np.eye(64)[0]
    rows = [(1, base.tolist()), (2, (2 * base).tolist()), (3, None), (4, [0.0] * 64), (5, [float("nan")] + [0.0] * 63), (6, [1.0] * 63), (7, [float("inf")] + [1.0] * 63), (8, [None] + [1.0] * 63), (None, base.tolist()), (9, (base + 0.01 * np.eye(64)[1]).tolist())]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SQL)
    assert found(vectors.similar_pairs(df)) == {(1, 2), (1, 9), (2, 9)}
    assert vectors.similar_pairs(df.limit(0)).count() == 0


def test_crowds_of_equal_vectors_tie_to_the_least_ids(spark):
    rng = np.random.default_rng(2)
    one, other = rng.standard_normal(64), rng.standard_normal(64)
    ids = list(range(1, 42))
    x = np.stack([one] * 40 + [one + 0.001 * other])
    got = {}
    for r in vectors.similar_vectors(frame(spark, ids, x)).collect():
        got.setdefault(r.id, []).append((r.place, r.neighbour))
    for i in range(1, 41):
        assert [n for _, n in sorted(got[i])] == [j for j in range(1, 8) if j != i][:5]
    assert [n for _, n in sorted(got[41])] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("local", [10, 100_000])
def test_crowded_buckets_are_cut_into_tiles(spark, monkeypatch, local):
    x = clustered(160, 64, 9, 0.05)
    df = frame(spark, range(160), x)
    whole = found(vectors.similar_pairs(df))
    monkeypatch.setattr(vectors, "HOT", 30)
    monkeypatch.setattr(vectors, "TILE", 16)
    monkeypatch.setattr(vectors, "LOCAL", local)
    assert found(vectors.similar_pairs(df)) == whole
    assert len(whole & exact(list(range(160)), x, 5, 0.9)) >= 0.95 * len(whole)


def test_probes_go_by_estimated_success():
    order = vectors.perturbations(6, 12)
    assert order[0] == (0,) and len(set(order)) == 12
    own, probed = vectors.keys_of(np.eye(64, dtype=np.float32), 6, 0, 4)
    assert len(probed) == 4 and all(len(p) == 64 for p in probed)
    assert all((p != own).mean() > 0.9 for p in probed[:1])


def test_squeezed_records_come_back():
    kind = vectors.entry_type(8)
    records = np.zeros(5, kind)
    records["id"], records["v"] = np.arange(5), np.arange(40).reshape(5, 8)
    assert (blocks.unsqueeze(blocks.squeeze(records), kind) == records).all()
