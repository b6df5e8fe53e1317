"""Links of vectors against all cosines."""

import numpy as np
import pyarrow as pa
import pytest

from trafficloom.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, n long"


def expected(rows):
    good = [(i, np.array(v, dtype=np.float64)) for i, v, *_ in rows if v and None not in v]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and v.any()]
    ids = [i for i, _ in good]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    near = unit @ unit.T >= 0.95
    label = np.array(ids)
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    out = {i: (0, i) for i, *_ in rows}
    return out | {i: (int(near[k].sum() - 1), int(label[k])) for k, i in enumerate(ids)}


def clusters(seed, sizes, noise, dims=16):
    rng = np.random.default_rng(seed)
    rows = []
    for size in sizes:
        centre = rng.normal(size=dims)
        for _ in range(size):
            v = (centre + rng.normal(size=dims) * noise).astype(np.float32)
            rows.append((len(rows) * 3 + 1, v.tolist(), 0, 5))
    return rows


@pytest.mark.parametrize("block_rows", [4, 64, 4096])
def test_links_and_components(spark, block_rows):
    rows = clusters(1, [1] * 30 + [40, 12, 5, 5], 0.08)
    copy = rows[35][1]
    rows += [(1000 + i, copy, 0, 5) for i in range(30)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows += [(2000 + i, v, None, 5) for i, v in enumerate(odd)]
    rows += [(3000, [1e-30] * 16, 0, 5), (3001, [1e30] * 16, 0, 5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = embeddings.near_vectors(df, block_rows=block_rows).collect()
    want = expected([r for r in rows if r[0] not in (2006, 2007, 3000, 3001)])
    want |= {2006: (1, 2006), 2007: (1, 2006), 3000: (1, 3000), 3001: (1, 3000)}
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == want
    assert len(out) == len(rows) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_each_link_is_counted_once(spark):
    rows = clusters(4, [120], 0.02)
    out = embeddings.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["n_links"] for r in out} == {119} and {r["component_id"] for r in out} == {1}


def test_null_ids_repeats_and_nothing(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(None, v, 0, 1), (None, v, 0, 1), (5, [3.0, -1.0, 0.0], 0, 1), (5, [3.0, -1.0, 0.0], 0, 1)], SCHEMA)
    out = sorted((r["n_links"], r["vec_id"] or -1, r["component_id"] or -1, r["kept"]) for r in embeddings.near_vectors(df).collect())
    assert out == [(1, -1, -1, True), (1, -1, -1, True), (1, 5, 5, True), (1, 5, 5, True)]
    assert embeddings.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("dims", [16, 64, 256])
@pytest.mark.parametrize("rows", [1_000, 1_000_000, 50_000_000])
def test_recall_at_the_threshold(dims, rows):
    """Pairs with a cosine of exactly 0.95, in collections of different size."""
    n = 300 if dims == 256 else 600
    rng = np.random.default_rng(2)
    x, z = rng.normal(size=(2, n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    a, b = (embeddings.codes(v, embeddings.TABLES, rows) for v in (x, y))
    met = ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).any(axis=1)
    assert met.mean() >= 0.95


def test_chance_meetings_do_not_grow_with_the_collection():
    """Candidate pairs per vector among random vectors, from 10,000 to 80,000 of them."""
    met = []
    for n in (10_000, 20_000, 40_000, 80_000):
        unit = np.random.default_rng(n).normal(size=(n, 64))
        found = embeddings.codes(unit / np.linalg.norm(unit, axis=1, keepdims=True), embeddings.TABLES, n)
        pairs = 0
        for t in range(found.shape[1]):
            home, count = np.unique(found[:, t, 0], return_counts=True)
            probe, probed = np.unique(found[:, t, 1:], return_counts=True)
            at = np.clip(np.searchsorted(home, probe), 0, len(home) - 1)
            pairs += (count * (count - 1) // 2).sum() + (count[at] * probed)[home[at] == probe].sum()
        met.append(pairs / n)
        hashes, tables = embeddings.shape(64, n, embeddings.TABLES)
        assert 128**hashes >= n and tables == embeddings.TABLES
    assert max(met) <= 60 and met[-1] <= met[0] * 1.5, met


def test_links_of_a_collection_with_three_hashes(spark, monkeypatch):
    """The same links when tables are made for many more vectors."""
    real = embeddings.shape
    monkeypatch.setattr(embeddings, "shape", lambda dims, rows, tables: real(dims, 1 << 17, tables))
    rows = clusters(7, [1] * 40 + [30, 12, 5, 5], 0.05)
    assert embeddings.shape(16, len(rows), 8)[0] == 4
    unit = np.array([np.array(v) / np.linalg.norm(v) for _, v, *_ in rows])
    batches = [pa.record_batch({"class_no": pa.array(range(len(rows))), "vector": pa.array([u.tobytes() for u in unit], pa.binary())})]
    buckets = pa.Table.from_batches(embeddings._bucketed(8, len(rows))(iter(batches))).to_pandas()
    want = {(i, j) for i in range(len(rows)) for j in range(i) if unit[i] @ unit[j] >= 0.95}
    found = set()
    for _, group in buckets.groupby("bucket"):
        home = set(group.class_no[group.home])
        found |= {(max(i, j), min(i, j)) for i in home for j in group.class_no if i != j}
    assert len(want & found) >= 0.99 * len(want)
