"""Near-duplicate vectors where a label is dealt into cells."""

from __future__ import annotations

import time

import numpy as np

from mattelake.llm import embedding_dedup as ed

DIM = 64


def threshold_pairs(rng, n, cosine):
    a, b = rng.normal(size=(2, n, DIM))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


def test_deals_and_count_keep_the_recall():
    a, b = threshold_pairs(np.random.default_rng(8), 100_000, ed.COSINE)
    apart = np.abs((a - b) @ ed.directions(DIM)) / ed.step(ed.COSINE, DIM)
    counted = (apart <= ed.WINDOW).sum(axis=1) >= ed.calibrate()
    for size in (5_000, 200_000, 20_000_000):
        bits, times = ed.deals(size)
        met = np.concatenate([(ed.cell_codes(a[k : k + 5000], bits, times) == ed.cell_codes(b[k : k + 5000], bits, times)).any(axis=1) for k in range(0, len(a), 5000)])
        assert (counted & met).mean() >= ed.RECALL - 0.0001


def test_deals_grow_slowly():
    got = [ed.deals(n) for n in (1_000, 2_000, 20_000, 200_000, 2_000_000, 200_000_000)]
    assert got[0] == (0, 1) and [t for _, t in got] == sorted(t for _, t in got) and got[-1][1] <= 32


def test_cut_cells_against_all_cosines(spark):
    rng = np.random.default_rng(7)
    a, b = threshold_pairs(rng, 300, 0.9801)
    c, d = threshold_pairs(rng, 300, 0.9799)
    cluster = rng.normal(size=DIM) + rng.normal(scale=0.1, size=(200, DIM))
    x = np.concatenate([a, b, c, d, cluster])
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in ed.near_duplicates(df, cell_size=32).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= ed.COSINE
    np.fill_diagonal(link, False)
    want = link.sum(axis=1)
    have = np.array([got[k]["n_links"] for k in range(len(x))])
    assert (have <= want).all() and have.sum() >= 0.999 * want.sum()
    assert all(got[k]["component_id"] == k % 300 for k in range(600))
    assert all(got[k]["n_links"] == 0 for k in range(600, 1200))


def test_counting_finds_what_all_cosines_find():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2048, DIM))
    x[1024:] = x[:1024] + rng.normal(scale=0.15, size=(1024, DIM))
    began = time.perf_counter()
    got = set()
    for i, j in ed.colliding(x, x):
        good = ed.verified(x, x, i, j, ed.COSINE)
        got |= set(zip(i[good].tolist(), j[good].tolist()))
    took = time.perf_counter() - began
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set(zip(*(k.tolist() for k in np.nonzero(u @ u.T >= ed.COSINE))))
    assert len(got & want) >= 0.9999 * len(want) and not got - want and took < 20
