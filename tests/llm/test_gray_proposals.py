"""The near-duplicate stage's SimHash proposals through the Gray-ordered index."""

from __future__ import annotations

import numpy as np
import pytest

from mattelake.llm import gray_simhash, near_copies
from mattelake.llm.components import local_stars


@pytest.mark.parametrize("bits", [20, 24, 28])
def test_radius_keeps_pairs_at_the_threshold(bits):
    """From one side or the other in one of the four words."""
    rng = np.random.default_rng(bits)
    lost = 0
    for _ in range(3000):
        h = rng.integers(0, 2**64, 200, np.uint64)
        (a, x), (b, y) = near_copies.fingerprint(h[:180]), near_copies.fingerprint(np.concatenate([h[:160], h[180:]]))
        cost = [sum(np.bitwise_count((a ^ b) & p).astype(int) << k for k, p in enumerate(near_copies._planes(d[::2], d[1::2], bits))) for d in (x, y)]
        lost += bool(np.minimum(*cost).min() > bits // near_copies.BITS_A_UNIT)
    assert lost <= 3
    assert near_copies.weighed_bits(1 << (bits - 1)) == bits


@pytest.mark.parametrize("sizes", [(8, 1), (80, 10), (720, 90), (160, 40)])
def test_index_alone_finds_pairs_at_the_threshold(spark, sizes):
    """Pairs at similarity 0.8 among unrelated sets: each adds its own shingles, or the larger one does."""
    rng = np.random.default_rng(sum(sizes))
    rows, n = [], 1000 if sizes[0] < 700 else 300
    for k in range(n):
        both, own = sizes
        h = rng.integers(0, 2**64, both + 2 * own, np.uint64)
        pair = (h[: both + own], np.concatenate([h[:both], h[both + own :]])) if sizes != (160, 40) else (h[:both], h[: both + own])
        rows += [(2 * k + i, len(f), *(x.view(np.int64).tolist() for x in near_copies.fingerprint(f))) for i, f in enumerate(pair)]
    marked = spark.createDataFrame(rows, "node long, size long, words array<long>, digits array<long>")
    links = near_copies.neighbours(marked).collect()
    node, root = local_stars(np.array([r["u"] for r in links]), np.array([r["v"] for r in links]))
    part = dict(zip(node.tolist(), root.tolist()))
    assert sum(r["u"] // 2 != r["v"] // 2 for r in links) <= 0.02 * n  # proposals that the exact similarity will refuse
    assert sum(part.get(2 * k, 2 * k) == part.get(2 * k + 1, 2 * k + 1) for k in range(n)) >= 0.998 * n


def test_weighted_search_against_brute_force():
    rng = np.random.default_rng(1)
    words, queries = rng.integers(0, 2**64, 700, np.uint64), rng.integers(0, 2**64, 90, np.uint64)
    weight = rng.integers(0, 16, (90, 64))
    planes = tuple(np.packbits((weight >> b & 1).astype(np.uint8), axis=1).view(">u8").ravel().astype(np.uint64) for b in range(4))
    order = words[np.argsort(gray_simhash.gray_rank(words))]
    differ = np.unpackbits((queries[:, None] ^ order[None]).astype(">u8").view(np.uint8).reshape(90, 700, 8), axis=2)
    want = set(zip(*np.nonzero((differ * weight[:, None]).sum(axis=2) <= 150)))
    got = {(a, b) for q, leaf in gray_simhash.GrayIndex(order).search(queries, 150, 32, planes) for a, b in zip(q, leaf)}
    assert got == want and 0 < len(want) < 90 * 700 / 4


def test_stage_takes_proposals_from_the_index(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(near_copies, "bands", lambda found: np.empty(0, np.uint64))
    text = " ".join(f"w{k}" for k in range(200))
    rows = [(1, text), (2, text.replace("w77 ", "x ")), (3, text.replace("w20 ", "y ").replace("w150 ", "z ")), (4, " ".join(f"v{k}" for k in range(200)))]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4]
