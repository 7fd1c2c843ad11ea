"""Near-duplicate vectors, components and the WebP codec."""

from __future__ import annotations

import numpy as np
import pytest

from mattelake.llm import embedding_dedup, webp
from mattelake.llm.components import connected_components


def vectors(rng, n, dim=16):
    base = rng.normal(size=(n, dim))
    close = np.repeat(base[: n // 4], 4, axis=0) + rng.normal(scale=0.05, size=(n // 4 * 4, dim))
    return np.concatenate([base, close, base[:5], base[5:8] * 3]).astype(np.float32)


@pytest.mark.parametrize("cell_size", [8, 2048])
def test_links_against_brute_force(spark, cell_size):
    rng = np.random.default_rng(cell_size)
    x = vectors(rng, 60)
    label = rng.integers(0, 2, len(x))
    ids = rng.permutation(len(x)) * 3
    rows = [(int(i), v.tolist(), int(y), "e") for i, v, y in zip(ids, x, label)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell string").repartition(3)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, cell_size=cell_size).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98 - 1e-12) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    assert [got[int(i)]["n_links"] for i in ids] == link.sum(axis=1).tolist()
    reach = link | np.eye(len(x), dtype=bool)
    for _ in range(8):
        reach = reach @ reach
    assert [got[int(i)]["component_id"] for i in ids] == [int(ids[r].min()) for r in reach]
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_odd_vectors(spark):
    one = [1.0, 2.0]
    rows = [(1, one, 0), (2, one, 0), (3, one, 1), (4, one, None), (5, None, 0), (6, [0.0, 0.0], 0), (7, [float("nan"), 1.0], 0), (8, [float("inf"), 1.0], 0), (9, [None, 1.0], 0), (10, [], 0), (11, [1.0, 2.0, 0.0], 0), (None, one, 0), (2, one, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in embedding_dedup.near_duplicates(df).collect():
        got.setdefault(r["vec_id"], []).append(r)
    assert got[1][0]["n_links"] == 3 and got[1][0]["kept"] and [r["n_links"] for r in got[2]] == [3, 3] and got[2][0]["component_id"] == 1
    assert got[None][0]["component_id"] is None and not got[None][0]["kept"]
    for i in (3, 4, 5, 6, 7, 8, 9, 10, 11):
        assert (got[i][0]["n_links"], got[i][0]["component_id"], got[i][0]["kept"]) == (0, i, True), i
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_calibration():
    need = embedding_dedup.calibrate()
    rng = np.random.default_rng(0)
    d = embedding_dedup.directions(64)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    other = 0.98 * a + np.sqrt(1 - 0.98**2) * b
    hits = (np.abs((a - other) @ d) <= embedding_dedup.WINDOW * embedding_dedup.step(0.98, 64)).sum(axis=1)
    assert (hits >= need).mean() >= 0.999


@pytest.mark.parametrize("seed", range(2))
def test_components_against_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame([*edges, (None, 3), (7000, 7000)], "u long, v long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {k: find(k) for k in root}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (9, 1), (7, 5), (21, 33)])
def test_webp_round_trips(shape):
    rng = np.random.default_rng(sum(shape))
    noise = rng.integers(0, 2**32, shape, dtype=np.uint32)
    smooth = webp._packed(np.cumsum(np.cumsum(rng.integers(-1, 2, (*shape, 4)), 0), 1) + 128)
    few = noise.ravel()[rng.integers(0, min(5, noise.size), shape)]
    blocks = (webp._count(shape[0], 3), webp._count(shape[1], 3))
    ways = [{}, {"references": False}, {"cache_bits": 4}, {"green": True}, {"cross": rng.integers(0, 2**32, blocks, dtype=np.uint32)}]
    ways += [{"predictor": np.full(blocks, m)} for m in range(14)]
    ways += [{"predictor": rng.integers(0, 14, blocks), "green": True, "cross": rng.integers(0, 2**32, blocks, dtype=np.uint32), "cache_bits": 7, "groups": rng.integers(0, 3, blocks)}]
    for img in (noise, smooth, few):
        for way in [*ways, *([{"palette": True}, {"palette": True, "cache_bits": 2}] if len(np.unique(img)) <= 256 else [])]:
            assert (webp.decode(webp.encode(img, **way)) == img).all(), way


@pytest.mark.parametrize("colors", [1, 2, 3, 4, 5, 16, 17, 200])
def test_webp_palettes_of_all_bundles(colors):
    rng = np.random.default_rng(colors)
    img = rng.integers(0, 2**32, colors, dtype=np.uint32)[rng.integers(0, colors, (11, 13))]
    assert (webp.decode(webp.encode(img, palette=True)) == img).all()


def test_grey_payloads():
    rng = np.random.default_rng(0)
    for img in (np.zeros((3, 64), np.uint8), rng.integers(0, 256, (900, 256), dtype=np.uint8), np.repeat(rng.integers(0, 9, (40, 8), dtype=np.uint8), 40, axis=1), np.minimum(rng.geometric(0.3, (400, 64)), 255).astype(np.uint8)):
        assert (webp.grey(webp.decode(webp.encode_gray(img))) == img).all()


def test_code_lengths_stay_within_the_limit():
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    for longest in (7, 15):
        n = webp.code_lengths(np.array(fib), longest)
        assert n.max() <= longest and sum(2.0 ** -n) == 1


@pytest.mark.parametrize("cut", [0, 10, 24, 40, 60])
def test_broken_files_raise(cut):
    data = webp.encode(np.arange(400, dtype=np.uint32).reshape(20, 20) * 77777)
    with pytest.raises((webp.WebPError, IndexError)):
        webp.decode(data[:cut])


def test_shared_tables_can_be_released(spark):
    import os

    from mattelake.llm import common

    kept = common.materialise(spark.range(3).toDF("n"))
    path = kept.shared_path.removeprefix("file://")
    assert kept.count() == 3 and os.path.isdir(path) and path.startswith(common.shared_dir(spark).removeprefix("file://"))
    common.discard(kept)
    assert not os.path.exists(path)


def test_public_sample_image():
    """The one-pixel lossless image that browsers' feature tests use, written by another encoder."""
    import base64

    data = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert webp.decode(data).tolist() == [[0]]
