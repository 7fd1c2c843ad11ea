from __future__ import annotations

import numpy as np
import pytest

from mattelake.operators import qc, regions
from mattelake.schemas import MASK


def square(side, *boxes, holes=()):
    m = np.zeros((side, side), int)
    for top, bottom, left, right in boxes:
        m[top:bottom, left:right] = 255
    for top, bottom, left, right in holes:
        m[top:bottom, left:right] = 0
    return m


MASKS = {
    "centre": square(100, (20, 80, 25, 75)),
    "side": square(100, (20, 80, 0, 40)),
    "bottom": square(100, (25, 100, 20, 80)),
    "empty": square(20),
    "hole": square(100, (10, 90, 10, 90), holes=[(30, 70, 30, 70)]),
    "speck": square(100, (45, 50, 45, 50)),
    "full": square(50, (0, 50, 0, 50)),
    "many": square(100, *[(10 * k, 10 * k + 5, 10 * k, 10 * k + 5) for k in range(1, 8)]),
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(k, *m.shape, m.ravel().tolist()) for k, m in MASKS.items()] + [("null", 4, 4, None)]
    out = qc.judge(qc.measure(regions.regions(spark.createDataFrame(rows, MASK))))
    return {r["image_id"]: r for r in out.collect()}


def test_plain_subject_passes(judged):
    r = judged["centre"]
    assert r["hard_reasons"] == [] and r["components"] == 1 and r["foreground_area"] == 3000
    assert r["foreground_ratio"] == pytest.approx(0.3) and not r["cropped_source_signal"]


def test_side_contact_is_a_signal_but_no_review(judged):
    r = judged["side"]
    assert r["touch_left"] and r["cropped_source_signal"] and r["hard_reasons"] == []
    assert r["span_left"] == pytest.approx(0.6) and r["qc_telemetry"] == ["cropped_source_signal"]


def test_wide_bottom_contact_is_usual(judged):
    assert judged["bottom"]["touch_bottom"] and not judged["bottom"]["cropped_source_signal"]


def test_empty_full_and_torn_masks_are_hard(judged):
    for name in ("empty", "speck", "full", "many", "null"):
        assert judged[name]["hard_reasons"] == ["mask_issue"], name
        assert len(judged[name]["hard_details"]) >= 1
    assert judged["many"]["hard_details"] == ["7 significant disconnected components"]


def test_hole_is_a_trigger(judged):
    r = judged["hole"]
    assert r["triggers"] == ["large_internal_holes"] and r["hard_reasons"] == []
    assert r["hole_pixels"] == 1600 and r["hole_ratio"] == pytest.approx((41 * 41 - 2) / 4800)


def test_similarity_of_empty_masks(spark):
    df = spark.createDataFrame([([0] * 100, [0] * 100), ([255] * 4, [255, 255, 0, 0])], "alpha_a array<int>, alpha_b array<int>")
    got = [(r["iou"], r["difference"]) for r in qc.similarity(df).collect()]
    assert sorted(got) == [(0.0, 0.0), (0.5, 0.5)]


def test_flipping_swaps_sides(spark):
    rng = np.random.default_rng(3)
    m = (rng.random((12, 9)) > 0.6) * 255
    rows = [("a", 12, 9, m.ravel().tolist()), ("b", 12, 9, m[:, ::-1].ravel().tolist())]
    a, b = qc.measure(spark.createDataFrame(rows, MASK)).orderBy("image_id").collect()
    assert a["edge_left_ratio"] == b["edge_right_ratio"] and a["span_right"] == b["span_left"] and a["span_top"] == b["span_top"]


def test_label_against_flood_fill():
    rng = np.random.default_rng(5)
    for diagonal in (True, False):
        for _ in range(30):
            m = rng.random(rng.integers(1, 14, 2)) > 0.5
            got, seen = regions.label(m, diagonal), np.zeros(m.shape, int)
            n = 0
            for y, x in zip(*np.nonzero(m)):
                if seen[y, x]:
                    continue
                n += 1
                stack = [(y, x)]
                while stack:
                    i, j = stack.pop()
                    if not (0 <= i < m.shape[0] and 0 <= j < m.shape[1]) or not m[i, j] or seen[i, j]:
                        continue
                    seen[i, j] = n
                    stack += [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if diagonal or not (a and b)]
            assert (got == seen).all()


def test_kernel_and_expressions_agree(spark):
    rng = np.random.default_rng(9)
    shapes = [(7, 7), (12, 9), (5, 40), (130, 120)]
    masks = [np.where(rng.random(s) < 0.7, rng.choice([0, 24, 100, 224, 255], s), 0).astype(np.uint8) for s in shapes]
    ints = spark.createDataFrame([(str(k), *m.shape, m.ravel().tolist()) for k, m in enumerate(masks)], MASK)
    raw = spark.createDataFrame([(str(k), *m.shape, m.tobytes()) for k, m in enumerate(masks)], "image_id string, height int, width int, mask binary")
    names = qc.MEASURES.replace(",", "").split(" ")[::2]
    a = qc.measure(regions.regions(ints)).select("image_id", *names).orderBy("image_id").collect()
    b = qc.measure_bytes(raw).select("image_id", *names).orderBy("image_id").collect()
    for x, y in zip(a, b):
        assert all(x[n] == pytest.approx(y[n]) for n in names)
