from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mattelake.operators import boxes
from mattelake.schemas import BOX

NAMES = ("x1", "y1", "x2", "y2", "score", "coverage", "center_coverage")


def image(spark, rows, people=None):
    return spark.createDataFrame([("i", [dict(zip(NAMES, r)) for r in rows], people)], f"image_id string, boxes array<{boxes.BOX_TYPE}>, person_count int")


def chosen(spark, rows):
    return boxes.select_prompts(image(spark, rows)).first()["chosen"]


def kept(spark, rows):
    return [k for k, b in enumerate(chosen(spark, rows)) if b["keep"]]


def triggers(spark, rows, people=None):
    return boxes.select_prompts(image(spark, rows, people)).first()


def test_low_score_and_small_box_go(spark):
    assert kept(spark, [(10, 10, 90, 190, 0.99, 0.80, 0.90), (140, 20, 160, 60, 0.91, 0.0, 0.0)]) == [0]


def test_partial_person_at_the_limit_stays(spark):
    assert kept(spark, [(0, 0, 100, 200, 0.99, 0.80, 0.90), (120, 20, 180, 120, 0.95, 0.10, 0.02)]) == [0, 1]


def test_union_of_two_people_is_a_duplicate(spark):
    out = chosen(spark, [(0, 0, 60, 180, 0.99, 0.80, 0.90), (65, 0, 125, 180, 0.97, 0.80, 0.90), (0, 0, 125, 180, 0.91, 0.20, 0.0)])
    assert out[2]["covered"] == 120 * 180 and out[2]["branch"] == "duplicate" and not out[2]["keep"]


def test_missing_scores_count_as_one(spark):
    assert kept(spark, [(0, 0, 10, 10, None, 0.9, None)]) == [0]


def test_triggers_in_order(spark):
    r = triggers(spark, [(0, 0, 100, 200, 0.99, 0.58, 0.50), (120, 0, 220, 200, 0.95, 0.30, 0.80)])
    assert r["kept"] == 2 and r["human_triggers"] == ["person_center_coverage", "person_box_coverage", "multiple_people_coverage"]


def test_people_without_boxes_all_count(spark):
    r = triggers(spark, [], 2)
    assert (r["kept"], r["filtered"], r["human_triggers"]) == (2, 0, ["person_box_coverage", "person_center_coverage"])
    assert triggers(spark, [], 0)["human_triggers"] == [] and triggers(spark, [], 0)["kept"] == 0


def test_details_of_filtered_boxes(spark):
    r = triggers(spark, [(0, 0, 100, 100, 0.99, 0.9, 0.9), (0, 0, 10, 10, 0.7, 0.0, 0.0), (90, 90, 100, 110, 0.9, 0.1, 0.0)])
    assert r["filtered"] == 2
    assert r["filter_details"] == ["person 2: detector confidence 0.700 below prompt threshold", "person 3: low-value prompt (relative area=0.020, overlap=0.500, coverage=0.100)"]


@pytest.mark.parametrize("seed", range(3))
def test_overlap_against_pixels(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(12):
        x, y = rng.integers(0, 20, 2)
        w, h = rng.integers(1, 14, 2)
        rows.append((int(x), int(y), int(x + w), int(y + h), 0.9, float(rng.choice([0.9, 0.1])), 0.0))
    got = [b["covered"] for b in chosen(spark, rows)]
    for k, (x1, y1, x2, y2, *_) in enumerate(rows):
        grid = np.zeros((40, 40), bool)
        for j, (a, b, c, d, _, cov, _) in enumerate(rows):
            if j != k and cov >= 0.45:
                grid[b:d, a:c] = True
        assert got[k] == grid[y1:y2, x1:x2].sum()


def test_clamp_drops_outside_boxes(spark):
    frame = spark.createDataFrame([("i", 0, -5, -5, 4, 4, 1.0, 0.0, 0.0), ("i", 1, 30, 30, 40, 40, 1.0, 0.0, 0.0)], BOX)
    out = boxes.clamp(frame, F.lit(20), F.lit(20)).collect()
    assert [(r["x1"], r["y1"], r["x2"], r["y2"]) for r in out] == [(0, 0, 4, 4)]


def test_coverage_by_hand():
    mask = np.zeros((40, 60), np.uint8)
    mask[:, :30] = 200
    found = [{"x1": -3.4, "y1": 0, "x2": 59.6, "y2": 90, "score": 0.8}, {"x1": 40, "y1": 0, "x2": 50, "y2": 20, "score": 0.9}, {"x1": 0, "y1": 0, "x2": 9, "y2": 9, "score": 0.3}, {"x1": 0, "y1": 0, "x2": 9, "y2": 9, "score": 0.9, "label": 3}, {"x1": 70, "y1": 0, "x2": 90, "y2": 9, "score": 0.9}]
    out, missing, uncertain = boxes.coverage(mask, found)
    assert [(b["x1"], b["y1"], b["x2"], b["y2"], b["coverage"]) for b in out] == [(0, 0, 60, 40, 0.5), (40, 0, 50, 20, 0.0)]
    assert out[0]["center_coverage"] == mask[4:36, 13:47].astype(bool).mean() and (missing, uncertain) == (1, 0)
    mask[:, 28:] = 0
    mask[:, 12:28] = 0
    assert boxes.coverage(mask, [{"x1": 0, "y1": 0, "x2": 60, "y2": 40, "score": 0.9}])[1:] == (1, 0)


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_erosion_against_pixels(radius):
    rng = np.random.default_rng(radius)
    mask = rng.random((30, 41)) < 0.97
    half = boxes.ellipse_rows(radius)
    assert half[radius] == radius and half == half[::-1]
    want = np.zeros_like(mask)
    for y in range(30):
        for x in range(41):
            around = [(y + dy, x + dx) for dy, n in zip(range(-radius, radius + 1), half) for dx in range(-n, n + 1)]
            want[y, x] = all(mask[a, b] for a, b in around if 0 <= a < 30 and 0 <= b < 41)
    assert (boxes.erode(mask, radius) == want).all()


def test_strong_check():
    mask = np.zeros((60, 60), np.uint8)
    mask[10:50, 10:30] = 255
    own = np.zeros((60, 60), bool)
    own[10:50, 10:50] = True
    prompt = {"x1": 5, "y1": 5, "x2": 55, "y2": 55, "person": 1}
    got = boxes.confirm(mask, [prompt], [own], [0.9], people=2)
    assert got["checked_people"] == 1 and 0.45 < got["min_recall"] < 0.55 and got["reasons"] == ["missing_body_part", "human_mask_disagreement", "multiple_people_uncertain"]
    assert got["details"][0].startswith("person 2: SAM recall=0.")
    assert boxes.confirm(mask, [prompt], [own], [0.7])["checked_people"] == 0
    assert boxes.confirm(mask, [prompt], [mask > 0], [0.9])["min_recall"] == 1.0
    thin = np.zeros((60, 60), bool)
    thin[20, 12:28] = True
    assert boxes.confirm(mask, [prompt], [thin], [0.9])["min_recall"] == 1.0
    assert not boxes.confirm(mask, [], [], [])["ran"]
