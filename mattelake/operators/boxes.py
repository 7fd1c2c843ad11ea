"""Person boxes: geometry, coverage, overlap, and which of them deserve the strong verifier.

An image's boxes are one array column. What compares boxes of an image works on this array, a row at a
time, so nothing is exploded, joined or shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mattelake.config import MaskRules, VerifyRules
from mattelake.operators.kernels import by_row

BOX_TYPE = "struct<x1:int,y1:int,x2:int,y2:int,score:double,coverage:double,center_coverage:double>"


def clamp(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes cut to the frame; those without an inside go."""
    cut = boxes.withColumns({"x1": F.greatest(F.lit(0), "x1"), "y1": F.greatest(F.lit(0), "y1"), "x2": F.least(width, "x2"), "y2": F.least(height, "y2")})
    return cut.where("x2 > x1 and y2 > y1")


def covered(box: dict, others: list[dict]) -> int:
    """Pixels of a box that the others cover together: the grid of their common parts' edges, cell by cell."""
    parts = [(max(box["x1"], o["x1"]), max(box["y1"], o["y1"]), min(box["x2"], o["x2"]), min(box["y2"], o["y2"])) for o in others]
    parts = [p for p in parts if p[2] > p[0] and p[3] > p[1]]
    if len(parts) < 2:
        return sum((x2 - x1) * (y2 - y1) for x1, y1, x2, y2 in parts)
    xs, ys = sorted({x for p in parts for x in p[::2]}), sorted({y for p in parts for y in p[1::2]})
    hit = np.zeros((len(ys) - 1, len(xs) - 1), bool)
    at_x, at_y = {x: k for k, x in enumerate(xs)}, {y: k for k, y in enumerate(ys)}
    for x1, y1, x2, y2 in parts:
        hit[at_y[y1] : at_y[y2], at_x[x1] : at_x[x2]] = True
    return int(np.diff(ys) @ hit @ np.diff(xs))


CHOSEN = f"chosen array<{BOX_TYPE[:-1]},area:bigint,relative_area:double,covered:bigint,branch:string,keep:boolean>>, kept bigint, filtered bigint, filter_details array<string>, human_triggers array<string>"


def choose(found: list[dict] | None, rules: VerifyRules = VerifyRules(), people: int | None = None) -> dict:
    """``CHOSEN`` of one image: its boxes in order, which of them deserve the strong verifier, and what speaks for it.

    A score not given counts as 1, a coverage not given as 0. ``covered`` counts the other supported boxes.
    Triggers come in box order, the shared one last. Without boxes every one of ``people`` counts as kept and
    uncovered.
    """
    r = rules
    default = {"score": 1.0, "coverage": 0.0, "center_coverage": 0.0}
    full = [b | {k: v for k, v in default.items() if b.get(k) is None} for b in found or []]
    for b in full:
        b["area"] = max(0, b["x2"] - b["x1"]) * max(0, b["y2"] - b["y1"])
    most = max([1, *(b["area"] for b in full)])
    supported = [b["coverage"] >= r.box_coverage or b["center_coverage"] >= r.center_coverage for b in full]
    details, triggers = [], []
    for k, b in enumerate(full):
        b["relative_area"] = b["area"] / most
        b["covered"] = covered(b, [o for j, o in enumerate(full) if j != k and supported[j]])
        share = b["covered"] / max(1, b["area"])
        if b["score"] < r.prompt_confidence:
            b["branch"] = "low_score"
        elif supported[k]:
            b["branch"] = "supported"
        elif share >= r.overlap and b["coverage"] < r.box_coverage * 0.55:
            b["branch"] = "duplicate"
        elif b["relative_area"] + 1e-9 >= r.min_relative_area * 0.75 and b["coverage"] >= r.box_coverage * 0.2 and b["center_coverage"] < r.center_coverage * 0.27:
            b["branch"] = "partial"
        else:
            b["branch"] = "significant" if b["relative_area"] >= r.min_relative_area else "small"
        b["keep"] = b["branch"] in ("supported", "partial", "significant")
        if b["branch"] == "low_score":
            details.append(f"person {k + 1}: detector confidence {b['score']:.3f} below prompt threshold")
        elif not b["keep"]:
            details.append(f"person {k + 1}: low-value prompt (relative area={b['relative_area']:.3f}, overlap={share:.3f}, coverage={b['coverage']:.3f})")
        else:
            triggers += ["person_box_coverage"] * (b["coverage"] < r.box_coverage) + ["person_center_coverage"] * (b["center_coverage"] < r.center_coverage)
    kept = [b for b in full if b["keep"]]
    if len(kept) > 1 and any(b["coverage"] < r.multi_coverage for b in kept):
        triggers.append("multiple_people_coverage")
    if not full and people:
        triggers = ["person_box_coverage", "person_center_coverage"]
    return {"chosen": full, "kept": len(kept) if full else people or 0, "filtered": len(full) - len(kept), "filter_details": details, "human_triggers": list(dict.fromkeys(triggers))}


def select_prompts(images: DataFrame, rules: VerifyRules = VerifyRules(), boxes: str = "boxes") -> DataFrame:
    """images with ``CHOSEN``, of their boxes (an array) and person_count where that is given."""
    return by_row(images, CHOSEN, lambda row: choose(row[boxes], rules, row.get("person_count")), together=4096)


def coverage(mask: np.ndarray, found: list[dict], rules: MaskRules = MaskRules()) -> tuple[list[dict], int, int]:
    """Detections of one image as (boxes, missing, uncertain).

    Only people (label 1 where a label is given) of enough confidence stay; boxes are rounded half to even
    and cut to the frame. coverage is the foreground's share of a box, center_coverage that of its middle,
    which leaves out 22 % of the width and 10 % of the height on each side.
    """
    h, w = mask.shape
    # A summed-area table answers every box in four reads.
    table = np.zeros((h + 1, w + 1), np.int64)
    np.cumsum(np.cumsum(mask >= rules.foreground, axis=0), axis=1, out=table[1:, 1:])

    def share(x1: int, y1: int, x2: int, y2: int) -> float:
        if x2 <= x1 or y2 <= y1:
            return 0.0
        return float(table[y2, x2] - table[y1, x2] - table[y2, x1] + table[y1, x1]) / ((x2 - x1) * (y2 - y1))

    out, missing, uncertain = [], 0, 0
    for b in found:
        score = 1.0 if b.get("score") is None else float(b["score"])
        if b.get("label", 1) != 1 or score < rules.person_confidence:
            continue
        x1, y1, x2, y2 = (int(np.rint(b[k])) for k in ("x1", "y1", "x2", "y2"))
        x1, y1, x2, y2 = max(0, x1), max(0, y1), min(w, x2), min(h, y2)
        if x2 <= x1 or y2 <= y1:
            continue
        mx, my = int((x2 - x1) * 0.22), int((y2 - y1) * 0.10)
        whole, middle = share(x1, y1, x2, y2), share(x1 + mx, y1 + my, x2 - mx, y2 - my)
        if whole < rules.min_person_coverage or middle < rules.min_person_center:
            missing += 1
        elif whole < rules.min_person_coverage * 1.35:
            uncertain += 1
        out.append({"x1": x1, "y1": y1, "x2": x2, "y2": y2, "score": score, "coverage": whole, "center_coverage": middle})
    return out, missing, uncertain


def plane(row: dict, name: str) -> np.ndarray:
    """A mask column, bytes or an array of ints, as (height, width)."""
    v = row[name]
    return (np.frombuffer(v, np.uint8) if isinstance(v, bytes) else np.array(v)).reshape(row["height"], row["width"])


def measured(images: DataFrame, found: str = "found", mask: str = "mask", rules: MaskRules = MaskRules()) -> DataFrame:
    """images (height, width, a mask, detections as array of structs) with boxes, missing and uncertain by ``coverage``."""

    def work(row: dict) -> dict:
        kept, missing, uncertain = coverage(plane(row, mask), row[found] or [], rules)
        return {"boxes": kept, "missing": missing, "uncertain": uncertain}

    return by_row(images, f"boxes array<{BOX_TYPE}>, missing int, uncertain int", work)


VERDICT = "ran boolean, checked_people int, reasons array<string>, details array<string>, min_recall double, min_iou double"


def confirmed(images: DataFrame, prompts: str = "prompts", masks: str = "masks", scores: str = "scores", mask: str = "mask", rules: VerifyRules = VerifyRules()) -> DataFrame:
    """images with ``VERDICT`` by ``confirm``: prompts as array of structs, a mask (array of ints) and a score for each."""

    def work(row: dict) -> dict:
        size = row["height"], row["width"]
        own = [np.array(m).reshape(size) > 0 for m in row[masks]]
        return confirm(plane(row, mask), [b | {"person": k} for k, b in enumerate(row[prompts])], own, row[scores], rules)

    return by_row(images, VERDICT, work)


def ellipse_rows(radius: int) -> list[int]:
    """Half-widths of the rows, from top to bottom, of the ellipse of this radius in a square of 2 r + 1."""
    return [int(np.rint(radius * np.sqrt((radius * radius - dy * dy) / (radius * radius)))) for dy in range(-radius, radius + 1)]


def erode(mask: np.ndarray, radius: int) -> np.ndarray:
    """Pixels whose whole ellipse is set; beyond the frame counts as set."""
    h, w = mask.shape
    gaps = np.zeros((h + 2 * radius, w + 2 * radius + 1), np.int64)
    gaps[radius : radius + h, radius + 1 : radius + 1 + w] = ~mask
    gaps = gaps.cumsum(axis=1)
    out = np.ones((h, w), bool)
    for k, half in enumerate(ellipse_rows(radius)):
        rows = gaps[k : k + h]
        out &= rows[:, radius + half + 1 : radius + half + 1 + w] == rows[:, radius - half : radius - half + w]
    return out


def confirm(mask: np.ndarray, prompts: list[dict], masks: list[np.ndarray], scores: list[float], rules: VerifyRules = VerifyRules(), people: int | None = None) -> dict:
    """The strong check of one image: prompts (boxes with ``person``, counted from 0) against the verifier's masks.

    Masks of too little confidence, and empty ones, are not checked. A person's core is the mask within the
    box, eroded by the boundary tolerance, or the whole of it where nothing would be left.
    """
    candidate = mask >= rules.alpha_threshold
    radius = max(1, round(min(mask.shape) * rules.boundary))
    recalls, ious, details, missing = [], [], [], 0
    for k, (b, own) in enumerate(zip(prompts, masks)):
        if (float(scores[k]) if k < len(scores) else 0.0) < rules.mask_confidence:
            continue
        at = np.s_[b["y1"] : b["y2"], b["x1"] : b["x2"]]
        local, have = np.asarray(own, bool)[at], candidate[at]
        if not local.any():
            continue
        core = erode(local, radius)
        core = core if core.any() else local
        hit, size = int((core & have).sum()), int(core.sum())
        recall, gap = hit / max(1, size), (size - hit) / max(1, core.size)
        recalls.append(recall)
        ious.append(hit / max(1, int((core | have).sum())))
        if recall < rules.min_recall and gap >= rules.min_missing:
            missing += 1
            details.append(f"person {b['person'] + 1}: SAM recall={recall:.3f}, missing box ratio={gap:.3f}")
    reasons = ["missing_body_part", "human_mask_disagreement"] if missing else []
    if missing and (len(prompts) if people is None else people) > 1:
        reasons.append("multiple_people_uncertain")
    return {"ran": bool(prompts), "checked_people": len(recalls), "reasons": reasons, "details": details, "min_recall": min(recalls, default=None), "min_iou": min(ious, default=None)}
