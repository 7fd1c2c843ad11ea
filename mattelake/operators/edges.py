"""Edge artifacts of cut-outs: an Arrow kernel, one row per image in and out.

Only transition pixels are looked at. For each of them the ray along the alpha gradient is read at all
steps at once as a (steps, pixels) table, and the first step inside and outside is its argmax.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mattelake.config import EdgeRules
from mattelake.operators.compose import resample
from mattelake.operators.kernels import by_row
from mattelake.operators.regions import speckles
from mattelake.schemas import SCORES, extend

GREY = np.array([0.299, 0.587, 0.114])


def _window_sum(a: np.ndarray, weights_y, weights_x) -> np.ndarray:
    """Separable stencil with mirrored borders, the edge pixel not repeated."""
    ry, rx = len(weights_y) // 2, len(weights_x) // 2
    h, w = a.shape
    mode = "reflect" if min(h, w) > max(ry, rx) else "edge"
    wide = np.pad(a, ((ry, ry), (rx, rx)), mode=mode)
    rows = sum(k * wide[i : i + h] for i, k in enumerate(weights_y))
    return sum(k * rows[:, i : i + w] for i, k in enumerate(weights_x))


def gradients(alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel derivatives along x and y."""
    return _window_sum(alpha, (1, 2, 1), (-1, 0, 1)), _window_sum(alpha, (-1, 0, 1), (1, 2, 1))


def deviation(grey: np.ndarray) -> np.ndarray:
    """Standard deviation in 5 x 5 windows; exact sums where the samples are whole numbers."""
    ones = (1,) * 5
    total = _window_sum(grey, ones, ones)
    return np.sqrt(np.maximum(25 * _window_sum(grey * grey, ones, ones) - total * total, 0)) / 25


def texture(rgb: np.ndarray) -> np.ndarray:
    """Standard deviation of grey in 5 x 5 windows."""
    return deviation(rgb @ GREY)


def stencils(masks: DataFrame, mask: str = "alpha") -> DataFrame:
    """masks (height, width, an array of 8-bit samples) with gx, gy and deviation of every pixel, and the number of transition pixels."""

    def work(row: dict) -> dict:
        a = np.array(row[mask], float).reshape(row["height"], row["width"])
        gx, gy = gradients(a)
        return {"gx": gx.ravel(), "gy": gy.ravel(), "deviation": deviation(a).ravel(), "transition": len(Rays(a / 255, 1).y)}

    return by_row(masks, "gx array<double>, gy array<double>, deviation array<double>, transition int", work)


def dilate(mask: np.ndarray, r: int = 2) -> np.ndarray:
    return _window_sum(mask.astype(float), (1,) * (2 * r + 1), (1,) * (2 * r + 1)) > 0 if min(mask.shape) > r else np.full(mask.shape, mask.any())


class Rays:
    """Transition pixels with the reference pixels along their gradient."""

    def __init__(self, alpha: np.ndarray, radius: int):
        gx, gy = gradients(alpha)
        size = np.hypot(gx, gy)
        self.y, self.x = np.nonzero((alpha > 0.035) & (alpha < 0.965) & (size > 0.015))
        n = np.maximum(size[self.y, self.x], 1e-6)
        self.nx, self.ny, self.shape = gx[self.y, self.x] / n, gy[self.y, self.x] / n, alpha.shape
        steps = np.arange(1, radius + 1)[:, None]
        iy, ix = self.at(steps)
        oy, ox = self.at(-steps)
        hit_in, hit_out = alpha[iy, ix] >= 0.96, alpha[oy, ox] <= 0.03
        self.valid = hit_in.any(axis=0) & hit_out.any(axis=0)
        first_in, first_out = hit_in.argmax(axis=0), hit_out.argmax(axis=0)
        col = np.arange(len(self.y))
        self.inner, self.outer = (iy[first_in, col], ix[first_in, col]), (oy[first_out, col], ox[first_out, col])
        self.width = first_in + first_out + 2
        self.far = self.at(-(radius + max(3, radius // 3)))

    def at(self, step):
        """Pixels at a (signed) step towards the inside, rounded and kept in the frame."""
        y = np.clip(np.rint(self.y + self.ny * step).astype(int), 0, self.shape[0] - 1)
        x = np.clip(np.rint(self.x + self.nx * step).astype(int), 0, self.shape[1] - 1)
        return y, x


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1)


def score(rgb: np.ndarray, cutout: np.ndarray, alpha: np.ndarray, rules: EdgeRules = EdgeRules(), heat: np.ndarray | None = None) -> dict:
    """The ten scores and the edge sample of one image; samples are floats from 0 to 1.

    ``heat``, an array of the image's size, takes up the strength of what was found at every pixel.
    """
    rays = Rays(alpha, rules.radius)
    ok = rays.valid
    out = dict.fromkeys(SCORES, 0.0) | {"edge_pixels": int(ok.sum())}
    if out["edge_pixels"] < rules.min_edge_pixels:
        return out
    pick = lambda img, at: img[at[0][ok], at[1][ok]]
    own, inner, outer, far = pick(cutout, (rays.y, rays.x)), pick(cutout, rays.inner), pick(rgb, rays.outer), pick(rgb, rays.far)
    a, width, tex = pick(alpha, (rays.y, rays.x)), rays.width[ok], pick(texture(rgb), (rays.y, rays.x))
    stable = (a >= 0.08) & (a <= 0.88)
    n_stable = max(1, int(stable.sum()))

    moved, towards = own - inner, outer - inner
    tint, pull = moved - moved.mean(axis=1, keepdims=True), towards - towards.mean(axis=1, keepdims=True)
    along, reach = _dot(tint, pull), np.linalg.norm(pull, axis=1)
    seen = np.maximum(0, along / np.maximum(reach, 1e-5)) * a
    same = along / np.maximum(np.linalg.norm(tint, axis=1) * reach, 1e-5)
    top = outer.max(axis=1)
    saturation = np.where(top > 0, (top - outer.min(axis=1)) / np.maximum(top, 1e-12), 0)
    tinted = stable & (saturation > 0.18) & (same > 0.45) & (seen > 0.012)
    out["chromatic"] = min(1.0, tinted.sum() / n_stable / 0.08)
    shift, way = moved.mean(axis=1), towards.mean(axis=1)
    greyed = stable & (saturation <= 0.18) & (shift * way > 0) & (np.abs(shift) * a > 0.045) & (np.abs(way) > 0.08)
    out["neutral"] = min(1.0, greyed.sum() / n_stable / 0.08)
    out["residual"] = max(out["chromatic"], out["neutral"])

    scale = min(1.0, max(alpha.shape) / 640)
    usual, excess = max(3.0, 7 * scale), max(6.0, 12 * scale)
    if stable.any():
        out["loose"] = float(np.clip((np.percentile(width[stable], 90) - usual) / excess, 0, 1))
    low = (alpha > 0.02) & (alpha < 0.35) & ~dilate(alpha >= 0.5)
    dust = speckles(low)
    out["instability"] = min(1.0, dust.sum() / out["edge_pixels"] / 0.20)

    omitted = np.clip((np.linalg.norm(outer - far, axis=1) - np.linalg.norm(outer - inner, axis=1) - 0.025) / 0.20, 0, 1)
    out["compact"] = float(np.percentile(omitted * np.clip((0.12 - tex) / 0.09, 0, 1), 97))
    out["hair"] = float(np.percentile(omitted * np.clip(tex / 0.12, 0, 1), 97))
    out["semantic"] = float(np.sqrt(out["chromatic"] * out["loose"]))
    joint = tinted & (width >= excess) & (tex < 0.045)
    out["agreement"] = min(1.0, joint.sum() / max(1, tinted.sum()) / 0.02)
    out["total"] = max(out["semantic"], 0.72 * out["residual"], 0.72 * out["loose"], 0.60 * out["compact"], 0.55 * out["hair"], 0.60 * out["instability"])
    if heat is not None:
        at = rays.y[ok], rays.x[ok]
        heat[at] = np.clip(np.maximum(seen, np.abs(shift) * a) / 0.12, 0, 1)
        heat[at] = np.maximum(heat[at], np.where(stable, np.clip((width - usual) / excess, 0, 1), 0))
        heat[dust] = 1
    return {k: v if k == "edge_pixels" else float(v) for k, v in out.items()}


def analysed(rgb: np.ndarray, cutout: np.ndarray, mask: np.ndarray, rules: EdgeRules = EdgeRules(), heat: bool = False) -> tuple[dict, np.ndarray | None]:
    """``score`` of 8-bit planes, scaled down to ``analysis_size`` first; and the heat map at that size if asked for."""
    if rgb.shape != cutout.shape or rgb.shape[:2] != mask.shape:
        raise ValueError("image and cut-out differ in size")
    h, w = mask.shape
    k = min(1.0, rules.analysis_size / max(h, w))
    size = max(1, round(h * k)), max(1, round(w * k))
    planes = [p if size == (h, w) else resample(p, *size) for p in (rgb, cutout, mask)]
    hot = np.zeros(size) if heat else None
    return score(*(p / 255 for p in planes), rules, hot), hot


DIAGNOSTICS = ("raw_share", "tint_share", "seen_p99", "width_p90", "joint_share", "joint_of_tint", "smooth_joint_of_tint")


def diagnostics(rgb: np.ndarray, cutout: np.ndarray, alpha: np.ndarray, radius: int = 16, wide: float = 12.0) -> dict:
    """Offline ratios of one image: background pull by colour and by tint alone, widths, and where both meet."""
    rays = Rays(alpha, radius)
    keep = rays.valid & (alpha[rays.y, rays.x] >= 0.08) & (alpha[rays.y, rays.x] <= 0.88)
    if not keep.any():
        return dict.fromkeys(DIAGNOSTICS, 0.0)
    at = lambda img, p: img[p[0][keep], p[1][keep]]
    own, inner, outer = at(cutout, (rays.y, rays.x)), at(cutout, rays.inner), at(rgb, rays.outer)
    a, width, tex = at(alpha, (rays.y, rays.x)), rays.width[keep], at(texture(rgb), (rays.y, rays.x))
    top = outer.max(axis=1)
    vivid = np.where(top > 0, (top - outer.min(axis=1)) / np.maximum(top, 1e-12), 0) > 0.18

    def pulled(moved, towards):
        along, reach = _dot(moved, towards), np.linalg.norm(towards, axis=1)
        seen = np.maximum(0, along / np.maximum(reach, 1e-5)) * a
        same = along / np.maximum(np.linalg.norm(moved, axis=1) * reach, 1e-5)
        return seen, vivid & (same > 0.45) & (seen > 0.012)

    moved, towards = own - inner, outer - inner
    seen, raw = pulled(moved, towards)
    _, tint = pulled(moved - moved.mean(axis=1, keepdims=True), towards - towards.mean(axis=1, keepdims=True))
    joint = tint & (width >= wide)
    n, n_tint = len(a), max(1, int(tint.sum()))
    values = (raw.sum() / n, tint.sum() / n, np.percentile(seen, 99), np.percentile(width, 90), joint.sum() / n, joint.sum() / n_tint, (joint & (tex < 0.045)).sum() / n_tint)
    return dict(zip(DIAGNOSTICS, map(float, values)))


def artifact_diagnostics(images: DataFrame, radius: int = 16) -> DataFrame:
    """images (height, width, rgb, cutout, mask) with ``DIAGNOSTICS`` beside their other columns."""
    names = [c for c in images.columns if c not in ("rgb", "cutout", "mask")]

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                h, w = row.column("height")[0].as_py(), row.column("width")[0].as_py()
                planes = [np.frombuffer(row.column(c)[0].as_py(), np.uint8).reshape(h, w, -1) / 255 for c in ("rgb", "cutout", "mask")]
                got = diagnostics(planes[0], planes[1], planes[2][..., 0], radius)
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in names), *(pa.array([got[d]], pa.float64()) for d in DIAGNOSTICS)], names=[*names, *DIAGNOSTICS])

    return images.mapInArrow(run, extend(images.select(*names).schema, ", ".join(f"{d} double" for d in DIAGNOSTICS)))


def artifact_scores(images: DataFrame, rules: EdgeRules = EdgeRules()) -> DataFrame:
    """images (height, width, rgb, cutout as 3 bytes a pixel, mask as 1) with SCORES and edge_pixels, at the analysis size.

    Sizes that do not fit, or nulls, give null scores and the reason in score_error; the run goes on.
    """
    names = [c for c in images.columns if c not in ("rgb", "cutout", "mask")]

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                h, w = row.column("height")[0].as_py(), row.column("width")[0].as_py()
                try:
                    planes = [np.frombuffer(row.column(c)[0].as_py(), np.uint8).reshape(h, w, -1) for c in ("rgb", "cutout", "mask")]
                    got, why = analysed(planes[0], planes[1], planes[2][..., 0], rules)[0], None
                except (TypeError, ValueError) as e:
                    got, why = dict.fromkeys((*SCORES, "edge_pixels")), str(e)
                cols = [pa.array([got[s]], pa.float64()) for s in SCORES]
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in names), *cols, pa.array([got["edge_pixels"]], pa.int32()), pa.array([why], pa.string())], names=[*names, *SCORES, "edge_pixels", "score_error"])

    ddl = ", ".join(f"{s} double" for s in SCORES)
    return images.mapInArrow(run, extend(images.select(*names).schema, f"{ddl}, edge_pixels int, score_error string"))
