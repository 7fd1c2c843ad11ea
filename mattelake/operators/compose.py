"""Cut-outs and previews: composing, fitting and decontaminating rasters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mattelake.functions import rasters, scalars


def over(masks: DataFrame, value: str, canvas: int | Column, name: str = "composite") -> DataFrame:
    """Adds the samples of ``value`` laid over a canvas by ``alpha``."""
    return masks.withColumn(name, rasters.composite(F.col("alpha"), F.col(value), canvas if isinstance(canvas, Column) else F.lit(canvas)))


def checker(height: int, width: int, cell: int = 16, light: int = 230, dark: int = 180) -> np.ndarray:
    y, x = np.indices((height, width)) // cell
    return np.where((y + x) % 2, dark, light).astype(np.uint8)


def resample(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """8-bit samples scaled by the windowed sinc of three lobes (Lanczos), widened where the image shrinks; columns first."""

    def weights(n: int, m: int) -> np.ndarray:
        ratio = n / m
        spread = max(1.0, ratio)
        x = (np.arange(n)[None] + 0.5 - (np.arange(m) + 0.5)[:, None] * ratio) / spread
        w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)
        return w / w.sum(axis=1, keepdims=True)

    out = img.astype(float)
    for axis, size in ((1, width), (0, height)):
        if out.shape[axis] != size:
            out = np.moveaxis(np.tensordot(weights(out.shape[axis], size), out, axes=(1, axis)), 0, axis)
            out = np.clip(np.floor(out + 0.5), 0, 255)
    return out.astype(np.uint8)


resize = resample


def letterbox(img: np.ndarray, box_h: int, box_w: int, fill: int = 255) -> np.ndarray:
    """img scaled down to fit and centred in a box; never enlarged."""
    h, w = img.shape[:2]
    k = min(1.0, box_h / h, box_w / w)
    small = img if k == 1 else resize(img, max(1, round(h * k)), max(1, round(w * k)))
    out = np.full((box_h, box_w, *img.shape[2:]), fill, np.uint8)
    top, left = (box_h - small.shape[0]) // 2, (box_w - small.shape[1]) // 2
    out[top : top + small.shape[0], left : left + small.shape[1]] = small
    return out


def rgba(rgb: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    if rgb.shape[:2] != alpha.shape:
        alpha = resize(alpha, *rgb.shape[:2])
    return np.dstack([rgb, alpha])


# The colour of heat maps and the two of the contrast canvas.
HEAT, CONTRAST = (255, 43, 89), ((255, 0, 168), (0, 214, 255))


def heat_overlay(rgb: np.ndarray, heat: np.ndarray, strength: float = 0.72) -> np.ndarray:
    """Tints a picture by a heat map from 0 to 1 of any size."""
    scaled = np.clip(heat * 255, 0, 255).astype(np.uint8)
    full = scaled if scaled.shape == rgb.shape[:2] else resample(scaled, *rgb.shape[:2])
    share = np.rint(full * strength)[..., None] / 255
    return np.rint(rgb * (1 - share) + np.array(HEAT) * share).astype(np.uint8)


def contrast(height: int, width: int) -> np.ndarray:
    """Coloured squares of a twelfth of the shorter side, 16 pixels at least."""
    cell = max(16, min(height, width) // 12)
    y, x = np.indices((height, width)) // cell
    return np.where(((y + x) % 2 == 1)[..., None], CONTRAST[1], CONTRAST[0]).astype(np.uint8)


def strip(rgb: np.ndarray, alpha: np.ndarray, side: int = 320, cutout: np.ndarray | None = None, heat: np.ndarray | None = None) -> np.ndarray:
    """Preview panels side by side: the original, the cut-out on white, grey, black and contrast, and the heat map if given."""
    a, fore = alpha[..., None] / 255, rgb if cutout is None else cutout
    canvases = [np.full(rgb.shape, v, np.uint8) for v in (255, 136, 0)] + [contrast(*alpha.shape)]
    panels = [rgb] + [np.rint(fore * a + c * (1 - a)).astype(np.uint8) for c in canvases]
    panels += [] if heat is None else [heat_overlay(rgb, heat)]
    return np.concatenate([letterbox(p, side, side, 238) for p in panels], axis=1)


#: Alpha under which corrections fade out and the division stops.
PROTECTED = 0.12


def decontaminate(color: Column, background: Column, alpha: Column, strength: float = 0.85) -> tuple[Column, Column]:
    """(corrected sample, estimate before clipping) under C = aF + (1 - a)B; samples and alpha from 0 to 1."""
    estimate = (color - (1 - alpha) * background) / F.greatest(alpha, F.lit(PROTECTED))
    mix = F.lit(strength) * (1 - alpha) * scalars.clip(alpha / PROTECTED)
    return color * (1 - mix) + scalars.clip(estimate) * mix, estimate


def correction_metrics(pixels: DataFrame, low: int = 8, high: int = 247) -> DataFrame:
    """pixels (image_id, alpha, before, after, estimate: arrays of channels from 0 to 1) -> how far edge pixels move.

    A pixel's magnitude is the length of its move over all channels, of the longest one possible. It counts
    as clipped where any channel's estimate lies outside 0 to 1.
    """
    square = F.aggregate(F.zip_with("before", "after", lambda b, a: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    outside = F.exists("estimate", lambda e: (e < 0) | (e > 1))
    edge = pixels.where(F.col("alpha").between(low, high)).select("image_id", (F.sqrt(square) / F.sqrt(F.size("before").cast("double"))).alias("moved"), outside.cast("int").alias("clipped"))
    return edge.groupBy("image_id").agg(
        F.count("*").alias("edge_pixels"), F.round(F.avg("moved"), 6).alias("mean_correction"), F.round(F.percentile("moved", 0.95), 6).alias("p95_correction"), F.round(F.avg("clipped"), 6).alias("clipped_ratio"),
    )
