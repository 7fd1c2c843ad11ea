"""Foreground colours under a matte, by multi-level least squares (Germer et al., 2020)."""

from __future__ import annotations

import numpy as np

RIDGE, ROUNDS_SMALL, ROUNDS_BIG = 1e-5, 10, 2


def _scaled(img: np.ndarray, h: int, w: int) -> np.ndarray:
    y, x = np.arange(h) * img.shape[0] // h, np.arange(w) * img.shape[1] // w
    return img[y[:, None], x[None]]


def _around(a: np.ndarray) -> np.ndarray:
    """The four neighbours of every pixel, edge pixels repeated: (4, height, width, ...)."""
    wide = np.pad(a, ((1, 1), (1, 1)) + ((0, 0),) * (a.ndim - 2), mode="edge")
    return np.stack([wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]])


def estimate(rgb: np.ndarray, alpha: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Foreground colours from 0 to 1. Every pixel's colour is a mix of foreground and background; both
    vary little where the matte does. Solved from one pixel upwards, each level starting from the last."""
    h, w = alpha.shape
    levels = int(np.ceil(np.log2(max(h, w, 2))))
    fore = back = rgb.mean(axis=(0, 1), keepdims=True)
    for k in range(levels + 1):
        lh, lw = max(1, round(h ** (k / levels))), max(1, round(w ** (k / levels)))
        img, a = _scaled(rgb, lh, lw), _scaled(alpha, lh, lw)
        fore, back = _scaled(fore, lh, lw), _scaled(back, lh, lw)
        weight = (ridge + np.abs(_around(a) - a))[..., None]
        total, a = weight.sum(axis=0), a[..., None]
        b = 1 - a
        for _ in range(ROUNDS_SMALL if max(lh, lw) <= 32 else ROUNDS_BIG):
            u, v = a * img + (weight * _around(fore)).sum(axis=0), b * img + (weight * _around(back)).sum(axis=0)
            det = total * (a * a + b * b + total)
            fore = np.clip(((b * b + total) * u - a * b * v) / det, 0, 1)
            back = np.clip(((a * a + total) * v - a * b * u) / det, 0, 1)
    return fore


def refine(rgb: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """A ``Plugins.refine``: 8-bit foreground colours; the mask itself is never changed."""
    if rgb.shape[:2] != mask.shape:
        raise ValueError("image and mask differ in size")
    return np.clip(np.rint(estimate(rgb / 255.0, mask / 255.0) * 255), 0, 255).astype(np.uint8)
