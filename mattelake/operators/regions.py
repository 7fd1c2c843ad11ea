"""Connected regions of masks: an Arrow kernel, one row per image in and out, no shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mattelake.schemas import extend


def label(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Region numbers from 1 (0 outside the mask), by smallest pixel index first.

    Every pixel takes the smallest index around it, then follows that index's own, until nothing moves.
    """
    h, w = mask.shape
    if not mask.any():
        return np.zeros((h, w), np.int64)
    far = h * w
    own = np.full((h + 2, w + 2), far)
    core = own[1:-1, 1:-1]
    core[mask] = np.flatnonzero(mask)
    steps = [(0, 1), (1, 0), (1, 1), (1, -1)] if diagonal else [(0, 1), (1, 0)]
    while True:
        low = core.copy()
        for dy, dx in steps:
            for s in (1, -1):
                np.minimum(low, own[1 + s * dy : 1 + s * dy + h, 1 + s * dx : 1 + s * dx + w], out=low)
        low[~mask] = far
        flat = np.append(low.ravel(), far)
        flat = flat[flat]
        flat = flat[flat]
        new = flat[:-1].reshape(h, w)
        if (new == core).all():
            break
        core[:] = new
    out = np.zeros((h, w), np.int64)
    roots = np.unique(core[mask])
    out[mask] = np.searchsorted(roots, core[mask]) + 1
    return out


def areas(mask: np.ndarray) -> np.ndarray:
    """Pixels of each 8-connected region."""
    return np.bincount(label(mask).ravel())[1:]


def hole_area(mask: np.ndarray) -> float:
    """Area of the holes of a mask, each measured along the mask pixels around it.

    A hole is a 4-connected region of unset pixels that misses the border. With n of its own pixels and
    b mask pixels beside them, the polygon through these b pixels has the area n + b / 2 - 1.
    """
    gaps = label(~mask, diagonal=False)
    if not gaps.max():
        return 0.0
    open_ = np.unique(np.concatenate([gaps[0], gaps[-1], gaps[:, 0], gaps[:, -1]]))
    size = np.bincount(gaps.ravel())
    h, w = mask.shape
    wide = np.zeros((h + 2, w + 2), np.int64)
    wide[1:-1, 1:-1] = gaps
    around = np.stack([wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]])[:, mask]
    pixel = np.broadcast_to(np.arange(around.shape[1]), around.shape)
    pairs = np.unique(np.stack([around.ravel(), pixel.ravel()]), axis=1)[0]
    beside = np.bincount(pairs, minlength=len(size))
    closed = np.setdiff1d(np.arange(1, len(size)), open_)
    return float((size[closed] + beside[closed] / 2 - 1).sum())


def enclosed(mask: np.ndarray) -> int:
    """Unset pixels that no 4-connected path of unset pixels joins with the border."""
    gaps = label(~mask, diagonal=False)
    border = np.concatenate([gaps[0], gaps[-1], gaps[:, 0], gaps[:, -1]])
    return int(((gaps > 0) & ~np.isin(gaps, border)).sum())


def speckles(low: np.ndarray) -> np.ndarray:
    """Pixels of regions of a few pixels, up to 0.025 % of the image but at least four."""
    most = max(4, round(low.size * 0.00025))
    numbers = label(low)
    size = np.bincount(numbers.ravel())
    size[0] = most + 1
    return (size <= most)[numbers]


def regions(masks: DataFrame, foreground: int = 24, solid: int = 224, min_ratio: float = 0.002) -> DataFrame:
    """masks with components, hole_pixels (plain count) and hole_ratio (by ``hole_area``, of the foreground).

    A null or empty raster has neither.
    """
    keep = masks.columns

    def run(batches):
        for b in batches:
            out = []
            sizes = zip(b.column("height").to_pylist(), b.column("width").to_pylist(), b.column("alpha").to_pylist())
            for h, w, alpha in sizes:
                if not alpha:
                    out.append((0, 0, 0.0))
                    continue
                a = np.array(alpha).reshape(h, w)
                fg, hard = a >= foreground, a >= solid
                out.append((int((areas(fg) / a.size >= min_ratio).sum()), enclosed(hard), hole_area(hard) / max(1, int(fg.sum()))))
            cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*keep, "components", "hole_pixels", "hole_ratio"])

    return masks.mapInArrow(run, extend(masks.schema, "components int, hole_pixels int, hole_ratio double"))
