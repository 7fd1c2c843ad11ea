"""Mask checks of one image: areas, bands, holes, components, and the rules over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mattelake.config import MaskRules
from mattelake.functions import rasters, scalars
from mattelake.operators.regions import areas, enclosed, hole_area
from mattelake.schemas import extend

SIDES = ("top", "bottom", "left", "right")


def measure(masks: DataFrame, rules: MaskRules = MaskRules()) -> DataFrame:
    """masks (height, width, alpha) with areas, ratios, band shares and touches; expressions only.

    A null raster has no pixels: its ratios are 0. Other columns pass through.
    """
    alpha = F.coalesce(F.col("alpha"), F.array().cast("array<int>"))
    h, w = F.col("height"), F.col("width")
    out = masks.withColumn("_band", rasters.band_width(h, w, rules.band)).withColumn("foreground_area", rasters.count_at_least(alpha, rules.foreground))
    out = out.withColumn("foreground_ratio", scalars.share(F.col("foreground_area"), h * w))
    out = out.withColumn("translucent_ratio", scalars.share(rasters.count_between(alpha, rules.foreground, rules.solid), F.col("foreground_area")))
    for side in SIDES:
        area, span = rasters.band(alpha, h, w, side, F.col("_band"), rules.foreground)
        out = out.withColumns({f"edge_{side}_ratio": area, f"span_{side}": span})
    return out.withColumns({f"touch_{s}": F.col(f"span_{s}") >= rules.min_span for s in SIDES}).drop("_band")


MEASURES = (
    "foreground_area int, foreground_ratio double, translucent_ratio double, "
    + ", ".join(f"edge_{s}_ratio double, span_{s} double" for s in SIDES)
    + ", "
    + ", ".join(f"touch_{s} boolean" for s in SIDES)
    + ", components int, hole_pixels int, hole_ratio double"
)


def measured(a: np.ndarray, rules: MaskRules) -> dict:
    h, w = a.shape
    on, solid = a >= rules.foreground, a >= rules.solid
    size, area = max(2, int(min(h, w) * rules.band)), int(on.sum())
    out = {"foreground_area": area, "foreground_ratio": area / max(1, a.size), "translucent_ratio": int(((a > rules.foreground) & ~solid).sum()) / max(1, area)}
    strips = {"top": on[:size], "bottom": on[-size:], "left": on[:, :size].T, "right": on[:, -size:].T}
    for side, strip in strips.items():
        span = float(strip.any(axis=0).mean())
        out |= {f"edge_{side}_ratio": float(strip.mean()), f"span_{side}": span, f"touch_{side}": span >= rules.min_span}
    parts = int((areas(on) / a.size >= rules.min_component_ratio).sum())
    return out | {"components": parts, "hole_pixels": enclosed(solid), "hole_ratio": hole_area(solid) / max(1, area)}


def measure_bytes(masks: DataFrame, rules: MaskRules = MaskRules(), mask: str = "mask") -> DataFrame:
    """What ``measure`` and ``regions`` give together, for masks held as bytes: an Arrow kernel for full-size images."""
    names = MEASURES.replace(",", "").split(" ")[::2]
    kinds = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[k] for k in MEASURES.replace(",", "").split(" ")[1::2]]

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                h, w = row.column("height")[0].as_py(), row.column("width")[0].as_py()
                got = measured(np.frombuffer(row.column(mask)[0].as_py(), np.uint8).reshape(h, w), rules)
                yield pa.RecordBatch.from_arrays([*row.columns, *(pa.array([got[n]], t) for n, t in zip(names, types))], names=[*row.schema.names, *names])

    return masks.mapInArrow(run, extend(masks.schema, MEASURES))


def cropped(rules: MaskRules = MaskRules()) -> Column:
    """Whether the subject seems cut by the frame; a wide contact at the bottom is usual and no sign."""

    def side(name: str, low: float, high: float = float("inf")) -> Column:
        span = F.col(f"span_{name}")
        return F.col(f"touch_{name}") & (F.col(f"edge_{name}_ratio") >= rules.min_band_area) & (span >= low) & (span <= high)

    return side("top", rules.crop_top) | side("bottom", rules.min_span, rules.crop_bottom) | side("left", rules.crop_side) | side("right", rules.crop_side)


def judge(measured: DataFrame, rules: MaskRules = MaskRules()) -> DataFrame:
    """Adds hard_reasons, hard_details, triggers, trigger_details, cropped_source_signal and qc_telemetry.

    Needs components and hole_ratio beside what ``measure`` gives.
    """
    ratio, parts = F.col("foreground_ratio"), F.col("components")
    thin, full, torn = ratio < rules.min_foreground_ratio, ratio > rules.max_foreground_ratio, parts > rules.max_components
    holes, glass = F.col("hole_ratio") > rules.max_hole_ratio, F.col("translucent_ratio") > rules.max_translucent_ratio
    details = F.array_compact(F.array(F.when(thin, "almost empty foreground mask"), F.when(full, "foreground covers almost the entire image"), F.when(torn, F.concat(parts.cast("string"), F.lit(" significant disconnected components")))))
    return measured.withColumns(
        {
            "hard_reasons": scalars.flags((thin | full | torn, "mask_issue")),
            "hard_details": details,
            "triggers": scalars.flags((holes, "large_internal_holes"), (glass, "high_translucency")),
            "trigger_details": scalars.flags((holes, "large internal holes in foreground"), (glass, "unusually high translucent pixel ratio")),
            "cropped_source_signal": cropped(rules),
        }
    ).withColumn("qc_telemetry", scalars.flags((F.col("cropped_source_signal"), "cropped_source_signal")))


def similarity(pairs: DataFrame, threshold: int = 127) -> DataFrame:
    """pairs (alpha_a, alpha_b) with iou and difference (mean absolute, of 255)."""
    both, either, apart = rasters.overlap_counts(F.col("alpha_a"), F.col("alpha_b"), threshold)
    return pairs.withColumns({"iou": scalars.share(both, either), "difference": apart / F.greatest(F.size("alpha_a"), F.lit(1)) / 255.0})
