"""A batch run: images to decisions, with models as plug-ins.

Plug-ins are plain functions over numpy arrays and run in Arrow batches on the executors. A run is one
chain over the images: a kernel that cuts out and measures, the rules as expressions, a kernel that asks
the strong verifier where they want it, the rest of the rules. Nothing branches or joins, so every image
is read, cut out and verified once, and its pixels never enter an exchange.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mattelake.config import Settings, fingerprint
from mattelake.functions import scalars
from mattelake.operators import boxes, decision, edges, foreground, ledger, qc
from mattelake.operators.kernels import by_row
from mattelake.schemas import SCORES


@dataclass(frozen=True)
class Plugins:
    """The models of a run.

    predict(rgb) -> mask; detect(rgb, mask) -> boxes as dicts of x1, y1, x2, y2, score and perhaps label;
    segment(rgb, boxes) -> (masks, scores) of the strong verifier; refine(rgb, mask) -> rgb, or (rgb, mask)
    whose mask must be the one given. Without ``refine`` the settings' own method is used. ``load`` runs
    once in each worker before its first image, ``clear`` before a prediction that ran out of memory is
    tried again. device and precision go to the ledger.
    """

    predict: Callable[[np.ndarray], np.ndarray]
    detect: Callable[[np.ndarray, np.ndarray], list[dict]] | None = None
    segment: Callable[[np.ndarray, list[dict]], tuple[list[np.ndarray], list[float]]] | None = None
    refine: Callable | None = None
    load: Callable[[], None] | None = None
    clear: Callable[[], None] | None = None
    retry_on: str = "out of memory"
    device: str = "test"
    precision: str = "test"


BOXES = f"boxes array<{boxes.BOX_TYPE}>"
EXAMINED = f"mask binary, cutout binary, {qc.MEASURES}, {', '.join(f'{s} double' for s in SCORES)}, edge_pixels int, {BOXES}, {boxes.CHOSEN}, person_count int, missing int, uncertain int, seconds double"
VERDICT = "ran boolean, checked_people int, reasons array<string>, details array<string>, min_recall double, min_iou double, sam_error string, sam_seconds double"


def _reason(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def _rgb(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], 3)


def _refined(rgb: np.ndarray, mask: np.ndarray, plugins: Plugins, settings: Settings) -> np.ndarray:
    """Foreground colours; the refiner may change neither size nor mask."""
    if plugins.refine is not None:
        got = plugins.refine(rgb, mask)
    elif not settings.foreground.enabled:
        return rgb
    elif settings.foreground.method == "pymatting_ml":
        got = foreground.refine(rgb, mask)
    else:
        raise ValueError(f"Unsupported foreground refinement method: {settings.foreground.method}")
    if isinstance(got, tuple):
        got, alpha = got
        if alpha.shape != mask.shape:
            raise RuntimeError("Foreground refinement changed output dimensions")
        if not np.array_equal(alpha, mask):
            raise RuntimeError("Foreground refinement changed portrait alpha")
    if got.shape != rgb.shape:
        raise RuntimeError("Foreground refinement changed output dimensions")
    return np.ascontiguousarray(got, np.uint8)


def examine(images: DataFrame, plugins: Plugins, settings: Settings = Settings()) -> DataFrame:
    """images (height, width, data, error) with ``EXAMINED``; what goes wrong with an image is its error."""

    def work(row: dict) -> dict:
        began = time.perf_counter()
        out = {"error": row["error"]}
        if row["error"] is None:
            try:
                rgb = _rgb(row)
                try:
                    mask = plugins.predict(rgb)
                except RuntimeError as e:
                    if plugins.retry_on not in str(e).lower():
                        raise
                    if plugins.clear is not None:
                        plugins.clear()
                    mask = plugins.predict(rgb)
                mask = np.ascontiguousarray(mask, np.uint8)
                if mask.shape != rgb.shape[:2]:
                    raise ValueError("Alpha mask must be a 2D array of the image's size")
                found = plugins.detect(rgb, mask) if plugins.detect is not None else []
                kept, missing, uncertain = boxes.coverage(mask, found, settings.mask)
                fine = _refined(rgb, mask, plugins, settings)
                blank = dict.fromkeys(SCORES, 0.0) | {"edge_pixels": 0}
                scores = edges.analysed(rgb, fine, mask, settings.edges)[0] if settings.edges.enabled else blank
                out |= qc.measured(mask, settings.mask) | scores
                out |= {"mask": mask.tobytes(), "cutout": fine.tobytes(), "boxes": kept, "person_count": len(kept), "missing": missing, "uncertain": uncertain}
                out |= boxes.choose(kept, settings.verify)
            except Exception as e:  # a plug-in may raise anything; its image becomes a FAILED row
                out = {"error": _reason(e)}
        return out | {"seconds": time.perf_counter() - began}

    return by_row(images, f"{EXAMINED}, error string", work, plugins.load)


def verify(images: DataFrame, plugins: Plugins, settings: Settings = Settings()) -> DataFrame:
    """images with ``VERDICT``: the strong check of those whose ``_ask`` holds, nulls for the others."""

    def work(row: dict) -> dict:
        if not row["_ask"] or plugins.segment is None:
            return {}
        began = time.perf_counter()
        try:
            prompts = [b | {"person": k} for k, b in enumerate(row["chosen"]) if b["keep"]]
            mask = np.frombuffer(row["mask"], np.uint8).reshape(row["height"], row["width"])
            masks, scores = plugins.segment(_rgb(row), prompts)
            out = boxes.confirm(mask, prompts, masks, scores, settings.verify, row["person_count"])
        except Exception as e:  # the verifier's failure leaves the image in doubt
            out = {"sam_error": _reason(e)}
        return out | {"sam_seconds": time.perf_counter() - began}

    return by_row(images, VERDICT, work)


def judged(images: DataFrame, plugins: Plugins, settings: Settings = Settings(), done: DataFrame | None = None) -> DataFrame:
    """Every image (source_file, height, width, data, error) that ``done`` does not have, with all that was found and decided.

    Pixels, mask and cut-out stay in the row, for whoever saves them. An image's failure ends in its own row.
    """
    todo = ledger.pending(images, done) if done is not None else images
    out = qc.judge(examine(todo, plugins, settings), settings.mask)
    # Without a detector there are no people, and nothing is known about them.
    out = out.withColumn("semantic_relevant", F.when(F.lit(plugins.detect is not None), F.col("person_count") > 0))
    out = decision.edge_severity(out, settings.edges) if settings.edges.enabled else _no_edges(out)
    out = out.withColumn("_ask", F.col("error").isNull() & F.coalesce(decision.verifier_wanted(settings.verify.enabled), F.lit(False)))
    out = decision.escalate(verify(out, plugins, settings), plugins.segment is not None, settings.verify.enabled)
    seconds = F.col("seconds") + F.coalesce("sam_seconds", F.lit(0.0))
    return out.withColumns(
        {
            "processing_time": seconds, "device": F.lit(plugins.device), "precision": F.lit(plugins.precision), "foreground_refinement": F.lit(settings.foreground.method),
            "pipeline_fingerprint": F.lit(fingerprint(settings)), "filename": scalars.png_name(F.col("source_file")),
            "output_file": F.when(F.col("status") != "FAILED", F.concat(F.lower("status"), F.lit("/"), scalars.png_name(F.col("source_file")))),
        }
    ).drop("_ask")


def _no_edges(rows: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return rows.withColumns({"severity": F.lit("none")} | {c: none for c in ("flags", "edge_hard", "edge_hard_details", "edge_weak", "edge_telemetry")})


def run(images: DataFrame, plugins: Plugins, settings: Settings = Settings(), done: DataFrame | None = None) -> DataFrame:
    """One ledger row per image that ``done`` does not have; lists stay arrays, the sink renders them."""
    return as_ledger(judged(images, plugins, settings, done))


def as_ledger(rows: DataFrame) -> DataFrame:
    """Decided rows under the ledger's names; a failed image has its names, times and error only."""
    renamed = {
        "hard_reasons": "fast_qc_hard_reasons", "hard_details": "fast_qc_hard_details", "all_triggers": "verification_triggers", "trigger_details": "verification_trigger_details",
        "requested": "sam_requested", "filter_details": "sam_filter_details", "min_recall": "sam_min_recall", "min_iou": "sam_min_iou", "filtered": "sam_filtered_boxes",
        "residual": "artifact_residual_background_score", "chromatic": "artifact_chromatic_background_score", "neutral": "artifact_neutral_background_score", "loose": "artifact_loose_edge_score",
        "compact": "artifact_compact_damage_score", "hair": "artifact_weak_hair_edge_score", "instability": "artifact_local_alpha_instability_score", "semantic": "artifact_semantic_edge_anomaly_score",
        "agreement": "artifact_local_agreement_score", "total": "artifact_total_score", "edge_pixels": "artifact_edge_pixels", "severity": "artifact_severity", "flags": "artifact_flags",
        "edge_hard": "artifact_hard_reasons", "edge_hard_details": "artifact_hard_details", "edge_weak": "artifact_weak_triggers", "edge_telemetry": "artifact_telemetry", "telemetry": "telemetry_signals", "final_reasons": "final_review_reasons",
    }
    always = ["source_file", "filename", "output_file", "status", "processing_time", "device", "precision", "pipeline_fingerprint", "error"]
    good = ["width", "height", "foreground_ratio", "components", "hole_ratio", "translucent_ratio", "touch_top", "touch_bottom", "touch_left", "touch_right", "cropped_source_signal", "person_count", "sam_result", "sam_error", "foreground_refinement"]
    called = F.col("ran").isNotNull()
    values = {c: F.col(c) for c in good} | {b: F.col(a) for a, b in renamed.items()}
    values |= {
        "person_detector_zero": F.col("person_count") == 0,
        "person_box_coverage_min": F.array_min(F.transform("boxes", lambda b: b["coverage"])),
        "sam_ran": F.coalesce("ran", F.lit(False)),
        "sam_prompted_boxes": F.when(called, F.col("kept")).otherwise(F.lit(0)).cast("int"),
        "sam_checked_people": F.coalesce("checked_people", F.lit(0)),
        "review_reason": F.col("final_reasons"),
        "review_details": F.col("final_details"),
    }
    return rows.select(*always, *[F.when(F.col("status") != "FAILED", c).alias(n) for n, c in values.items()])


def validate(originals: DataFrame, report: DataFrame, cutouts: DataFrame, key: str = "source_file") -> DataFrame:
    """Offline re-scoring input: originals with their report row (by relative path) and their cut-out.

    Images without a cut-out go; images without a report row count no person.
    """
    people = report.select(key, F.coalesce(F.col("person_count").try_cast("int"), F.lit(0)).alias("person_count"))
    return originals.join(cutouts, key).join(people, key, "left").withColumn("person_count", F.coalesce("person_count", F.lit(0)))


def severity_report(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(severity histogram, hard cases in order)."""
    return rows.groupBy("severity").agg(F.count("*").alias("n")), rows.where("severity = 'hard'").orderBy("source_file")
