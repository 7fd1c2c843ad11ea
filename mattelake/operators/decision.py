"""From checks to READY, REVIEW or FAILED, as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mattelake.config import EdgeRules
from mattelake.functions import scalars


def _names(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def edge_flags(rules: EdgeRules = EdgeRules()) -> Column:
    """Names of the scores that stand out, in a fixed order."""
    r = rules
    return scalars.flags(
        (F.col("residual") >= r.weak_residual, "residual_background_color"),
        (F.col("loose") >= r.weak_loose, "loose_edge_noise"),
        (F.col("compact") >= r.weak_local, "overcut_compact_structure"),
        (F.col("hair") >= r.weak_local, "weak_hair_edge"),
        (F.col("instability") >= r.weak_local, "local_alpha_instability"),
        ((F.col("residual") >= r.weak_residual) & (F.col("loose") >= r.weak_loose * 0.8), "semantic_edge_anomaly"),
    )


def edge_severity(scores: DataFrame, rules: EdgeRules = EdgeRules()) -> DataFrame:
    """scores (the columns of SCORES, edge_pixels, semantic_relevant) with flags, severity, edge_hard,
    edge_hard_details, edge_weak and edge_telemetry.

    semantic_relevant is three-valued: null counts as relevant. Too few edge pixels decide nothing.
    """
    r = rules
    relevant = F.coalesce("semantic_relevant", F.lit(True))
    small = F.col("edge_pixels") < r.min_edge_pixels
    none = F.array().cast("array<string>")
    out = scores.withColumn("flags", F.when(small, none).otherwise(edge_flags(r)))
    spread = relevant & F.col("chromatic").between(*r.hard_residual) & F.col("loose").between(*r.hard_loose) & F.col("semantic").between(*r.hard_combined) & F.col("agreement").between(*r.hard_agreement)
    torn = relevant & (F.col("compact") >= r.hard_structural) & (F.col("instability") >= r.hard_structural)
    weak = F.filter("flags", lambda f: f.isin("loose_edge_noise", "local_alpha_instability", "semantic_edge_anomaly"))
    seen = (F.size("flags") > 0) | (F.col("total") >= 0.15)
    severity = F.when(small, "none").when(spread | torn, "hard").when(F.size(weak) > 0, "weak").when(seen, "telemetry").otherwise("none")
    out = out.withColumn("severity", severity)
    hard, soft = F.col("severity") == "hard", F.col("severity") == "weak"
    hushed = (F.col("semantic_relevant") == F.lit(False)) & (F.size("flags") > 0)
    return out.withColumns(
        {
            "edge_hard": F.when(hard, F.array(F.lit("edge_artifact"))).otherwise(none),
            "edge_weak": F.when(soft, weak).otherwise(none),
            "edge_hard_details": F.when(hard & spread, F.array(F.format_string("background-colour residual and locally loose edge agree (residual=%.3f, loose=%.3f)", "chromatic", "loose")))
            .when(hard, F.array(F.format_string("compact edge damage and local alpha instability agree (compact=%.3f, alpha=%.3f)", "compact", "instability")))
            .otherwise(none),
            "edge_telemetry": scalars.flags((small, "artifact_edge_sample_too_small"), (severity == "telemetry", "artifact_signal_observed"), (~small & F.coalesce(hushed, F.lit(False)), "artifact_semantic_suppression")),
        }
    )


def verifier_wanted(enabled: bool = True) -> Column:
    """Whether the strong verifier is to look: people there, prompts left, a trigger of the mask or of a person, nothing hard yet."""
    hard = F.size(_names("hard_reasons")) + F.size(_names("edge_hard"))
    weak = F.size(_names("triggers")) + F.size(_names("human_triggers"))
    return F.lit(enabled) & (hard == 0) & (F.col("person_count") > 0) & (F.col("kept") > 0) & (weak > 0)


def escalate(images: DataFrame, has_verifier: bool = True, enabled: bool = True) -> DataFrame:
    """Adds requested, sam_result, final_reasons, final_details, status, all_triggers and telemetry.

    images: hard_reasons, triggers, qc_telemetry, edge_hard, edge_weak, edge_telemetry, person_count, kept,
    human_triggers, of the verifier ran, checked_people, reasons, sam_error (null where not called), and
    where given hard_details, edge_hard_details and the verifier's details; error is set where an image
    could not be processed, which is FAILED whatever else holds.
    """
    listed = lambda c: _names(c) if c in images.columns else F.array().cast("array<string>")
    hard = scalars.distinct_in_order(_names("hard_reasons"), _names("edge_hard"))
    every = scalars.distinct_in_order(_names("triggers"), _names("human_triggers"))
    out = images.withColumn("_hard", hard).withColumn("all_triggers", every).withColumn("requested", F.coalesce(verifier_wanted(enabled), F.lit(False)))
    is_hard, asked = F.size("_hard") > 0, F.col("requested")
    checked = F.coalesce("checked_people", F.lit(0))
    short = ~F.coalesce("ran", F.lit(False)) | (checked < F.col("kept"))
    result = (
        F.when(is_hard, "hard_review")
        .when(asked & F.lit(not has_verifier), "unavailable")
        .when(asked & F.col("sam_error").isNotNull(), "error")
        .when(asked & short, "incomplete")
        .when(asked & (F.size(_names("reasons")) > 0), "disagreement")
        .when(asked, "confirmed")
        .when(F.size("all_triggers") > 0, "unavailable")
        .otherwise("not_requested")
    )
    out = out.withColumn("sam_result", result)
    unsure = F.col("sam_result").isin("error", "incomplete", "unavailable")
    said = F.col("sam_result").isin("incomplete", "disagreement")
    none = F.array().cast("array<string>")
    # Doubt comes before what the verifier itself found.
    out = out.withColumn("final_reasons", scalars.distinct_in_order(F.col("_hard"), scalars.flags((unsure, "low_confidence")), F.when(said, _names("reasons")).otherwise(none)))
    why = (
        F.when(F.col("sam_result") == "error", "strong verifier failed on a suspicious result")
        .when((F.col("sam_result") == "unavailable") & asked, "strong verifier is unavailable for a suspicious result")
        .when(F.col("sam_result") == "unavailable", "strong verification could not be requested for a suspicious result")
        .when(F.col("sam_result") == "incomplete", F.concat(F.lit("strong verification did not evaluate every requested person prompt ("), checked.cast("string"), F.lit("/"), F.col("kept").cast("string"), F.lit(")")))
    )
    details = F.array_compact(F.concat(listed("hard_details"), listed("edge_hard_details"), F.array(why), F.when(said, listed("details")).otherwise(none)))
    telemetry = scalars.distinct_in_order(
        _names("qc_telemetry"), _names("edge_telemetry"),
        F.transform(_names("edge_weak"), lambda w: F.concat(F.lit("artifact:"), w)),
        scalars.flags((F.coalesce("person_count", F.lit(0)) == 0, "person_detector_zero")),
    )
    status = F.when(F.col("error").isNotNull(), "FAILED").when(F.size("final_reasons") == 0, "READY").otherwise("REVIEW")
    return out.withColumns({"telemetry": telemetry, "final_details": details, "status": status}).drop("_hard")
