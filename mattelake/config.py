"""Settings of the engine: frozen dataclasses, an optional YAML overlay, and the run fingerprint."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field


# The default thresholds of the decision rules.
@dataclass(frozen=True)
class MaskRules:
    foreground: int = 24
    solid: int = 224
    min_foreground_ratio: float = 0.015
    max_foreground_ratio: float = 0.94
    max_components: int = 5
    min_component_ratio: float = 0.002
    max_hole_ratio: float = 0.08
    max_translucent_ratio: float = 0.42
    band: float = 0.018
    min_span: float = 0.08
    min_band_area: float = 0.0015
    crop_side: float = 0.18
    crop_top: float = 0.12
    crop_bottom: float = 0.28
    person_confidence: float = 0.55
    min_person_coverage: float = 0.18
    min_person_center: float = 0.30


@dataclass(frozen=True)
class EdgeRules:
    analysis_size: int = 512
    radius: int = 14
    weak_residual: float = 0.35
    weak_loose: float = 0.45
    weak_local: float = 0.85
    hard_residual: tuple[float, float] = (0.65, 0.90)
    hard_loose: tuple[float, float] = (0.60, 0.90)
    hard_combined: tuple[float, float] = (0.55, 0.85)
    hard_agreement: tuple[float, float] = (0.45, 0.90)
    hard_structural: float = 0.90
    min_edge_pixels: int = 48
    enabled: bool = True


@dataclass(frozen=True)
class VerifyRules:
    prompt_confidence: float = 0.80
    mask_confidence: float = 0.80
    alpha_threshold: int = 24
    box_coverage: float = 0.45
    center_coverage: float = 0.55
    multi_coverage: float = 0.60
    min_relative_area: float = 0.40
    overlap: float = 0.50
    min_recall: float = 0.82
    min_missing: float = 0.02
    boundary: float = 0.006
    enabled: bool = True


@dataclass(frozen=True)
class ModelRules:
    primary: str = "ZhengPeng7/BiRefNet-portrait"
    fallback: str = "ZhengPeng7/BiRefNet_HR-matting"
    primary_revision: str = "ecdeb6240ef23557dbd48ff27c59c1a88cbcb755"
    fallback_revision: str = "5d6b6f8adcb5b417c871b1d84ceaae9871355b7f"
    image_size: int = 1024
    fallback_image_size: int = 2048
    precision: str = "fp16"


@dataclass(frozen=True)
class ForegroundRules:
    method: str = "pymatting_ml"
    enabled: bool = True


@dataclass(frozen=True)
class LegacyRules:
    enabled: bool = False
    alpha_low: int = 8
    alpha_high: int = 247
    background_inpaint_radius: int = 7
    correction_strength: float = 0.85
    low_alpha_protection: float = 0.12


@dataclass(frozen=True)
class PreviewRules:
    width: int = 1000
    panel_height: int = 320
    contact_columns: int = 4
    contact_thumb_width: int = 300


@dataclass(frozen=True)
class Settings:
    model: ModelRules = field(default_factory=ModelRules)
    mask: MaskRules = field(default_factory=MaskRules)
    edges: EdgeRules = field(default_factory=EdgeRules)
    verify: VerifyRules = field(default_factory=VerifyRules)
    foreground: ForegroundRules = field(default_factory=ForegroundRules)
    legacy: LegacyRules = field(default_factory=LegacyRules)
    preview: PreviewRules = field(default_factory=PreviewRules)
    extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".webp")


# A settings file's sections, the field of Settings that each one fills, and the keys whose
# names differ here. A key beside a number is one end of a range. Keys that fill None are kept for the
# fingerprint only.
SECTIONS = {
    "model": ("model", {}),
    "qc": (
        "mask",
        {
            "foreground_threshold": "foreground", "solid_threshold": "solid", "edge_band_ratio": "band",
            "edge_min_span_ratio": "min_span", "edge_min_area_ratio": "min_band_area",
            "halo_correction_p95": None, "halo_clipped_ratio": None,
            "min_person_mask_coverage": "min_person_coverage", "min_person_center_coverage": "min_person_center",
            "cropped_side_span_ratio": "crop_side", "cropped_top_span_ratio": "crop_top", "cropped_bottom_span_ratio": "crop_bottom",
        },
    ),
    "foreground": ("foreground", {}),
    "artifacts": (
        "edges",
        {
            "analysis_max_size": "analysis_size", "normal_search_radius": "radius", "residual_weak_score": "weak_residual",
            "loose_edge_weak_score": "weak_loose", "local_signal_weak_score": "weak_local",
            "hard_residual_score": ("hard_residual", 0), "hard_residual_max_score": ("hard_residual", 1),
            "hard_loose_edge_score": ("hard_loose", 0), "hard_loose_edge_max_score": ("hard_loose", 1),
            "hard_combined_score": ("hard_combined", 0), "hard_combined_max_score": ("hard_combined", 1),
            "hard_local_agreement_score": ("hard_agreement", 0), "hard_local_agreement_max_score": ("hard_agreement", 1),
            "hard_structural_score": "hard_structural",
        },
    ),
    "verification": (
        "verify",
        {
            "enabled": None, "model": None, "run_on_all": None, "sam_enabled": "enabled", "sam_model": None, "sam_revision": None,
            "sam_prompt_confidence": "prompt_confidence", "sam_mask_confidence": "mask_confidence", "sam_alpha_threshold": "alpha_threshold",
            "sam_trigger_box_coverage": "box_coverage", "sam_trigger_center_coverage": "center_coverage", "sam_trigger_multiple_coverage": "multi_coverage",
            "sam_prompt_min_relative_area": "min_relative_area", "sam_prompt_overlap_suppression": "overlap",
            "sam_min_person_recall": "min_recall", "sam_min_missing_box_ratio": "min_missing", "sam_boundary_tolerance_ratio": "boundary",
        },
    ),
    "edge": ("legacy", {}),
    "preview": ("preview", {}),
}
UNUSED = {
    "qc": {"halo_correction_p95": 0.32, "halo_clipped_ratio": 0.10},
    "verification": {"enabled": True, "model": "ssdlite320_mobilenet_v3_large", "run_on_all": True, "sam_model": "facebook/sam2.1-hiera-small", "sam_revision": "ee5bba1d82bb8749febdf90f45e84b687142ba03"},
}
#: Sections that decide a result.
DECIDING = ("model", "qc", "foreground", "artifacts", "verification")


def _places(section: str) -> dict[str, str | tuple[str, int] | None]:
    """Every key of a section and the field that holds it."""
    own, renamed = SECTIONS[section]
    taken = {v if isinstance(v, str) else v[0] for v in renamed.values() if v is not None}
    plain = {f.name: f.name for f in dataclasses.fields(getattr(Settings(), own)) if f.name not in taken and f.name not in renamed}
    return plain | renamed


def file_form(s: Settings) -> dict[str, dict]:
    """Settings under the names of the settings file."""
    out = {}
    for section, (own, _) in SECTIONS.items():
        rules = getattr(s, own)
        out[section] = {}
        for key, place in _places(section).items():
            if place is None:
                out[section][key] = UNUSED[section][key]
            else:
                out[section][key] = getattr(rules, place) if isinstance(place, str) else getattr(rules, place[0])[place[1]]
    return out


def overlay(base: Settings, values: dict | None) -> Settings:
    """base with the values of a settings file over it; sections and keys that it does not know are ignored."""
    new = {}
    for section, given in (values or {}).items():
        if section == "extensions":
            new[section] = tuple(str(v).lower() for v in given)
        if section not in SECTIONS or not isinstance(given, dict):
            continue
        own, places = SECTIONS[section][0], _places(section)
        rules = getattr(base, own)
        for key, value in given.items():
            place = places.get(key)
            if isinstance(place, tuple):
                pair = list(getattr(rules, place[0]))
                pair[place[1]] = value
                rules = dataclasses.replace(rules, **{place[0]: tuple(pair)})
            elif place:
                rules = dataclasses.replace(rules, **{place: value})
        new[own] = rules
    return dataclasses.replace(base, **new)


def load(path: str | None = None) -> Settings:
    """Settings of a YAML or JSON file over the defaults; the defaults alone where the file is missing."""
    if path is None:
        return Settings()
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except FileNotFoundError:
        return Settings()
    if path.endswith(".json"):
        return overlay(Settings(), json.loads(text))
    import yaml  # only YAML files need it

    return overlay(Settings(), yaml.safe_load(text))


SCHEMA_VERSION = 4


def fingerprint(s: Settings) -> str:
    """SHA-256 of the canonical JSON of what decides a result; previews, extensions and the legacy correction do not."""
    form = file_form(s)
    body = {"schema": SCHEMA_VERSION} | {k: form[k] for k in DECIDING}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
