"""Gate thresholds, language profiles and other settings. Fixed values."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

NATIVE_MIN_CHARS = 50
HIGH_CONFIDENCE = 92.0
SCORE_MIN_CONFIDENCE = 70.0
DECISION_ACCURACY = 0.8
UNRELIABLE = (0.75, 0.25)  # low-confidence ratio above, pass similarity below
DIAGRAM_HEAVY = (0.85, 0.25, 0.95, 0.15)
MAX_RETRIES = 2
DEFAULT_PAGE_HEIGHT = 792.0
BBOX_TOLERANCE = 20.0
JOB_TTL_SECONDS = 3600
PREVIEW_CHARS, TEXT_CHARS = 500, 5000
MIN_IMAGE_AREA, MIN_IMAGE_PIXELS = 1000.0, 20
EQUATION_ASPECT = (1.5, 20.0)
OTSU_DEFAULT = 200
OCR_CHUNK_PAGES = 5
LLM_BATCH = 15


@dataclass(frozen=True)
class Gate:
    """Thresholds of the quality gate."""

    min_avg_confidence: float = 93.0
    max_low_conf_ratio: float = 0.5
    min_pass_similarity: float = 0.85
    min_native_similarity: float = 0.85
    decision_accuracy: float = DECISION_ACCURACY
    skip_native_gate: bool = False


TARGETS = {90: {"min_avg_confidence": 90.0, "max_low_conf_ratio": 0.6, "min_pass_similarity": 0.90, "min_native_similarity": 0.90,
                "decision_accuracy": 0.9, "skip_native_gate": True}}
PRESETS = {"default": {}, "kannada": {"min_avg_confidence": 90.0, "max_low_conf_ratio": 0.6, "min_pass_similarity": 0.35, "min_native_similarity": 0.0}}
#: Relaxed thresholds by layout: (max_low_conf_ratio, min_pass_similarity, min_native_similarity, min_avg_confidence); None: as is.
LAYOUTS = {"table": (0.8, 0.36, 0.0, 90.0), "noisy": (0.85, 0.35, 0.0, 90.0), "text": (None, 0.88, None, None)}

#: Languages: tesseract, paddle, sarvam, preset.
LANGUAGES = {
    "english": ("eng", "en", None, "default"),
    "kannada": ("kan", "kn", "kn-IN", "kannada"),
    "hindi": ("hin", "hi", "hi-IN", "default"),
    "tamil": ("tam", "ta", "ta-IN", "default"),
    "telugu": ("tel", "te", "te-IN", "default"),
}
ALIASES = {"eng": "english", "en": "english", "kan": "kannada", "kn": "kannada", "hin": "hindi", "hi": "hindi", "tam": "tamil", "ta": "tamil",
           "tel": "telugu", "te": "telugu"}
#: Unicode ranges of scripts.
EXPECTED_SCRIPT = {"kn": (0x0C80, 0x0CFF), "hi": (0x0900, 0x097F), "ta": (0x0B80, 0x0BFF), "te": (0x0C00, 0x0C7F)}
FOREIGN_SCRIPTS = {"thai": (0x0E00, 0x0E7F), "sinhala": (0x0D80, 0x0DFF), "khmer": (0x1780, 0x17FF), "lao": (0x0E80, 0x0EFF)}
MALAYALAM = (0x0D00, 0x0D7F)

OCR_STRATEGIES = {"standard": (200, 3, (1, 150, 3), 1), "aggressive": (220, 5, (2, 200, 3), 2)}
LAYOUT_PASSES = {"text": ((6, 3), ("standard",)), "table": ((4, 11, 6), ("standard", "aggressive")), "noisy": ((4, 6, 11, 3), ("standard", "aggressive"))}
RETRY_DPI, RETRY_THRESHOLD, RETRY_OSD = (800, 1000), (220, 180), (True, False)


def gate(quality_target: int | None = None, preset: str = "default") -> Gate:
    """Strict defaults, then the quality target, then the language preset."""
    return replace(Gate(), **(TARGETS.get(quality_target or 0, {}) | PRESETS[preset]))


def env_int(name: str, default: int, low: int, high: int) -> int:
    """An integer setting from the environment, kept within bounds."""
    try:
        value = int(os.environ.get(name, default))
    except ValueError:
        value = default
    return max(low, min(high, value))


def env_bool(name: str, default: bool = False) -> bool:
    value = os.environ.get(name)
    return default if value is None else value.strip().lower() in ("1", "true", "yes")

#: Limits of a small host: resolution, and pages of a call and of a job (fixed values).
SAFE_DPI, SYNC_MAX_PAGES, ASYNC_MAX_PAGES = 300, 5, 100
