"""Scan settings and the default lists the operators start from."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: defaults that decide results -------------------------------
CONFIDENCE_THRESHOLD = 0.8
CHUNK_TAIL_CHARS = 128
MAX_BODY_BYTES = 10 * 1024 * 1024
SCAN_HEADERS = ("X-User-Email", "X-User-Name", "X-Forwarded-For")
BLOCKED_TERMS = ("CONFIDENTIAL", "TOP SECRET")
SAFE_VALUES = ("example.com", "test@test.com")
ROUTES = (
    ("/openai", "openai"),
    ("/anthropic", "anthropic"),
    ("/azure", "azure"),
    ("/gemini", "gemini"),
)
FAILURES_TO_TRIP = 5
MAX_CONCURRENCY = 10_000
LATENCY_BUCKETS_SECONDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
# --- end of fixed values ------------------------------------------------------


@dataclass(frozen=True)
class ScanConfig:
    """What to look for and what to keep.

    ``detectors`` is ordered: on equal confidence the earlier detector wins an
    overlap. ``allowlist`` entries exempt a span whose whole value equals one of
    them, ignoring case. Texts of more than ``watched_chars`` are scanned like all
    others and can be told by ``detect.oversize``.
    """

    detectors: tuple = ()
    threshold: float = CONFIDENCE_THRESHOLD
    allowlist: tuple[str, ...] = ()
    unit_chars: int = 4096
    watched_chars: int = 1_000_000

    def __post_init__(self) -> None:
        if not self.detectors:
            raise ValueError("a scan needs at least one detector")
        if self.unit_chars < 1:
            raise ValueError("unit_chars must be positive")


def default_config(
    threshold: float = CONFIDENCE_THRESHOLD,
    terms: tuple[str, ...] = BLOCKED_TERMS,
    allowlist: tuple[str, ...] = SAFE_VALUES,
) -> ScanConfig:
    """The eight patterns plus the term list, as configured out of the box."""
    from veilframe.operators.detect import PatternDetector, TermDetector

    detectors: tuple = (PatternDetector(),)
    if terms:
        detectors += (TermDetector(terms),)
    return ScanConfig(detectors=detectors, threshold=threshold, allowlist=allowlist)
