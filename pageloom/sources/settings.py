"""Settings from the environment, read by type; what can't be read falls back silently."""

from __future__ import annotations

import os
from dataclasses import dataclass


def whole(name: str, default: int) -> int:
    try:
        return int(os.environ.get(name, default))
    except (TypeError, ValueError):
        return default


def decimal(name: str, default: float) -> float:
    try:
        return float(os.environ.get(name, default))
    except (TypeError, ValueError):
        return default


def text(name: str, default: str) -> str:
    return os.environ.get(name, default).strip()


@dataclass(frozen=True)
class Limits:
    """Limits of an installation; made on the driver and sent along by closure."""

    max_mb: int
    max_batch_mb: int
    ttl_min: int
    max_age_min: int
    page_jobs: int
    detect_all_pages: int

    @classmethod
    def from_environment(cls) -> Limits:
        single = whole("PAGELOOM_MAX_MB", 100)
        return cls(single, max(single, whole("PAGELOOM_MAX_BATCH_MB", 500)), whole("PAGELOOM_TTL_MIN", 30), whole("PAGELOOM_MAX_AGE_MIN", 240),
                   max(1, min(whole("PAGELOOM_PAGE_JOBS", 4), os.cpu_count() or 2)), max(1, min(whole("PAGELOOM_DETECT_ALL", 12), 100)))
