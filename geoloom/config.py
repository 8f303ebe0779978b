"""Settings with the defaults of the ingestion jobs."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class FetchOptions:
    """How a provider is asked; ``limit`` is the page size."""

    limit: int
    pause_sec: float = 0.25
    retries: int = 5
    backoff_sec: float = 1.5
    max_pages: int = 200
    timeout_sec: float = 30.0

    def __post_init__(self) -> None:
        for name, least in (("limit", 1), ("pause_sec", 0), ("retries", 1), ("max_pages", 1)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be {least} or more, not {getattr(self, name)}")


NESTED_FETCH, FLAT_FETCH = FetchOptions(limit=2000), FetchOptions(limit=1000)


@dataclass(frozen=True)
class Settings:
    """Read from the environment when made."""

    database_url: str = field(default_factory=lambda: os.environ.get("DATABASE_URL", ""))
    nested_token: str = field(default_factory=lambda: os.environ.get("MAPILLARY_ACCESS_TOKEN", ""))
    dedup_radius_m: float = 7.0
    max_per_cluster: int = 2
    min_image_bytes: int = 10_000
    download_retries: int = 3
    preview_count: int = 20
