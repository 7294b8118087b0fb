"""Limits and identities of one intake deployment."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class IntakeConfig:
    """Settings shared by the jobs; the defaults are the service limits."""

    expected_bucket: str = "docs"
    max_size_bytes: int = 65_536
    lease_seconds: int = 300
    max_receives: int = 3
    visibility_seconds: int = 720
    dead_letter_visibility_seconds: int = 180
    provider_name: str = "rules"
    service: str = "intake"
    # hot-key handling of the lookups, see operators/skew.py
    hot_share: float = 1e-5
    hot_min_rows: int = 100_000
    salts: int = 64
    # a counted batch of at most this many rows and bytes may be broadcast to large tables
    broadcast_rows: int = 200_000
    broadcast_bytes: int = 32 << 20

    def hot_options(self) -> dict:
        return {"share": self.hot_share, "min_rows": self.hot_min_rows, "salts": self.salts}

    def __post_init__(self) -> None:
        if not self.expected_bucket.strip():
            raise ValueError("expected_bucket must not be blank")
        if self.max_size_bytes <= 0 or self.lease_seconds <= 0:
            raise ValueError("max_size_bytes and lease_seconds must be positive")
        if self.max_receives < 1:
            raise ValueError("max_receives must be at least 1")
