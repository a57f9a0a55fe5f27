"""Settings of a deployment, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

from .functions.numbers import PRICES


@dataclass(frozen=True)
class Config:
    max_upload_bytes: int = 25 << 20
    review_threshold: float = 0.80
    embedding_width: int = 512
    budget_calls: int = 40
    budget_days: int = 7
    budget_share: float = 0.9
    lease_seconds: int = 120
    max_attempts: int = 3
    embedding_provider: str = "hashing"
    allowed_hosts: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if self.max_upload_bytes <= 0:
            raise ValueError("max_upload_bytes must be positive")
        if not 0 <= self.review_threshold <= 1 or not 0 < self.budget_share <= 1:
            raise ValueError("shares lie between 0 and 1")
        if not 64 <= self.embedding_width <= 4096:
            raise ValueError("embedding_width must be 64 to 4096")
        if self.budget_calls < 0 or self.budget_days < 1 or self.lease_seconds < 1 or self.max_attempts < 1:
            raise ValueError("counts and times must be positive")
        if self.embedding_provider not in ("hashing", "local", "hosted"):
            raise ValueError("unknown embedding provider")
        if any("/" in h or "@" in h for h in self.allowed_hosts):
            raise ValueError("allowed_hosts are bare host names")


__all__ = ["Config", "PRICES"]
