"""Parameters of the operators; the defaults are the published operating constants."""

from __future__ import annotations

from dataclasses import dataclass

RETENTION_DAYS = 45
RULE_OFF = 999.0
"""Rule threshold no risk score reaches: switches the score rule off."""
CONTAMINATION_OFF = 2.0
"""Cluster share no cluster reaches: switches the network estimate off."""


@dataclass(frozen=True)
class RiskParams:
    """Thresholds of the A-F grouping."""

    edge: float = 0.50
    mid: float = 0.90
    high: float = 0.95
    rule_threshold: float = RULE_OFF
    block_b: bool = False

    def __post_init__(self):
        if not self.edge <= self.mid <= self.high:
            raise ValueError(
                f"thresholds must satisfy edge <= mid <= high, got {self.edge}, {self.mid}, {self.high}"
            )


@dataclass(frozen=True)
class ResolutionParams:
    """Rules for the resolution vocabulary and its z-score."""

    min_days: int = 7
    min_user_days: int = 100
    z_clip: float = 10.0
    min_training_days: int = 3


@dataclass(frozen=True)
class ForestParams:
    """Isolation forest of Liu, Ting and Zhou (2008)."""

    trees: int = 100
    sample_size: int = 256
    contamination: float = 0.05
    seed: int = 42
