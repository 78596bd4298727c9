"""Parameters that decide results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    threshold: float = 0.5
    nb_weight: float = 0.6
    lexicon_weight: float = 0.4
    distress_factor: float = 0.4
    max_words: int = 128
    language_ratio: float = 0.15
    negation_window: int = 3
    nb_negation_kept: float = 0.75
    negation_scalar: float = -0.74
    caps_step: float = 0.733
    far_booster: float = 0.95
    exclamation: float = 0.292
    exclamations_at_most: int = 4
    alpha_floor: int = 10
    alpha_top: int = 15
    alert_after: int = 3
    log_rows: int = 200
    log_chars: int = 100
    test_share: float = 0.2
    negatives_per_positive: int = 3


DEFAULT = Config()
