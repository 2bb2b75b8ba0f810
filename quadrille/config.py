"""Engine settings."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Constants of retrieval, evidence filtering and evaluation."""

    semantic_top_k: int = 20
    relation_top_k: int = 3
    direction_limit: int = 10
    entity_threshold: float = 0.85
    trigger_l0: float = 30.0
    trigger_alpha: float = 0.5
    trigger_beta: float = 0.5
    trigger_tau: float = 0.75
    delta_days: int = 1
    verify_ratio: float = 3.0
    hit_k: int = 1
    #: "time": chronological pools; "ingest": the order in which lines were read.
    order: str = "time"
    #: "always": filtered evidence overrides; "triggered_only": only where the filter ran.
    override: str = "always"
    answerer: str = "extractive"
    #: Whether a generator, where there is one, also traces evidence that the ratio gate doubts.
    verify: bool = True
