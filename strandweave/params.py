"""Tunable values of the pipeline, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # read preparation
    min_read_length: int = 1000
    min_base_quality: float = 10.0
    genome_size: int | None = None
    target_depth: int = 50
    estimation_budget: int = 500_000_000
    estimation_coverage: float = 10.0
    # alignment filtering and classification
    min_overlap_length: int = 2000
    min_overlap_count: int = 3
    min_percent_identity: float = 5.0
    overhang_ratio: float = 0.8
    coords: str = "observed"
    # graph cleaning
    fuzz: int = 10
    max_bubble_length: int = 100
    min_support_ratio: float = 1.1
    max_tip_len: int = 4
    tip_mode: str = "observed"
    short_edge_ratio: float = 0.8
    cleanup_iterations: int = 3
    # read-guided completion
    completion_enabled: bool = False
    completion_rounds: int = 1
    completion_min_alignment_len: int = 2000
    completion_min_identity: float = 0.8
    completion_end_slack: int = 500

    def __post_init__(self) -> None:
        if self.coords not in ("observed", "coclip"):
            raise ValueError(f"coords must be 'observed' or 'coclip', not {self.coords!r}")
        if self.tip_mode not in ("observed", "documented"):
            raise ValueError(f"tip_mode must be 'observed' or 'documented', not {self.tip_mode!r}")
        if self.max_tip_len < 1:
            raise ValueError("max_tip_len must be at least 1")

    def but(self, **changes) -> "Params":
        return replace(self, **changes)
