"""Settings of a mining run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MiningConfig:
    min_support: int = 3
    max_size: int = 3
    chunk_size: int = 50
    #: Emitted combinations per basket row beyond which level-wise joins are used instead.
    explode_ratio: float = 50.0
    #: Largest pruned basket for which combinations are exploded.
    explode_items: int = 60
