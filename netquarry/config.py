"""Engine parameters."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    """All tunable values of the batch analysis, with their defaults."""

    # Score weights for cohesion, infrastructure, timing and intelligence.
    w1: float = 0.35
    w2: float = 0.25
    w3: float = 0.20
    w4: float = 0.20
    drift_threshold: float = 0.15
    drift_window: str = "6 hours"
    fingerprint_window: str = "1 hour"
    cluster_method: str = "kmeans"  # kmeans | hierarchical | density
    k_min: int = 2
    k_max: int = 10
    n_init: int = 10
    seed: int = 42
    min_cluster_size: int = 5
    min_samples: int = 3
    iot_ports: tuple[int, ...] = (23, 2323, 7547, 8080, 8443, 5555, 48101, 37215)
    enrich_per_campaign: int | None = None  # None: every address of a campaign
    graph_display_cap: int = 3_000
    replay_steps: int = 1_500
    sample_rows: int = 50_000
    scatter_cap: int = 4_000

    @property
    def weights(self) -> dict[str, float]:
        return {"w1": self.w1, "w2": self.w2, "w3": self.w3, "w4": self.w4}


DEFAULT = EngineConfig()
