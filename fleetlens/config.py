"""Rule thresholds and window sizes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    """Every constant a rule reads. Window sizes are in rule minutes.

    ``unit_s`` is the length of one rule minute in seconds; it stretches the
    whole time axis (windows, slopes, ETAs) for data sampled more coarsely.
    """

    # Configurable thresholds.
    heap_cap_mb: float = 4096.0
    io_z: float = 4.0
    retrans_pct: float = 5.0
    latency_x: float = 2.0

    # Windows.
    recent_min: int = 10
    heap_min: int = 30
    baseline_min: int = 30

    # Rule tuning.
    heap_min_rows: int = 8
    heap_min_slope: float = 4.0
    heap_min_corr: float = 0.60
    heap_min_fill: float = 0.5
    heap_horizon_min: float = 120.0
    heap_p1_eta_min: float = 45.0
    io_min_std: float = 0.01
    latency_floor_ms: float = 60.0
    error_floor_pct: float = 3.0
    error_jump_x: float = 3.0
    error_base_floor_pct: float = 0.1
    error_p1_pct: float = 8.0

    # Root-cause verdict.
    rca_latency_x: float = 1.3
    rca_heap_slope: float = 8.0
    rca_heap_fill: float = 0.6
    rca_gc_ms: float = 80.0
    rca_io_ms: float = 30.0
    rca_worst_vms: int = 3

    unit_s: float = 60.0

    @property
    def unit_us(self) -> int:
        return int(self.unit_s * 1_000_000)

    @classmethod
    def from_settings(cls, settings: Mapping[str, str]) -> "Thresholds":
        """Read the user-facing setting names; anything absent keeps its default."""
        names = {
            "heap_limit_mb": "heap_cap_mb",
            "io_z_threshold": "io_z",
            "retrans_pct": "retrans_pct",
            "latency_x": "latency_x",
        }
        return cls(**{field: float(settings[key]) for key, field in names.items() if key in settings})
