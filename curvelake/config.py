"""Settings of the curve analyses, in hours and OD units."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class GridConfig:
    step: float = 0.5
    tmax: float = 16.0
    min_points: int = 4

    @property
    def points(self) -> int:
        return int(self.tmax / self.step + 1e-9) + 1


@dataclass(frozen=True)
class OverrideConfig:
    max_gap_hours: float = 10.0
    max_missing: float = 0.85
    max_feature_missing: float = 0.25
    low_confidence: float = 0.30


@dataclass(frozen=True)
class LateConfig:
    """Late-window evidence (times after ``start``)."""

    start: float = 16.0
    min_points: int = 3
    noise_floor: float = 0.005
    z_cap: float = 50.0
    z_strong: float = 2.0
    z_full: float = 4.0
    cv_low: float = 0.05
    cv_high: float = 0.20
    evaporation_slope: float = -0.005
    artifact: float = 0.70
    decline: float = 0.70
    quality: float = 0.30
    max_missing: float = 0.85
    full_span: float = 4.0


@dataclass(frozen=True)
class FitConfig:
    min_doses: int = 6
    bootstrap_curve: int = 200
    bootstrap_dose: int = 300
    alpha: float = 0.05
    seed: int = 42
    grid: int = 400


#: Horizons of truncation, the pool of candidate features and those in use.
HORIZONS = [8.0, 10.0, 12.0, 14.75, 16.0]
FEATURE_POOL = [
    "observed_tmax", "n_points_observed", "max_gap_hours", "missing_frac_on_grid", "initial_OD", "final_OD", "net_change_per_hour", "max_slope", "auc_per_hour", "lag_time_est", "growth_phase_duration",
    "monotonicity_fraction", "largest_drop_frac", "multi_phase_flag", "roughness", "noise_residual_std",
]
SELECTED_FEATURES = ["largest_drop_frac", "auc_per_hour", "growth_phase_duration", "multi_phase_flag", "max_slope", "final_OD", "net_change_per_hour", "lag_time_est", "roughness", "max_gap_hours"]
SLICES = ["source_type", "train_horizon", "is_censored", "too_sparse"]


@dataclass(frozen=True)
class RunConfig:
    grid: GridConfig = field(default_factory=GridConfig)
    overrides: OverrideConfig = field(default_factory=OverrideConfig)
    late: LateConfig = field(default_factory=LateConfig)
    fit: FitConfig = field(default_factory=FitConfig)
