"""Settings of scoring and ingest. Values become literals in expressions, so Catalyst folds them."""

from __future__ import annotations

from dataclasses import dataclass, field

CRORE = 1e7


@dataclass(frozen=True)
class Settings:
    """Results depend on them."""

    # points of the six components
    weight_annualised: float = 40.0
    weight_quarterly: float = 20.0
    weight_firmness: float = 15.0
    weight_margin: float = 10.0
    weight_novelty: float = 10.0
    weight_capacity: float = 5.0
    # tiers
    high: float = 75.0
    medium: float = 60.0
    watch: float = 40.0
    floor_inr: float = CRORE
    override_quarters: float = 0.50
    implausible_quarters: float = 25.0
    # materiality gate
    gate_annualised: tuple[float, float] = (0.02, 0.10)
    gate_quarterly: tuple[float, float] = (0.10, 0.50)
    gate_unknown: float = 0.25
    # guidance
    guidance_revenue: tuple[float, float] = (1.15, 2.0)
    guidance_pat: tuple[float, float] = (1.25, 3.0)
    guidance_revenue_weight: float = 0.6
    guidance_pat_only: float = 0.8
    guidance_horizon: tuple[float, float, float] = (1.0, 0.85, 0.65)
    guidance_implausible: float = 8.0
    guidance_implausible_factor: float = 0.3
    guidance_bonus: float = 0.25
    # penalties
    penalty_mcap: float = 0.40
    penalty_sme: float = 0.60
    penalty_related: float = 0.50
    penalty_stale: float = 0.70
    penalty_implausible: float = 0.35
    stale_hours: int = 48
    cap_no_value: float = 35.0
    cap_no_revenue: float = 60.0
    cap_amendment: float = 25.0
    # novelty
    history_days: int = 720
    # ingest
    overlap_minutes: int = 10
    lookback_minutes: int = 60
    catchup_hours: int = 96
    # order book
    book_min_confidence: float = 0.45
    fx: dict = field(default_factory=lambda: {"INR": 1.0, "USD": 88.0, "EUR": 96.0, "GBP": 112.0})


SETTINGS = Settings()
