"""Every threshold in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

#: USD for one unit of each currency, where no rate table says otherwise.
USD_RATES = {"USD": 1.0, "EUR": 1.08, "GBP": 1.27, "INR": 0.012, "MYR": 0.22, "CAD": 0.73, "AUD": 0.66, "JPY": 0.0067, "CNY": 0.14, "SGD": 0.74, "AED": 0.27, "CHF": 1.12}


@dataclass(frozen=True)
class Settings:
    """Thresholds of matching, rules and tiers."""

    # near-duplicate matching
    block_length: int = 3
    amount_tolerance: float = 0.005
    amount_slack: float = 0.01
    date_window: int = 7
    id_match: float = 0.85
    id_support: float = 0.70
    name_same_vendor: float = 0.85
    name_any_vendor: float = 0.90
    ratio_weight: float = 0.4
    jaro_winkler_weight: float = 0.6
    # statistics: larger groups use all their invoices instead of all but the one judged
    leave_one_out_most: int = 500
    # rules
    over_history: int = 3
    over_ratio: float = 3.0
    over_z: float = 3.5
    review_ratio: float = 2.0
    review_z: float = 2.5
    burst: int = 3
    round_least: float = 25_000.0
    round_step: float = 5_000.0
    round_ratio: float = 2.5
    # tiers
    high: float = 0.8
    medium: float = 0.4
    # vendor resolution, on a scale of 0 to 100
    vendor_ratio: float = 90.0
    vendor_partial: float = 95.0
    vendor_partial_length: int = 15
    vendor_suggest: float = 70.0
    rates: dict[str, float] = field(default_factory=lambda: dict(USD_RATES))


DEFAULT = Settings()
