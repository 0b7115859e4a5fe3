"""Default parameters of the modelled application (one frozen dataclass)."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values that must equal the modelled application's defaults.
COMMERCE_DROP_COLUMNS = (
    "user_id", "signup_time", "purchase_time", "device_id", "country",
    "ip_address", "browser_source", "ip_country",
)
CARD_DROP_COLUMNS = ("Time", "Amount")
CATEGORICAL_COLUMNS = ("browser", "source", "sex")
RISK_CUTS = (0.3, 0.6, 0.8)  # low < 0.3 <= medium < 0.6 <= high < 0.8 <= critical
AGE_BIN_EDGES = (0, 18, 25, 35, 45, 55, 65, 100)  # right-closed bins, codes 0..6
AMOUNT_BIN_EDGES = (10, 50, 100, 500)  # (-inf,10],(10,50],(50,100],(100,500],(500,inf)
INSTANT_PURCHASE_HOURS = 0.0833
QUICK_PURCHASE_HOURS = 1.0
HIGH_RISK_RATE = 0.20
HIGH_RISK_MIN_COUNT = 10
SEVERE_IMBALANCE = 0.01
THRESHOLD_GRID = (0.05, 0.60, 0.01)  # start, stop (exclusive), step -> 55 values
SWEEP_GRID = (0.05, 0.95, 19)  # linspace start, stop, num


@dataclass(frozen=True)
class Defaults:
    target: str = "class"
    test_size: float = 0.2
    seed: int = 42
    threshold: float = 0.5
    cv_folds: int = 5
    # random forest
    rf_trees: int = 200
    rf_depth: int = 10
    rf_min_leaf: int = 5
    # boosted trees
    gbt_rounds: int = 200
    gbt_depth: int = 4
    gbt_step: float = 0.05
    gbt_subsample: float = 0.8
    gbt_pos_weight: float = 11.0
    # the second boosted-tree setting, of the learning curve
    curve_rounds: int = 100
    curve_depth: int = 6
    curve_step: float = 0.1
    curve_pos_weight: float = 1.0
    # logistic regression
    lr_max_iter: int = 1000
    # oversampling
    oversample: bool = True
    oversample_ratio: float = 0.5
    smote_k: int = 5
    commerce_drop: tuple = field(default=COMMERCE_DROP_COLUMNS)
    card_drop: tuple = field(default=CARD_DROP_COLUMNS)


DEFAULTS = Defaults()
