"""Feature preparation entry points shared by training and scoring.

``prepare_features`` dispatches on the dataset type, engineers features
with fitted state, drops the configured columns and keeps numeric columns
(plus the key).  ``Preprocessor`` is impute -> scale (-> oversample on the
training side) with state fitted on training rows only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from riskloom.config import CARD_DROP_COLUMNS, COMMERCE_DROP_COLUMNS, DEFAULTS
from riskloom.operators import prep as P
from riskloom.operators import quality as Q
from riskloom.plans import card as CD
from riskloom.plans import commerce as C

DATASET_TYPES = ("fraud", "creditcard")


@dataclass
class FeatureState:
    dataset_type: str
    commerce: C.CommerceState | None = None
    card: CD.CardState | None = None


def fit_feature_state(df: DataFrame, dataset_type: str, label: str = "class") -> FeatureState:
    if dataset_type == "fraud":
        return FeatureState(dataset_type, commerce=C.fit_state(df, label))
    if dataset_type == "creditcard":
        return FeatureState(dataset_type, card=CD.fit_card_state(df))
    raise ValueError(f"Unknown dataset type: {dataset_type}")


def engineer(df: DataFrame, state: FeatureState, ranges: DataFrame | None = None,
             materialize: bool = True, history=None) -> DataFrame:
    if state.dataset_type == "fraud":
        return C.engineer(df, state.commerce, ranges, materialize=materialize, history=history)
    if state.dataset_type == "creditcard":
        return CD.engineer(df, state.card)
    raise ValueError(f"Unknown dataset type: {state.dataset_type}")


def prepare_features(df: DataFrame, dataset_type: str, state: FeatureState | None = None,
                     drop_columns: Sequence[str] | None = None, keep: Sequence[str] = ("txn_id",),
                     ranges: DataFrame | None = None, label: str = "class",
                     materialize: bool = True, history=None) -> DataFrame:
    """Engineer -> drop -> numeric columns.  ``state=None`` fits on ``df``;
    ``history`` is the saved per-key state (``keystate.KeyState``), if any.

    ``materialize`` checkpoints the (joined) input once before the many
    feature branches read it; see ``commerce.engineer``."""
    if dataset_type not in DATASET_TYPES:
        raise ValueError(f"Unknown dataset type: {dataset_type}")
    if state is None:
        base = df
        if dataset_type == "fraud" and ranges is not None and "ip_country" not in df.columns:
            base = C.with_country(df, ranges)
            if materialize:
                from riskloom.session import cut_lineage
                base = cut_lineage(base)  # read by the state fit and the features
                materialize = False
            df, ranges = base, None
        state = fit_feature_state(base, dataset_type, label)
    out = engineer(df, state, ranges, materialize=materialize, history=history)
    if drop_columns is None:
        drop_columns = COMMERCE_DROP_COLUMNS if dataset_type == "fraud" else CARD_DROP_COLUMNS
    out = Q.drop_present(out, [c for c in drop_columns if c not in keep])
    numeric = Q.numeric_columns(out)
    return out.select(*[c for c in keep if c in out.columns and c not in numeric], *numeric)


# ------------------------------------------------------------ preprocess --

@dataclass
class Preprocessor:
    """impute (train medians) -> scale (train moments) [-> oversample train]."""
    features: list = field(default_factory=list)
    impute: P.ImputeState = field(default_factory=P.ImputeState)
    scale: P.ScaleState = field(default_factory=P.ScaleState)
    use_smote: bool = DEFAULTS.oversample

    @property
    def fitted(self) -> bool:
        return self.scale.fitted

    def fit(self, train: DataFrame, features: Sequence[str]) -> "Preprocessor":
        self.features = list(features)
        self.impute = P.fit_medians(train, self.features)
        self.scale = P.fit_scaler(P.apply_medians(train, self.impute), self.features)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise RuntimeError("Preprocessor must be fitted before transform")
        return P.apply_scaler(P.apply_medians(df, self.impute), self.scale)

    def fit_transform(self, train: DataFrame, features: Sequence[str], label: str = "class",
                      key: str = "txn_id") -> DataFrame:
        out = self.fit(train, features).transform(train)
        if self.use_smote:
            from riskloom.operators.balance import smote
            out = smote(out, self.features, label=label, key=key,
                        ratio=DEFAULTS.oversample_ratio, k=DEFAULTS.smote_k, seed=DEFAULTS.seed)
        return out
