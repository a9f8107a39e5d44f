"""Canonical schema and rule configuration."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference application for equal results.
# Canonical columns with the raw header variants accepted for each (order
# matters: the first exact variant wins).
CANONICAL_VARIANTS: dict[str, tuple[str, ...]] = {
    "transaction_id": ("transaction_id", "tx_id", "id"),
    "amount": ("amount", "transaction_value", "amt", "shuma_e_transaksionit", "shuma"),
    "sender_id": ("sender_id", "from_id", "id_i_llogarise_se_derguesit", "sender_account"),
    "receiver_id": ("receiver_id", "to_id", "id_i_llogarise_se_perfituesit", "receiver_account"),
    "sender_bank": ("sender_bank", "bank_from", "banka_derguese", "sending_bank"),
    "receiver_bank": ("receiver_bank", "bank_to", "banka_pranuese", "receiving_bank"),
    "sender_country": ("sender_country", "origin_country", "lokacioni_i_derguesit", "from_country"),
    "receiver_country": ("receiver_country", "dest_country", "lokacioni_i_perfituesit", "to_country"),
    "timestamp": ("timestamp", "date", "transaction_date", "data_transaksionit", "datetime"),
    "transaction_type": ("transaction_type", "type", "tx_type"),
    "currency": ("currency", "valuta_e_transaksionit", "valuta"),
    "sender_details": ("sender_details", "detajet_e_tjera_te_derguesit"),
    "receiver_details": ("receiver_details", "detajet_e_tjera_te_perfituesit"),
}
REQUIRED_COLUMNS: tuple[str, ...] = ("amount", "timestamp")

# Default risk lists (ISO-2 codes) and defaults filled during cleaning.
HIGH_RISK_COUNTRIES: tuple[str, ...] = (
    "KP", "IR", "MM", "DZ", "AO", "BG", "BF", "CM", "CI", "CD",
    "HT", "KE", "LA", "LB", "ML", "MC", "MZ", "NA", "NP", "NG",
    "ZA", "SS", "SY", "TZ", "VE", "VN", "YE", "BO", "VI",
)
HIGH_RISK_DRUG_COUNTRIES: tuple[str, ...] = ("AF", "CO", "MX", "VE", "MM", "BO", "PE", "LA", "PA")
FILL_DEFAULTS: dict[str, str] = {
    "sender_bank": "", "receiver_bank": "", "sender_country": "", "receiver_country": "",
    "transaction_type": "Unknown", "currency": "EUR",
}
# Columns that are identifiers, text or time, never model inputs.
NON_FEATURE_COLUMNS: tuple[str, ...] = (
    "transaction_id", "timestamp", "date", "sender_id", "receiver_id",
    "sender_bank", "receiver_bank", "sender_country", "receiver_country",
    "transaction_type", "currency", "sender_details", "receiver_details",
)
# Scoring constants: enhanced-score cut and high-weight indicator rule.
ENHANCED_SCORE_CUT = 6.0
HIGH_WEIGHT_INDICATORS: tuple[str, ...] = (
    "high_risk_sender", "high_risk_receiver", "is_high_risk_drug_country_receiver",
    "high_cashflow_flag_acct_total",
)
HIGH_WEIGHT_MIN_COUNT = 2
# End of fixed values.
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class RiskConfig:
    """Thresholds, lists and weights of the rules. The defaults are fixed values that must equal the reference
    application's, as are the ranges in ``_RANGES``."""
    reporting_threshold: float = 10000.0
    near_threshold_buffer: float = 0.9
    structuring_min_count: int = 3
    rare_bank_min_count: int = 3
    high_amount_percentile: float = 0.99
    contamination: float = 0.01
    midnight_start_hour: int = 0
    midnight_end_hour: int = 6
    midnight_wraps: bool = False
    high_risk_countries: tuple[str, ...] = HIGH_RISK_COUNTRIES
    high_risk_drug_countries: tuple[str, ...] = HIGH_RISK_DRUG_COUNTRIES
    weight_high_risk_sender: float = 3.0
    weight_high_risk_receiver: float = 3.0
    weight_drug_country: float = 4.0
    weight_near_threshold: float = 2.5
    weight_structuring: float = 2.0
    weight_midnight: float = 1.5
    weight_high_cashflow: float = 2.5
    weight_multiple_high_risk: float = 2.0
    weight_rare_bank: float = 1.5
    extra: dict = field(default_factory=dict, compare=False)

    @property
    def near_threshold_floor(self) -> float:
        return float(self.reporting_threshold) * float(self.near_threshold_buffer)

    def weights(self) -> dict[str, float]:
        """Flag column -> weight, in the order the weighted score adds them."""
        return {
            "high_risk_sender": self.weight_high_risk_sender,
            "high_risk_receiver": self.weight_high_risk_receiver,
            "is_high_risk_drug_country_receiver": self.weight_drug_country,
            "high_cashflow_flag_acct_total": self.weight_high_cashflow,
            "near_threshold": self.weight_near_threshold,
            "structuring_flag": self.weight_structuring,
            "midnight_transaction": self.weight_midnight,
            "multiple_high_risk_transfers": self.weight_multiple_high_risk,
            "rare_bank_combo_flag": self.weight_rare_bank,
        }

    def as_dict(self) -> dict:
        d = dataclasses.asdict(self)
        d.pop("extra", None)
        d["high_risk_countries"] = list(self.high_risk_countries)
        d["high_risk_drug_countries"] = list(self.high_risk_drug_countries)
        return d


DEFAULT_CONFIG = RiskConfig()

# Accepted ranges, as the reference application's form has them.
_RANGES = {
    "reporting_threshold": (0.0, 1_000_000.0),
    "near_threshold_buffer": (0.5, 1.0),
    "high_amount_percentile": (0.8, 0.999),
    "contamination": (0.001, 0.2),
    "structuring_min_count": (1, 20),
    "rare_bank_min_count": (1, 10),
    "midnight_start_hour": (0, 23),
    "midnight_end_hour": (0, 23),
}
# End of fixed values.
_ALIASES = {"multi_bank_min": "rare_bank_min_count"}


def _codes(values) -> tuple[str, ...]:
    if isinstance(values, str):
        values = values.split(",")
    return tuple(str(v).strip().upper() for v in values if str(v).strip())


def with_config(base: RiskConfig | None = None, **kv) -> RiskConfig:
    """Override thresholds, lists and weights with range checks."""
    base = base or DEFAULT_CONFIG
    changes = {}
    names = {f.name for f in dataclasses.fields(RiskConfig)}
    for k, v in kv.items():
        k = _ALIASES.get(k, k)
        if k not in names:
            raise ValueError(f"unknown config key: {k}")
        if k in ("high_risk_countries", "high_risk_drug_countries"):
            v = _codes(v)
        elif k.startswith("weight_"):
            v = float(v)
            if not 0.0 <= v <= 10.0:
                raise ValueError(f"{k}={v} outside [0, 10]")
        elif k in _RANGES:
            lo, hi = _RANGES[k]
            v = type(lo)(v)
            if not lo <= v <= hi:
                raise ValueError(f"{k}={v} outside [{lo}, {hi}]")
        changes[k] = v
    return dataclasses.replace(base, **changes)
