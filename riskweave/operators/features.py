"""Rule features (F1-F20) on a cleaned transaction table.

Per-group counts (sender-day, receiver-day, bank pairs) are computed as
aggregates and joined back, not as windows: the aggregate combines map-side
before its shuffle, and the join back broadcasts a small aggregate or splits a
hot key (one sender-day may hold a third of all rows). Columns that are absent
degrade to constants, as in the reference application. Flags are 0 or 1 and
counts bigint, never null (F18), by construction.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from riskweave.config import DEFAULT_CONFIG, ENHANCED_SCORE_CUT, NON_FEATURE_COLUMNS, RiskConfig
from riskweave.functions.joins import ROWS_COL, join_all_back
from riskweave.functions.quantile import exact_quantile, exact_quantiles
from riskweave.session import cut_lineage

FLAG_COLUMNS = (
    "high_risk_sender", "high_risk_receiver", "is_high_risk_drug_country_receiver",
    "near_threshold", "structuring_flag", "midnight_transaction",
    "high_cashflow_flag_acct_total", "rare_bank_combo_flag", "multiple_high_risk_transfers",
    "definite_fraud_flag", "high_risk_country_transaction",
    "high_risk_drug_country_transaction", "threshold_risk_transaction",
    "transaksione_ne_lokacione_ndryshe", "multiple_senders_same_receiver",
)
COUNT_COLUMNS = (
    "small_txn_count_per_day", "high_risk_transfers_per_day", "sender_bank_count",
    "receiver_bank_count", "unique_receiver_locations_per_day", "unique_senders_per_day",
)
FEATURE_ORDER = (
    "hour", "day", "month", "year", "dayofweek", "date",
    "high_risk_sender", "high_risk_receiver", "is_high_risk_drug_country_receiver",
    "near_threshold", "small_transaction", "small_txn_count_per_day", "structuring_flag",
    "high_risk_transfers_per_day", "multiple_high_risk_transfers",
    "sender_bank_count", "receiver_bank_count", "rare_sender_bank_combo",
    "rare_receiver_bank_combo", "rare_bank_combo_flag", "midnight_transaction",
    "high_cashflow_flag_acct_total", "high_cashflow_midnight",
    "unique_receiver_locations_per_day", "transaksione_ne_lokacione_ndryshe",
    "unique_senders_per_day", "multiple_senders_same_receiver", "enhanced_aml_score",
    "definite_fraud_flag", "high_risk_country_transaction",
    "high_risk_drug_country_transaction", "threshold_risk_transaction",
)


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def _calendar(have: set[str]) -> dict[str, Column]:
    """hour (null -> 12), day, month, year, dayofweek (Monday=0), date."""
    if "timestamp" in have:
        ts = F.col("timestamp")
        return {"hour": F.coalesce(F.hour(ts), F.lit(12)), "day": F.dayofmonth(ts), "month": F.month(ts), "year": F.year(ts),
                "dayofweek": F.weekday(ts), "date": ts.cast("date")}
    return {"hour": F.lit(12), "day": F.lit(1), "month": F.lit(1), "year": F.lit(2025), "dayofweek": F.lit(0),
            "date": F.lit(None).cast("date")}


def _countries(have: set[str], cfg: RiskConfig) -> dict[str, Column]:
    """sender/receiver in the high-risk list, receiver in the drug list (0 where the column is absent)."""
    def listed(c: str, codes) -> Column:
        return _flag(F.col(c).isin(list(codes))) if c in have else F.lit(0)
    return {"high_risk_sender": listed("sender_country", cfg.high_risk_countries),
            "high_risk_receiver": listed("receiver_country", cfg.high_risk_countries),
            "is_high_risk_drug_country_receiver": listed("receiver_country", cfg.high_risk_drug_countries)}


def _thresholds(cfg: RiskConfig) -> dict[str, Column]:
    """F5 near_threshold (closed interval), F6 small_transaction (< floor)."""
    lo, hi = cfg.near_threshold_floor, float(cfg.reporting_threshold)
    return {"near_threshold": _flag(F.col("amount").between(lo, hi)), "small_transaction": _flag(F.col("amount") < lo)}


def night(cfg: RiskConfig, hour: Column) -> Column:
    """start <= hour <= end, both inclusive (no wrap unless configured)."""
    s, e = int(cfg.midnight_start_hour), int(cfg.midnight_end_hour)
    return _flag((hour >= s) | (hour <= e) if cfg.midnight_wraps and s > e else hour.between(s, e))


#: Aggregate -> the feature columns that need it.
_USES = {
    "sender_day": ("small_txn_count_per_day", "structuring_flag", "high_risk_transfers_per_day", "multiple_high_risk_transfers",
                   "unique_receiver_locations_per_day", "transaksione_ne_lokacione_ndryshe", "enhanced_aml_score"),
    "receiver_day": ("unique_senders_per_day", "multiple_senders_same_receiver"),
    "sender_banks": ("sender_bank_count", "rare_sender_bank_combo", "rare_bank_combo_flag", "enhanced_aml_score"),
    "receiver_banks": ("receiver_bank_count", "rare_receiver_bank_combo", "rare_bank_combo_flag", "enhanced_aml_score"),
}
_CASHFLOW_USES = {"high_cashflow_flag_acct_total", "high_cashflow_midnight", "enhanced_aml_score"}
#: Features of the row alone.
ROW_FEATURES = frozenset(FEATURE_ORDER) - _CASHFLOW_USES - {c for uses in _USES.values() for c in uses}


def _aggregates(base: DataFrame, have: set[str], distinct_senders=F.count_distinct) -> dict[str, tuple[DataFrame, list[str]]]:
    """Counts by sender-day, receiver-day and bank pair, each with its keys and rows per key."""
    rows = F.count(F.lit(1)).alias(ROWS_COL)
    dated = base.where(F.col("date").isNotNull())
    out: dict[str, tuple[DataFrame, list[str]]] = {}
    if "sender_id" in have:
        parts = [F.sum("small_transaction").alias("small_txn_count_per_day"),
                 F.sum("is_high_risk_drug_country_receiver").alias("high_risk_transfers_per_day")]
        if "receiver_country" in have:
            parts.append(F.count_distinct("receiver_country").alias("unique_receiver_locations_per_day"))
        out["sender_day"] = dated.groupBy("sender_id", "date").agg(*parts, rows), ["sender_id", "date"]
    if {"receiver_id", "sender_id"} <= have:
        senders = distinct_senders("sender_id").cast("bigint").alias("unique_senders_per_day")
        out["receiver_day"] = (dated.where(F.col("sender_id").isNotNull()).groupBy("receiver_id", "date").agg(senders, rows),
                               ["receiver_id", "date"])
    if {"sender_bank", "receiver_bank", "sender_country", "receiver_country"} <= have:
        for side in ("sender", "receiver"):
            keys = [f"{side}_country", f"{side}_bank"]
            out[f"{side}_banks"] = base.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{side}_bank_count"), rows), keys
    return out


def _rules(cfg: RiskConfig, level: dict[str, Column], counts: dict[str, Column], cut: float | None) -> dict[str, Column]:
    """F7-F17 from the row-level flags and the counts; absent counts are 0, absent bank counts never rare."""
    c = {n: F.coalesce(counts.get(n, F.lit(0)), F.lit(0)).cast("bigint") for n in COUNT_COLUMNS}
    is1 = {n: level[n] == 1 for n in ("high_risk_sender", "high_risk_receiver", "is_high_risk_drug_country_receiver", "near_threshold")}
    limit = int(cfg.rare_bank_min_count)
    rare = {s: _flag(c[f"{s}_bank_count"] < limit) if f"{s}_bank_count" in counts else F.lit(0) for s in ("sender", "receiver")}
    at_night = night(cfg, level["hour"])
    cash = _flag(F.col("amount") >= F.lit(cut)) if cut is not None else F.lit(0)
    country = is1["high_risk_sender"] | is1["high_risk_receiver"]
    out = {**c,
           "structuring_flag": _flag(c["small_txn_count_per_day"] >= int(cfg.structuring_min_count)),
           "multiple_high_risk_transfers": _flag(c["high_risk_transfers_per_day"] >= 2),
           "transaksione_ne_lokacione_ndryshe": _flag(c["unique_receiver_locations_per_day"] > 1),
           "multiple_senders_same_receiver": _flag(c["unique_senders_per_day"] > 1),
           "rare_sender_bank_combo": rare["sender"], "rare_receiver_bank_combo": rare["receiver"],
           "rare_bank_combo_flag": _flag((rare["sender"] == 1) | (rare["receiver"] == 1)),
           "midnight_transaction": at_night, "high_cashflow_flag_acct_total": cash,
           "high_cashflow_midnight": _flag((cash == 1) & (at_night == 1)),
           "definite_fraud_flag": _flag(country & is1["near_threshold"] & (at_night == 1)),
           "high_risk_country_transaction": _flag(country),
           "high_risk_drug_country_transaction": _flag(is1["is_high_risk_drug_country_receiver"]),
           "threshold_risk_transaction": _flag(is1["near_threshold"])}
    terms = [(out[f] if f in out else level[f]) * F.lit(float(w)) for f, w in cfg.weights().items()]
    return {**out, "enhanced_aml_score": sum(terms[1:], terms[0]).cast("double")}


def numeric_features(df: DataFrame, include_ids: bool = False) -> list[str]:
    """numeric columns minus identifier/text/time names."""
    excl = set() if include_ids else set(NON_FEATURE_COLUMNS)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in excl]


def engineer_features(cleaned: DataFrame, cfg: RiskConfig = DEFAULT_CONFIG, cashflow_threshold: float | None = None,
                      only: Iterable[str] | None = None, approximate_senders: bool = False) -> DataFrame:
    """F1-F18 over an already cleaned (ideally materialised) table: its columns and FEATURE_ORDER, or just the
    features in ``only``.

    One row-level projection, the grouped aggregates that the asked-for features
    need, joined back (functions/joins.py), and one final projection. Without such
    features the result is a projection of ``cleaned``: no job runs to plan it.
    The cash-flow cut is an exact quantile (X1) unless it is given.
    ``approximate_senders`` counts distinct senders (F14) by a sketch."""
    have = set(cleaned.columns)
    wanted = [c for c in FEATURE_ORDER if only is None or c in set(only)]
    if only is not None and (unknown := set(only) - set(FEATURE_ORDER)):
        raise ValueError(f"no such features: {sorted(unknown)}")
    level = {**_calendar(have), **_countries(have, cfg), **_thresholds(cfg)}
    base = cleaned.select(*[F.col(f"`{c}`") for c in cleaned.columns], *[e.alias(c) for c, e in level.items()])
    cut = cashflow_threshold
    if cut is None and _CASHFLOW_USES & set(wanted):
        cut = exact_quantile(cleaned, "amount", float(cfg.high_amount_percentile))
    aggs = {name: a for name, a in _aggregates(
        base, have, F.approx_count_distinct if approximate_senders else F.count_distinct).items() if set(_USES[name]) & set(wanted)}
    joined = join_all_back(base, cleaned, aggs)
    rules = _rules(cfg, {c: F.col(c) for c in level}, {c: F.col(c) for c in COUNT_COLUMNS if c in joined.columns}, cut)
    return joined.select(*[F.col(f"`{c}`") for c in cleaned.columns],
                         *[rules[c].alias(c) if c in rules else F.col(c) for c in wanted])


def sweep(cleaned: DataFrame, configs: dict[str, RiskConfig], flags: Iterable[str], enhanced_cut: float = ENHANCED_SCORE_CUT) -> DataFrame:
    """F21 over many configurations: (config, n_rows, how many rows have each of ``flags``, n_enhanced), in one pass.

    What configurations share is computed once. Every distinct threshold is a
    column of the sender-day histogram (payments below it), every distinct drug
    list another; the bank counts hold for all, and one quantile call answers all
    percentiles. A row then has each configuration's flags as a projection, and
    one aggregate adds them up."""
    flags, have = list(flags), set(cleaned.columns)
    wanted = {*flags, "enhanced_aml_score"}
    floors = sorted({c.near_threshold_floor for c in configs.values()})
    lists = list(dict.fromkeys(tuple(c.high_risk_drug_countries) for c in configs.values()))
    cuts: dict[float, float | None] = {}
    if _CASHFLOW_USES & wanted:
        ranks = sorted({float(c.high_amount_percentile) for c in configs.values()})
        cuts = dict(zip(ranks, exact_quantiles(cleaned, "amount", ranks)["amount"]))
    base = cleaned.select(*[F.col(f"`{c}`") for c in cleaned.columns], *[e.alias(c) for c, e in _calendar(have).items()])

    def drug(codes) -> Column:
        return _flag(F.col("receiver_country").isin(list(codes))) if "receiver_country" in have else F.lit(0)
    below = [F.sum(_flag(F.col("amount") < f)).alias(f"_below{k}") for k, f in enumerate(floors)]
    below += [F.sum(drug(codes)).alias(f"_drug{k}") for k, codes in enumerate(lists)]
    first = with_thresholds(base, next(iter(configs.values())))
    aggs = {n: a for n, a in _aggregates(first, have).items() if set(_USES[n]) & wanted}
    if "sender_day" in aggs:
        rows, places = F.count(F.lit(1)).alias(ROWS_COL), F.count_distinct("receiver_country").alias("unique_receiver_locations_per_day")
        more = [places] if "transaksione_ne_lokacione_ndryshe" in wanted and "receiver_country" in have else []
        day = base.where(F.col("date").isNotNull()).groupBy("sender_id", "date").agg(*below, *more, rows)
        aggs["sender_day"] = day, ["sender_id", "date"]
    joined = join_all_back(base, cleaned, aggs)
    sums = [F.count(F.lit(1)).alias("n_rows")]
    for i, cfg in enumerate(configs.values()):
        level = {"hour": F.col("hour"), **_countries(have, cfg), **_thresholds(cfg)}
        counts = {c: F.col(c) for c in COUNT_COLUMNS if c in joined.columns}
        if "sender_day" in aggs:
            counts["small_txn_count_per_day"] = F.col(f"_below{floors.index(cfg.near_threshold_floor)}")
            counts["high_risk_transfers_per_day"] = F.col(f"_drug{lists.index(tuple(cfg.high_risk_drug_countries))}")
        rules = {**level, **_rules(cfg, level, counts, cuts.get(float(cfg.high_amount_percentile)))}
        hit = {**{f: rules[f] == 1 for f in flags}, "n_enhanced": rules["enhanced_aml_score"] >= enhanced_cut}
        sums += [F.count(F.when(h, 1)).alias(f"_{i}_{f}") for f, h in hit.items()]
    total = joined.agg(*sums)
    each = [F.struct(F.lit(name).alias("config"), F.col("n_rows").alias("n_rows"),
                     *[F.col(f"_{i}_{f}").alias(f) for f in (*flags, "n_enhanced")]) for i, name in enumerate(configs)]
    return total.select(F.explode(F.array(*each)).alias("_c")).select("_c.*")


def with_thresholds(base: DataFrame, cfg: RiskConfig) -> DataFrame:
    """``base`` with the row-level flags of one configuration."""
    level = {**_countries(set(base.columns), cfg), **_thresholds(cfg)}
    return base.select("*", *[e.alias(c) for c, e in level.items()])


def preprocess(df: DataFrame, cfg: RiskConfig = DEFAULT_CONFIG) -> tuple[DataFrame, list[str]]:
    """clean + features; returns (table, numeric feature names). The cleaned table is written once, as the
    features' aggregates and quantile all read it."""
    from riskweave.operators.clean import clean
    out = engineer_features(cut_lineage(clean(df)), cfg)
    return out, numeric_features(out)
