"""Composed plans over the fixtures: features table and scored table.

The cleaned table is checkpointed once (reliably, in spark.checkpoint.dir):
five feature branches and the cash-flow quantile read it, instead of each
re-running the scan, joins and dedup shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.config import DEFAULT_CONFIG, RiskConfig
from riskweave.functions.keys import with_row_key
from riskweave.operators.alerts import attach_scores
from riskweave.operators.clean import clean
from riskweave.operators.features import ROW_FEATURES, engineer_features
from riskweave.session import cut_lineage
from riskweave.sources import fixtures


def features_table(spark: SparkSession, sf_dir: str, cfg: RiskConfig = DEFAULT_CONFIG,
                   materialize: bool = True, only: Iterable[str] | None = None) -> DataFrame:
    """The fixture's features, or just those in ``only``. Row-level features alone need no written table."""
    cleaned = clean(fixtures.txn(spark, sf_dir))
    if materialize and (only is None or not set(only) <= ROW_FEATURES):
        cleaned = cut_lineage(cleaned)
    return engineer_features(cleaned, cfg, only=only)


def surrogate_native_score():
    """Deterministic stand-in for a model score (FIXTURES §4)."""
    return F.col("amount") / (1 + F.col("amount"))


def scored_table(spark: SparkSession, sf_dir: str, cfg: RiskConfig = DEFAULT_CONFIG) -> DataFrame:
    feat = features_table(spark, sf_dir, cfg)
    out, _ = attach_scores(feat, surrogate_native_score(), None, cfg.contamination)
    return out


def score_transactions(spark: SparkSession, model_path: str, df: DataFrame, policy: str = "native",
                       manual_cutoff: float = 0.0, topk_pct: float = 1.0,
                       contamination: float = 0.01) -> tuple[DataFrame, str]:
    """Model native score + percentile score + policy + rule flags.

    The model UDF runs once over the rows: the scored rows are written, and the
    quantile and the percentile rank read that table. The model kind comes from
    the artifact metadata; a feed without ``transaction_id`` gets row keys.
    Returns (scored table, policy description)."""
    from riskweave.operators import alerts as A
    from riskweave.operators.models.artifacts import load_model
    from riskweave.operators.models.training import native_scores
    model, scaler, md = load_model(spark, model_path)
    df = with_row_key(df)
    with_native = cut_lineage(native_scores(model, scaler, df, keep=df.columns).drop("x"))
    ranked = A.percentile_score(with_native, "native_score", "transaction_id", "aml_score")
    cut, text = A.policy_cut(ranked, policy, "native_score", md.get("threshold"), manual_cutoff, topk_pct,
                             contamination)
    out = A.combine_flags(A.flag_indicators(A.flag_enhanced(A.apply_policy(ranked, cut))))
    return out.select(*df.columns, *A.SCORE_COLUMNS), text
