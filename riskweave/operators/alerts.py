"""Scoring, alert policies, KPIs and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.config import (DEFAULT_CONFIG, ENHANCED_SCORE_CUT, HIGH_WEIGHT_INDICATORS,
                              HIGH_WEIGHT_MIN_COUNT, RiskConfig)
from riskweave.functions.keys import with_row_key
from riskweave.functions.quantile import exact_quantile
from riskweave.functions.rank import percentile_rank


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


# --- A1-A4: model score -> policy flag ---------------------------------------
def percentile_score(df: DataFrame, native_col: str = "native_score", tie_col: str = "transaction_id",
                     out_col: str = "aml_score") -> DataFrame:
    """A1: ordinal rank of the native score / (n - 1), ties by ``tie_col`` (a row key where absent)."""
    return percentile_rank(with_row_key(df, tie_col), native_col, tie_col, out_col)


def policy_cut(df: DataFrame, policy: str = "native", native_col: str = "native_score",
               trained_threshold: float | None = None, manual_cutoff: float = 0.0,
               topk_pct: float = 1.0, contamination: float = 0.01) -> tuple[float | None, str]:
    """A2-A4: the native-score cut of a policy and its description."""
    if policy == "native":
        cut = trained_threshold
        if cut is None:
            cut = exact_quantile(df, native_col, 1.0 - float(contamination))
        return cut, "learned cut: no scores" if cut is None else f"learned cut: {float(cut):.6g}"
    if policy == "manual":
        cut = float(manual_cutoff or 0.0)
        return cut, f"score cut set by hand: {cut:.6g}"
    if policy == "topk":
        cut = exact_quantile(df, native_col, 1.0 - float(topk_pct) / 100.0)
        return cut, f"scores in the top {float(topk_pct):.1f}%, from {float(cut):.6g}" if cut is not None else "highest scores: no rows"
    raise ValueError(f"unknown policy: {policy}")


def apply_policy(df: DataFrame, cut: float | None, native_col: str = "native_score",
                 out_col: str = "anomaly_label") -> DataFrame:
    flag = _flag(F.col(native_col) >= F.lit(cut)) if cut is not None else F.lit(0)
    return df.withColumn(out_col, flag)


# --- A5-A7: rule flags and the final alert ------------------------------------
def flag_enhanced(df: DataFrame, cut: float = ENHANCED_SCORE_CUT) -> DataFrame:
    """A5: enhanced score >= cut (0 if the column is absent)."""
    e = _flag(F.col("enhanced_aml_score") >= cut) if "enhanced_aml_score" in df.columns else F.lit(0)
    return df.withColumn("flagged_by_enhanced", e)


def flag_indicators(df: DataFrame, min_count: int = HIGH_WEIGHT_MIN_COUNT) -> DataFrame:
    """Number of high-weight indicators fired; flag if >= min_count."""
    terms = [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in HIGH_WEIGHT_INDICATORS if c in df.columns]
    cnt = sum(terms[1:], terms[0]) if terms else F.lit(0)
    return (df.withColumn("high_weight_indicator_count", cnt.cast("int"))
              .withColumn("flagged_by_indicators", _flag(F.col("high_weight_indicator_count") >= min_count)))


def combine_flags(df: DataFrame) -> DataFrame:
    """flagged_by_model = anomaly_label; is_flagged = any of three."""
    out = df.withColumn("flagged_by_model", F.col("anomaly_label").cast("int"))
    if "flagged_by_enhanced" not in out.columns:
        out = flag_enhanced(out)
    if "flagged_by_indicators" not in out.columns:
        out = flag_indicators(out)
    return out.withColumn("is_flagged", _flag((F.col("flagged_by_enhanced") == 1) |
                                              (F.col("flagged_by_indicators") == 1) |
                                              (F.col("flagged_by_model") == 1)))


SCORE_COLUMNS = ("aml_score", "native_score", "anomaly_label", "flagged_by_model", "flagged_by_enhanced",
                 "flagged_by_indicators", "high_weight_indicator_count", "is_flagged")


def attach_scores(df: DataFrame, native: Column, cut: float | None = None, contamination: float = 0.01,
                  tie_col: str = "transaction_id") -> tuple[DataFrame, float | None]:
    """Native score column -> the eight score columns of a scored table.

    The percentile rank checkpoints the table once; the policy cut (data
    quantile when no trained threshold is given) is read from that copy.
    """
    df = with_row_key(df, tie_col)
    out = df.withColumn("native_score", native.cast("double"))
    out = percentile_score(out, "native_score", tie_col, "aml_score")
    if cut is None:
        cut = exact_quantile(out, "native_score", 1.0 - float(contamination))
    out = apply_policy(out, cut)
    out = combine_flags(flag_indicators(flag_enhanced(out)))
    return out.select(*[c for c in df.columns], *SCORE_COLUMNS), cut


# --- A9-A11, A17: KPIs --------------------------------------------------------
def _flag_column(df: DataFrame) -> Column:
    if "is_flagged" in df.columns:
        return F.col("is_flagged")
    if "anomaly_label" in df.columns:
        return F.col("anomaly_label")
    return F.lit(0)


def _kpi_aggs(df: DataFrame, score_col: str = "aml_score") -> list[Column]:
    n = F.count(F.lit(1))
    f = F.coalesce(F.sum(_flag_column(df)), F.lit(0)).cast("bigint")
    mean = F.avg(score_col) if score_col in df.columns else F.lit(None).cast("double")
    return [n.alias("n_transactions"), f.alias("n_flagged"),
            F.when(n > 0, f * 100.0 / n).otherwise(0.0).alias("flagged_rate_pct"),
            mean.alias("avg_aml_score")]


def kpis(df: DataFrame) -> DataFrame:
    """Rows, flagged, rate %, mean aml_score (one aggregate)."""
    return df.agg(*_kpi_aggs(df))


def quality_assessment(df: DataFrame, score_col: str = "aml_score") -> DataFrame:
    """A10: rate band, mean band, expected count, spread (sample std).

    On ``aml_score`` (a percentile rank) mean and spread are constant (about
    0.5 and 0.289); ``score_col="native_score"`` applies the same bands to the
    model's own score. The ``avg_aml_score`` column holds the chosen score."""
    std_src = F.stddev_samp(score_col) if score_col in df.columns else F.lit(None).cast("double")
    k = df.agg(*_kpi_aggs(df, score_col), std_src.alias("score_std"))
    rate = F.col("flagged_rate_pct")
    avg = F.coalesce(F.col("avg_aml_score"), F.lit(0.0))
    std = F.coalesce(F.col("score_std"), F.lit(0.0))
    return k.select(
        "n_transactions", "n_flagged", "flagged_rate_pct", "avg_aml_score", "score_std",
        F.when(rate.between(0.1, 3.0), "good").when((rate > 3.0) & (rate <= 5.0), "acceptable")
         .when(rate < 0.1, "low").otherwise("check_threshold").alias("rate_band"),
        F.when(avg >= 0.60, "tail_heavy").when(avg <= 0.40, "tail_light").otherwise("balanced").alias("score_band"),
        F.when(F.col("n_flagged") <= F.col("n_transactions") * 0.02 * 1.5, "expected")
         .otherwise("many_flagged").alias("volume_band"),
        F.when(std > 0.15, "good_separation").otherwise("low_variance").alias("spread_band"))


def flag_breakdown(df: DataFrame) -> DataFrame:
    """Count and % of rows per flagging method, plus the unique total."""
    n = F.count(F.lit(1))
    parts = {"enhanced_score": "flagged_by_enhanced", "high_weight_indicators": "flagged_by_indicators",
             "model_policy": "flagged_by_model", "unique_total": "is_flagged"}
    aggs = [n.alias("n")] + [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(k) if c in df.columns
                             else F.lit(0).cast("bigint").alias(k) for k, c in parts.items()]
    wide = df.agg(*aggs)
    stack = "stack(4, " + ", ".join(f"'{k}', {k}" for k in parts) + ") AS (method, n_flagged)"
    return (wide.selectExpr("n", stack)
                .select("method", "n_flagged",
                        F.when(F.col("n") > 0, F.col("n_flagged") * 100.0 / F.col("n")).otherwise(0.0).alias("pct")))


def config_diagnostic(df: DataFrame, cfg: RiskConfig = DEFAULT_CONFIG, policy_text: str = "") -> DataFrame:
    """Rows, flagged, rate, contamination %, policy text."""
    return kpis(df).select("n_transactions", "n_flagged", "flagged_rate_pct",
                           F.lit(float(cfg.contamination) * 100.0).alias("contamination_pct"),
                           F.lit(policy_text).alias("policy"))


# --- A12-A14: top rows, reasons, histograms ----------------------------------
TOP_COLUMNS = ("transaction_id", "amount", "sender_country", "receiver_country",
               "sender_bank", "receiver_bank", "aml_score", "enhanced_aml_score")


def top_suspicious(df: DataFrame, n: int = 5, score_col: str = "aml_score") -> DataFrame:
    """Highest score first (top-k plan, no full sort), ties by id."""
    df = with_row_key(df)
    cols = [c for c in TOP_COLUMNS if c in df.columns]
    return df.orderBy(F.col(score_col).desc(), F.col("transaction_id").asc()).limit(n).select(*cols)


def reason_catalog(cfg: RiskConfig = DEFAULT_CONFIG) -> list[tuple[str, str, str]]:
    """(flag column, stable reason code, English text) in the fixed display order."""
    limit = f"{float(cfg.reporting_threshold):,.0f}"
    top = f"{100 * (1 - float(cfg.high_amount_percentile)):.4g}"

    def weighed(text: str, weight: float) -> str:
        return f"{text} [+{weight}]"

    return [
        ("high_risk_sender", "high_risk_sender", weighed("sender in a risk country", cfg.weight_high_risk_sender)),
        ("high_risk_receiver", "high_risk_receiver", weighed("receiver in a risk country", cfg.weight_high_risk_receiver)),
        ("is_high_risk_drug_country_receiver", "drug_country",
         weighed("receiver in a drug-route country", cfg.weight_drug_country)),
        ("near_threshold", "near_threshold", weighed(f"amount just under {limit}", cfg.weight_near_threshold)),
        ("structuring_flag", "structuring",
         weighed(f"{cfg.structuring_min_count} or more small payments on one day", cfg.weight_structuring)),
        ("midnight_transaction", "midnight",
         weighed(f"made between hours {cfg.midnight_start_hour} and {cfg.midnight_end_hour}", cfg.weight_midnight)),
        ("high_cashflow_flag_acct_total", "high_cashflow", weighed(f"amount in the top {top} %", cfg.weight_high_cashflow)),
        ("multiple_high_risk_transfers", "multiple_high_risk",
         weighed("repeated payments to risk countries", cfg.weight_multiple_high_risk)),
        ("rare_bank_combo_flag", "rare_bank", weighed("banks that seldom pay each other", cfg.weight_rare_bank)),
        ("definite_fraud_flag", "definite_fraud", "several strong signs at once"),
    ]


def with_reasons(df: DataFrame, cfg: RiskConfig = DEFAULT_CONFIG) -> DataFrame:
    """The rows with reason_codes, reasons and n_reasons: fired indicators, as a projection."""
    cat = [c for c in reason_catalog(cfg) if c[0] in df.columns]
    codes = F.array_compact(F.array(*[F.when(F.col(col) == 1, F.lit(code)) for col, code, _ in cat]))
    texts = F.array_compact(F.array(*[F.when(F.col(col) == 1, F.lit(txt)) for col, _, txt in cat]))
    return df.select("*", codes.alias("reason_codes"), F.concat_ws("; ", texts).alias("reasons"),
                     F.size(codes).alias("n_reasons"))


def explain_flags(df: DataFrame, cfg: RiskConfig = DEFAULT_CONFIG, only_flagged: bool = True) -> DataFrame:
    """Fired indicators per row, as an array of reason codes and a text
    (for every flagged row, not just the top five)."""
    df = with_row_key(df)
    src = df.where(F.col("is_flagged") == 1) if only_flagged and "is_flagged" in df.columns else df
    return with_reasons(src, cfg).select("transaction_id", "reason_codes", "reasons", "n_reasons")


def reason_counts(df: DataFrame, cfg: RiskConfig = DEFAULT_CONFIG) -> DataFrame:
    """A13 summary: reason code -> number of flagged rows it fired on."""
    return (explain_flags(df, cfg).select(F.explode("reason_codes").alias("reason"))
              .groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows")))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between min and max; the last bin is closed."""
    mm = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, bin_start double, bin_end double, n bigint")
    width = (hi - lo) / bins if hi > lo else 0.0
    b = (F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1)).cast("int")
         if hi > lo else F.lit(0))
    return (df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
              .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
                      (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"), "n"))


def training_log_append(spark: SparkSession, path: str, action: str, models: list[str], n_samples: int) -> None:
    """Append (timestamp, action, models, n_samples) to a parquet table."""
    from datetime import datetime
    row = [(datetime.now().strftime("%Y-%m-%d %H:%M:%S"), action, ",".join(models), int(n_samples))]
    (spark.createDataFrame(row, "logged_at string, action string, models string, n_samples bigint")
          .write.mode("append").parquet(path))


def training_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
