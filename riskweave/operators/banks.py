"""Bank and country analysis (B1-B12) on a scored table.

Two-level aggregation: per (bank, role) then per bank, both with map-side
partial aggregation, so a hot bank costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.functions.rank import global_rank

ROLE_COLUMNS = {"sender": ("sender_bank", "sender_country"), "receiver": ("receiver_bank", "receiver_country")}
BANK_SCHEMA = ("bank string, total_transactions bigint, flagged_transactions bigint, avg_aml_score double, "
               "max_aml_score double, total_amount double, flagged_percent double, risk_score double, rank int")


def missing_columns(df: DataFrame, score_col: str, label_col: str, with_countries: bool) -> list[str]:
    """Inputs a bank report needs that the table lacks."""
    need = ["amount", score_col, label_col, "sender_bank", "receiver_bank"]
    if with_countries:
        need += ["sender_country", "receiver_country"]
    return [c for c in need if c not in df.columns]


def bank_role_metrics(df: DataFrame, role: str, score_col: str = "aml_score",
                      label_col: str = "anomaly_label", min_transactions: int = 5) -> DataFrame:
    """B1: per bank in one role: count, sum amount, mean/max score, flagged."""
    bank_col = ROLE_COLUMNS[role][0]
    return (df.where(F.col(bank_col).isNotNull())
              .groupBy(F.col(bank_col).alias("bank"))
              .agg(F.count(F.lit(1)).alias("total_transactions"),
                   F.sum("amount").alias("total_amount"),
                   F.avg(score_col).alias("avg_aml_score"),
                   F.max(score_col).alias("max_aml_score"),
                   F.sum(F.col(label_col).cast("bigint")).alias("flagged_transactions"))
              .where(F.col("total_transactions") >= min_transactions)
              .withColumn("role", F.lit(role)))


def focus_country_filter(df: DataFrame, country: str = "XK") -> DataFrame:
    """B2: rows where either side's country (case-blind) is the focus country."""
    c = country.upper()
    return df.where((F.upper(F.col("sender_country")) == c) | (F.upper(F.col("receiver_country")) == c))


def union_roles(df: DataFrame, score_col: str = "aml_score", label_col: str = "anomaly_label",
                min_transactions: int = 5, country: str | None = None) -> DataFrame:
    """Sender-role rows + receiver-role rows (each side filtered by the
    focus country when given; a payment inside one bank counts in both)."""
    parts = []
    for role, (_, ccol) in ROLE_COLUMNS.items():
        side = df if country is None else df.where(F.upper(F.col(ccol)) == country.upper())
        parts.append(bank_role_metrics(side, role, score_col, label_col, min_transactions))
    return parts[0].unionByName(parts[1])


def bank_risk(roles: DataFrame, weighted: bool = False) -> DataFrame:
    """Per bank over roles; mean of role means (unweighted, as the
    reference; ``weighted=True`` weights each role by its row count); risk."""
    mean = (F.sum(F.col("avg_aml_score") * F.col("total_transactions")) / F.sum("total_transactions")
            if weighted else F.avg("avg_aml_score"))
    g = roles.groupBy("bank").agg(
        F.sum("total_transactions").alias("total_transactions"),
        F.sum("flagged_transactions").alias("flagged_transactions"),
        mean.alias("avg_aml_score"),
        F.max("max_aml_score").alias("max_aml_score"),
        F.sum("total_amount").alias("total_amount"))
    pct = F.col("flagged_transactions") * 100.0 / F.col("total_transactions")
    return (g.withColumn("flagged_percent", pct)
             .withColumn("risk_score", F.col("flagged_percent") * 0.4 + F.col("avg_aml_score") * 100 * 0.3
                         + F.col("max_aml_score") * 100 * 0.3))


def _bank_order():
    return [(F.col("flagged_transactions") > 0).desc(), F.col("flagged_transactions").desc(),
            F.col("risk_score").desc(), F.col("bank").asc()]


def rank_banks(metrics: DataFrame, top_n: int | None = None) -> DataFrame:
    """Banks with flagged payments first, then flagged desc, risk desc,
    bank; ``rank`` keeps the order through hashing. With top_n it is a top-k
    (bounded rows numbered after the limit); without, the global rank X2."""
    if top_n:
        top = metrics.orderBy(*_bank_order()).limit(top_n)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*_bank_order())))
    ranked = global_rank(metrics, _bank_order(), "_r")
    return ranked.withColumn("rank", (F.col("_r") + 1).cast("int")).drop("_r")


def focus_country_banks(df: DataFrame, country: str = "XK", score_col: str = "aml_score",
                        label_col: str = "anomaly_label", min_transactions: int = 5,
                        weighted: bool = False) -> DataFrame:
    """B6 = B2 + B1 x 2 + B3 + B4 + B5."""
    if missing_columns(df, score_col, label_col, True):
        return df.sparkSession.createDataFrame([], BANK_SCHEMA)
    roles = union_roles(focus_country_filter(df, country), score_col, label_col, min_transactions, country)
    return rank_banks(bank_risk(roles, weighted)).select(*[c.split()[0] for c in BANK_SCHEMA.split(", ")])


def all_banks(df: DataFrame, score_col: str = "aml_score", label_col: str = "anomaly_label",
              min_transactions: int = 10, top_n: int | None = 20, weighted: bool = False) -> DataFrame:
    """Same without the country filter; top_n (None = every bank)."""
    if missing_columns(df, score_col, label_col, False):
        return df.sparkSession.createDataFrame([], BANK_SCHEMA)
    ranked = rank_banks(bank_risk(union_roles(df, score_col, label_col, min_transactions), weighted), top_n)
    return ranked.select(*[c.split()[0] for c in BANK_SCHEMA.split(", ")])


def bank_chart_data(metrics: DataFrame, metric: str = "risk_score", top_n: int = 15) -> DataFrame:
    """Top-n banks by a metric with five hover measures."""
    return (metrics.orderBy(F.col(metric).desc(), F.col("bank").asc()).limit(top_n)
                   .select("bank", F.col(metric).alias("metric_value"), "total_transactions",
                           "flagged_transactions", "flagged_percent", "avg_aml_score", "total_amount"))


def bank_comparison_data(metrics: DataFrame, top_n: int = 10) -> DataFrame:
    """Per bank flagged % and avg score x 100, long form."""
    top = metrics.orderBy(F.col("risk_score").desc(), F.col("bank").asc()).limit(top_n)
    return top.selectExpr("bank", "stack(2, 'flagged_percent', flagged_percent, "
                                  "'avg_score_x100', avg_aml_score * 100) AS (measure, value)")


def fraud_country_counts(df: DataFrame, side: str = "sender", top_n: int = 10,
                         label_col: str = "anomaly_label") -> DataFrame:
    """Value counts of a side's country among model-flagged rows, top n."""
    col = f"{side}_country"
    return (df.where(F.col(label_col) == 1).groupBy(F.col(col).alias("country"))
              .agg(F.count(F.lit(1)).alias("n_flagged"))
              .orderBy(F.col("n_flagged").desc(), F.col("country").asc()).limit(top_n))


def fraud_scatter_sample(df: DataFrame, n: int = 500, label_col: str = "anomaly_label") -> DataFrame:
    """First n flagged rows (by transaction id): amount and both scores."""
    cols = [c for c in ("transaction_id", "amount", "aml_score", "enhanced_aml_score") if c in df.columns]
    return df.where(F.col(label_col) == 1).orderBy("transaction_id").limit(n).select(*cols)
