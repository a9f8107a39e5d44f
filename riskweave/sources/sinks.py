"""Sinks (S15): export scored transactions as CSV or parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.config import CANONICAL_VARIANTS

SCORE_ONLY_COLUMNS = ("aml_score", "anomaly_label", "is_flagged", "enhanced_aml_score")


def export_frame(df: DataFrame, mode: str = "all") -> DataFrame:
    """all | flagged (is_flagged = 1; all rows if absent) | original (drop the
    four score columns, as the reference does) | input (canonical columns only)."""
    if mode == "all":
        return df
    if mode == "flagged":
        return df.where(F.col("is_flagged") == 1) if "is_flagged" in df.columns else df
    if mode == "original":
        return df.drop(*[c for c in SCORE_ONLY_COLUMNS if c in df.columns])
    if mode == "input":
        return df.select(*[c for c in CANONICAL_VARIANTS if c in df.columns])
    raise ValueError(f"unknown export mode: {mode}")


def export(df: DataFrame, path: str, mode: str = "all", fmt: str = "csv", partition_by: str | None = None) -> None:
    out = export_frame(df, mode)
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        w.parquet(path)
