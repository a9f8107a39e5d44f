"""Global rank over a total order without an unpartitioned window.

Range-partition on the order, sort inside partitions, number rows inside each
partition (monotonically_increasing_id keeps the in-partition record number in
its low 33 bits), checkpoint so the two passes see the same partitions, then
add per-partition prefix offsets (one small row per partition, broadcast).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.sizes import partitions_for
from riskweave.session import cut_lineage

_LOW33 = (1 << 33) - 1


def global_rank(df: DataFrame, order_cols: list, rank_col: str = "rank",
                num_partitions: int | None = None, with_total: bool = False):
    """Adds ``rank_col`` = 0-based position in ``order_cols`` order.

    With ``with_total`` returns (DataFrame, row count); the count is the sum of
    the per-partition counts, so it costs no extra job."""
    spark = df.sparkSession
    # an explicit count is not changed by AQE, so it follows the input's size
    p = num_partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(10_000, partitions_for(df)))
    ranged = (df.repartitionByRange(p, *order_cols)
                .sortWithinPartitions(*order_cols)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33))))
    ranged = cut_lineage(ranged)
    counts = sorted((r["_pid"], r["count"]) for r in ranged.groupBy("_pid").count().collect())
    offsets, acc = [], 0
    for pid, cnt in counts:            # at most one row per partition
        offsets.append((pid, acc))
        acc += cnt
    off = spark.createDataFrame(offsets, "_pid int, _offset long")
    out = (ranged.join(F.broadcast(off), "_pid")
                 .withColumn(rank_col, F.col("_offset") + F.col("_local"))
                 .drop("_pid", "_local", "_offset"))
    return (out, acc) if with_total else out


def percentile_rank(df: DataFrame, score_col: str, tie_col: str, out_col: str = "aml_score") -> DataFrame:
    """A1: rank / (n - 1) by (score, tie key); 0 when n <= 1."""
    ranked, total = global_rank(df, [score_col, tie_col], "_rank", with_total=True)
    score = F.lit(0.0) if total <= 1 else F.col("_rank") / F.lit(float(total - 1))
    return ranked.withColumn(out_col, score.cast("double")).drop("_rank")
