"""How large a table is, by its plan's statistics (file sizes after pruning; no job)."""

from __future__ import annotations

from pyspark.sql import DataFrame

PARTITION_BYTES = 128 << 20


def plan_bytes(df: DataFrame) -> int:
    """The optimiser's bound on the result's size: of a scan its files, of a join the product of its sides."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def input_bytes(df: DataFrame) -> int:
    """The sizes of all tables that ``df`` reads, added up."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))


def partitions_for(df: DataFrame, most: int = 100_000, bytes_each: int = PARTITION_BYTES) -> int:
    """Partitions of about ``bytes_each`` of what ``df`` reads."""
    return max(1, min(most, -(-input_bytes(df) // bytes_each)))
