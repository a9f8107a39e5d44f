"""Join per-key aggregates back to their rows, safe for hot keys.

AQE cannot split a skewed key here: the join reuses the aggregate's own
partitioning, so only one side is a shuffle stage. So sizes are known first:

* a table whose files are under ``broadcast_bytes`` is joined with broadcast
  aggregates (they are smaller than it), without a look at them;
* otherwise every aggregate is written once, and its keys, rows, largest group
  and bytes are read from what was written. Under ``broadcast_bytes`` it is
  broadcast;
* beyond, keys holding more than total / (2 P) rows are hot -- at most 2 P of
  them -- and only those are salted: their aggregate rows are replicated ``S``
  times and their input rows are spread over S buckets by a row hash, so one
  key with a third of all rows is processed by S tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.sizes import partitions_for, plan_bytes
from riskweave.session import cut_lineage

BROADCAST_BYTES = 32 << 20        # of aggregate rows in a broadcast
ROWS_COL = "_rows"                # rows per key, carried by every aggregate
_FIXED = {"tinyint": 1, "smallint": 2, "int": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}


def broadcast_bytes(spark: SparkSession) -> int:
    """The limit, or the session's own (``riskweave.join.broadcastBytes``)."""
    return int(spark.conf.get("riskweave.join.broadcastBytes", str(BROADCAST_BYTES)))


@dataclass
class AggStats:
    keys: int
    rows: int
    largest: int
    size: int = 0                 # bytes of its values


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values."""
    fixed = sum(_FIXED.get(t, 8) for _, t in df.dtypes if t != "string")
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t == "string"]
    return sum(texts, F.lit(fixed)).cast("bigint")


def aggregate_stats(aggs: dict[str, DataFrame]) -> dict[str, AggStats]:
    """Key count, row total, largest group and bytes of several aggregates, one job."""
    if not aggs:
        return {}
    parts = [a.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("k"),
                   F.coalesce(F.sum(ROWS_COL), F.lit(0)).cast("bigint").alias("n"),
                   F.coalesce(F.max(ROWS_COL), F.lit(0)).cast("bigint").alias("mx"),
                   F.coalesce(F.sum(_row_bytes(a)), F.lit(0)).cast("bigint").alias("sz"))
             for name, a in aggs.items()]
    rows = reduce(lambda x, y: x.unionByName(y), parts).collect()
    return {r["name"]: AggStats(r["k"], r["n"], r["mx"], r["sz"]) for r in rows}


def join_back(rows: DataFrame, agg: DataFrame, keys: list[str], stats: AggStats,
              broadcast_keys: int | None = None, salt_buckets: int | None = None) -> DataFrame:
    """Left join ``agg`` (keys, values, ``_rows``; a written table) to ``rows`` on ``keys``. ``broadcast_keys``: a limit
    on keys instead of bytes."""
    spark = rows.sparkSession
    values = agg.drop(ROWS_COL)
    small = stats.keys <= broadcast_keys if broadcast_keys is not None else stats.size <= broadcast_bytes(spark)
    if small:
        return rows.join(F.broadcast(values), keys, "left")          # measured bound
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), partitions_for(rows))
    hot_limit = max(1, stats.rows // (2 * parts))
    if stats.largest <= hot_limit:
        return rows.join(values, keys, "left")
    hot = agg.where(F.col(ROWS_COL) > hot_limit).select(*keys)       # at most 2 * parts keys
    hot_keys = spark.createDataFrame(hot.collect(), hot.schema).withColumn("_hot", F.lit(True))
    s = salt_buckets or min(parts, 1000)
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    left = (rows.join(F.broadcast(hot_keys), keys, "left")
                .withColumn("_salt", F.when(F.col("_hot"), F.pmod(row_hash, F.lit(s))).otherwise(F.lit(0)))
                .drop("_hot"))
    right = (agg.drop(ROWS_COL).join(F.broadcast(hot_keys), keys, "left")
                .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(s - 1)))
                                               .otherwise(F.array(F.lit(0)))))
                .drop("_hot"))
    return left.join(right, keys + ["_salt"], "left").drop("_salt")


def join_all_back(rows: DataFrame, source: DataFrame, aggs: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Join several aggregates of ``source`` to ``rows``, each computed once: {name: (aggregate, keys)}."""
    if plan_bytes(source) <= broadcast_bytes(rows.sparkSession):
        for agg, keys in aggs.values():
            rows = rows.join(F.broadcast(agg.drop(ROWS_COL)), keys, "left")
        return rows
    written = {name: cut_lineage(agg) for name, (agg, _) in aggs.items()}
    stats = aggregate_stats(written)
    for name, (_, keys) in aggs.items():
        rows = join_back(rows, written[name], keys, stats[name])
    return rows
