"""F14 across uploads: distinct senders per receiver and day as stored, mergeable sketches.

An upload's sketches (HyperLogLog, one per receiver and day) are a partition of
the store, so uploading again replaces its own. Reading merges the partitions;
the sketch of a union is the union of the sketches, whatever the order and
however often a payment is seen. ``compact`` writes the merged table as one
partition. Sketches have a fixed size, so a receiver with a third of all
payments costs no more than another.

Defined results: rows without receiver, sender or date have no part in it; an
empty upload leaves the store as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LG_K = 12                            # 2^12 registers: 1.6 % relative standard error
COMPACTED = "compacted"


def sender_sketches(payments: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """(receiver_id, date, senders, n_rows): the sketch of the senders of each receiver and day."""
    rows = payments.where(F.col("receiver_id").isNotNull() & F.col("date").isNotNull() & F.col("sender_id").isNotNull())
    return rows.groupBy("receiver_id", "date").agg(
        F.hll_sketch_agg(F.col("sender_id").cast("string"), F.lit(lg_k)).alias("senders"), F.count(F.lit(1)).alias("n_rows"))


def merged(sketches: DataFrame) -> DataFrame:
    """Sketches of several uploads as one per receiver and day."""
    return sketches.groupBy("receiver_id", "date").agg(F.hll_union_agg("senders").alias("senders"), F.sum("n_rows").alias("n_rows"))


def estimates(sketches: DataFrame) -> DataFrame:
    """(receiver_id, date, unique_senders_per_day, multiple_senders_same_receiver)."""
    n = F.hll_sketch_estimate("senders")
    return sketches.select("receiver_id", "date", n.alias("unique_senders_per_day"),
                           (n > 1).cast("int").alias("multiple_senders_same_receiver"))


class SenderStore:
    """The sketches of all uploads, as a table under ``path``."""

    def __init__(self, spark: SparkSession, path: str, lg_k: int = LG_K):
        self.spark, self.path, self.lg_k = spark, path.rstrip("/"), lg_k

    def add(self, payments: DataFrame, upload: str) -> None:
        """Keep an upload's sketches; the same upload again replaces them."""
        if not upload or "/" in upload or upload == COMPACTED:
            raise ValueError(f"no name for an upload: {upload!r}")
        self._write(sender_sketches(payments, self.lg_k), upload)

    def _write(self, sketches: DataFrame, upload: str) -> None:
        (sketches.withColumn("upload", F.lit(upload)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("upload").parquet(f"{self.path}/sketches"))

    def table(self) -> DataFrame:
        """(receiver_id, date, senders, n_rows) over all uploads."""
        return merged(self.spark.read.parquet(f"{self.path}/sketches"))

    def compact(self) -> None:
        """All uploads as one partition. The merged table is written beside the store first, so a lost job loses nothing."""
        aside = f"{self.path}/merged-{uuid.uuid4().hex}"
        self.table().write.parquet(aside)
        whole = self.spark.read.parquet(aside)
        whole.withColumn("upload", F.lit(COMPACTED)).write.mode("overwrite").option("partitionOverwriteMode", "static") \
            .partitionBy("upload").parquet(f"{self.path}/sketches")


def with_senders_so_far(features: DataFrame, store: SenderStore) -> DataFrame:
    """``features`` with F14's two columns as of all uploads in the store (0 where it has none)."""
    known = estimates(store.table())
    names = ["unique_senders_per_day", "multiple_senders_same_receiver"]
    out = features.drop(*names).join(known, ["receiver_id", "date"], "left")
    zero = {"unique_senders_per_day": F.lit(0).cast("bigint"), "multiple_senders_same_receiver": F.lit(0)}
    cols = features.columns + [n for n in names if n not in features.columns]
    return out.select(*[F.coalesce(F.col(c), zero[c]).alias(c) if c in names else F.col(f"`{c}`") for c in cols])
