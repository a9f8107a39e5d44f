"""What the operators share: word pattern, ids, and written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"                 # a word: no ASCII white space
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST_ID = (1 << 63) - 1                      # where a null doc_id sorts
HELD_OUT = 5                                 # crc32(doc_id) mod 5 = 0 is never learned from


def ordered_id(c: str = "doc_id") -> Column:
    """doc_id with null as the largest."""
    return F.coalesce(F.col(c).cast("bigint"), F.lit(LAST_ID))


def held_out(c: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5 (null id: true)."""
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % HELD_OUT == 0, F.lit(True))


def scratch_path(spark: SparkSession, kind: str = "llm") -> str:
    """A new folder name on the shared storage that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to shared storage and read it back: a lost executor rereads
    the files, and the plan above starts from them."""
    path = path or scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that no later plan reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scattered(df: DataFrame) -> int:
    """Partitions to shuffle whole texts into: as many as the input has splits, at
    least the session's number, so that it follows the input's size."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
