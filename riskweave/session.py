"""Session helpers: a tuned local/cluster session and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

# Settings every operator assumes: UTC session zone, ANSI on (Spark 4 default),
# AQE with skew-join splitting and runtime broadcast conversion.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "riskweave", cpus: int | str = "*", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if not SparkConf().get("spark.master", None):          # a master that spark-submit names stays
        b = b.master(f"local[{cpus}]")
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or (os.cpu_count() if cpus == "*" else cpus))
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` must name shared storage; we only
    create a folder of our own in local mode (tests), where it is unset.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    d = tempfile.mkdtemp(prefix="riskweave-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


_SCRATCH: list[str] = []


def cut_lineage(df: DataFrame, reader: SparkSession | None = None) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and
    read it back (by the session ``reader`` where given): lineage is cut (a lost executor re-reads the table instead
    of replaying the plan), and later scans get column pruning and pushdown,
    which a checkpointed RDD would not. Never a machine-local folder."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _SCRATCH.append(path)
    return (reader or spark).read.parquet(path)


def drop_scratch_tables(spark: SparkSession) -> int:
    """Delete the tables written by ``cut_lineage`` in this process."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _SCRATCH:
        p = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        if p.getFileSystem(conf).delete(p, True):
            n += 1
    return n


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))
