"""A hot key holding a third of all rows: AQE splits it in the join back and
results do not change."""

import datetime as dt

from pyspark.sql import functions as F

from riskweave.operators.clean import clean
from riskweave.operators.features import engineer_features
from riskweave.session import cut_lineage
from riskweave.sources import fixtures
from tests.conftest import SF_SMALL

SKEW_CONF = {
    "riskweave.join.broadcastBytes": "0",          # force the shuffled path
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def _hot(spark):
    t = fixtures.txn(spark, SF_SMALL)
    hot = F.col("transaction_id") % 3 == 0          # a third of the rows: one sender, one day
    return cut_lineage(clean(t.withColumn("sender_id", F.when(hot, F.lit(999999)).otherwise(F.col("sender_id")))
                              .withColumn("timestamp", F.when(hot, F.lit(dt.datetime(2024, 1, 5, 3, 0)))
                                          .otherwise(F.col("timestamp")))))


def _run(spark, conf):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = engineer_features(_hot(spark), cashflow_threshold=5000.0).drop("timestamp")
        rows = sorted(tuple(r) for r in df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return rows, plan


def test_hot_sender_day_is_salted_and_results_equal(spark):
    salted_rows, salted_plan = _run(spark, SKEW_CONF)
    broadcast_rows, broadcast_plan = _run(spark, {**SKEW_CONF, "riskweave.join.broadcastBytes": "100000000"})
    assert salted_rows == broadcast_rows
    assert "_salt" in salted_plan and "_salt" not in broadcast_plan
    hot = [r for r in salted_rows if r[2] == 999999]
    assert len(hot) >= len(salted_rows) // 3 - 1
    assert {r[-1] for r in hot} != set()


def test_join_back_salts_only_hot_keys(spark):
    from riskweave.functions.joins import ROWS_COL, aggregate_stats, join_back
    rows = spark.range(0, 3000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 500))
    agg = rows.groupBy("k").agg(F.count(F.lit(1)).alias("cnt"), F.count(F.lit(1)).alias(ROWS_COL))
    st = aggregate_stats({"a": agg})["a"]
    assert (st.keys, st.rows, st.largest) == (501, 3000, 1000)
    out = join_back(rows, agg, ["k"], st, broadcast_keys=0, salt_buckets=8)
    got = {r["id"]: r["cnt"] for r in out.collect()}
    assert len(got) == 3000 and got[0] == 1000 and got[1] == 4


def test_components_with_hub_salted(spark):
    from riskweave.operators.components import connected_components
    from tests.test_primitives import _brute_components
    edges = [("hub", f"a{i:04d}") for i in range(600)] + [(f"b{i:04d}", f"b{i + 1:04d}") for i in range(1200)]
    edges += [("a0007", "b0003")]
    spark.conf.set("riskweave.join.broadcastBytes", "0")
    try:
        got = {r["node"]: r["component"] for r in
               connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    finally:
        spark.conf.unset("riskweave.join.broadcastBytes")
    assert got == _brute_components(edges)
