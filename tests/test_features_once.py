"""Features on demand, aggregates once, sweeps in one pass, group limits, network summary."""

import uuid

import pytest
from pyspark.sql import functions as F

from riskweave.config import DEFAULT_CONFIG, with_config
from riskweave.functions.topk import top_k_per_group
from riskweave.operators import network as N
from riskweave.operators.clean import clean
from riskweave.operators.features import FEATURE_ORDER, ROW_FEATURES, engineer_features, preprocess, sweep
from riskweave.plans.catalog import QUERIES
from riskweave.session import cut_lineage
from riskweave.sources import fixtures
from tests.conftest import SF_SMALL


def jobs_of(spark, fn):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = fn()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture(scope="module")
def cleaned(spark):
    return cut_lineage(clean(fixtures.txn(spark, SF_SMALL)))


@pytest.mark.parametrize("name", ["q_f1_calendar_parts", "q_f2_high_risk_sender", "q_f3_high_risk_receiver",
                                  "q_f4_drug_country_receiver", "q_f5_near_threshold", "q_f6_small_transaction",
                                  "q_f10_midnight_transaction", "q_f17_risk_categories"])
def test_row_features_plan_without_a_job(spark, name):
    planned, n = jobs_of(spark, lambda: QUERIES[name](spark, SF_SMALL))
    # three jobs: the schemas of the three tables
    plan = planned._jdf.queryExecution().optimizedPlan().toString()
    assert n <= 3 and "riskweave-ckpt" not in plan and "Aggregate [sender_id" not in plan


def test_asked_features_equal_all(spark, cleaned):
    whole = {r["transaction_id"]: r for r in engineer_features(cleaned).collect()}
    for only in (["structuring_flag"], ["unique_senders_per_day", "hour"], ["rare_bank_combo_flag"], sorted(ROW_FEATURES), ["enhanced_aml_score"]):
        got = engineer_features(cleaned, only=only)
        assert got.columns == cleaned.columns + [c for c in FEATURE_ORDER if c in only]
        for r in got.collect():
            assert all(r[c] == whole[r["transaction_id"]][c] for c in only)
    with pytest.raises(ValueError):
        engineer_features(cleaned, only=["no_such"])


def test_only_needed_aggregates_are_planned(cleaned):
    plan = engineer_features(cleaned, only=["unique_senders_per_day"])._jdf.queryExecution().optimizedPlan().toString()
    assert "receiver_id" in plan and "sender_bank_count" not in plan and "small_txn_count_per_day" not in plan


def test_large_aggregates_run_once(spark, cleaned):
    """Beyond the broadcast bound every aggregate is written and read back: none is left in the result's plan."""
    spark.conf.set("riskweave.join.broadcastBytes", "0")
    try:
        out = engineer_features(cleaned, cashflow_threshold=5000.0)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("riskweave.join.broadcastBytes")
    assert "Aggregate" not in plan
    want = sorted(map(str, engineer_features(cleaned, cashflow_threshold=5000.0).collect()))
    assert sorted(map(str, out.collect())) == want


def test_approximate_senders(spark):
    rows = [(i, 10.0, i % 3000, 7, "2024-01-01 00:00:00") for i in range(6000)]
    df = spark.createDataFrame(rows, "transaction_id long, amount double, sender_id long, receiver_id long, timestamp string")
    df = clean(df)
    n = engineer_features(df, only=["unique_senders_per_day"], approximate_senders=True).first()["unique_senders_per_day"]
    assert abs(n - 3000) < 0.15 * 3000
    assert engineer_features(df, only=["unique_senders_per_day"]).first()["unique_senders_per_day"] == 3000


SWEEP = {f"c{i}": with_config(reporting_threshold=3000.0 * (1 + i % 3), structuring_min_count=1 + i % 4, rare_bank_min_count=1 + i % 5,
                              high_amount_percentile=0.9 + 0.01 * (i % 4), midnight_start_hour=i % 5, midnight_end_hour=6 + i % 6,
                              high_risk_drug_countries="CO,AL" if i % 2 else "MX", weight_midnight=1.0 + i % 3) for i in range(16)}
FLAGS = ["near_threshold", "structuring_flag", "multiple_high_risk_transfers", "midnight_transaction", "high_cashflow_flag_acct_total",
         "rare_bank_combo_flag", "definite_fraud_flag", "transaksione_ne_lokacione_ndryshe"]


def test_sweep_equals_one_run_per_configuration(spark, cleaned):
    got = {r["config"]: r.asDict() for r in sweep(cleaned, SWEEP, FLAGS).collect()}
    for name in ("c0", "c5", "c10", "c15"):
        f = engineer_features(cleaned, SWEEP[name])
        want = f.agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(c).alias(c) for c in FLAGS],
                     F.sum((F.col("enhanced_aml_score") >= 6.0).cast("int")).alias("n_enhanced")).first().asDict()
        assert got[name] == {"config": name, **want}
    assert len(got) == 16


def test_sweep_reads_the_table_as_often_for_16_as_for_1(spark, cleaned):
    one, n1 = jobs_of(spark, lambda: sweep(cleaned, {"a": DEFAULT_CONFIG}, FLAGS))
    many, n16 = jobs_of(spark, lambda: sweep(cleaned, SWEEP, FLAGS))
    assert n16 == n1
    scans = [d._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for d in (one, many)]
    assert scans[0] == scans[1]


def test_sweep_of_few_columns_and_no_rows(spark):
    df = spark.createDataFrame([(50.0,), (9500.0,)], "amount double")
    got = {r["config"]: r for r in sweep(df, {"a": DEFAULT_CONFIG, "b": with_config(reporting_threshold=100.0)}, FLAGS).collect()}
    assert (got["a"]["near_threshold"], got["b"]["near_threshold"], got["a"]["structuring_flag"]) == (1, 0, 0)
    assert sweep(df.limit(0), {"a": DEFAULT_CONFIG}, FLAGS).first()["n_rows"] == 0


def test_preprocess_cleans_once(spark):
    out, names = preprocess(fixtures.txn(spark, SF_SMALL))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "c_custkey" not in plan and "enhanced_aml_score" in names and out.count() == 1000


def test_top_k_limits_groups_before_the_shuffle(spark):
    """A group with most rows: the exchange carries at most k rows of it a task."""
    df = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") % 10 < 9, -1).otherwise(F.col("id") % 50).alias("g"), "id")
    out = top_k_per_group(df, ["g"], [F.col("id").desc()], 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning(g"):]
    assert "WindowGroupLimit" in below and "Partial" in below
    got = {}
    for r in out.collect():
        got.setdefault(r["g"], []).append((r["pos"], r["id"]))
    assert sorted(got[-1]) == [(1, 19_998), (2, 19_997), (3, 19_996)] and len(got[9]) == 3
    for k in (0, 1001):
        with pytest.raises(ValueError):
            top_k_per_group(df, ["g"], [F.col("id").desc()], k)


def test_network_summary_has_hubs_and_counts(spark):
    rows = [(i, float(i), "hub", f"r{i % 7}", 0.9 if i < 5 else 0.1) for i in range(60)] + [(99, 1.0, "x", "y", 0.2)]
    df = spark.createDataFrame(rows, "transaction_id long, amount double, sender_id string, receiver_id string, aml_score double")
    net = N.transaction_network(df, "aml_score", 0.5, limit=30)
    m = net.metrics.first().asDict(recursive=True)
    assert m["top_hubs"][0] == {"account_id": "hub", "degree": 7, "in_degree": 0, "out_degree": 7} and len(m["top_hubs"]) == 8
    assert [h["degree"] for h in m["top_hubs"]] == sorted((h["degree"] for h in m["top_hubs"]), reverse=True)
    assert (m["selected_total"], m["selected_fraud"], m["selected_context"]) == (30, 5, 25)
    assert (m["total_transactions_in_df"], m["flagged_transactions_in_df"]) == (61, 5)
    assert (m["n_nodes"], m["n_connected_components"]) == (8, 1)
    whole = N.transaction_network(df, "aml_score", 0.5, limit=None).metrics.first().asDict(recursive=True)
    assert (whole["n_nodes"], whole["n_connected_components"], whole["n_edges"]) == (10, 2, 8) and "selected_total" not in whole
    empty = N.transaction_network(df.limit(0), "aml_score", 0.5, limit=None).metrics.first().asDict(recursive=True)
    assert (empty["n_nodes"], empty["n_edges"], empty["density"]) == (0, 0, 0.0) and not empty["top_hubs"]
