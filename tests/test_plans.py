"""Plan shape: shuffles, no Python in rule features, no global window; and
results that do not depend on the partitioning."""

import re

from riskweave.operators.clean import clean
from riskweave.operators.features import engineer_features
from riskweave.plans.scoring import features_table
from riskweave.session import cut_lineage
from riskweave.sources import fixtures

from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_plan_shape(spark):
    cleaned = cut_lineage(clean(fixtures.txn(spark, SF_SMALL)))
    feat = engineer_features(cleaned, cashflow_threshold=1.0)
    plan = _plan(feat)
    # 4 grouped aggregates (sender-day with distinct: 2 exchanges), no more
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 7
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    assert "SinglePartition" not in plan
    assert "Window" not in plan
    scan = feat._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in scan


def test_pushdown_and_pruning(spark):
    df = fixtures.txn(spark, SF_SMALL).where("amount > 100").select("transaction_id", "amount")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(value)" in plan or "PushedFilters: [IsNotNull(value), GreaterThan" in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in plan


def test_invariant_to_partitioning(spark):
    def rows(n):
        t = clean(fixtures.txn(spark, SF_SMALL)).repartition(n)
        return sorted(tuple(r) for r in engineer_features(t).drop("timestamp").collect())
    assert rows(1) == rows(16)


def test_features_table_runs(spark):
    assert features_table(spark, SF_SMALL).count() == 1000
