"""Feeds without ids, one scoring pass, network selection and account columns."""

from pyspark.sql import functions as F

from riskweave.operators import alerts as A
from riskweave.operators import network as N
from riskweave.operators.models.training import train_models
from riskweave.plans.scoring import score_transactions

ROWS = [(float(i % 7), f"s{i % 5}", f"r{i % 3}", i / 40.0) for i in range(40)]
SCHEMA = "amount double, sender_id string, receiver_id string, risk double"


def test_feed_without_ids(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    once, again = (A.percentile_score(df, "risk").orderBy("risk").collect() for _ in range(2))
    assert [r.transaction_id for r in once] == [r.transaction_id for r in again]
    assert len({r.transaction_id for r in once}) == 40 and once[-1].aml_score == 1.0
    ends = N.resolve_endpoints(df.withColumn("sender_id", F.lit(" ")), "risk").collect()
    assert all(r.src == "S_" + r.transaction_id and r.dst.startswith("r") for r in ends)
    assert A.top_suspicious(df.withColumn("aml_score", F.col("risk")), 3).count() == 3
    paths = train_models(df, ["pca"], str(tmp_path), features=["amount", "risk"], hyper={"pca": {"k": 1}})
    scored, _ = score_transactions(spark, paths["pca"], df)
    assert scored.count() == 40


def test_model_runs_once(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("transaction_id", F.monotonically_increasing_id())
    paths = train_models(df, ["isolation_forest"], str(tmp_path), features=["amount", "risk"],
                         hyper={"isolation_forest": {"n_estimators": 5}})
    scored, _ = score_transactions(spark, paths["isolation_forest"], df)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Arrow" not in plan and "Pandas" not in plan             # scores come from the written table


def _select(df, threshold, limit):
    s = N.select_for_network(df, "risk", threshold, limit)
    return [sorted(r.risk for r in part.collect()) for part in (s.flagged, s.context, s.filler)], s


def test_selection(spark):
    df = spark.createDataFrame([(1, "a", "b", 1.0, 0.9), (2, "a", "c", 1.0, 0.5), (3, "d", "b", 9.0, 0.5),
                                (4, "x", "y", 1.0, 0.8), (None, "z", None, 1.0, 0.7), (6, None, None, 1.0, 0.1)],
                               "transaction_id long, sender_id string, receiver_id string, amount double, risk double")
    parts, s = _select(df, 0.9, 5)
    assert parts == [[0.9], [0.5, 0.5], [0.7, 0.8]] and s.rows.columns == df.columns
    parts, s = _select(df, 0.9, 2)                                   # the larger amount wins a tie
    assert parts == [[0.9], [0.5], []] and s.context.first().transaction_id == 3
    assert _select(df, 0.5, 2)[0] == [[0.8, 0.9], [], []]            # flagged rows overfill it
    assert _select(df, 2.0, 2)[0] == [[], [], [0.8, 0.9]]
    assert _select(df, 0.9, 0)[0] == _select(df.limit(0), 0.9, 5)[0] == [[], [], []]
    c = _select(df, 0.9, 5)[1].counts.first()
    assert tuple(c) == (5, 1, 4, 6, 1)


def test_account_columns(spark):
    names = ["banka_derguese", "llogaria_derguesit", "llogaria_perfituesit", "total"]
    assert N.account_column(names, N.SENDER_NAMES, N.SENDER_KEYWORDS) == "llogaria_derguesit"
    assert N.account_column(names, N.RECEIVER_NAMES, N.RECEIVER_KEYWORDS) == "llogaria_perfituesit"
    assert N.guess_column(["id_llogarise_se_derguesit"], (), N.SENDER_KEYWORDS) == "id_llogarise_se_derguesit"
    assert N.guess_column(["total"], (), N.RECEIVER_KEYWORDS) is None
    df = spark.createDataFrame([(7, "a", "b", "zz")], "id long, llogaria_derguesit string, llogaria_perfituesit string, shuma string")
    e = N.resolve_endpoints(df).first()
    assert (e.src, e.dst, e.amount) == ("a", "b", 0.0)
