"""Edge frames for cleaning and rule features (boundary rules)."""

import datetime as dt

import pytest

from riskweave.config import DEFAULT_CONFIG, with_config
from riskweave.operators.clean import clean
from riskweave.operators.features import (COUNT_COLUMNS, FEATURE_ORDER, FLAG_COLUMNS, engineer_features,
                                          numeric_features, preprocess)

SCHEMA = ("transaction_id long, amount double, sender_id long, receiver_id long, sender_bank string, "
          "receiver_bank string, sender_country string, receiver_country string, timestamp timestamp_ntz, "
          "transaction_type string, currency string")
T0 = dt.datetime(2024, 3, 4, 10, 0, 0)


def row(i, amount=100.0, s=1, r=2, sc="DE", rc="DE", ts=T0, sb="B1", rb="B2"):
    return (i, amount, s, r, sb, rb, sc, rc, ts, "wire", "EUR")


def feats(spark, rows, cfg=DEFAULT_CONFIG):
    return {r["transaction_id"]: r for r in engineer_features(clean(spark.createDataFrame(rows, SCHEMA)), cfg).collect()}


def test_near_threshold_closed_and_small_open(spark):
    out = feats(spark, [row(1, 8999.99), row(2, 9000.0), row(3, 10000.0), row(4, 10000.01)])
    assert [out[i]["near_threshold"] for i in (1, 2, 3, 4)] == [0, 1, 1, 0]
    assert [out[i]["small_transaction"] for i in (1, 2, 3, 4)] == [1, 0, 0, 0]


def test_night_hours_inclusive_and_null_hour(spark):
    ts = [dt.datetime(2024, 1, 1, 0, 0), dt.datetime(2024, 1, 1, 6, 59, 59), dt.datetime(2024, 1, 1, 7, 0), None]
    out = feats(spark, [row(i + 1, 50.0 + i, ts=t) for i, t in enumerate(ts)])
    assert [out[i]["hour"] for i in (1, 2, 3, 4)] == [0, 6, 7, 12]
    assert [out[i]["midnight_transaction"] for i in (1, 2, 3, 4)] == [1, 1, 0, 0]


def test_midnight_wrap_option(spark):
    cfg = with_config(midnight_start_hour=22, midnight_end_hour=3)
    out = feats(spark, [row(1, ts=dt.datetime(2024, 1, 1, 23)), row(2, 101.0, ts=dt.datetime(2024, 1, 1, 12))], cfg)
    assert out[1]["midnight_transaction"] == 0        # reference rule: start > end never fires
    import dataclasses
    cfg2 = dataclasses.replace(cfg, midnight_wraps=True)
    out2 = feats(spark, [row(1, ts=dt.datetime(2024, 1, 1, 23)), row(2, 101.0, ts=dt.datetime(2024, 1, 1, 12))], cfg2)
    assert out2[1]["midnight_transaction"] == 1 and out2[2]["midnight_transaction"] == 0


def test_structuring_counts_calendar_day(spark):
    d1, d2 = dt.datetime(2024, 1, 1, 23, 50), dt.datetime(2024, 1, 2, 0, 10)
    rows = [row(1, 10.0, s=7, ts=d1), row(2, 11.0, s=7, ts=d1), row(3, 12.0, s=7, ts=d2),
            row(4, 13.0, s=8, ts=d1), row(5, 14.0, s=8, ts=d1), row(6, 15.0, s=8, ts=d1)]
    out = feats(spark, rows)
    assert [out[i]["small_txn_count_per_day"] for i in (1, 2, 3)] == [2, 2, 1]
    assert [out[i]["structuring_flag"] for i in (1, 3, 4)] == [0, 0, 1]


def test_null_day_counts_zero(spark):
    out = feats(spark, [row(1, 10.0, ts=None), row(2, 11.0, ts=None), row(3, 12.0, ts=None)])
    assert all(out[i]["small_txn_count_per_day"] == 0 and out[i]["structuring_flag"] == 0 for i in (1, 2, 3))
    assert all(out[i]["unique_senders_per_day"] == 0 for i in (1, 2, 3))


def test_drug_list_counts_multiple_high_risk(spark):
    rows = [row(1, rc="CO"), row(2, 101.0, rc="MX"), row(3, 102.0, s=5, rc="IR")]
    out = feats(spark, rows)
    assert out[1]["multiple_high_risk_transfers"] == 1 and out[3]["multiple_high_risk_transfers"] == 0
    assert out[3]["high_risk_receiver"] == 1 and out[1]["is_high_risk_drug_country_receiver"] == 1


def test_rare_bank_and_cashflow(spark):
    rows = [row(i, 100.0 + i, rb="BIG") for i in range(1, 11)] + [row(99, 5000.0, rb="ONE")]
    out = feats(spark, rows)
    assert out[99]["rare_bank_combo_flag"] == 1 and out[1]["rare_bank_combo_flag"] == 0
    assert out[99]["high_cashflow_flag_acct_total"] == 1 and out[1]["high_cashflow_flag_acct_total"] == 0


def test_clean_rules(spark):
    raw = spark.createDataFrame(
        [("1", "100", "a", "b", " xk ", None, "2024-01-01 10:00:00"),
         ("1", "100", "a", "b", " xk ", None, "2024-01-01 10:00:00"),      # exact copy
         ("2", "n/a", "a", "b", "DE", "DE", "2024-01-01 10:00:00"),
         ("3", "-5", "a", "b", "DE", "DE", "2024-01-01 10:00:00"),
         ("4", "7", None, "b", "DE", "DE", "bad-date"),
         ("5", "8", "a", "b", "NA", None, "bad-date")],
        "transaction_id string, amount string, sender_id string, receiver_id string, sender_country string, "
        "receiver_country string, timestamp string")
    out = {r["transaction_id"]: r for r in clean(raw).collect()}
    assert sorted(out) == ["1", "5"]
    assert out["1"]["sender_country"] == "XK" and out["1"]["receiver_country"] == ""
    assert out["5"]["sender_country"] == "NA" and out["5"]["timestamp"] is None


def test_empty_and_missing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    out, names = preprocess(empty)
    assert out.count() == 0 and list(out.columns)[-len(FEATURE_ORDER):] == list(FEATURE_ORDER)
    only = spark.createDataFrame([(1, 9500.0), (2, 20.0)], "transaction_id long, amount double")
    res = {r["transaction_id"]: r for r in preprocess(only)[0].collect()}
    assert res[1]["near_threshold"] == 1 and res[1]["hour"] == 12 and res[1]["year"] == 2025
    assert res[1]["structuring_flag"] == 0 and res[1]["rare_bank_combo_flag"] == 0


def test_schema_types_and_numeric_features(spark):
    out = engineer_features(clean(spark.createDataFrame([row(1)], SCHEMA)))
    types = dict(out.dtypes)
    assert all(types[c] == "int" for c in FLAG_COLUMNS)
    assert all(types[c] == "bigint" for c in COUNT_COLUMNS)
    assert types["enhanced_aml_score"] == "double" and types["date"] == "date"
    nf = numeric_features(out)
    assert "transaction_id" not in nf and "amount" in nf and "date" not in nf


def test_enhanced_score_weights(spark):
    out = feats(spark, [row(1, 9500.0, sc="IR", rc="LA", ts=dt.datetime(2024, 1, 1, 3))])
    r = out[1]
    expect = sum(r[c] * w for c, w in DEFAULT_CONFIG.weights().items())
    assert r["enhanced_aml_score"] == expect and r["definite_fraud_flag"] == 1


def test_with_config_validation():
    cfg = with_config(multi_bank_min=5, high_risk_countries=" ir, kp ,")
    assert cfg.rare_bank_min_count == 5 and cfg.high_risk_countries == ("IR", "KP")
    with pytest.raises(ValueError):
        with_config(near_threshold_buffer=0.2)
    with pytest.raises(ValueError):
        with_config(weight_midnight=11)
    with pytest.raises(ValueError):
        with_config(no_such_key=1)
