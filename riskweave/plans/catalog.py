"""Query catalog: one Spark plan per operator, with its SQL oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> str``
(DuckDB over the driver's tables). Names are ``q_<op id>_<op name>``.
Floating sums and means are rounded to 6 digits on both sides, timestamps are
compared as second-precision text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.config import DEFAULT_CONFIG, HIGH_WEIGHT_INDICATORS, REQUIRED_COLUMNS, with_config
from riskweave.operators import clean as C
from riskweave.plans import oracle as O
from riskweave.plans.scoring import features_table, scored_table, surrogate_native_score
from riskweave.sources import fixtures
from riskweave.sources.mapping import apply_mapping, resolve_mapping

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def ts_text(c: str = "timestamp"):
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss").alias(c)


TS_SQL = """strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp\""""


def r6(c, alias=None):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(alias or c)


# ---------------------------------------------------------------- sources / cleaning
def _mapped_raw(spark, sf_dir):
    raw = fixtures.txn_raw(spark, sf_dir)
    return apply_mapping(raw, resolve_mapping(raw.columns))


RAW_COLS = ", ".join(f'"{c}"' for c in O.RAW_MAPPED_COLUMNS)


@register("q_s6_apply_mapping", O.with_chain(O.txn_raw_cte(), O.RAW_MAPPED_CTE, body="SELECT * FROM mapped"))
def q_s6(spark, sf_dir):
    return _mapped_raw(spark, sf_dir)


def _raw_sql(body):
    return O.raw_query(body)


@register("q_c1_clean_amount", _raw_sql("SELECT transaction_id, amount FROM c1"))
def q_c1(spark, sf_dir):
    return C.clean_amount(_mapped_raw(spark, sf_dir)).select("transaction_id", "amount")


@register("q_c2_clean_timestamp", _raw_sql(f"SELECT transaction_id, {TS_SQL} FROM c2"))
def q_c2(spark, sf_dir):
    return C.clean_timestamp(_mapped_raw(spark, sf_dir)).select("transaction_id", ts_text())


# Three feeds that write the same dates month first, day first and with dots; some texts are no dates.
_DATE_FEEDS = (("us", "M/d/yyyy h:mm:ss a", "%-m/%-d/%Y %-I:%M:%S %p"), ("eu", "dd/MM/yyyy HH:mm", "%d/%m/%Y %H:%M"),
               ("dots", "M.d.yyyy H:mm:ss", "%-m.%-d.%Y %-H:%M:%S"), ("iso", "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"))


def _date_order_sql() -> str:
    text = " ".join(f"WHEN {k} THEN strftime(ts, '{sql}')" for k, (_, _, sql) in enumerate(_DATE_FEEDS))
    names = " ".join(f"WHEN {k} THEN '{name}'" for k, (name, _, _) in enumerate(_DATE_FEEDS))
    looks = {"/": ("month", ("%m/%d/%Y %H:%M", "%m/%d/%Y %I:%M:%S %p"), ("%d/%m/%Y %H:%M", "%d/%m/%Y %I:%M:%S %p")),
             ".": ("day", ("%m.%d.%Y %H:%M:%S",), ("%d.%m.%Y %H:%M:%S",))}
    reads, wins = [], []
    for k, (sep, (tie, month, day)) in enumerate(looks.items()):
        for name, forms in (("m", month), ("d", day)):
            reads.append(f"CASE WHEN contains(t, '{sep}') THEN try_strptime(t, [{', '.join(map(repr, forms))}]) END AS {name}{k}")
        better = f"count(d{k}) > count(m{k})" if tie == "month" else f"count(d{k}) >= count(m{k})"
        wins.append(f"{better} AS w{k}")
    read = ", ".join(f"CASE WHEN w{k} THEN d{k} ELSE m{k} END" for k in range(len(looks)))
    return f"""WITH t AS (SELECT event_id AS transaction_id, CASE event_id % 4 {names} END AS feed,
  CASE WHEN event_id % 103 = 0 THEN 'bad-date' ELSE CASE event_id % 4 {text} END END AS t FROM events),
r AS (SELECT *, {', '.join(reads)} FROM t),
w AS (SELECT feed, {', '.join(wins)} FROM r GROUP BY feed),
o AS (SELECT transaction_id, r.feed, coalesce(TRY_CAST(t AS TIMESTAMP), {read}) AS "timestamp" FROM r JOIN w ON r.feed = w.feed)
SELECT transaction_id, feed, {TS_SQL} FROM o"""


@register("q_c2_date_order", _date_order_sql())
def q_c2_order(spark, sf_dir):
    """Each feed's dates are read the way that reads most of them."""
    ev, k = read_table(spark, sf_dir, "events"), F.col("event_id") % len(_DATE_FEEDS)
    text, feed = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, (name, form, _) in enumerate(_DATE_FEEDS):
        text, feed = F.when(k == n, F.date_format("ts", form)).otherwise(text), F.when(k == n, name).otherwise(feed)
    rows = ev.select(F.col("event_id").alias("transaction_id"), feed.alias("feed"),
                     F.when(F.col("event_id") % 103 == 0, "bad-date").otherwise(text).alias("timestamp"))
    return C.clean_timestamp(rows, "feed").select("transaction_id", "feed", ts_text())


_TYPED_OUT = ", ".join(f'"{c}"' for c in O.RAW_MAPPED_COLUMNS if c != "timestamp") + ", " + TS_SQL


def _typed_out(df):
    return df.select(*[c for c in O.RAW_MAPPED_COLUMNS if c != "timestamp"], ts_text())


@register("q_c3_drop_exact_duplicates", _raw_sql(f"SELECT {_TYPED_OUT} FROM c3"))
def q_c3(spark, sf_dir):
    d = _mapped_raw(spark, sf_dir).transform(C.clean_amount).transform(C.clean_timestamp)
    return _typed_out(C.drop_exact_duplicates(d))


@register("q_c4_require_parties", _raw_sql(f"SELECT {_TYPED_OUT} FROM c4"))
def q_c4(spark, sf_dir):
    d = _mapped_raw(spark, sf_dir).transform(C.clean_amount).transform(C.clean_timestamp)
    return _typed_out(C.require_parties(C.drop_exact_duplicates(d)))


@register("q_c5_normalize_country", O.with_chain(
    O.txn_raw_cte(), O.RAW_MAPPED_CTE,
    body="SELECT transaction_id, upper(trim(sender_country)) AS sender_country, "
         "upper(trim(receiver_country)) AS receiver_country FROM mapped"))
def q_c5(spark, sf_dir):
    return C.normalize_country(_mapped_raw(spark, sf_dir)).select("transaction_id", "sender_country", "receiver_country")


@register("q_c6_fill_defaults", O.with_chain(
    O.txn_raw_cte(), O.RAW_MAPPED_CTE,
    body="SELECT transaction_id, coalesce(sender_bank, '') AS sender_bank, "
         "coalesce(sender_country, '') AS sender_country, coalesce(receiver_country, '') AS receiver_country, "
         "coalesce(transaction_type, 'Unknown') AS transaction_type FROM mapped"))
def q_c6(spark, sf_dir):
    return C.fill_defaults(_mapped_raw(spark, sf_dir)).select(
        "transaction_id", "sender_bank", "sender_country", "receiver_country", "transaction_type")


@register("q_c7_clean", _raw_sql(f"SELECT {_TYPED_OUT} FROM cl"))
def q_c7(spark, sf_dir):
    return _typed_out(C.clean(_mapped_raw(spark, sf_dir)))


#: Headers of a second, untidily written feed.
FEED_HEADERS = {"tx_id": "Transaction ID", "shuma_e_transaksionit": "AMOUNT", "id_i_llogarise_se_derguesit": "Sender ID",
                "id_i_llogarise_se_perfituesit": "Receiver ID", "banka_derguese": "Sender Bank",
                "lokacioni_i_derguesit": "sender country", "lokacioni_i_perfituesit": "Receiver Country ",
                "data_transaksionit": "Timestamp", "tx_type": "Transaction Type"}


@register("q_s13_load_and_map", _raw_sql(f"SELECT {_TYPED_OUT.replace(TS_SQL, '')} {TS_SQL} FROM c2"))
def q_s13(spark, sf_dir):
    """The upload as many CSV files with two different headers, read and mapped to one table. A row's id decides its
    feed; all are read whole."""
    from riskweave.sources.mapping import load_and_map
    raw, path = fixtures.txn_raw(spark, sf_dir), scratch_dir(spark)
    first = F.crc32(F.col("tx_id")) % 2 == 0
    feeds = {"a.csv": raw.where(first), "b.csv": raw.where(~first).withColumnsRenamed(FEED_HEADERS)}
    for name, feed in feeds.items():
        (feed.repartition(8).write.option("header", True).option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(f"{path}/{name}"))
    d, _ = load_and_map(spark, [f"{path}/{name}" for name in feeds], "csv")
    typed = F.expr("try_cast(amount AS double)")
    return _typed_out(C.clean_timestamp(d).withColumn("amount", typed))


@register("q_s2_read_workbooks", _raw_sql(f"SELECT {_TYPED_OUT.replace(TS_SQL, '')} {TS_SQL} FROM c2"))
def q_s2(spark, sf_dir):
    """The upload as workbooks in two layouts, streamed, written once and mapped by layout."""
    from functools import reduce

    from riskweave.session import cut_lineage
    from riskweave.sources.mapping import mapped_workbooks
    from riskweave.sources.readers import workbook_rows
    table = cut_lineage(workbook_rows(fixtures.txn_workbooks(spark, sf_dir, FEED_HEADERS)))
    parts, _ = mapped_workbooks(table)
    d = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    typed = F.expr("try_cast(amount AS double)")
    return _typed_out(C.clean_timestamp(d).withColumn("amount", typed))


# ---------------------------------------------------------------- rule features
def _feat_query(name: str, cols: list[str], cfg=DEFAULT_CONFIG):
    sel_sql = ", ".join(["transaction_id"] + [f'"{c}"' for c in cols])

    def fn(spark, sf_dir):
        only = [c for c in cols if c in O.FEATURE_COLUMNS]
        return features_table(spark, sf_dir, cfg, only=only).select("transaction_id", *cols)
    fn.__name__ = name
    register(name, O.features_query(f"SELECT {sel_sql} FROM feat", cfg))(fn)


_feat_query("q_f1_calendar_parts", ["hour", "day", "month", "year", "dayofweek", "date"])
_feat_query("q_f2_high_risk_sender", ["sender_country", "high_risk_sender"])
_feat_query("q_f3_high_risk_receiver", ["receiver_country", "high_risk_receiver"])
_feat_query("q_f4_drug_country_receiver", ["receiver_country", "is_high_risk_drug_country_receiver"])
_feat_query("q_f5_near_threshold", ["amount", "near_threshold"])
_feat_query("q_f6_small_transaction", ["amount", "small_transaction"])
_feat_query("q_f7_structuring", ["small_txn_count_per_day", "structuring_flag"])
_feat_query("q_f8_multiple_high_risk_transfers", ["high_risk_transfers_per_day", "multiple_high_risk_transfers"])
_feat_query("q_f9_rare_bank_combo", ["sender_bank_count", "receiver_bank_count", "rare_sender_bank_combo",
                                     "rare_receiver_bank_combo", "rare_bank_combo_flag"])
_feat_query("q_f10_midnight_transaction", ["hour", "midnight_transaction"])
_feat_query("q_f11_high_cashflow", ["amount", "high_cashflow_flag_acct_total"])
_feat_query("q_f12_high_cashflow_midnight", ["high_cashflow_midnight"])
_feat_query("q_f13_receiver_locations_per_day", ["unique_receiver_locations_per_day",
                                                 "transaksione_ne_lokacione_ndryshe"])
_feat_query("q_f14_senders_per_receiver_day", ["unique_senders_per_day", "multiple_senders_same_receiver"])
_feat_query("q_f15_enhanced_aml_score", ["enhanced_aml_score"])
_feat_query("q_f16_definite_fraud_flag", ["definite_fraud_flag"])
_feat_query("q_f17_risk_categories", ["high_risk_country_transaction", "high_risk_drug_country_transaction",
                                      "threshold_risk_transaction"])
_feat_query("q_f7_structuring_min6", ["small_txn_count_per_day", "structuring_flag"],
            with_config(structuring_min_count=6))

_ALL_FEAT = [c for c in O.TXN_COLUMNS if c != "timestamp"] + list(O.FEATURE_COLUMNS)


@register("q_f20_preprocess", O.features_query(
    "SELECT " + ", ".join(f'"{c}"' for c in _ALL_FEAT) + ", " + TS_SQL + " FROM feat"))
def q_f20(spark, sf_dir):
    return features_table(spark, sf_dir).select(*_ALL_FEAT, ts_text())


@register("q_f14_sender_store", O.features_query(
    "SELECT receiver_id, date, count(DISTINCT sender_id) AS unique_senders_per_day, "
    "CAST(count(DISTINCT sender_id) > 1 AS INTEGER) AS multiple_senders_same_receiver FROM feat "
    "WHERE date IS NOT NULL AND sender_id IS NOT NULL AND receiver_id IS NOT NULL GROUP BY receiver_id, date"))
def q_f14_store(spark, sf_dir):
    """Distinct senders from the stored sketches of three uploads, one of them sent twice, compacted half way."""
    from riskweave.operators.sender_sketches import SenderStore, estimates
    days = features_table(spark, sf_dir, only=["date"])
    store = SenderStore(spark, scratch_dir(spark) + "/senders")
    parts = [days.where(F.col("transaction_id") % 3 == k) for k in range(3)]
    store.add(parts[0], "a")
    store.add(parts[1], "b")
    store.add(parts[1], "b")
    store.compact()
    store.add(parts[2].unionByName(parts[0]), "c")
    return estimates(store.table())


SWEEP = {
    "default": {},
    "strict_structuring": {"structuring_min_count": 6},
    "low_threshold": {"reporting_threshold": 5000.0, "near_threshold_buffer": 0.8},
    "short_night": {"midnight_start_hour": 1, "midnight_end_hour": 4, "high_amount_percentile": 0.95},
}
_SWEEP_FLAGS = ["near_threshold", "structuring_flag", "midnight_transaction", "high_cashflow_flag_acct_total",
                "rare_bank_combo_flag", "definite_fraud_flag"]


def _sweep_sql(sweep: dict) -> str:
    parts = []
    for name, kv in sweep.items():
        cfg = with_config(**kv)
        sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _SWEEP_FLAGS)
        body = (f"SELECT '{name}' AS config, count(*) AS n_rows, {sums}, "
                f"CAST(sum(CASE WHEN enhanced_aml_score >= 6.0 THEN 1 ELSE 0 END) AS BIGINT) AS n_enhanced FROM feat")
        parts.append("SELECT * FROM (" + O.features_query(body, cfg) + ")")
    return "\nUNION ALL\n".join(parts)


def _sweep(spark, sf_dir, sweep):
    from riskweave.operators.features import sweep as sweep_all
    from riskweave.session import cut_lineage
    cleaned = cut_lineage(C.clean(fixtures.txn(spark, sf_dir)))
    return sweep_all(cleaned, {name: with_config(**kv) for name, kv in sweep.items()}, _SWEEP_FLAGS)


@register("q_f21_config_sweep", _sweep_sql(SWEEP))
def q_f21(spark, sf_dir):
    """flag counts per configuration, all from one pass over the cleaned table."""
    return _sweep(spark, sf_dir, SWEEP)


#: Sixteen configurations: four thresholds, night hours, lists and limits against each other.
SWEEP_16 = {f"t{t}_c{c}": {"reporting_threshold": 2500.0 * (t + 1), "near_threshold_buffer": 0.7 + 0.1 * (t % 3),
                           "structuring_min_count": 2 + c, "rare_bank_min_count": 1 + 2 * c, "high_amount_percentile": 0.9 + 0.03 * c,
                           "midnight_start_hour": t, "midnight_end_hour": 5 + c,
                           **({"high_risk_drug_countries": "CO,MX,AL"} if c % 2 else {}),
                           **({"high_risk_countries": "IR,US,TR", "weight_midnight": 4.0} if t % 2 else {})}
            for t in range(4) for c in range(4)}


@register("q_f21_config_sweep_16", _sweep_sql(SWEEP_16))
def q_f21_16(spark, sf_dir):
    return _sweep(spark, sf_dir, SWEEP_16)


@register("q_f7_structuring_salted", O.features_query(
    "SELECT transaction_id, small_txn_count_per_day, structuring_flag, receiver_bank_count FROM feat"))
def q_f7_salted(spark, sf_dir):
    """The join back of large aggregates: none is broadcast, and hot keys are salted."""
    old = spark.conf.get("riskweave.join.broadcastBytes", None)
    spark.conf.set("riskweave.join.broadcastBytes", "0")
    try:
        only = ["small_txn_count_per_day", "structuring_flag", "receiver_bank_count"]
        return features_table(spark, sf_dir, only=only).select("transaction_id", *only)
    finally:
        if old is None:
            spark.conf.unset("riskweave.join.broadcastBytes")
        else:
            spark.conf.set("riskweave.join.broadcastBytes", old)


# ---------------------------------------------------------------- scoring and alerts
from riskweave.operators import alerts as A  # noqa: E402
from riskweave.operators import banks as B  # noqa: E402
from riskweave.operators import network as N  # noqa: E402


def _sc(body: str) -> str:
    return O.scored_query(body)


@register("q_a1_percentile_score", _sc("SELECT transaction_id, native_score, aml_score FROM scored"))
def q_a1(spark, sf_dir):
    return scored_table(spark, sf_dir).select("transaction_id", "native_score", "aml_score")


@register("q_a2_policy_native", _sc("SELECT transaction_id, native_score FROM scored WHERE anomaly_label = 1"))
def q_a2(spark, sf_dir):
    s = scored_table(spark, sf_dir)
    cut, _ = A.policy_cut(s, "native", contamination=DEFAULT_CONFIG.contamination)
    return A.apply_policy(s, cut, out_col="_p").where(F.col("_p") == 1).select("transaction_id", "native_score")


@register("q_a3_policy_manual", _sc("SELECT transaction_id, native_score FROM scored WHERE native_score >= 0.9999"))
def q_a3(spark, sf_dir):
    s = scored_table(spark, sf_dir)
    cut, _ = A.policy_cut(s, "manual", manual_cutoff=0.9999)
    return A.apply_policy(s, cut, out_col="_p").where(F.col("_p") == 1).select("transaction_id", "native_score")


@register("q_a4_policy_topk", _sc(
    "SELECT transaction_id, native_score FROM scored "
    "WHERE native_score >= (SELECT quantile_cont(native_score, 0.98) FROM scored)"))
def q_a4(spark, sf_dir):
    s = scored_table(spark, sf_dir)
    cut, _ = A.policy_cut(s, "topk", topk_pct=2.0)
    return A.apply_policy(s, cut, out_col="_p").where(F.col("_p") == 1).select("transaction_id", "native_score")


@register("q_a5_flag_enhanced", _sc("SELECT transaction_id, enhanced_aml_score, flagged_by_enhanced FROM scored"))
def q_a5(spark, sf_dir):
    feat = features_table(spark, sf_dir, only=["enhanced_aml_score"])
    return A.flag_enhanced(feat).select("transaction_id", "enhanced_aml_score", "flagged_by_enhanced")


@register("q_a6_flag_indicators", _sc(
    "SELECT transaction_id, high_weight_indicator_count, flagged_by_indicators FROM scored"))
def q_a6(spark, sf_dir):
    feat = features_table(spark, sf_dir, only=HIGH_WEIGHT_INDICATORS)
    return A.flag_indicators(feat).select("transaction_id", "high_weight_indicator_count", "flagged_by_indicators")


_A7 = ["transaction_id", "anomaly_label", "flagged_by_model", "flagged_by_enhanced", "flagged_by_indicators", "is_flagged"]


@register("q_a7_combine_flags", _sc("SELECT " + ", ".join(_A7) + " FROM scored"))
def q_a7(spark, sf_dir):
    """Flags need no rank: the policy's cut is the one quantile read here."""
    feat = features_table(spark, sf_dir, only=[*HIGH_WEIGHT_INDICATORS, "enhanced_aml_score"])
    feat = feat.withColumn("native_score", surrogate_native_score())
    cut, _ = A.policy_cut(feat.select("native_score"), "native", contamination=DEFAULT_CONFIG.contamination)
    return A.combine_flags(A.apply_policy(feat, cut)).select(*_A7)


_KPI_SQL = ("count(*) AS n_transactions, CAST(sum(is_flagged) AS BIGINT) AS n_flagged, "
            "round(sum(is_flagged) * 100.0 / count(*), 6) AS flagged_rate_pct, round(avg(aml_score), 6) AS avg_aml_score")


@register("q_a9_kpis", _sc(f"SELECT {_KPI_SQL} FROM scored"))
def q_a9(spark, sf_dir):
    k = A.kpis(scored_table(spark, sf_dir))
    return k.select("n_transactions", "n_flagged", r6("flagged_rate_pct"), r6("avg_aml_score"))


@register("q_a10_quality_assessment", _sc(f"""
SELECT n_transactions, n_flagged, flagged_rate_pct, avg_aml_score, round(score_std, 6) AS score_std,
       CASE WHEN rate BETWEEN 0.1 AND 3.0 THEN 'good' WHEN rate > 3.0 AND rate <= 5.0 THEN 'acceptable'
            WHEN rate < 0.1 THEN 'low' ELSE 'check_threshold' END AS rate_band,
       CASE WHEN avg_raw >= 0.6 THEN 'tail_heavy' WHEN avg_raw <= 0.4 THEN 'tail_light' ELSE 'balanced' END AS score_band,
       CASE WHEN n_flagged <= n_transactions * 0.02 * 1.5 THEN 'expected' ELSE 'many_flagged' END AS volume_band,
       CASE WHEN score_std > 0.15 THEN 'good_separation' ELSE 'low_variance' END AS spread_band
FROM (SELECT {_KPI_SQL}, sum(is_flagged) * 100.0 / count(*) AS rate, avg(aml_score) AS avg_raw,
             stddev_samp(aml_score) AS score_std FROM scored) k"""))
def q_a10(spark, sf_dir):
    q = A.quality_assessment(scored_table(spark, sf_dir))
    return q.select("n_transactions", "n_flagged", r6("flagged_rate_pct"), r6("avg_aml_score"), r6("score_std"),
                    "rate_band", "score_band", "volume_band", "spread_band")


@register("q_a11_flag_breakdown", _sc("""
SELECT method, n_flagged, round(n_flagged * 100.0 / n, 6) AS pct FROM (
  SELECT 'enhanced_score' AS method, CAST(sum(flagged_by_enhanced) AS BIGINT) AS n_flagged, count(*) AS n FROM scored
  UNION ALL SELECT 'high_weight_indicators', CAST(sum(flagged_by_indicators) AS BIGINT), count(*) FROM scored
  UNION ALL SELECT 'model_policy', CAST(sum(flagged_by_model) AS BIGINT), count(*) FROM scored
  UNION ALL SELECT 'unique_total', CAST(sum(is_flagged) AS BIGINT), count(*) FROM scored) t"""))
def q_a11(spark, sf_dir):
    return A.flag_breakdown(scored_table(spark, sf_dir)).select("method", "n_flagged", r6("pct"))


_TOP = ", ".join(A.TOP_COLUMNS)


@register("q_a12_top_suspicious", _sc(f"SELECT {_TOP} FROM scored ORDER BY aml_score DESC, transaction_id LIMIT 5"))
def q_a12(spark, sf_dir):
    return A.top_suspicious(scored_table(spark, sf_dir), 5)


def _reasons_sql() -> str:
    parts = ", ".join(f"CASE WHEN {col} = 1 THEN '{txt}' END" for col, _, txt in A.reason_catalog())
    n = " + ".join(f"CASE WHEN {col} = 1 THEN 1 ELSE 0 END" for col, _, _ in A.reason_catalog())
    return (f"SELECT transaction_id, concat_ws('; ', {parts}) AS reasons, CAST({n} AS INTEGER) AS n_reasons "
            f"FROM scored WHERE is_flagged = 1")


@register("q_a13_explain_flags", _sc(_reasons_sql()))
def q_a13(spark, sf_dir):
    return A.explain_flags(scored_table(spark, sf_dir)).select("transaction_id", "reasons", "n_reasons")


@register("q_a13_reason_counts", _sc(" UNION ALL ".join(
    f"SELECT '{code}' AS reason, count(*) AS n_rows FROM scored WHERE is_flagged = 1 AND {col} = 1 "
    f"HAVING count(*) > 0" for col, code, _ in A.reason_catalog())))
def q_a13b(spark, sf_dir):
    return A.reason_counts(scored_table(spark, sf_dir))


def _hist_sql(col: str) -> str:
    return f"""SELECT bin, count(*) AS n, round(min(lo) + bin * min(w), 6) AS bin_start FROM (
  SELECT CAST(CASE WHEN mx > mn THEN least(floor(({col} - mn) / (mx - mn) * 50), 49) ELSE 0 END AS INTEGER) AS bin,
         mn AS lo, CASE WHEN mx > mn THEN (mx - mn) / 50 ELSE 0.0 END AS w
  FROM scored CROSS JOIN (SELECT min({col}) AS mn, max({col}) AS mx FROM scored) m) t GROUP BY bin"""


@register("q_a14_score_histogram", _sc(_hist_sql("aml_score")))
def q_a14(spark, sf_dir):
    return A.histogram(scored_table(spark, sf_dir), "aml_score").select("bin", "n", r6("bin_start"))


@register("q_a14_amount_histogram", _sc(_hist_sql("amount")))
def q_a14b(spark, sf_dir):
    return A.histogram(scored_table(spark, sf_dir), "amount").select("bin", "n", r6("bin_start"))


@register("q_a17_config_diagnostic", _sc(
    f"SELECT {_KPI_SQL.replace(', round(avg(aml_score), 6) AS avg_aml_score', '')}, CAST(1.0 AS DOUBLE) AS contamination_pct, "
    "'native' AS policy FROM scored"))
def q_a17(spark, sf_dir):
    d = A.config_diagnostic(scored_table(spark, sf_dir), DEFAULT_CONFIG, "native")
    return d.select("n_transactions", "n_flagged", r6("flagged_rate_pct"), "contamination_pct", "policy")


# ---------------------------------------------------------------- banks
def _role_sql(role: str, where: str, min_tx: int) -> str:
    return (f"SELECT {role}_bank AS bank, '{role}' AS role, count(*) AS total_transactions, sum(amount) AS total_amount, "
            f"avg(aml_score) AS avg_aml_score, max(aml_score) AS max_aml_score, "
            f"CAST(sum(anomaly_label) AS BIGINT) AS flagged_transactions FROM scored "
            f"WHERE {role}_bank IS NOT NULL {where} GROUP BY {role}_bank HAVING count(*) >= {min_tx}")


def _roles_sql(min_tx: int, country: str | None) -> str:
    parts = []
    for role in ("sender", "receiver"):
        where = f"AND upper({role}_country) = '{country}'" if country else ""
        parts.append(_role_sql(role, where, min_tx))
    return " UNION ALL ".join(parts)


_ROLE_OUT = ["bank", "role", "total_transactions", "flagged_transactions", "max_aml_score"]


def _role_out(df):
    return df.select(*_ROLE_OUT, r6("total_amount"), r6("avg_aml_score"))


_ROLE_OUT_SQL = ", ".join(_ROLE_OUT) + ", round(total_amount, 6) AS total_amount, round(avg_aml_score, 6) AS avg_aml_score"


@register("q_b1_bank_role_metrics", _sc(f"SELECT {_ROLE_OUT_SQL} FROM ({_roles_sql(10, None)}) r"))
def q_b1(spark, sf_dir):
    return _role_out(B.union_roles(scored_table(spark, sf_dir), min_transactions=10))


@register("q_b2_focus_country_filter", _sc(
    "SELECT transaction_id, sender_country, receiver_country FROM scored "
    "WHERE upper(sender_country) = 'XK' OR upper(receiver_country) = 'XK'"))
def q_b2(spark, sf_dir):
    return B.focus_country_filter(scored_table(spark, sf_dir), "XK").select(
        "transaction_id", "sender_country", "receiver_country")


@register("q_b3_union_roles", _sc(f"SELECT {_ROLE_OUT_SQL} FROM ({_roles_sql(3, 'XK')}) r"))
def q_b3(spark, sf_dir):
    s = B.focus_country_filter(scored_table(spark, sf_dir), "XK")
    return _role_out(B.union_roles(s, min_transactions=3, country="XK"))


def _risk_sql(min_tx: int, country: str | None) -> str:
    return f"""SELECT bank, total_transactions, flagged_transactions, avg_aml_score, max_aml_score, total_amount,
       flagged_transactions * 100.0 / total_transactions AS flagged_percent,
       flagged_transactions * 100.0 / total_transactions * 0.4 + avg_aml_score * 100 * 0.3 + max_aml_score * 100 * 0.3 AS risk_score
FROM (SELECT bank, CAST(sum(total_transactions) AS BIGINT) AS total_transactions,
             CAST(sum(flagged_transactions) AS BIGINT) AS flagged_transactions, avg(avg_aml_score) AS avg_aml_score,
             max(max_aml_score) AS max_aml_score, sum(total_amount) AS total_amount
      FROM ({_roles_sql(min_tx, country)}) r GROUP BY bank) g"""


_RISK_OUT = ["bank", "total_transactions", "flagged_transactions", "max_aml_score"]
_RISK_R6 = ["avg_aml_score", "total_amount", "flagged_percent", "risk_score"]
_RISK_OUT_SQL = ", ".join(_RISK_OUT) + ", " + ", ".join(f"round({c}, 6) AS {c}" for c in _RISK_R6)


def _risk_out(df, rank=False):
    return df.select(*_RISK_OUT, *[r6(c) for c in _RISK_R6], *(["rank"] if rank else []))


def _ranked_sql(min_tx: int, country: str | None, top: int | None) -> str:
    lim = f"WHERE rank <= {top}" if top else ""
    return (f"SELECT {_RISK_OUT_SQL}, rank FROM (SELECT *, CAST(row_number() OVER (ORDER BY flagged_transactions > 0 DESC, "
            f"flagged_transactions DESC, risk_score DESC, bank) AS INTEGER) AS rank FROM ({_risk_sql(min_tx, country)}) x) y {lim}")


@register("q_b4_bank_risk", _sc(f"SELECT {_RISK_OUT_SQL} FROM ({_risk_sql(3, 'XK')}) x"))
def q_b4(spark, sf_dir):
    s = B.focus_country_filter(scored_table(spark, sf_dir), "XK")
    return _risk_out(B.bank_risk(B.union_roles(s, min_transactions=3, country="XK")))


@register("q_b5_rank_banks", _sc(_ranked_sql(10, None, None)))
def q_b5(spark, sf_dir):
    return _risk_out(B.all_banks(scored_table(spark, sf_dir), min_transactions=10, top_n=None), rank=True)


@register("q_b6_focus_country_banks", _sc(_ranked_sql(5, "XK", None)))
def q_b6(spark, sf_dir):
    return _risk_out(B.focus_country_banks(scored_table(spark, sf_dir), "XK", min_transactions=5), rank=True)


@register("q_b7_all_banks", _sc(_ranked_sql(10, None, 20)))
def q_b7(spark, sf_dir):
    return _risk_out(B.all_banks(scored_table(spark, sf_dir), min_transactions=10, top_n=20), rank=True)


@register("q_b9_bank_chart_data", _sc(
    f"SELECT bank, round(risk_score, 6) AS metric_value, total_transactions, flagged_transactions, "
    f"round(flagged_percent, 6) AS flagged_percent, round(avg_aml_score, 6) AS avg_aml_score, "
    f"round(total_amount, 6) AS total_amount FROM ({_risk_sql(10, None)}) x ORDER BY risk_score DESC, bank LIMIT 15"))
def q_b9(spark, sf_dir):
    m = B.all_banks(scored_table(spark, sf_dir), min_transactions=10, top_n=None)
    return B.bank_chart_data(m, "risk_score", 15).select(
        "bank", r6("metric_value"), "total_transactions", "flagged_transactions", r6("flagged_percent"),
        r6("avg_aml_score"), r6("total_amount"))


@register("q_b10_bank_comparison_data", _sc(
    f"""SELECT bank, measure, round(value, 6) AS value FROM (
  SELECT bank, 'flagged_percent' AS measure, flagged_percent AS value FROM t
  UNION ALL SELECT bank, 'avg_score_x100', avg_aml_score * 100 FROM t) u""".replace(
        "FROM t", f"FROM (SELECT * FROM ({_risk_sql(10, None)}) x ORDER BY risk_score DESC, bank LIMIT 10) t")))
def q_b10(spark, sf_dir):
    m = B.all_banks(scored_table(spark, sf_dir), min_transactions=10, top_n=None)
    return B.bank_comparison_data(m, 10).select("bank", "measure", r6("value"))


def _country_sql(side: str) -> str:
    return (f"SELECT {side}_country AS country, count(*) AS n_flagged FROM scored WHERE anomaly_label = 1 "
            f"GROUP BY {side}_country ORDER BY n_flagged DESC, country LIMIT 10")


@register("q_b11_fraud_sender_countries", _sc(_country_sql("sender")))
def q_b11s(spark, sf_dir):
    return B.fraud_country_counts(scored_table(spark, sf_dir), "sender")


@register("q_b11_fraud_receiver_countries", _sc(_country_sql("receiver")))
def q_b11r(spark, sf_dir):
    return B.fraud_country_counts(scored_table(spark, sf_dir), "receiver")


@register("q_b12_fraud_scatter_sample", _sc(
    "SELECT transaction_id, amount, aml_score, enhanced_aml_score FROM scored WHERE anomaly_label = 1 "
    "ORDER BY transaction_id LIMIT 500"))
def q_b12(spark, sf_dir):
    return B.fraud_scatter_sample(scored_table(spark, sf_dir), 500)


# ---------------------------------------------------------------- network
NET_SCORE, NET_THR, NET_LIMIT = "aml_score", 0.99, 400

def _sel_ctes(threshold: float, limit: int) -> str:
    return f"""fl AS (SELECT * FROM scored WHERE aml_score >= {threshold}),
nf AS (SELECT count(*) AS c FROM fl),
nm AS (SELECT * FROM scored WHERE aml_score < {threshold}),
sel_f AS (SELECT * FROM fl WHERE (SELECT c FROM nf) < {limit}
          UNION ALL
          SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (ORDER BY aml_score DESC, transaction_id) AS rn FROM fl) z
          WHERE (SELECT c FROM nf) >= {limit} AND rn <= {limit}),
acc AS (SELECT CAST(sender_id AS VARCHAR) AS a FROM fl UNION SELECT CAST(receiver_id AS VARCHAR) FROM fl),
ctx AS (SELECT * FROM (
          SELECT *, row_number() OVER (ORDER BY aml_score DESC, amount DESC, transaction_id) AS rn FROM nm
          WHERE CAST(sender_id AS VARCHAR) IN (SELECT a FROM acc) OR CAST(receiver_id AS VARCHAR) IN (SELECT a FROM acc)) z
        WHERE (SELECT c FROM nf) < {limit} AND rn <= {limit} - (SELECT c FROM nf)),
fil AS (SELECT * FROM (
          SELECT *, row_number() OVER (ORDER BY aml_score DESC, transaction_id) AS rn FROM nm
          WHERE transaction_id NOT IN (SELECT transaction_id FROM ctx)) z
        WHERE (SELECT c FROM nf) < {limit} AND rn <= {limit} - (SELECT c FROM nf) - (SELECT count(*) FROM ctx)),
sel AS (SELECT transaction_id, sender_id, receiver_id, amount, sender_bank, receiver_bank, aml_score, "timestamp" FROM sel_f
        UNION ALL SELECT transaction_id, sender_id, receiver_id, amount, sender_bank, receiver_bank, aml_score, "timestamp" FROM ctx
        UNION ALL SELECT transaction_id, sender_id, receiver_id, amount, sender_bank, receiver_bank, aml_score, "timestamp" FROM fil)"""


_COMP_CTE = """ue AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed),
reach(node, lbl) AS (SELECT a, a FROM ue
                     UNION
                     SELECT ue.b, reach.lbl FROM reach JOIN ue ON reach.node = ue.a WHERE reach.lbl < ue.b),
comp AS (SELECT node, min(lbl) AS component FROM reach GROUP BY node)"""


def _net_sql(body: str, source: str = "scored", components: bool = False, threshold: float = NET_THR,
             limit: int = NET_LIMIT) -> str:
    """Scored fixture -> selection -> endpoints (from ``source``) -> edges ->
    edge ends -> degrees; with ``components`` also the recursive label CTEs."""
    ep = f"""ep AS (SELECT CAST(transaction_id AS VARCHAR) AS transaction_id,
              coalesce(nullif(trim(CAST(sender_id AS VARCHAR)), ''), 'S_' || CAST(transaction_id AS VARCHAR)) AS src,
              coalesce(nullif(trim(CAST(receiver_id AS VARCHAR)), ''), 'R_' || CAST(transaction_id AS VARCHAR)) AS dst,
              coalesce(TRY_CAST(amount AS DOUBLE), 0.0) AS amount,
              coalesce(nullif(trim(sender_bank), ''), 'Unknown') AS sender_bank,
              coalesce(nullif(trim(receiver_bank), ''), 'Unknown') AS receiver_bank,
              coalesce(TRY_CAST({NET_SCORE} AS DOUBLE), 0.0) AS score, "timestamp" FROM {source}),
ed AS (SELECT src, dst, count(*) AS weight, sum(amount) AS total_amount, max(score) AS max_score FROM ep GROUP BY src, dst),
ends AS (SELECT src AS account, 0 AS in_degree, 1 AS out_degree, 0.0 AS amount_in, total_amount AS amount_out,
                weight AS tx, max_score, CAST(max_score >= {NET_THR} AS INTEGER) AS fl FROM ed
         UNION ALL
         SELECT dst, 1, 0, total_amount, 0.0, weight, max_score, CAST(max_score >= {NET_THR} AS INTEGER) FROM ed),
deg AS (SELECT account, CAST(sum(in_degree) AS BIGINT) AS in_degree, CAST(sum(out_degree) AS BIGINT) AS out_degree,
               CAST(sum(in_degree) + sum(out_degree) AS BIGINT) AS degree FROM ends GROUP BY account)"""
    ctes = [O.txn_cte(), O.clean_ctes("txn", O.TXN_COLUMNS), O.feature_ctes(),
            O.scored_ctes(DEFAULT_CONFIG.contamination), _sel_ctes(threshold, limit), ep]
    if components:
        ctes.append(_COMP_CTE)
    sql = O.with_chain(*ctes, body=body)
    return "WITH RECURSIVE " + sql[len("WITH "):] if components else sql


def _sel(spark, sf_dir):
    return N.select_for_network(scored_table(spark, sf_dir), NET_SCORE, NET_THR, NET_LIMIT)


@register("q_n2_select_flagged", _net_sql("SELECT transaction_id, aml_score FROM sel_f"))
def q_n2(spark, sf_dir):
    return _sel(spark, sf_dir).flagged.select("transaction_id", "aml_score")


@register("q_n3_select_context", _net_sql("SELECT transaction_id, aml_score FROM ctx"))
def q_n3(spark, sf_dir):
    return _sel(spark, sf_dir).context.select("transaction_id", "aml_score")


#: A threshold and a limit that leave room for filler rows.
FILLER_THR, FILLER_LIMIT = 0.9995, 2000


@register("q_n4_select_filler", _net_sql("SELECT transaction_id, aml_score FROM fil",
                                           threshold=FILLER_THR, limit=FILLER_LIMIT))
def q_n4(spark, sf_dir):
    sel = N.select_for_network(scored_table(spark, sf_dir), NET_SCORE, FILLER_THR, FILLER_LIMIT)
    return sel.filler.select("transaction_id", "aml_score")


FULL_LIMIT = 5


@register("q_n2_select_flagged_full", _net_sql("SELECT transaction_id, aml_score FROM sel_f", limit=FULL_LIMIT))
def q_n2_full(spark, sf_dir):
    """More flagged rows than the selection holds."""
    sel = N.select_for_network(scored_table(spark, sf_dir), NET_SCORE, NET_THR, FULL_LIMIT)
    return sel.flagged.select("transaction_id", "aml_score")


@register("q_n5_selection_counts", _net_sql(
    "SELECT (SELECT count(*) FROM sel) AS selected_total, (SELECT count(*) FROM sel_f) AS selected_fraud, "
    "(SELECT count(*) FROM sel) - (SELECT count(*) FROM sel_f) AS selected_context, "
    "(SELECT count(*) FROM scored) AS total_transactions_in_df, (SELECT c FROM nf) AS flagged_transactions_in_df"))
def q_n5(spark, sf_dir):
    return _sel(spark, sf_dir).counts


def _ep(spark, sf_dir):
    return N.resolve_endpoints(scored_table(spark, sf_dir), NET_SCORE)


@register("q_n6_resolve_endpoints", _net_sql(
    "SELECT transaction_id, src, dst, amount, sender_bank, receiver_bank, score FROM ep"))
def q_n6(spark, sf_dir):
    return _ep(spark, sf_dir).drop("timestamp")


@register("q_n7_edges", _net_sql("SELECT src, dst, weight, round(total_amount, 6) AS total_amount, max_score FROM ed"))
def q_n7(spark, sf_dir):
    return N.edges(_ep(spark, sf_dir)).select("src", "dst", "weight", r6("total_amount"), "max_score")


@register("q_n8_edge_recent_tx", _net_sql(
    "SELECT src, dst, pos, transaction_id FROM (SELECT src, dst, transaction_id, CAST(row_number() OVER "
    "(PARTITION BY src, dst ORDER BY \"timestamp\" DESC NULLS LAST, transaction_id DESC) AS INTEGER) AS pos FROM ep) z "
    "WHERE pos <= 6"))
def q_n8(spark, sf_dir):
    return N.edge_recent_tx(_ep(spark, sf_dir), 6).select("src", "dst", "pos", "transaction_id")


@register("q_n9_degrees", _net_sql("SELECT * FROM deg"))
def q_n9(spark, sf_dir):
    return N.degrees(N.edges(_ep(spark, sf_dir)))


@register("q_n10_node_stats", _net_sql(
    "SELECT account, CAST(sum(in_degree) AS BIGINT) AS in_degree, CAST(sum(out_degree) AS BIGINT) AS out_degree, "
    "round(sum(amount_in), 6) AS amount_in, round(sum(amount_out), 6) AS amount_out, "
    "CAST(sum(tx) AS BIGINT) AS transactions, greatest(max(max_score), 0.0) AS max_edge_score, "
    "CAST(sum(fl) AS BIGINT) AS flagged_edges, CAST(sum(fl) > 0 AS INTEGER) AS touches_flagged "
    "FROM ends GROUP BY account"))
def q_n10(spark, sf_dir):
    ns = N.node_stats(N.edges(_ep(spark, sf_dir)), NET_THR)
    return ns.select("account", "in_degree", "out_degree", r6("amount_in"), r6("amount_out"), "transactions",
                     "max_edge_score", "flagged_edges", "touches_flagged")


@register("q_n11_flagged_edges", _net_sql(f"SELECT src, dst, weight, max_score FROM ed WHERE max_score >= {NET_THR}"))
def q_n11(spark, sf_dir):
    return N.flagged_edges(N.edges(_ep(spark, sf_dir)), NET_THR).select("src", "dst", "weight", "max_score")





def _net_sql_with_comp(body: str, source: str = "scored") -> str:
    return _net_sql(body, source, components=True)


_METRICS_SQL = f"""SELECT (SELECT count(*) FROM deg) AS n_nodes, count(*) AS n_edges,
       CASE WHEN (SELECT count(*) FROM deg) > 0 THEN count(*) * 2.0 / (SELECT count(*) FROM deg) ELSE 0.0 END AS average_degree,
       CASE WHEN (SELECT count(*) FROM deg) > 1 THEN count(*) / ((SELECT count(*) FROM deg) * ((SELECT count(*) FROM deg) - 1.0)) ELSE 0.0 END AS density,
       count(CASE WHEN max_score >= {NET_THR} THEN 1 END) AS num_fraud_edges,
       round(coalesce(sum(total_amount), 0.0), 6) AS total_amount, CAST({NET_THR} AS DOUBLE) AS score_threshold_used,
       '{NET_SCORE}' AS score_column_used,
       (SELECT count(DISTINCT component) FROM comp) AS n_connected_components FROM ed"""


def _metrics_out(df):
    return df.select("n_nodes", "n_edges", "average_degree", "density", "num_fraud_edges", r6("total_amount"),
                     "score_threshold_used", "score_column_used", "n_connected_components")


@register("q_n12_network_metrics", _net_sql_with_comp(_METRICS_SQL))
def q_n12(spark, sf_dir):
    net = N.transaction_network(scored_table(spark, sf_dir), NET_SCORE, NET_THR, limit=None)
    return _metrics_out(net.metrics)


@register("q_n13_components", _net_sql_with_comp("SELECT node, component FROM comp"))
def q_n13(spark, sf_dir):
    """Components need only the account pairs: the cleaned table (same rows as
    the scored one) without the scoring work."""
    from riskweave.operators.components import connected_components
    ep = N.resolve_endpoints(C.clean(fixtures.txn(spark, sf_dir)), None)
    return connected_components(ep.select("src", "dst").distinct(), "src", "dst")


@register("q_n14_top_hubs", _net_sql("SELECT * FROM deg ORDER BY degree DESC, account LIMIT 10"))
def q_n14(spark, sf_dir):
    return N.top_hubs(N.degrees(N.edges(_ep(spark, sf_dir))), 10)


@register("q_n15_flow_roles", _net_sql("""SELECT account, role, in_degree, out_degree, degree,
       CAST(row_number() OVER (PARTITION BY role ORDER BY degree DESC, account) AS BIGINT) AS role_position,
       CAST(CASE role WHEN 'source' THEN -1.0 WHEN 'sink' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS x,
       round(CASE WHEN count(*) OVER (PARTITION BY role) <= 1 THEN 0.0
            ELSE (row_number() OVER (PARTITION BY role ORDER BY degree DESC, account) - 1)
                 / (count(*) OVER (PARTITION BY role) - 1) * 2.0 - 1.0 END, 9) AS y
FROM (SELECT *, CASE WHEN out_degree > in_degree THEN 'source' WHEN out_degree < in_degree THEN 'sink'
                     ELSE 'middle' END AS role FROM deg) d"""))
def q_n15(spark, sf_dir):
    fr = N.flow_roles(N.degrees(N.edges(_ep(spark, sf_dir))))
    return fr.select("account", "role", "in_degree", "out_degree", "degree", "role_position", "x",
                     F.round("y", 9).alias("y"))


def _sel_net_sql(body: str) -> str:
    return _net_sql_with_comp(body, source="sel")


@register("q_n16_transaction_network", _sel_net_sql(_METRICS_SQL))
def q_n16(spark, sf_dir):
    net = N.transaction_network(scored_table(spark, sf_dir), NET_SCORE, NET_THR, limit=NET_LIMIT)
    return _metrics_out(net.metrics)


_SUMMARY_SQL = _METRICS_SQL.replace("SELECT (SELECT", f"""SELECT (SELECT string_agg(account || ':' || degree || ':' || in_degree || ':' || out_degree, ',' ORDER BY degree DESC, account)
         FROM (SELECT * FROM deg ORDER BY degree DESC, account LIMIT 10) h) AS hubs,
       (SELECT count(*) FROM sel) AS selected_total, (SELECT count(*) FROM sel_f) AS selected_fraud,
       (SELECT count(*) FROM sel) - (SELECT count(*) FROM sel_f) AS selected_context,
       (SELECT count(*) FROM scored) AS total_transactions_in_df, (SELECT c FROM nf) AS flagged_transactions_in_df, (SELECT""", 1)


@register("q_n16_network_summary", _sel_net_sql(_SUMMARY_SQL))
def q_n16_summary(spark, sf_dir):
    """The summary beside the drawn network: metrics, hubs and what was selected of how much."""
    m = N.transaction_network(scored_table(spark, sf_dir), NET_SCORE, NET_THR, limit=NET_LIMIT).metrics
    hubs = F.array_join(F.transform("top_hubs", lambda h: F.concat_ws(":", h["account_id"], h["degree"], h["in_degree"], h["out_degree"])), ",")
    counts = ["selected_total", "selected_fraud", "selected_context", "total_transactions_in_df", "flagged_transactions_in_df"]
    return m.select("n_nodes", "n_edges", "average_degree", "density", "num_fraud_edges", r6("total_amount"), "score_threshold_used",
                    "score_column_used", "n_connected_components", hubs.alias("hubs"), *counts)


# ---------------------------------------------------------------- models
import uuid  # noqa: E402

from riskweave.operators.models import autoencoder as AE  # noqa: E402
from riskweave.operators.models import iforest as IF  # noqa: E402
from riskweave.operators.models import thresholds as TH  # noqa: E402
from riskweave.operators.models.matrix import feature_matrix  # noqa: E402
from riskweave.operators.models.pca import fit_pca, pca_reconstruction_error  # noqa: E402
from riskweave.operators.models.scalers import fit_robust, fit_standard  # noqa: E402
from riskweave.session import ensure_checkpoint_dir, read_table  # noqa: E402

# F19 over the features table: amount + every numeric feature column.
MODEL_FEATURES = ["amount"] + [c for c in O.FEATURE_COLUMNS if c != "date"]


def scratch_dir(spark) -> str:
    """A fresh folder under the session's shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskweave-{uuid.uuid4().hex[:12]}"


@register("q_m1_feature_matrix", O.features_query(
    "SELECT transaction_id, " + str(len(MODEL_FEATURES)) + " AS n_features, round(" +
    " + ".join(f"CAST({c} AS DOUBLE)" for c in MODEL_FEATURES) + ", 6) AS feature_sum FROM feat"))
def q_m1(spark, sf_dir):
    m = feature_matrix(features_table(spark, sf_dir), MODEL_FEATURES, keep=["transaction_id"])
    return m.select("transaction_id", F.size("x").alias("n_features"),
                    F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 6).alias("feature_sum"))


def _scaler_sql(kind: str) -> str:
    parts = []
    for c in MODEL_FEATURES:
        if kind == "robust":
            parts.append(f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.5), 6) AS center, "
                         f"round(CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 THEN 1.0 "
                         f"ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END, 6) AS scale FROM feat")
        else:
            parts.append(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS center, "
                         f"round(CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1.0 ELSE stddev_pop({c}) END, 6) "
                         f"AS scale FROM feat")
    return O.features_query(" UNION ALL ".join(parts))


def _scaler_frame(spark, sc):
    return spark.createDataFrame(sc.to_rows(), "feature string, center double, scale double") \
        .select("feature", r6("center"), r6("scale"))


@register("q_m2_robust_scale", _scaler_sql("robust"))
def q_m2(spark, sf_dir):
    return _scaler_frame(spark, fit_robust(_features_once(spark, sf_dir), MODEL_FEATURES))


_X1_COLUMNS = ("amount", "hour", "near_threshold", "small_txn_count_per_day", "enhanced_aml_score")
_X1_RANKS = (0.0, 0.001, 0.25, 0.5, 0.99, 1.0)


def _x1_sql() -> str:
    return O.features_query(" UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({q!r} AS DOUBLE) AS rank, round(quantile_cont(CAST({c} AS DOUBLE), {q!r}), 9) AS value FROM feat"
        for c in _X1_COLUMNS for q in _X1_RANKS))


def _x1(spark, sf_dir, **kw):
    from riskweave.functions.quantile import exact_quantiles
    got = exact_quantiles(_features_once(spark, sf_dir), list(_X1_COLUMNS), list(_X1_RANKS), **kw)
    return spark.createDataFrame([(c, q, round(v, 9)) for c, vs in got.items() for q, v in zip(_X1_RANKS, vs)],
                                 "feature string, rank double, value double")


@register("q_x1_exact_quantiles", _x1_sql())
def q_x1(spark, sf_dir):
    return _x1(spark, sf_dir)


@register("q_x1_exact_quantiles_ranked", _x1_sql())
def q_x1_ranked(spark, sf_dir):
    """No value comes to the driver but those asked for: brackets are written and ranked in Spark."""
    return _x1(spark, sf_dir, bracket_limit=0)


@register("q_m3_standard_scale", _scaler_sql("standard"))
def q_m3(spark, sf_dir):
    return _scaler_frame(spark, fit_standard(_features_once(spark, sf_dir), MODEL_FEATURES))


def _features_once(spark, sf_dir):
    """Model queries read the feature table several times (scaler fit, matrix,
    scoring): materialise it once."""
    from riskweave.session import cut_lineage
    return cut_lineage(features_table(spark, sf_dir))


def _txn_matrix(spark, sf_dir):
    from riskweave.session import cut_lineage
    feat = _features_once(spark, sf_dir)
    sc = fit_robust(feat, MODEL_FEATURES)
    return cut_lineage(sc.transform(feat, keep=["transaction_id"])), sc


TREES = 1000                # as the trainer has it
NATIVE_TREES = 100          # the walk without Python costs about 50 times the CPU


@register("q_m4_iforest_fit", O.forest_query(
    "SELECT CAST(tree AS INTEGER) AS tree, count(*) AS n_nodes, count(*) FILTER (WHERE f IS NULL) AS n_leaves, "
    "CAST(max(depth) AS INTEGER) AS max_depth, CAST(max(n) AS INTEGER) AS root_size, "
    "CAST(sum(pos) AS BIGINT) AS sum_pos, CAST(sum(f - 1) AS BIGINT) AS sum_feature FROM nodes GROUP BY tree", MODEL_FEATURES, TREES))
def q_m4(spark, sf_dir):
    """Tree shapes and splits of a forest on the transaction features."""
    x, _ = _txn_matrix(spark, sf_dir)
    m = IF.fit_isolation_forest(x, "transaction_id", n_trees=TREES)
    nodes = spark.createDataFrame(m.nodes, IF.NODE_SCHEMA)
    split = F.col("feature") >= 0
    return nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n_nodes"), F.count(F.when(~split, 1)).alias("n_leaves"),
                                     F.max("depth").alias("max_depth"), F.max("size").alias("root_size"),
                                     F.sum("node").alias("sum_pos"), F.sum(F.when(split, F.col("feature"))).alias("sum_feature"))


def _forest_scores(spark, sf_dir, n_trees, method):
    x, _ = _txn_matrix(spark, sf_dir)
    m = IF.fit_isolation_forest(x, "transaction_id", n_trees=n_trees)
    scored = IF.score_isolation_forest(m, x, method=method)
    return scored.select("transaction_id", F.round("native_score", 9).alias("native_score"))


_WALKED = "SELECT transaction_id, round(native_score, 9) AS native_score FROM walked"


@register("q_m5_iforest_score", O.forest_query(_WALKED, MODEL_FEATURES, TREES))
def q_m5(spark, sf_dir):
    return _forest_scores(spark, sf_dir, TREES, "arrow")


@register("q_m5_iforest_score_native", O.forest_query(_WALKED, MODEL_FEATURES, NATIVE_TREES))
def q_m5_native(spark, sf_dir):
    return _forest_scores(spark, sf_dir, NATIVE_TREES, "native")


@register("q_m6_contamination_threshold", _sc(
    "SELECT round(quantile_cont(native_score, 0.99), 9) AS threshold FROM scored"))
def q_m6(spark, sf_dir):
    thr = TH.contamination_threshold(scored_table(spark, sf_dir), "native_score", 0.01)
    return spark.createDataFrame([(round(thr, 9),)], "threshold double")


@register("q_m7_calibrate_threshold", _sc(
    "SELECT round(quantile_cont(native_score, 0.95), 9) AS threshold, 'calibration' AS threshold_source, "
    "0.05 AS threshold_rate FROM scored".replace("0.05 AS", "CAST(0.05 AS DOUBLE) AS")))
def q_m7(spark, sf_dir):
    thr, md = TH.calibrate_threshold(scored_table(spark, sf_dir), "native_score", 0.05, 0.01)
    return spark.createDataFrame([(round(thr, 9), md["threshold_source"], md["threshold_rate"])],
                                 "threshold double, threshold_source string, threshold_rate double")


@register("q_m8_minmax_score_label", _sc(
    "SELECT transaction_id, round((native_score - mn) / (mx - mn), 9) AS ui_score, "
    "CAST(native_score >= cut AS INTEGER) AS label FROM scored CROSS JOIN "
    "(SELECT min(native_score) AS mn, max(native_score) AS mx, quantile_cont(native_score, 0.99) AS cut FROM scored) m"))
def q_m8(spark, sf_dir):
    out = TH.minmax_score_label(scored_table(spark, sf_dir), "native_score", None, 0.01)
    return out.select("transaction_id", F.round("ui_score", 9).alias("ui_score"), "label")


def _emb_matrix(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    dim = len(emb.select("embedding").first()[0])
    flat = emb.select("vec_id", *[F.col("embedding")[i].alias(f"e{i}") for i in range(dim)])
    sc = fit_robust(flat, [f"e{i}" for i in range(dim)])
    from riskweave.session import cut_lineage
    return cut_lineage(sc.transform(flat, keep=["vec_id"])), sc


@register("q_m9_autoencoder_fit")
def q_m9(spark, sf_dir):
    """Training history with the trainer's settings, on the transaction features."""
    x, _ = _txn_matrix(spark, sf_dir)
    m = AE.fit_autoencoder(x, "transaction_id")
    return spark.createDataFrame([(h["epoch"], round(h["loss"], 6), round(h["val_loss"], 6), h["lr"]) for h in m.history],
                                 "epoch int, loss double, val_loss double, lr double")


@register("q_m10_reconstruction_error")
def q_m10(spark, sf_dir):
    x, _ = _txn_matrix(spark, sf_dir)
    m = AE.fit_autoencoder(x, "transaction_id")
    return AE.reconstruction_error(m, x).select("transaction_id", F.round("native_score", 9).alias("native_score"))


@register("q_m11_pca_reconstruction")
def q_m11(spark, sf_dir):
    x, _ = _emb_matrix(spark, sf_dir)
    m = fit_pca(x, "x", 8)
    return pca_reconstruction_error(m, x).select("vec_id", F.round("native_score", 9).alias("native_score"))


def _train(spark, sf_dir, types=("isolation_forest", "pca")):
    from riskweave.operators.models.training import train_models
    feat = _features_once(spark, sf_dir)
    d = scratch_dir(spark)
    paths = train_models(feat, list(types), d, 0.01, features=MODEL_FEATURES,
                         hyper={"pca": {"k": 8}})
    return feat, d, paths


@register("q_m12_save_load_model", O.features_query(
    "SELECT count(*) AS n_rows, CAST(0 AS DOUBLE) AS max_abs_diff FROM feat"))
def q_m12(spark, sf_dir):
    """Scores of the saved-and-reloaded forest equal the in-memory ones."""
    from riskweave.operators.models.artifacts import load_model, model_metadata, save_model
    x, sc = _txn_matrix(spark, sf_dir)
    m = IF.fit_isolation_forest(x, "transaction_id", n_trees=TREES)
    path = scratch_dir(spark) + "/model_isolation_forest"
    save_model(spark, path, m, sc, model_metadata("IsolationForest", sc, None, 0, m.params, 0.01))
    m2, sc2, md = load_model(spark, path)
    a = IF.score_isolation_forest(m, x).select("transaction_id", F.col("native_score").alias("a"))
    b = IF.score_isolation_forest(m2, sc2.transform(_features_once(spark, sf_dir), keep=["transaction_id"])) \
        .select("transaction_id", F.col("native_score").alias("b"))
    return a.join(b, "transaction_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                           F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs_diff"))


_MODELS = {"IsolationForest": "isolation_forest", "PCA": "pca", "Autoencoder": "autoencoder"}


@register("q_m14_train_models", O.forest_query(" UNION ALL ".join(
    f"SELECT '{kind}' AS model_type, CAST({len(MODEL_FEATURES)} AS INTEGER) AS n_features, (SELECT count(*) FROM feat) AS n_samples, "
    f"CAST(0.01 AS DOUBLE) AS contamination, "
    + ("(SELECT round(quantile_cont(native_score, 0.99), 9) FROM walked)" if kind == "IsolationForest" else "CAST(NULL AS DOUBLE)")
    + " AS forest_threshold" for kind in _MODELS), MODEL_FEATURES, TREES))
def q_m14(spark, sf_dir):
    """The trainer's models with its settings; SQL grows the forest again and has its threshold."""
    from riskweave.operators.models.artifacts import model_registry
    _, d, _ = _train(spark, sf_dir, list(_MODELS.values()))
    thr = F.when(F.col("model_type") == "IsolationForest", F.round("threshold", 9))
    return model_registry(spark, d).select("model_type", "n_features", "n_samples", "contamination", thr.alias("forest_threshold"))


@register("q_m7_calibrate_model", O.forest_query(
    "SELECT transaction_id, round(native_score, 9) AS native_score, anomaly_label, is_flagged FROM scored",
    MODEL_FEATURES, TREES, scored=True, cfg=with_config(contamination=0.05)))
def q_m7_model(spark, sf_dir):
    """A trained forest calibrated to flag one payment in twenty: the artifact's threshold changes, and with it the labels."""
    from riskweave.operators.models.training import calibrate_model
    from riskweave.plans.scoring import score_transactions
    feat, _, paths = _train(spark, sf_dir, ("isolation_forest",))
    calibrate_model(spark, paths["isolation_forest"], feat, 0.05)
    scored, _ = score_transactions(spark, paths["isolation_forest"], feat, "native")
    return scored.select("transaction_id", F.round("native_score", 9).alias("native_score"), "anomaly_label", "is_flagged")


@register("q_m15_retrain", O.features_query(
    f"SELECT 'IsolationForest' AS model_type, CAST({len(MODEL_FEATURES) - 1} AS INTEGER) AS n_features, "
    f"count(*) AS n_samples, CAST({TREES} AS INTEGER) AS n_estimators FROM feat"))
def q_m15(spark, sf_dir):
    from riskweave.operators.models.artifacts import load_metadata
    from riskweave.operators.models.training import retrain
    feat, _, paths = _train(spark, sf_dir, ("isolation_forest",))
    new = retrain(spark, paths["isolation_forest"], feat.drop("year"), 0.01)
    md = load_metadata(spark, new)
    return spark.createDataFrame([(md["model_type"], md["n_features"], md["n_samples"], md["n_estimators"])],
                                 "model_type string, n_features int, n_samples bigint, n_estimators int")


@register("q_a8_score_transactions", O.forest_query(
    "SELECT transaction_id, round(native_score, 9) AS native_score, round(aml_score, 9) AS aml_score, "
    + ", ".join(A.SCORE_COLUMNS[2:]) + " FROM scored", MODEL_FEATURES, TREES, scored=True))
def q_a8(spark, sf_dir):
    from riskweave.plans.scoring import score_transactions
    feat, _, paths = _train(spark, sf_dir, ("isolation_forest",))
    scored, _ = score_transactions(spark, paths["isolation_forest"], feat, "native")
    return scored.select("transaction_id", F.round("native_score", 9).alias("native_score"),
                         F.round("aml_score", 9).alias("aml_score"), *A.SCORE_COLUMNS[2:])


# ---------------------------------------------------------------- sources and sinks
@register("q_s1_read_transactions", O.with_chain(O.txn_raw_cte(), body="SELECT * FROM txn_raw"))
def q_s1(spark, sf_dir):
    """Round trip of the raw upload through CSV text (header row, text columns)."""
    from riskweave.sources.readers import read_transactions
    path = scratch_dir(spark) + "/upload.csv"
    (fixtures.txn_raw(spark, sf_dir).write.option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return read_transactions(spark, path, "csv")


def _report_sql() -> str:
    m = resolve_mapping([c for c in FEED_HEADERS])
    rows = " UNION ALL ".join(
        f"SELECT '{canon}' AS canonical, {str(canon in REQUIRED_COLUMNS).lower()} AS required, "
        + (f"'{raw}' AS mapped_column, 100.0::DOUBLE AS confidence_pct, count(CASE WHEN trim({raw}) <> '' THEN 1 END) AS n_values"
           if raw else "NULL AS mapped_column, 0.0::DOUBLE AS confidence_pct, 0 AS n_values")
        + ", count(*) AS n_rows FROM txn_raw" for canon, raw in m.columns.items())
    return O.with_chain(O.txn_raw_cte(), body=rows)


@register("q_s14_mapping_report", _report_sql())
def q_s14(spark, sf_dir):
    """The upload's mapping (all its headers are known ones) with how far each mapped column is filled."""
    from riskweave.sources.mapping import mapping_report
    raw = fixtures.txn_raw(spark, sf_dir)
    report = mapping_report(spark, resolve_mapping(raw.columns), raw.columns, df=raw)
    return report.select("canonical", "required", "mapped_column", "confidence_pct", "n_values", "n_rows")


_EXPORT_COLS = [c for c in list(O.TXN_COLUMNS) + list(O.FEATURE_COLUMNS) + list(A.SCORE_COLUMNS) if c != "timestamp"]


def _export_sql(where: str = "", drop=()) -> str:
    cols = [f'"{c}"' for c in _EXPORT_COLS if c not in drop]
    return _sc(f"SELECT {', '.join(cols)}, {TS_SQL} FROM scored {where}")


def _export(spark, sf_dir, mode):
    """Written by the sink and read back."""
    from riskweave.sources.sinks import export
    path = scratch_dir(spark) + "/export"
    export(scored_table(spark, sf_dir), path, mode, "parquet")
    out = spark.read.parquet(path)
    return out.select(*[c for c in out.columns if c != "timestamp"], ts_text())


@register("q_s15_export_all", _export_sql())
def q_s15a(spark, sf_dir):
    return _export(spark, sf_dir, "all")


@register("q_s15_export_flagged", _export_sql("WHERE is_flagged = 1"))
def q_s15f(spark, sf_dir):
    return _export(spark, sf_dir, "flagged")


@register("q_s15_export_original", _export_sql(drop=("aml_score", "anomaly_label", "is_flagged", "enhanced_aml_score")))
def q_s15o(spark, sf_dir):
    return _export(spark, sf_dir, "original")
