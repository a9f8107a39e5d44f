"""ANSI/DuckDB SQL equivalents of the catalog queries (the correctness oracle).

Texts are CTE chains over the driver's tables: fixture -> clean -> features ->
scored, generated from the same ``RiskConfig`` as the Spark plans.
"""

from __future__ import annotations

from riskweave.config import DEFAULT_CONFIG, RiskConfig
from riskweave.sources.fixtures import COUNTRY_LIST


def _lst(codes) -> str:
    return ", ".join(f"'{c}'" for c in codes)


def txn_cte() -> str:
    return f"""txn AS (
  SELECT e.event_id AS transaction_id, e.value * 60 AS amount, e.user_id AS sender_id,
         s.s_suppkey AS receiver_id, c.c_mktsegment AS sender_bank,
         CASE WHEN e.event_id % 250 = 0 THEN concat('BANK_R', CAST(e.event_id AS VARCHAR))
              ELSE concat('BANK_', CAST(s.s_suppkey % 7 AS VARCHAR)) END AS receiver_bank,
         split_part('{COUNTRY_LIST}', ',', CAST(c.c_nationkey + 1 AS INTEGER)) AS sender_country,
         split_part('{COUNTRY_LIST}', ',', CAST(s.s_nationkey + 1 AS INTEGER)) AS receiver_country,
         e.ts AS "timestamp", e.event_type AS transaction_type, 'EUR' AS currency
  FROM (SELECT v.*, k.n FROM events v CROSS JOIN (SELECT count(*) AS n FROM supplier) k) e
  JOIN customer c ON c.c_custkey = e.user_id
  JOIN supplier s ON s.s_suppkey = (e.event_id * 37 + e.user_id) % e.n)"""


_RAW_SELECT = """CAST(event_id AS VARCHAR) AS tx_id,
       CASE WHEN event_id % 97 = 0 THEN 'n/a'
            WHEN event_id % 89 = 0 THEN concat('-', CAST(CAST(floor(value * 60) AS BIGINT) AS VARCHAR))
            ELSE CAST(CAST(floor(value * 60) AS BIGINT) AS VARCHAR) END AS shuma_e_transaksionit,
       CASE WHEN event_id % 101 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS id_i_llogarise_se_derguesit,
       CAST((event_id * 37 + user_id) % 10 AS VARCHAR) AS id_i_llogarise_se_perfituesit,
       CASE WHEN event_id % 53 = 0 THEN NULL ELSE 'banka a' END AS banka_derguese,
       CASE WHEN event_id % 3 = 0 THEN ' xk ' WHEN event_id % 59 = 0 THEN NULL ELSE 'NA' END AS lokacioni_i_derguesit,
       'de' AS lokacioni_i_perfituesit,
       CASE WHEN event_id % 103 = 0 THEN 'bad-date' ELSE CAST(date_trunc('second', ts) AS VARCHAR) END AS data_transaksionit,
       CASE WHEN event_id % 61 = 0 THEN NULL ELSE event_type END AS tx_type"""


def txn_raw_cte() -> str:
    return f"""txn_raw AS (
  SELECT {_RAW_SELECT} FROM events
  UNION ALL
  SELECT {_RAW_SELECT} FROM events WHERE event_id % 50 = 0)"""


RAW_MAPPED_CTE = """mapped AS (
  SELECT tx_id AS transaction_id, shuma_e_transaksionit AS amount,
         id_i_llogarise_se_derguesit AS sender_id, id_i_llogarise_se_perfituesit AS receiver_id,
         banka_derguese AS sender_bank, lokacioni_i_derguesit AS sender_country,
         lokacioni_i_perfituesit AS receiver_country, data_transaksionit AS "timestamp",
         tx_type AS transaction_type
  FROM txn_raw)"""
RAW_MAPPED_COLUMNS = ("transaction_id", "amount", "sender_id", "receiver_id", "sender_bank",
                      "sender_country", "receiver_country", "timestamp", "transaction_type")

_FILL = {"sender_bank": "''", "receiver_bank": "''", "sender_country": "''", "receiver_country": "''",
         "transaction_type": "'Unknown'", "currency": "'EUR'"}


def typed_select(cols, amount_text: bool, ts_text: bool) -> str:
    out = []
    for c in cols:
        q = f'"{c}"'
        if c == "amount" and amount_text:
            out.append(f"TRY_CAST(amount AS DOUBLE) AS amount")
        elif c == "timestamp" and ts_text:
            out.append(f'TRY_CAST("timestamp" AS TIMESTAMP) AS "timestamp"')
        else:
            out.append(q)
    return ", ".join(out)


def normalized_select(cols) -> str:
    out = []
    for c in cols:
        if c in ("sender_country", "receiver_country"):
            out.append(f"coalesce(upper(trim(CAST({c} AS VARCHAR))), '') AS {c}")
        elif c in _FILL:
            out.append(f"coalesce(CAST({c} AS VARCHAR), {_FILL[c]}) AS {c}")
        else:
            out.append(f'"{c}"')
    return ", ".join(out)


def clean_ctes(src: str, cols, amount_text: bool = False, ts_text: bool = False) -> str:
    """c1 (amount), c2 (timestamp), c3 (distinct), c4 (parties), cl (normalised + filled)."""
    cols = list(cols)
    parties = ("WHERE sender_id IS NOT NULL AND receiver_id IS NOT NULL"
               if "sender_id" in cols and "receiver_id" in cols else "")
    return f"""c2 AS (SELECT {typed_select(cols, amount_text, ts_text)} FROM {src}),
c1 AS (SELECT * FROM c2 WHERE amount > 0 AND NOT isnan(amount)),
c3 AS (SELECT DISTINCT * FROM c1),
c4 AS (SELECT * FROM c3 {parties}),
cl AS (SELECT {normalized_select(cols)} FROM c4)"""


FEATURE_COLUMNS = (
    "hour", "day", "month", "year", "dayofweek", "date",
    "high_risk_sender", "high_risk_receiver", "is_high_risk_drug_country_receiver",
    "near_threshold", "small_transaction", "small_txn_count_per_day", "structuring_flag",
    "high_risk_transfers_per_day", "multiple_high_risk_transfers",
    "sender_bank_count", "receiver_bank_count", "rare_sender_bank_combo",
    "rare_receiver_bank_combo", "rare_bank_combo_flag", "midnight_transaction",
    "high_cashflow_flag_acct_total", "high_cashflow_midnight",
    "unique_receiver_locations_per_day", "transaksione_ne_lokacione_ndryshe",
    "unique_senders_per_day", "multiple_senders_same_receiver", "enhanced_aml_score",
    "definite_fraud_flag", "high_risk_country_transaction",
    "high_risk_drug_country_transaction", "threshold_risk_transaction",
)
TXN_COLUMNS = ("transaction_id", "amount", "sender_id", "receiver_id", "sender_bank", "receiver_bank",
               "sender_country", "receiver_country", "timestamp", "transaction_type", "currency")


def feature_ctes(cfg: RiskConfig = DEFAULT_CONFIG, base_cols=TXN_COLUMNS) -> str:
    """f0..f2 and feat over ``cl`` (all canonical columns present)."""
    lo, hi = cfg.near_threshold_floor, float(cfg.reporting_threshold)
    hr, dr = _lst(cfg.high_risk_countries), _lst(cfg.high_risk_drug_countries)
    s, e = int(cfg.midnight_start_hour), int(cfg.midnight_end_hour)
    w = cfg.weights()
    score = " + ".join(f"{c} * {float(v)!r}" for c, v in w.items())
    base = ", ".join(f'"{c}"' for c in base_cols)
    return f"""f0 AS (
  SELECT *, CAST(coalesce(hour("timestamp"), 12) AS INTEGER) AS hour,
         CAST(day("timestamp") AS INTEGER) AS day, CAST(month("timestamp") AS INTEGER) AS month,
         CAST(year("timestamp") AS INTEGER) AS year, CAST(isodow("timestamp") - 1 AS INTEGER) AS dayofweek,
         CAST("timestamp" AS DATE) AS date,
         CAST(coalesce(sender_country IN ({hr}), false) AS INTEGER) AS high_risk_sender,
         CAST(coalesce(receiver_country IN ({hr}), false) AS INTEGER) AS high_risk_receiver,
         CAST(coalesce(receiver_country IN ({dr}), false) AS INTEGER) AS is_high_risk_drug_country_receiver,
         CAST(coalesce(amount BETWEEN {lo!r} AND {hi!r}, false) AS INTEGER) AS near_threshold,
         CAST(coalesce(amount < {lo!r}, false) AS INTEGER) AS small_transaction
  FROM cl),
sd AS (SELECT sender_id, date, sum(small_transaction) AS a1, sum(is_high_risk_drug_country_receiver) AS a2,
              count(DISTINCT receiver_country) AS a3
       FROM f0 WHERE date IS NOT NULL GROUP BY sender_id, date),
rd AS (SELECT receiver_id, date, count(DISTINCT sender_id) AS a4
       FROM f0 WHERE date IS NOT NULL AND sender_id IS NOT NULL GROUP BY receiver_id, date),
sb AS (SELECT sender_country, sender_bank, count(*) AS a5 FROM f0 GROUP BY sender_country, sender_bank),
rb AS (SELECT receiver_country, receiver_bank, count(*) AS a6 FROM f0 GROUP BY receiver_country, receiver_bank),
qa AS (SELECT quantile_cont(amount, {float(cfg.high_amount_percentile)!r}) AS thr FROM f0),
f1 AS (
  SELECT f0.*, CAST(coalesce(sd.a1, 0) AS BIGINT) AS small_txn_count_per_day,
         CAST(coalesce(sd.a2, 0) AS BIGINT) AS high_risk_transfers_per_day,
         CAST(coalesce(sd.a3, 0) AS BIGINT) AS unique_receiver_locations_per_day,
         CAST(coalesce(rd.a4, 0) AS BIGINT) AS unique_senders_per_day,
         CAST(coalesce(sb.a5, 0) AS BIGINT) AS sender_bank_count,
         CAST(coalesce(rb.a6, 0) AS BIGINT) AS receiver_bank_count,
         CAST(hour BETWEEN {s} AND {e} AS INTEGER) AS midnight_transaction,
         CAST(coalesce(amount >= qa.thr, false) AS INTEGER) AS high_cashflow_flag_acct_total
  FROM f0
  LEFT JOIN sd ON f0.sender_id = sd.sender_id AND f0.date = sd.date
  LEFT JOIN rd ON f0.receiver_id = rd.receiver_id AND f0.date = rd.date
  LEFT JOIN sb ON f0.sender_country = sb.sender_country AND f0.sender_bank = sb.sender_bank
  LEFT JOIN rb ON f0.receiver_country = rb.receiver_country AND f0.receiver_bank = rb.receiver_bank
  CROSS JOIN qa),
f2 AS (
  SELECT *, CAST(small_txn_count_per_day >= {int(cfg.structuring_min_count)} AS INTEGER) AS structuring_flag,
         CAST(high_risk_transfers_per_day >= 2 AS INTEGER) AS multiple_high_risk_transfers,
         CAST(sender_bank_count < {int(cfg.rare_bank_min_count)} AS INTEGER) AS rare_sender_bank_combo,
         CAST(receiver_bank_count < {int(cfg.rare_bank_min_count)} AS INTEGER) AS rare_receiver_bank_combo,
         CAST(sender_bank_count < {int(cfg.rare_bank_min_count)} OR receiver_bank_count < {int(cfg.rare_bank_min_count)} AS INTEGER) AS rare_bank_combo_flag,
         CAST(high_cashflow_flag_acct_total = 1 AND midnight_transaction = 1 AS INTEGER) AS high_cashflow_midnight,
         CAST(unique_receiver_locations_per_day > 1 AS INTEGER) AS transaksione_ne_lokacione_ndryshe,
         CAST(unique_senders_per_day > 1 AS INTEGER) AS multiple_senders_same_receiver
  FROM f1),
feat AS (
  SELECT {base}, {", ".join(c for c in FEATURE_COLUMNS if c not in ("enhanced_aml_score", "definite_fraud_flag", "high_risk_country_transaction", "high_risk_drug_country_transaction", "threshold_risk_transaction"))},
         CAST({score} AS DOUBLE) AS enhanced_aml_score,
         CAST((high_risk_sender = 1 OR high_risk_receiver = 1) AND near_threshold = 1 AND midnight_transaction = 1 AS INTEGER) AS definite_fraud_flag,
         CAST(high_risk_sender = 1 OR high_risk_receiver = 1 AS INTEGER) AS high_risk_country_transaction,
         CAST(is_high_risk_drug_country_receiver = 1 AS INTEGER) AS high_risk_drug_country_transaction,
         CAST(near_threshold = 1 AS INTEGER) AS threshold_risk_transaction
  FROM f2)"""


def scored_ctes(contamination: float = 0.01, native: str | None = None) -> str:
    """Native score (the surrogate, or table ``native`` of feat's rows with a native_score), percentile score,
    policy label and final flags."""
    source = f"SELECT * FROM {native}" if native else "SELECT feat.*, amount / (1 + amount) AS native_score FROM feat"
    return f"""s0 AS ({source}),
s1 AS (SELECT s0.*, CASE WHEN count(*) OVER () <= 1 THEN 0.0
              ELSE CAST(row_number() OVER (ORDER BY native_score, transaction_id) - 1 AS DOUBLE)
                   / (count(*) OVER () - 1) END AS aml_score FROM s0),
qn AS (SELECT quantile_cont(native_score, {1.0 - float(contamination)!r}) AS cut FROM s0),
s2 AS (SELECT s1.*, CAST(coalesce(native_score >= qn.cut, false) AS INTEGER) AS anomaly_label,
              CAST(enhanced_aml_score >= 6.0 AS INTEGER) AS flagged_by_enhanced,
              CAST(high_risk_sender + high_risk_receiver + is_high_risk_drug_country_receiver
                   + high_cashflow_flag_acct_total AS INTEGER) AS high_weight_indicator_count
       FROM s1 CROSS JOIN qn),
scored AS (SELECT s2.*, anomaly_label AS flagged_by_model,
                  CAST(high_weight_indicator_count >= 2 AS INTEGER) AS flagged_by_indicators,
                  CAST(flagged_by_enhanced = 1 OR high_weight_indicator_count >= 2 OR anomaly_label = 1 AS INTEGER) AS is_flagged
           FROM s2)"""


def _draw(*key: str) -> str:
    """The hash draw of the forest: 52 bits of the md5 of the key, in [0, 1)."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(key)})), 1, 13))::BIGINT / 4503599627370496::DOUBLE"


def forest_ctes(features, n_trees: int, psi: int = 256, seed: int = 42) -> str:
    """An isolation forest grown over ``feat`` level by level: ``nodes`` (tree, pos, f, thr, n, depth; f null in leaves),
    and ``walked`` (transaction_id, native_score). Unscaled features: centre and scale move no row to the other side."""
    x = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0)" for c in features)
    lo = ", ".join(f"min(x[{k}])" for k in range(1, len(features) + 1))
    hi = lo.replace("min(", "max(")
    height = max(psi - 1, 1).bit_length()
    out = [f"""mx AS (SELECT transaction_id AS id, [{x}] AS x FROM feat),
pr AS (SELECT n, least({psi}, n) AS psi, greatest(1, least({n_trees}, n // least({psi}, n))) AS per FROM (SELECT count(*) AS n FROM mx)),
od AS (SELECT unnest(range(CAST(ceil({n_trees}::DOUBLE / per) AS BIGINT))) AS o FROM pr),
rk AS (SELECT o, id, x, row_number() OVER (PARTITION BY o ORDER BY md5(concat_ws(':', '{seed}', o, id)), id) - 1 AS r FROM mx CROSS JOIN od),
fl0 AS (SELECT o * per + r // psi AS tree, 0::BIGINT AS pos, x FROM rk CROSS JOIN pr WHERE r < per * psi AND o * per + r // psi < {n_trees})"""]
    for d in range(height + 1):
        out.append(f"""fg{d} AS (SELECT tree, pos, count(*) AS n, [{lo}] AS lo, [{hi}] AS hi FROM fl{d} GROUP BY tree, pos),
fv{d} AS (SELECT *, CASE WHEN n > 1 AND {d} < {height} THEN list_filter(range(1, {len(features) + 1}), lambda k: hi[k] > lo[k]) ELSE [] END AS vary FROM fg{d}),
fs{d} AS (SELECT *, vary[1 + CAST(floor({_draw(f"'{seed}'", "'f'", "tree", "pos")} * len(vary)) AS BIGINT)] AS f FROM fv{d}),
fn{d} AS (SELECT tree, pos, f, lo[f] + {_draw(f"'{seed}'", "'t'", "tree", "pos")} * (hi[f] - lo[f]) AS thr, n, {d} AS depth FROM fs{d})""")
        if d < height:
            out.append(f"fl{d + 1} AS (SELECT l.tree, 2 * l.pos + 1 + CAST(x[f] > thr AS BIGINT) AS pos, x "
                       f"FROM fl{d} l JOIN fn{d} USING (tree, pos) WHERE f IS NOT NULL)")
    out.append("nodes AS (" + " UNION ALL ".join(f"SELECT * FROM fn{d}" for d in range(height + 1)) + ")")
    out.append("leaf AS (SELECT tree, pos, round((depth + CASE WHEN n < 2 THEN 0 WHEN n = 2 THEN 1 ELSE 2 * (ln(n - 1) + 0.5772156649) "
               "- 2 * (n - 1) / n::DOUBLE END) * 4294967296) / 4294967296 AS h FROM nodes WHERE f IS NULL)")
    # from the root down: a row stands in a split until it reaches a leaf, which then stays
    step = f"SELECT id, x, t.tree, 0::BIGINT AS pos FROM mx CROSS JOIN (SELECT unnest(range({n_trees})) AS tree) t"
    for d in range(height):
        step = (f"SELECT id, x, w.tree, CASE WHEN n.f IS NULL THEN w.pos ELSE 2 * w.pos + 1 + CAST(x[n.f] > n.thr AS BIGINT) END AS pos "
                f"FROM ({step}) w LEFT JOIN fn{d} n ON n.tree = w.tree AND n.pos = w.pos")
    out.append(f"""ends AS (SELECT id, tree, pos FROM ({step})),
cp AS (SELECT CASE WHEN psi < 2 THEN 1 WHEN psi = 2 THEN 1 ELSE 2 * (ln(psi - 1) + 0.5772156649) - 2 * (psi - 1) / psi::DOUBLE END AS c FROM pr),
walked AS (SELECT id AS transaction_id, pow(2.0::DOUBLE, -(sum(h) / {float(n_trees)!r}::DOUBLE) / max(c)) AS native_score
           FROM ends JOIN leaf USING (tree, pos) CROSS JOIN cp GROUP BY id)""")
    return ",\n".join(out)


def forest_query(body: str, features, n_trees: int, scored: bool = False, cfg: RiskConfig = DEFAULT_CONFIG) -> str:
    more = ["nat AS (SELECT feat.*, walked.native_score FROM feat JOIN walked USING (transaction_id))",
            scored_ctes(cfg.contamination, "nat")] if scored else []
    return with_chain(txn_cte(), clean_ctes("txn", TXN_COLUMNS), feature_ctes(cfg), forest_ctes(features, n_trees), *more, body=body)


def with_chain(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def features_query(body: str, cfg: RiskConfig = DEFAULT_CONFIG) -> str:
    return with_chain(txn_cte(), clean_ctes("txn", TXN_COLUMNS), feature_ctes(cfg), body=body)


def scored_query(body: str, cfg: RiskConfig = DEFAULT_CONFIG) -> str:
    return with_chain(txn_cte(), clean_ctes("txn", TXN_COLUMNS), feature_ctes(cfg),
                      scored_ctes(cfg.contamination), body=body)


def raw_query(body: str) -> str:
    return with_chain(txn_raw_cte(), RAW_MAPPED_CTE,
                      clean_ctes("mapped", RAW_MAPPED_COLUMNS, amount_text=True, ts_text=True), body=body)
