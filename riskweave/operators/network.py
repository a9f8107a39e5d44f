"""Account network (N1-N16): directed account graph as edge and node tables.

Works on a bounded selection (the drawn subset, capped by ``limit``) or on the
whole table (``limit=None``). Everything is aggregation over edge ends, so a
hub account costs partial aggregates, not a single task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.keys import row_key, with_row_key
from riskweave.functions.rank import global_rank
from riskweave.functions.topk import top_k_per_group
from riskweave.operators.components import connected_components
from riskweave.session import cut_lineage

# Direct column names tried first, then keyword tokens.
SCORE_NAMES = ("enhanced_aml_score", "anomaly_score", "aml_score", "score")
SCORE_KEYWORDS = ("aml", "anomaly", "score")
SENDER_NAMES = ("sender_id", "id_i_llogarise_se_derguesit", "sender_account", "from_account", "sender")
SENDER_KEYWORDS = ("sender", "from", "dergues", "llogarise_se_derguesit")
RECEIVER_NAMES = ("receiver_id", "id_i_llogarise_se_perfituesit", "receiver_account", "to_account", "receiver")
RECEIVER_KEYWORDS = ("receiver", "to", "perfitues", "llogarise_se_perfituesit")
AMOUNT_NAMES = ("amount", "shuma", "transaction_amount", "value", "amt")
SENDER_BANK_NAMES = ("sender_bank", "banka_e_derguesit", "bank_sender", "from_bank", "banka_derguese")
RECEIVER_BANK_NAMES = ("receiver_bank", "banka_e_perfituesit", "bank_receiver", "to_bank", "banka_pranuese")
TXID_NAMES = ("transaction_id", "id_transaksioni", "id", "tx_id")
TS_NAMES = ("timestamp", "date", "transaction_date", "created_at")
# End of fixed values.
MAX_TX_PER_EDGE = 6


def guess_column(columns: list[str], direct, keywords=()) -> str | None:
    """First exact name, else first column that holds a keyword: of up to four
    letters as a whole token, longer ones at a token's beginning, several tokens
    anywhere in the name."""
    def holds(name: str, word: str) -> bool:
        tokens = name.split("_")
        if "_" in word:
            return word in name
        return word in tokens or (len(word) > 4 and any(t.startswith(word) for t in tokens))

    for c in direct:
        if c in columns:
            return c
    return next((c for c in columns if any(holds(str(c).lower(), k) for k in keywords)), None)


def account_column(columns: list[str], direct, keywords) -> str | None:
    """N1 for an account: banks and places of the same party are no account."""
    other = ("bank", "banka", "country", "lokacioni", "shteti", "details", "risk")
    return guess_column([c for c in columns if not set(str(c).lower().split("_")) & set(other)], direct, keywords)


def _score(df: DataFrame, score_col: str | None):
    return (F.coalesce(F.expr(f"try_cast(`{score_col}` AS double)"), F.lit(0.0))
            if score_col else F.lit(0.0))


# --- N2-N5: bounded selection -------------------------------------------------
@dataclass
class Selection:
    rows: DataFrame
    flagged: DataFrame
    context: DataFrame
    filler: DataFrame
    counts: DataFrame


def select_for_network(df: DataFrame, score_col: str | None, threshold: float, limit: int,
                       id_col: str = "transaction_id") -> Selection:
    """Flagged rows first (by score), then context rows, which share an
    account with a flagged row (by score, then amount), then the others by score;
    ties by id, ``limit`` rows in all.

    One top-k over a rank of the three kinds, written once. The flagged rows'
    accounts are only needed when fewer than ``limit`` rows are flagged, so at
    most 2 * ``limit`` accounts are broadcast."""
    df = with_row_key(df, id_col)
    snd, rcv = (account_column(df.columns, names, words) for names, words in
                ((SENDER_NAMES, SENDER_KEYWORDS), (RECEIVER_NAMES, RECEIVER_KEYWORDS)))
    amt_col = guess_column(df.columns, AMOUNT_NAMES, ("amount", "shuma", "amt", "value"))
    amount = F.coalesce(F.expr(f"try_cast(`{amt_col}` AS double)"), F.lit(0.0)) if amt_col else F.lit(0.0)
    t = df.withColumn("_score_num", _score(df, score_col))
    is_flagged = F.col("_score_num") >= threshold
    n_total, n_flag = t.agg(F.count(F.lit(1)), F.count(F.when(is_flagged, 1))).first()
    shares = F.lit(False)
    if snd and rcv and 0 < n_flag < limit:
        both = F.explode(F.array(F.col(snd).cast("string"), F.col(rcv).cast("string"))).alias("_account")
        accounts = t.where(is_flagged).select(both).where("_account IS NOT NULL").distinct()
        for side, col in (("_s", snd), ("_r", rcv)):
            known = accounts.select(F.col("_account").alias(side))
            t = t.join(F.broadcast(known), F.col(col).cast("string") == F.col(side), "left")
        shares = F.col("_s").isNotNull() | F.col("_r").isNotNull()
    part = F.when(is_flagged, "flagged").when(shares, "context").otherwise("filler")
    rank = F.when(is_flagged, 0).when(shares, 1).otherwise(2)
    rows = (t.withColumn("_part", part)
             .orderBy(rank, F.col("_score_num").desc(), F.when(F.col("_part") == "context", amount).desc(),
                      F.col(id_col).asc())
             .limit(max(limit, 0)).select(*df.columns, "_part"))
    rows = cut_lineage(rows)
    counts = rows.agg(F.count(F.lit(1)).alias("selected_total"),
                      F.count(F.when(F.col("_part") == "flagged", 1)).alias("selected_fraud"),
                      F.count(F.when(F.col("_part") != "flagged", 1)).alias("selected_context")) \
                 .select("*", F.lit(int(n_total)).cast("bigint").alias("total_transactions_in_df"),
                         F.lit(int(n_flag)).cast("bigint").alias("flagged_transactions_in_df"))
    kinds = [rows.where(F.col("_part") == k).drop("_part") for k in ("flagged", "context", "filler")]
    return Selection(rows.drop("_part"), *kinds, counts)


# --- N6-N11: edges and nodes --------------------------------------------------
def _first_present(df: DataFrame, names) -> list[str]:
    lower = {c.lower(): c for c in df.columns}
    return [lower[n.lower()] for n in names if n and n.lower() in lower]


def _text_coalesce(df: DataFrame, names):
    cols = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in _first_present(df, names)]
    return F.coalesce(*cols) if cols else F.lit(None).cast("string")


def resolve_endpoints(df: DataFrame, score_col: str | None = None, id_col: str = "transaction_id") -> DataFrame:
    """Per payment: src, dst (S_/R_ + id when blank), amount (bad -> 0),
    banks ('Unknown' when blank), score (null -> 0). Accounts are found by keyword
    where no known name is there; a payment without an id has a row key."""
    score_col = score_col or guess_column(df.columns, SCORE_NAMES)
    amt_cols = _first_present(df, AMOUNT_NAMES)
    amount = F.coalesce(F.expr(f"try_cast(`{amt_cols[0]}` AS double)"), F.lit(0.0)) if amt_cols else F.lit(0.0)
    senders, receivers = ([account_column(df.columns, (), words)] if not _first_present(df, names) else names
                          for names, words in ((SENDER_NAMES, SENDER_KEYWORDS), (RECEIVER_NAMES, RECEIVER_KEYWORDS)))
    ts_cols = _first_present(df, TS_NAMES)
    read = [c for names in (senders, receivers, SENDER_BANK_NAMES, RECEIVER_BANK_NAMES) for c in _first_present(df, names)]
    read = list(dict.fromkeys(read + amt_cols[:1] + ts_cols[:1]))
    tid = F.coalesce(_text_coalesce(df, TXID_NAMES), row_key(df.select(*[f"`{c}`" for c in read])))
    return df.select(
        tid.alias("transaction_id"),
        F.coalesce(_text_coalesce(df, senders), F.concat(F.lit("S_"), tid)).alias("src"),
        F.coalesce(_text_coalesce(df, receivers), F.concat(F.lit("R_"), tid)).alias("dst"),
        amount.alias("amount"),
        F.coalesce(_text_coalesce(df, SENDER_BANK_NAMES), F.lit("Unknown")).alias("sender_bank"),
        F.coalesce(_text_coalesce(df, RECEIVER_BANK_NAMES), F.lit("Unknown")).alias("receiver_bank"),
        _score(df, score_col).alias("score"),
        (F.col(f"`{ts_cols[0]}`") if ts_cols else F.lit(None).cast("timestamp_ntz")).alias("timestamp"))


def edges(ep: DataFrame) -> DataFrame:
    """Per (src, dst): weight, total amount, max score."""
    return ep.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"),
                                        F.sum("amount").alias("total_amount"),
                                        F.max("score").alias("max_score"))


def edge_recent_tx(ep: DataFrame, k: int = MAX_TX_PER_EDGE) -> DataFrame:
    """Last k payments per edge by (timestamp, id), exploded with position
    (1 = most recent). A task hands on at most k payments of an edge (functions/topk.py)."""
    order = [F.col("timestamp").desc_nulls_last(), F.col("transaction_id").desc()]
    return top_k_per_group(ep, ["src", "dst"], order, k, "pos").select(
        "src", "dst", "pos", "transaction_id", "amount", "sender_bank", "receiver_bank", "score", "timestamp")


def _ends(e: DataFrame, threshold: float) -> DataFrame:
    fl = (F.col("max_score") >= threshold).cast("int")
    out_end = e.select(F.col("src").alias("account"), F.lit(0).alias("in_degree"), F.lit(1).alias("out_degree"),
                       F.lit(0.0).alias("amount_in"), F.col("total_amount").alias("amount_out"),
                       F.col("weight").alias("tx"), F.col("max_score"), fl.alias("fl"))
    in_end = e.select(F.col("dst").alias("account"), F.lit(1).alias("in_degree"), F.lit(0).alias("out_degree"),
                      F.col("total_amount").alias("amount_in"), F.lit(0.0).alias("amount_out"),
                      F.col("weight").alias("tx"), F.col("max_score"), fl.alias("fl"))
    return out_end.unionByName(in_end)


def degrees(e: DataFrame) -> DataFrame:
    """In, out and total degree (a self-loop counts on both sides)."""
    return (_ends(e, float("inf")).groupBy("account")
            .agg(F.sum("in_degree").cast("bigint").alias("in_degree"),
                 F.sum("out_degree").cast("bigint").alias("out_degree"))
            .withColumn("degree", F.col("in_degree") + F.col("out_degree")))


def node_stats(e: DataFrame, threshold: float) -> DataFrame:
    """Amounts in/out, transactions, max edge score (floor 0), flagged
    edges, touches-flagged; a self-loop counts on both sides."""
    return (_ends(e, threshold).groupBy("account")
            .agg(F.sum("in_degree").cast("bigint").alias("in_degree"),
                 F.sum("out_degree").cast("bigint").alias("out_degree"),
                 F.sum("amount_in").alias("amount_in"), F.sum("amount_out").alias("amount_out"),
                 F.sum("tx").cast("bigint").alias("transactions"),
                 F.greatest(F.max("max_score"), F.lit(0.0)).alias("max_edge_score"),
                 F.sum("fl").cast("bigint").alias("flagged_edges"))
            .withColumn("touches_flagged", (F.col("flagged_edges") > 0).cast("int")))


def flagged_edges(e: DataFrame, threshold: float) -> DataFrame:
    """Edges whose max score reaches the threshold."""
    return e.where(F.col("max_score") >= threshold)


def network_metrics(e: DataFrame, threshold: float, score_col: str | None, n_components: int | None = None,
                    n_nodes: int | None = None, hubs: int | None = None) -> DataFrame:
    """Nodes, edges, mean degree, density, flagged edges, total amount; with ``hubs``, the accounts of highest
    degree as an array. ``n_nodes`` is counted where it isn't known."""
    if n_nodes is None:
        ends = e.select(F.col("src").alias("a")).unionByName(e.select(F.col("dst").alias("a")))
        n_nodes = int(ends.select(F.count_distinct("a")).first()[0])
    n = n_nodes
    m = e.agg(F.count(F.lit(1)).alias("n_edges"),
              F.count(F.when(F.col("max_score") >= threshold, 1)).alias("num_fraud_edges"),
              F.coalesce(F.sum("total_amount"), F.lit(0.0)).alias("total_amount"))
    out = m.select(F.lit(n).cast("bigint").alias("n_nodes"), "n_edges",
                   (F.col("n_edges") * 2.0 / n if n > 0 else F.lit(0.0)).alias("average_degree"),
                   (F.col("n_edges") / (n * (n - 1.0)) if n > 1 else F.lit(0.0)).alias("density"),
                   "num_fraud_edges", "total_amount",
                   F.lit(float(threshold)).alias("score_threshold_used"),
                   F.lit(score_col).cast("string").alias("score_column_used"))
    if n_components is not None:
        out = out.withColumn("n_connected_components", F.lit(int(n_components)).cast("bigint"))
    if hubs is not None:
        record = F.struct(F.col("account").alias("account_id"), "degree", "in_degree", "out_degree")
        best = top_hubs(degrees(e), hubs).agg(F.sort_array(F.collect_list(
            F.struct((-F.col("degree")).alias("_o"), F.col("account").alias("_a"), record.alias("r")))).alias("h"))   # ``hubs`` rows
        out = out.withColumn("top_hubs", best.select(F.transform("h", lambda x: x["r"])).scalar())
    return out


def top_hubs(deg: DataFrame, n: int = 10) -> DataFrame:
    """Highest total degree (ties by account)."""
    return deg.orderBy(F.col("degree").desc(), F.col("account").asc()).limit(n)


def flow_roles(deg: DataFrame) -> DataFrame:
    """Source (out > in) left, sink right, middle centre; y evenly spaced
    in [-1, 1] by degree within the role. Position uses the global rank X2
    and per-role counts (three rows), not a window over a whole role."""
    role = (F.when(F.col("out_degree") > F.col("in_degree"), "source")
             .when(F.col("out_degree") < F.col("in_degree"), "sink").otherwise("middle"))
    r = deg.withColumn("role", role)
    ranked = global_rank(r, [F.col("role").asc(), F.col("degree").desc(), F.col("account").asc()], "_g")
    per_role = ranked.groupBy("role").agg(F.count(F.lit(1)).alias("_m"), F.min("_g").alias("_start"))
    out = ranked.join(F.broadcast(per_role), "role")        # three rows
    i = F.col("_g") - F.col("_start")
    return out.select("account", "role", "in_degree", "out_degree", "degree",
                      (i + 1).cast("bigint").alias("role_position"),
                      F.when(F.col("role") == "source", -1.0).when(F.col("role") == "sink", 1.0)
                       .otherwise(0.0).alias("x"),
                      F.when(F.col("_m") <= 1, 0.0).otherwise(i / (F.col("_m") - 1) * 2.0 - 1.0).alias("y"))


@dataclass
class Network:
    endpoints: DataFrame
    edges: DataFrame
    nodes: DataFrame
    metrics: DataFrame
    selection: Selection | None
    components: DataFrame | None


def transaction_network(df: DataFrame, score_col: str | None = None, threshold: float = 0.5,
                        limit: int | None = 400, with_components: bool = True, hubs: int | None = 10) -> Network:
    """Selection (or the whole table) -> endpoints -> edges -> nodes -> metrics.

    The edges are written once and read by all that follows; the components give the node count. Metrics hold the
    hubs and, with a selection, its counts."""
    score_col = score_col or guess_column(df.columns, SCORE_NAMES, SCORE_KEYWORDS)
    sel = select_for_network(df, score_col, threshold, limit) if limit is not None else None
    rows = sel.rows if sel is not None else df
    ep = resolve_endpoints(rows, score_col)
    e = cut_lineage(edges(ep))
    comps, n_comp, n_nodes = None, None, None
    if with_components:
        comps = cut_lineage(connected_components(e))
        n_nodes, n_comp = comps.agg(F.count(F.lit(1)), F.count(F.when(F.col("node") == F.col("component"), 1))).first()
    metrics = network_metrics(e, threshold, score_col, n_comp, n_nodes, hubs)
    if sel is not None:
        metrics = metrics.select("*", *[sel.counts.select(c).scalar().alias(c) for c in sel.counts.columns])
    return Network(ep, e, node_stats(e, threshold), metrics, sel, comps)
