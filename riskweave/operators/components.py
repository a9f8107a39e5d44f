"""Weakly connected components by alternating large-star / small-star
(Kiveris, Lattanzi, Mirrokni, Rastogi, Vassilvitskii 2014).

Each round is aggregates plus joins on the node key (a hub account's edges are
salted over many tasks, see functions/joins.py), with a parquet table per
round in the checkpoint folder so lineage stays short and a lost executor only
replays the last round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.joins import ROWS_COL, aggregate_stats, broadcast_bytes, join_back
from riskweave.session import cut_lineage


def _canon(df: DataFrame) -> DataFrame:
    return (df.where(F.col("a") != F.col("b"))
              .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _to_min(rows: DataFrame, m: DataFrame, small: bool) -> DataFrame:
    """rows (u, v) joined to the per-node minimum m (u, m, _rows). ``small``:
    the nodes' bytes (an upper bound of m's in every round) were checked
    under the broadcast limit. Otherwise sizes are checked per step and a hub
    node (one account in a third of all edges) is salted, not left to one task."""
    if small:
        joined = rows.join(F.broadcast(m.drop(ROWS_COL)), "u", "left")
    else:
        m = cut_lineage(m)
        joined = join_back(rows, m, ["u"], aggregate_stats({"m": m})["m"])
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b"))


def _large_star(e: DataFrame, small: bool) -> DataFrame:
    adj = _both(e)
    m = (adj.groupBy("u").agg(F.min("v").alias("mv"), F.count(F.lit(1)).alias(ROWS_COL))
            .select("u", F.least("u", "mv").alias("m"), ROWS_COL))
    return _canon(_to_min(adj.where(F.col("v") > F.col("u")), m, small))


def _small_star(e: DataFrame, small: bool) -> DataFrame:
    lower = _both(e).where(F.col("v") < F.col("u"))
    m = lower.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias(ROWS_COL))
    to_min = _to_min(lower, m, small)
    return _canon(to_min.unionByName(m.select(F.col("u").alias("a"), F.col("m").alias("b"))))


def _mark(e: DataFrame) -> tuple:
    """Row count and two order-free checksums of an edge set."""
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(h), F.bit_xor(F.xxhash64(h, F.lit(1)))).first())


def _minimum_bytes(e: DataFrame) -> int:
    """Bytes of two node ids for every node: what the per-node minima take, and more."""
    n = e.select("u").unionByName(e.select(F.col("v").alias("u"))).distinct()
    width = F.octet_length(F.col("u")) if dict(n.dtypes)["u"] == "string" else F.lit(16)
    return 2 * (n.agg(F.sum(width.cast("bigint"))).first()[0] or 0)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) with component = smallest node of its weak component.
    Rounds go on until the edge set stays the same."""
    nodes = (edges.select(F.col(src).alias("node"))
                  .unionByName(edges.select(F.col(dst).alias("node"))).distinct())
    e = cut_lineage(_canon(edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))))
    small = _minimum_bytes(e) <= broadcast_bytes(edges.sparkSession)
    mark, last = _mark(e), None
    while mark != last:
        e = cut_lineage(_small_star(_large_star(e, small), small))
        mark, last = _mark(e), mark
    adj = _both(e)
    label = adj.groupBy("u").agg(F.min("v").alias("mv")).select(F.col("u").alias("node"),
                                                                  F.least("u", "mv").alias("component"))
    return (nodes.join(label, "node", "left")
                 .select("node", F.coalesce("component", "node").alias("component")))

