"""X1 exact quantile, X2 global rank, X3 components, salted top-k."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.functions.quantile import exact_quantiles
from riskweave.functions.rank import global_rank, percentile_rank
from riskweave.functions.topk import top_k_per_group
from riskweave.operators.components import connected_components


def test_quantile_bracket_path_equals_exact(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(0, 1, 3000), np.full(500, 2.5), rng.exponential(5, 1500)])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double").repartition(7)
    qs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 0.999, 1.0]
    exact = df.agg(F.percentile("v", qs).alias("p")).first()["p"]
    forced = exact_quantiles(df, ["v"], qs, bracket_limit=50)["v"]
    assert np.allclose(forced, exact, rtol=0, atol=1e-12)
    direct = exact_quantiles(df, "v", qs)["v"]
    assert np.allclose(direct, exact, rtol=0, atol=1e-12)


def test_quantile_ignores_nulls_and_empty(spark):
    df = spark.createDataFrame([(None,), (1.0,), (3.0,), (float("nan"),)], "v double")
    assert exact_quantiles(df, "v", [0.5])["v"] == [2.0]
    assert exact_quantiles(df.where("v > 10"), "v", [0.5])["v"] == [None]


def test_global_rank_matches_row_number(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.randint(0, 50))) for i in range(3000)]        # many ties
    df = spark.createDataFrame(rows, "id long, s double").repartition(5)
    got = {r["id"]: r["rank"] for r in global_rank(df, ["s", "id"], num_partitions=6).collect()}
    w = Window.orderBy("s", "id")
    want = {r["id"]: r["rn"] - 1 for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == want


def test_percentile_rank_edges(spark):
    one = spark.createDataFrame([(1, 0.3)], "transaction_id long, native_score double")
    assert percentile_rank(one, "native_score", "transaction_id").first()["aml_score"] == 0.0
    ties = spark.createDataFrame([(3, 0.5), (1, 0.5), (2, 0.5)], "transaction_id long, native_score double")
    got = {r["transaction_id"]: r["aml_score"] for r in percentile_rank(ties, "native_score", "transaction_id").collect()}
    assert got == {1: 0.0, 2: 0.5, 3: 1.0}


def _brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    nodes = {n for e in edges for n in e}
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), []).append(n)
    return {n: min(g) for g in groups.values() for n in g}


def test_components_match_union_find(spark):
    rng = random.Random(7)
    edges = [(f"n{rng.randint(0, 120):03d}", f"n{rng.randint(0, 120):03d}") for _ in range(90)]
    edges += [("a", "a"), ("z1", "z2"), ("z2", "z3"), ("z3", "z4"), ("z4", "z5"), ("z5", "z6")]   # self-loop, chain
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == _brute_components(edges)


def test_top_k_per_group_hot_group(spark):
    rows = [(0, i) for i in range(2000)] + [(g, i) for g in range(1, 5) for i in range(3)]
    df = spark.createDataFrame(rows, "g long, transaction_id long")
    out = top_k_per_group(df, ["g"], [F.col("transaction_id").desc()], 6)
    got = {}
    for r in out.collect():
        got.setdefault(r["g"], []).append((r["pos"], r["transaction_id"]))
    assert sorted(got[0]) == [(i + 1, 1999 - i) for i in range(6)]
    assert sorted(got[3]) == [(1, 2), (2, 1), (3, 0)]
