"""All ranks of all columns in a bounded number of jobs, exact on any path."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.functions import quantile as Q

QS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 0.999, 1.0]


def columns(n, seed=1):
    rng = np.random.default_rng(seed)
    hot = np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n))             # one value in a good third of the rows
    return {"normal": rng.normal(size=n), "flag": (rng.random(n) < 0.1).astype(float), "hot": hot,
            "count": rng.poisson(3, n).astype(float), "same": np.full(n, 2.5), "wide": rng.normal(size=n) * 10.0 ** rng.integers(-9, 9, n)}


def frame(spark, data, parts=6):
    n = len(next(iter(data.values())))
    return spark.createDataFrame([tuple(float(v[i]) for v in data.values()) for i in range(n)], list(data)).repartition(parts)


def jobs(spark, fn):
    spark.sparkContext.setJobGroup("quantiles", "counted")
    try:
        out = fn()
    finally:
        ids = spark.sparkContext.statusTracker().getJobIdsForGroup("quantiles")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(ids)


@pytest.mark.parametrize("limit", [Q.BRACKET_LIMIT, 10])
@pytest.mark.parametrize("n", [1, 2, 7, 4000])
def test_equal_to_numpy(spark, n, limit):
    data = columns(n)
    got = Q.exact_quantiles(frame(spark, data), list(data), QS, bracket_limit=limit)
    for c, v in data.items():
        assert np.allclose(got[c], np.quantile(v, QS), rtol=1e-12, atol=1e-15), c


def test_ranked_path_spreads_over_partitions(spark, monkeypatch):
    """The values of a bracket in several ranges: only those that hold a rank are summed up."""
    monkeypatch.setattr(Q, "RANGE_ROWS", 300)
    data = columns(6000, 4)
    got = Q.exact_quantiles(frame(spark, data), list(data), QS, bracket_limit=0, error=0.1)
    for c, v in data.items():
        assert np.allclose(got[c], np.quantile(v, QS), rtol=1e-12, atol=1e-15), c


def test_bracket_that_misses_its_rank_is_widened(spark, monkeypatch):
    data = columns(3000, 5)
    real = F.kll_sketch_get_quantile_double
    for shift in (5.0, -5.0):
        monkeypatch.setattr(F, "kll_sketch_get_quantile_double", lambda s, p: F.transform(real(s, p), lambda v: v + shift))
        got = Q.exact_quantiles(frame(spark, data), ["normal", "count"], [0.3, 0.5])
        for c in ("normal", "count"):
            assert np.allclose(got[c], np.quantile(data[c], [0.3, 0.5]), rtol=1e-12)


def test_32_columns_and_3_ranks_in_4_jobs(spark):
    rng = np.random.default_rng(0)
    data = {f"c{j}": rng.normal(size=500) if j % 3 else rng.integers(0, 2, 500).astype(float) for j in range(32)}
    df = frame(spark, data).cache()
    df.count()
    got, n = jobs(spark, lambda: Q.exact_quantiles(df, list(data), [0.25, 0.5, 0.75]))
    assert n <= 4
    for c, v in data.items():
        assert np.allclose(got[c], np.quantile(v, [0.25, 0.5, 0.75]), rtol=1e-12)
    df.unpersist()


def test_many_partitions_merge_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(Q, "FAN_IN", 3)
    data = columns(2000, 6)
    df = frame(spark, data, 40).where("normal is not null")
    got = Q.exact_quantiles(df, list(data), QS)
    for c, v in data.items():
        assert np.allclose(got[c], np.quantile(v, QS), rtol=1e-12, atol=1e-15), c


def test_nulls_infinities_and_counts(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), None), (math.inf, None), (-math.inf, None), (3.0, None)], "a double, b double")
    counts = {}
    got = Q.exact_quantiles(df.withColumn("c", F.lit(None).cast("double")), ["a", "b", "c"], [0.5], counts=counts)
    assert got == {"a": [3.0], "b": [1.0], "c": [None]}
    assert counts == {"a": 3, "b": 1, "c": 0, "__rows__": 5}
    assert Q.exact_quantiles(df, [], [0.5]) == {}
    counts = {}
    assert Q.exact_quantiles(df.limit(0), ["a"], [0.5], counts=counts) == {"a": [None]} and counts["__rows__"] == 0


def test_counts_of_repeated_tasks_are_not_trusted(spark, monkeypatch):
    """The counts taken beside the second pass may be doubled when tasks run again: then they are taken anew."""
    class Doubled(Q.Observation):
        @property
        def get(self):
            return {k: 2 * v for k, v in super().get.items()}
    monkeypatch.setattr(Q, "Observation", Doubled)
    data = columns(1000, 7)
    got = Q.exact_quantiles(frame(spark, data), ["normal"], QS)
    assert np.allclose(got["normal"], np.quantile(data["normal"], QS), rtol=1e-12)


def test_ranks_of_many_columns_are_joined(spark, capfd):
    """64 columns with three ranks each, ranked in Spark: no condition grows beyond what Spark compiles."""
    x = np.random.default_rng(6).normal(size=(400, 64))
    df = spark.createDataFrame([tuple(r) for r in x.tolist()], ", ".join(f"c{j} double" for j in range(64)))
    got = Q.exact_quantiles(df, df.columns, [0.25, 0.5, 0.75], bracket_limit=0)
    for j in range(64):
        assert np.allclose(got[f"c{j}"], np.quantile(x[:, j], [0.25, 0.5, 0.75]), rtol=1e-12)
    assert "grows beyond 64 KB" not in capfd.readouterr().err


def test_brackets_of_one_value_make_no_rows(spark, monkeypatch):
    """Flags and small counts are counted where they lie: nothing is written, none of their values is made a row."""
    n = 6000
    df = spark.range(n).select((F.col("id") % 3 == 0).cast("double").alias("flag"), (F.col("id") % 7).cast("double").alias("count"),
                               F.lit(-0.0).alias("zero"))
    monkeypatch.setattr(Q, "cut_lineage", lambda df: pytest.fail("a table was written"))
    got = Q.exact_quantiles(df, ["flag", "count", "zero"], [0.25, 0.5, 0.75], bracket_limit=0)
    assert got == {"flag": [0, 0, 1], "count": [1, 3, 5], "zero": [0, 0, 0]}
    assert math.copysign(1, got["zero"][0]) == 1


def test_ends_of_a_bracket_count_with_what_lies_between(spark):
    """Ranks at a bracket's ends and between them, on both paths."""
    v = np.repeat([1.0, 2.0, 3.0, 4.0], [1000, 3, 4, 1000])
    for limit in (Q.BRACKET_LIMIT, 0):
        qs = [0.25, 1000 / 2006, 1003 / 2006, 1006 / 2006, 1007 / 2006, 0.75]
        got = Q.exact_quantiles(frame(spark, {"v": v}), "v", qs, bracket_limit=limit, error=0.01)["v"]
        assert np.allclose(got, np.quantile(v, qs))
