"""Stored sketches of distinct senders: unions, errors, uploads again, compaction."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskweave.operators.sender_sketches import SenderStore, estimates, merged, sender_sketches, with_senders_so_far

DAY = dt.date(2024, 1, 1)


def payments(spark, n, first=0, receiver=1, day=DAY):
    return spark.range(first, first + n).select(F.col("id").alias("sender_id"), F.lit(receiver).cast("bigint").alias("receiver_id"),
                                                F.lit(day).alias("date"))


def count(sketches):
    return {(r["receiver_id"], r["date"]): r["unique_senders_per_day"] for r in estimates(sketches).collect()}


@pytest.mark.parametrize("n", [10, 1_000, 60_000])
def test_union_of_uploads_is_the_sketch_of_both(spark, n):
    """Overlapping uploads, in either order: the union's estimate is that of one sketch over all payments, within its error."""
    a, b = payments(spark, n), payments(spark, n, n // 2)
    both = sender_sketches(a.unionByName(b))
    one = count(both)
    assert count(merged(sender_sketches(a).unionByName(sender_sketches(b)))) == pytest.approx(one, rel=0.03)
    assert count(merged(sender_sketches(b).unionByName(sender_sketches(a)))) == pytest.approx(one, rel=0.03)
    distinct = n + n // 2
    assert abs(one[1, DAY] - distinct) <= max(1, 4 * 0.0163 * distinct)             # four standard errors


def test_more_registers_err_less(spark):
    p = payments(spark, 200_000)
    assert abs(count(sender_sketches(p, 16))[1, DAY] - 200_000) <= 4 * 0.0041 * 200_000


def test_store_replaces_an_upload_and_compacts(spark, tmp_path):
    store = SenderStore(spark, str(tmp_path / "s"))
    store.add(payments(spark, 40).unionByName(payments(spark, 3, 0, 2)), "a")
    store.add(payments(spark, 40, 20), "b")
    first = count(store.table())
    assert first == {(1, DAY): 60, (2, DAY): 3}
    store.add(payments(spark, 40, 20), "b")
    assert count(store.table()) == first
    rows = {r["receiver_id"]: r["n_rows"] for r in store.table().collect()}
    assert rows == {1: 80, 2: 3}                                                      # the repeated upload counts once
    store.compact()
    assert count(store.table()) == first and {r["receiver_id"]: r["n_rows"] for r in store.table().collect()} == rows
    store.add(payments(spark, 5, 100, 2), "c")
    store.add(payments(spark, 0), "empty")
    assert count(store.table()) == {(1, DAY): 60, (2, DAY): 8}
    for bad in ("", "a/b", "compacted"):
        with pytest.raises(ValueError):
            store.add(payments(spark, 1), bad)


def test_nulls_have_no_part(spark):
    df = spark.createDataFrame([(1, 1, DAY), (None, 1, DAY), (2, None, DAY), (3, 1, None), (1, 1, DAY)],
                               "sender_id long, receiver_id long, date date")
    got = sender_sketches(df).collect()
    assert len(got) == 1 and got[0]["n_rows"] == 2 and count(sender_sketches(df)) == {(1, DAY): 1}


def test_features_as_of_all_uploads(spark, tmp_path):
    store = SenderStore(spark, str(tmp_path / "s"))
    store.add(payments(spark, 7), "a")
    now = payments(spark, 2, 5).unionByName(payments(spark, 1, 0, 9)).withColumn("unique_senders_per_day", F.lit(0).cast("bigint")) \
        .withColumn("multiple_senders_same_receiver", F.lit(0))
    out = with_senders_so_far(now, store)
    assert out.columns == now.columns
    got = {(r["sender_id"], r["receiver_id"]): (r["unique_senders_per_day"], r["multiple_senders_same_receiver"]) for r in out.collect()}
    assert got == {(5, 1): (7, 1), (6, 1): (7, 1), (0, 9): (0, 0)}
