"""Date forms, numeric text, long paths, quoted CSV and full autoencoder batches."""

import datetime as dt

import numpy as np

from riskweave.operators.clean import clean_amount, clean_timestamp
from riskweave.operators.components import connected_components
from riskweave.operators.models import autoencoder as A
from riskweave.sources.readers import read_transactions
from riskweave.sources.sinks import export


def test_date_forms(spark):
    day = dt.datetime(2024, 3, 15)
    forms = {"15.03.2024 10:00": day.replace(hour=10), "15/03/2024": day, "20240315": day, "03/15/2024 10:00": day.replace(hour=10),
             "15-Mar-2024": day, "2024-03-15 10:00:05": day.replace(hour=10, second=5), "2024/03/15": day, "soon": None}
    df = spark.createDataFrame([(t,) for t in forms], "timestamp string")
    assert [r[0] for r in clean_timestamp(df).collect()] == list(forms.values())


def test_amount_text(spark):
    df = spark.createDataFrame([(x,) for x in ("1d", "2.5f", "3", " 4.5 ", "1e2", "x", None)], "amount string")
    assert sorted(r[0] for r in clean_amount(df).collect()) == [3.0, 4.5, 100.0]


def test_long_path_is_one_component(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long")
    assert {r.component for r in connected_components(path).collect()} == {0}
    assert connected_components(path.limit(0)).count() == 0


def test_quoted_csv_round_trip(spark, tmp_path):
    rows = [("1", 'said "hi", left', "two\nlines"), ("2", "plain", "x")]
    export(spark.createDataFrame(rows, "transaction_id string, note string, more string"), str(tmp_path / "out.csv"))
    back = read_transactions(spark, str(tmp_path / "out.csv"), "csv", multi_line=True)
    assert sorted(map(tuple, back.collect())) == rows


def test_autoencoder_trains_on_every_row(monkeypatch):
    seen = []
    real = A.loss_grad
    monkeypatch.setattr(A, "loss_grad", lambda out, x, loss: seen.append(len(x)) or real(out, x, loss))
    monkeypatch.setattr(A, "forward", lambda p, x, train, cache=None, activation="relu": x)
    monkeypatch.setattr(A, "backward", lambda *a: {})
    cfg = {"batch_size": 128, "noise_std": 0.0, "loss": "mse", "l2_reg": 0.0}
    for n in (1, 128, 129, 257, 300):
        seen.clear()
        A.local_epoch({}, {"t": 0, "lr": 0.1}, np.zeros((n, 3)), cfg, np.random.default_rng(0))
        assert sum(seen) == n
