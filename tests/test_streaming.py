import os
import tempfile

from pyspark.sql import functions as F

from riskweave.sources import fixtures
from riskweave.streaming.uploads import score_uploads
from tests.conftest import SF_SMALL


def test_uploads_scored_per_batch(spark):
    d = tempfile.mkdtemp(prefix="rw-stream-")
    src, out, ck = os.path.join(d, "in"), os.path.join(d, "out"), os.path.join(d, "ck")
    txn = fixtures.txn(spark, SF_SMALL)
    txn.where("transaction_id < 500").write.parquet(src + "/u1")
    schema = ", ".join(f"`{n}` {t}" for n, t in txn.dtypes)
    q = score_uploads(spark, src + "/*", schema, out, ck)
    q.awaitTermination(300)
    res = spark.read.parquet(out)
    assert res.count() == 500 and "is_flagged" in res.columns and "aml_score" in res.columns
    txn.where("transaction_id >= 500").write.parquet(src + "/u2")
    q = score_uploads(spark, src + "/*", schema, out, ck)
    q.awaitTermination(300)
    res = spark.read.parquet(out)
    assert res.count() == 1000
    assert res.select(F.count_distinct("batch_id")).first()[0] == 2
