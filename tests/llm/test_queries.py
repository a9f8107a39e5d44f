"""The registered queries and the pipeline on the smallest tables."""

import duckdb
import pytest

from riskweave.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)] + ["pipeline"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLE[name]).df()
    cols = sorted(want.columns)
    have = QUERIES[name](spark, SF).toPandas()
    assert sorted(have.columns) == cols
    a = have[cols].sort_values(cols).reset_index(drop=True)
    assert a.equals(want[cols].sort_values(cols).reset_index(drop=True).astype(a.dtypes.to_dict()))


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from riskweave.llm.common import written
    docs = before = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES[:3]:
        docs = written(stage(spark, docs, SF))
        assert docs.columns == before.columns
    assert docs.count() == docs.select("doc_id").distinct().count() <= before.count()
    out = P.run(spark, SF).toPandas()
    assert out.exact.all() and set(out.doc_id) <= {r.doc_id for r in docs.select("doc_id").collect()}
    import tiktoken  # noqa: F401  the ids are the library's: test_operators.test_bpe
    assert (out.groupby("doc_id").size() <= 3).all()
