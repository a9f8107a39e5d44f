"""From raw documents to token ids: language ID, line dedup, near-duplicate
removal, mixing to target weights, and byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept, which is written as Parquet on the shared storage and read again. Texts go
to Python workers ``ARROW_ROWS`` at a time, which bounds what a task holds of
long documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm import bpe, language_id, line_dedup, mixing, ngram_join
from riskweave.llm.common import held_out, written
from riskweave.session import read_table


ARROW_ROWS = 2_000


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model finds, which becomes their ``lang``; texts without letters go. All stay if no document to learn from has a language."""
    _bounded(spark)
    model = language_id.train(language_id.sampled(docs.where(~held_out())))
    return language_id.with_language(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a smaller doc_id holds; n_chars is counted anew."""
    return line_dedup.dedup_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked by a Jaccard similarity of 0.8 on five-word shingles."""
    _bounded(spark)
    return ngram_join.first_of_each(docs, words=5, num=80, den=100)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, exact, lang): token ids, whether they decode to the text,
    and the language that the first stage found."""
    _bounded(spark)
    return bpe.encode_checked(docs, keep=["lang"])


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

# The first stage is a learned model: SQL can't express it. tests/llm/test_plain_versions.py holds run()'s rows against a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
