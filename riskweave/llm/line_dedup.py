"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

The index is a set of runs, each a table of (h1, h2, owner) hash-bucketed and
sorted by the 128-bit line hash. A batch of documents is aggregated to its
distinct line hashes, merge-anti-joined with every run (buckets line up, so no
run is shuffled or sorted again), and what is new becomes a run of level 0.
When a level holds ``fanout`` runs they are merged into one run of the next
level, so a batch meets at most ``fanout`` runs per level.

A line is dropped when no run names its document as the owner. That is an
anti-join on (hash, document): a line that a third of all documents hold is
spread by document and is no hot key.

Defined results: null or empty text is one empty line; a null doc_id sorts
after all ids and rows with a null id count as one document; rows that share
an id and differ in text are cleaned one by one and share ownership; repeated
rows give repeated results; an empty table gives an empty result; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import BLANKS, LOWER, UPPER, ordered_id, scratch_path

MIN_CHARS = 10


def _rows(docs: DataFrame) -> DataFrame:
    """(_id, _th, _text): one row per input row; _th tells texts of one id apart."""
    return (docs.select("doc_id", ordered_id().alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
                .withColumn("_th", F.xxhash64("_text")))


def _hashes(key: Column) -> tuple[Column, Column]:
    """Two independently seeded 64-bit hashes of a line key."""
    return F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2")


def line_hashes(rows: DataFrame, min_chars: int) -> DataFrame:
    """(_id, _th, pos, h1, h2) of every line whose key has ``min_chars`` code points."""
    lines = rows.select("_id", "_th", F.posexplode(F.split(F.translate("_text", UPPER, LOWER), "\n")).alias("pos", "_l"))
    keyed = lines.select("_id", "_th", "pos", F.btrim("_l", F.lit(BLANKS)).alias("_k"))
    return keyed.where(F.char_length("_k") >= min_chars).select("_id", "_th", "pos", *_hashes(F.col("_k")))


class LineRuns:
    """The levelled index. ``add`` batches in ascending doc_id order to make the
    smallest doc_id the owner; otherwise the first batch that holds a line owns it."""

    def __init__(self, spark: SparkSession, fanout: int = 3, min_chars: int = MIN_CHARS, buckets: int | None = None):
        self.spark, self.fanout, self.min_chars = spark, fanout, min_chars
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
           .option("path", scratch_path(self.spark, "line_runs")).saveAsTable(name))
        return name

    def add(self, docs: DataFrame) -> None:
        """Index the lines of one batch that no run holds yet."""
        new = (line_hashes(_rows(docs), self.min_chars)
               .groupBy("h1", "h2").agg(F.min("_id").alias("owner")))
        for run in self.runs():
            new = new.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(new))
        self._compact()

    def _compact(self) -> None:
        for at in range(len(self.levels)):
            if len(self.levels[at]) >= self.fanout:
                merged = self.spark.table(self.levels[at][0])
                for t in self.levels[at][1:]:
                    merged = merged.unionByName(self.spark.table(t))
                if at + 1 == len(self.levels):
                    self.levels.append([])
                # runs of a level hold disjoint hashes: the merge only brings buckets together
                self.levels[at + 1].append(self._write(merged.repartition(self.buckets, "h1", "h2")))
                for t in self.levels[at]:
                    self.spark.sql(f"DROP TABLE {t}")       # external: the files stay for readers
                self.levels[at] = []

    def clean(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept_text) of documents that were added."""
        rows = _rows(docs)
        owned = None
        for run in self.runs():
            part = run.select("h1", "h2", F.col("owner").alias("_id"))
            owned = part if owned is None else owned.unionByName(part)
        lines = line_hashes(rows, self.min_chars)
        gone = lines.join(owned, ["h1", "h2", "_id"], "left_anti") if owned is not None else lines.limit(0)
        gone = gone.groupBy("_id", "_th").agg(F.collect_set("pos").alias("_gone"))     # one document's lines
        # lines are cut before the join: behind it they are a column, not an expression to repeat per line
        cut = rows.select("doc_id", "_id", "_th", F.split("_text", "\n").alias("_lines"))
        both = cut.join(gone, ["_id", "_th"], "left")
        stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
        text = F.when(F.col("_gone").isNull(), F.array_join("_lines", "\n")).otherwise(
            F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
        return both.select("doc_id", F.size("_lines").cast("bigint").alias("n_lines"),
                           F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
                           text.alias("kept_text"), "_id", "_th")


def batches(docs: DataFrame, n: int) -> list[DataFrame]:
    """``docs`` cut into ``n`` ranges of ascending doc_id, of about equal row counts."""
    if n < 2:
        return [docs]
    cuts = docs.select(ordered_id().alias("i")).agg(
        F.percentile_approx("i", [j / n for j in range(1, n)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    c = ordered_id()
    bounds = [None, *cuts, None]
    return [docs.where((F.lit(True) if lo is None else c > lo) & (F.lit(True) if hi is None else c <= hi))
            for lo, hi in zip(bounds[:-1], bounds[1:])]


def index_lines(docs: DataFrame, n_batches: int = 4, fanout: int = 3, min_chars: int = MIN_CHARS) -> LineRuns:
    """Index a whole table, batch by batch in ascending doc_id order."""
    index = LineRuns(docs.sparkSession, fanout, min_chars)
    for batch in batches(docs.select("doc_id", "text"), n_batches):
        index.add(batch)
    return index


def dedup_lines(docs: DataFrame, n_batches: int = 4, fanout: int = 3, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) of every row of ``docs``."""
    return index_lines(docs, n_batches, fanout, min_chars).clean(docs).drop("_id", "_th")


def dedup_documents(docs: DataFrame, n_batches: int = 4) -> DataFrame:
    """``docs`` with its text cleaned and n_chars counted anew, all other columns as they were."""
    index = index_lines(docs, n_batches)
    kept = index.clean(docs).select("_id", "_th", "kept_text").dropDuplicates(["_id", "_th"])
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row")
    joined = (docs.select(rest, ordered_id().alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"))
                  .join(kept, ["_id", "_th"], "left"))
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("bigint")}
    return joined.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
