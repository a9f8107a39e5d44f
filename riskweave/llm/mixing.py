"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key ``-ln(u) / w`` (u: a fixed hash of its
id, w: its quality weight). A source whose target is ``e + f`` times its size
takes all its documents e times (complete epochs first), then the documents of
smallest key until their sizes add up to the rest.

Prefix sums never sort a source in one task: keys are cut into buckets whose
number follows the table's size, bucket sums are added up per source, and only
the one bucket in which a source's budget ends is sorted, with equal rows added
up before. Where the budget ends among equal rows, they are counted off
partition by partition.

Defined results: null text has size 0 and takes nothing; a null source is a
source of its own, sorted last; a null doc_id has the key of the empty id;
repeated rows count as documents of their own, and as many of them are taken as
the budget has room for; an empty table gives an empty result; other columns are
not read. ``mix_documents`` leaves out texts without words, which add nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import WORD, written

MAX_EPOCHS = 3
ROWS_PER_BUCKET = 20_000
BROADCAST_SOURCES = 50_000


def sizes(docs: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, weight, key): the narrow table all passes read.

    Quality weight: 0.1 + 0.9 x the share of distinct words among a text's words."""
    return _keyed(docs.select("doc_id", "source", _words()), seed)


def _words() -> Column:
    return F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)).alias("_w")


def _keyed(rows: DataFrame, seed: int, *more: str) -> DataFrame:
    """rows (doc_id, source, _w: words) with size, weight and key."""
    n = F.size("_w").cast("bigint")
    w = F.when(n > 0, 0.1 + 0.9 * F.size(F.array_distinct("_w")) / n).otherwise(F.lit(0.1))
    rows = rows.select("doc_id", "source", n.alias("size"), w.alias("weight"), uniform(seed).alias("_u"), *more)
    return rows.select("doc_id", "source", "size", "weight", (-F.log("_u") / F.col("weight")).alias("key"), *more)


def uniform(seed: int) -> Column:
    """A number in (0, 1) that depends on the seed and doc_id only: 52 bits of an md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") + 0.5) / F.lit(float(1 << 52))


def targets(per_source: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_EPOCHS) -> DataFrame:
    """per_source (source, source_size) with ``target``: shares of the total by
    weight, none above ``cap`` times its source; the excess is reshared by weight.

    With sources sorted by cap * size / weight, those up to some place stand at
    their caps and the rest share what is left: the place is the first at which
    the next source stays under its cap. One row per source goes through the
    windows, never a document."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    t = per_source.withColumn("_n", F.row_number().over(order) - 1).withColumn(
        "_w", F.get(w, F.col("_n") % len(weights)))
    t = t.withColumn("_cap", F.col("source_size") * cap).withColumn("_r", F.col("_cap") / F.col("_w"))
    by = Window.orderBy("_r", "_n")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy()
    t = (t.withColumn("_left", F.sum("source_size").over(all_) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
          .withColumn("_wsum", F.sum("_w").over(after))
          .withColumn("_level", F.col("_left") / F.col("_wsum"))
          .withColumn("_free", F.col("_level") <= F.col("_r")))
    # the level of the first source that stays under its cap holds for all free ones
    t = t.withColumn("_lam", F.min(F.when(F.col("_free"), F.struct("_r", "_n", "_level"))).over(all_)["_level"])
    target = F.least(F.col("_cap").cast("double"),
                     F.coalesce(F.col("_lam") * F.col("_w"), F.col("_cap").cast("double")))
    return t.select("source", "source_size", target.alias("target"))


def cuts(narrow: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source: source_size, target, epochs, and the last (key, doc_id)
    that the fractional pass takes (null: none)."""
    n = narrow.count()
    b = max(64, -(-n // ROWS_PER_BUCKET))
    bucket = F.floor(F.col("key") / (1 + F.col("key")) * b).alias("_b")
    sums = narrow.select("source", "size", bucket).groupBy("source", "_b").agg(F.sum("size").alias("_s"))
    sums = written(sums)
    per = targets(sums.groupBy("source").agg(F.sum("_s").alias("source_size")), weights)
    epochs = F.least(F.lit(MAX_EPOCHS), F.floor(F.col("target") / F.col("source_size") + 1e-9))
    per = written(per.withColumn("epochs", F.coalesce(F.when(F.col("source_size") > 0, epochs), F.lit(0)).cast("bigint"))
                     .withColumn("_budget", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))))
    run = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    upto = sums.withColumn("_end", F.sum("_s").over(run)).alias("s").join(
        per.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")))
    # the bucket in which the budget ends: the only one whose rows are sorted, equal rows as one
    last = (upto.where((F.col("_end") > F.col("_budget")) & (F.col("_end") - F.col("_s") <= F.col("_budget")) & (F.col("_s") > 0))
                .select(F.col("s.source").alias("source"), "_b", (F.col("_end") - F.col("_s")).alias("_from"), "_budget"))
    rows = (narrow.select("doc_id", "source", "size", "key", bucket).alias("n")
                  .join(written(last).alias("l"), F.col("n.source").eqNullSafe(F.col("l.source")) & (F.col("n._b") == F.col("l._b"))))
    rows = rows.groupBy(F.col("n.source").alias("source"), "key", _id().alias("id"), "size", F.col("n._b").alias("_b"),
                        "_from", "_budget").agg(F.count(F.lit(1)).alias("_rows"))
    order = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("_start", F.col("_from") + F.sum(F.col("size") * F.col("_rows")).over(order) - F.col("size") * F.col("_rows"))
    # a document is taken when at least half of it lies under the budget: no source misses by more than half a document
    room = F.when(F.col("size") > 0, F.floor((F.col("_budget") - F.col("_start")) / F.col("size") + 0.5)).otherwise(F.col("_rows"))
    within = within.withColumn("_taken", F.greatest(F.lit(0), F.least(F.col("_rows"), room)).cast("bigint"))
    took = within.where("_taken > 0").groupBy("source").agg(
        F.max(F.struct("key", "id", "size", "_taken", "_rows")).alias("_t"))
    edge = within.groupBy("source").agg(F.max("_b").alias("_b"))
    out = (per.alias("p").join(edge.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left")
              .join(took.alias("k"), F.col("p.source").eqNullSafe(F.col("k.source")), "left"))
    return out.select("p.source", "source_size", "target", "epochs", "_budget", F.col("e._b").alias("_b"),
                      F.struct("k._t.key", "k._t.id", "k._t.size").alias("_last"), F.col("k._t._taken").alias("_taken"),
                      F.col("k._t._rows").alias("_rows"), F.lit(b).alias("_buckets"))


def _id() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))


def _with_copies(rows: DataFrame, per: DataFrame) -> DataFrame:
    """``rows`` with their source's cuts (``per``, a written table) and ``copies``."""
    at = _with_cuts(rows, per)
    bucket = F.floor(F.col("key") / (1 + F.col("key")) * F.col("_buckets"))
    here = F.struct(F.col("key").alias("key"), _id().alias("id"), F.col("size").alias("size"))
    ends = (bucket == F.col("_b")) & F.coalesce(here == F.col("_last"), F.lit(False)) & (F.col("_taken") < F.col("_rows"))
    part = F.when(F.col("_b").isNull(), F.col("_budget") > 0).otherwise(
        (bucket < F.col("_b")) | ((bucket == F.col("_b")) & F.coalesce(here <= F.col("_last"), F.lit(False))))

    def copies(taken: Column) -> Column:
        more = F.when(taken & (F.col("_budget") > 0), 1).otherwise(0)
        return F.least(F.lit(MAX_EPOCHS), F.col("epochs") + more).cast("bigint")
    if per.where("_taken < _rows and _budget > 0").isEmpty():
        return at.withColumn("copies", copies(part))
    plain = at.withColumn("_ends", ends & (F.col("_budget") > 0))
    out = plain.where(~F.col("_ends")).withColumn("copies", copies(part))
    # equal rows among which a budget ends: numbered where they are written, then counted off by partition
    equal = written(plain.where("_ends").withColumn("_p", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id()))
    counts = written(equal.groupBy("source", "_p").agg(F.count(F.lit(1)).alias("_c")))
    run = Window.partitionBy("source").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("source").alias("_s"), F.col("_p").alias("_q"), F.coalesce(F.sum("_c").over(run), F.lit(0)).alias("_before"))
    nth = F.col("_before") + F.row_number().over(Window.partitionBy("source", "_p").orderBy("_n"))
    equal = equal.join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_p") == F.col("_q")))
    equal = equal.withColumn("_nth", nth).withColumn("copies", copies(F.col("_nth") <= F.col("_taken")))
    return out.unionByName(equal.select(*out.columns))


def _with_cuts(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Join per-source rows on; broadcast only under a counted number of sources."""
    if per.count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    return rows.alias("r").join(per.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source"))).drop(F.col("c.source"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """(doc_id, source, size, weight, key, source_size, target, copies, taken) of every row."""
    narrow = written(sizes(docs, seed))
    at = _with_copies(narrow, written(cuts(narrow, weights)))
    return at.select("doc_id", "source", "size", "weight", "key", "source_size", "target", "copies",
                     (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, its columns unchanged."""
    narrow = written(sizes(docs, seed))
    per = written(cuts(narrow, weights))
    cols = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), "doc_id", "source", "text")
    keyed = _keyed(keyed.select("_row", "doc_id", "source", _words()), seed, "_row")
    at = _with_copies(keyed.select("_row", "doc_id", "source", "size", "key"), per)
    return (at.where((F.col("copies") > 0) & (F.col("size") > 0))       # a text without words adds nothing to a mix
              .select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
              .select("_row.*"))
