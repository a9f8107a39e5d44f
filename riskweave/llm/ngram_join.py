"""N-gram Jaccard join and its components by PartEnum signatures.

1. Every text becomes its set of word-shingle hashes; equal sets are merged
   first, so copies cost one signature set however many there are.
2. Sets that share a PartEnum signature are candidates (partenum.py: no linked
   pair is lost). The smallest set id under a signature is its hub. Each set is
   compared with the hub that it shares most signatures with, then with the hubs
   that this left in other components, then in a few rounds with another member
   of a signature it shares; links become components each time.
3. What that leaves open are signatures that hold several components. Under one
   of at most ``FEW`` sets, pairs of different components are compared one by
   one; the sets under a larger one are joined on a prefix of their rarest
   shingles instead (linked sets must share one) and then compared. Nothing is
   capped, so no link between different components is lost.

So a group of near copies costs a comparison a set and not one a pair: its
pairs are never made once hubs have joined them. Before any comparison a pair
must pass two exact bounds, on set sizes and on 512 odd bits of each set; only
sets of pairs that pass are read again, and compared by their shingle hashes.

Defined results: A-Z are lower-cased; a text of fewer words than a shingle has
is one shingle; a text without words (or null) has an empty set, links with
nothing and is its own component; a null doc_id is never linked and has a null
component; repeated rows give repeated results; rows that share a doc_id and
differ in text are sets of their own; ties go to the smaller doc_id; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.joins import AggStats, join_back
from riskweave.llm.common import discard, scratch_path, written
from riskweave.llm.partenum import PartEnum
from riskweave.llm.shingles import set_digest, shingle_set
from riskweave.operators.components import connected_components

FEW = 512                                # sets under a signature that are paired directly
BROADCAST_SETS = 400_000                 # sizes and odd bits in a broadcast: 35 MB and their table
BROADCAST_WIDE = 60_000                  # wide odd bits in a broadcast: 32 MB
ROUNDS = 2                               # of comparisons with one more member, while they find links
FILTER_BITS = 1 << 30                    # of a filter of signatures: 128 MB, at most
BROADCAST_ROWS = 1_000_000               # longs in a broadcast: 16 MB and their table


def _small(df: DataFrame, n: int) -> DataFrame:
    """Broadcast a written table of a counted number of rows, else join it as it is."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


ODD = [f"p{j}" for j in range(8)]


def odd_bits(s: np.ndarray) -> np.ndarray:
    """512 bits as 8 longs: which of 512 hash classes hold an odd number of the
    set's elements. Two sets that differ in d elements differ in at most d bits."""
    odd = (np.bincount((s & np.uint64(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


WIDE = 64                                # longs of the odd bits that are compared before whole sets are


def wide_bits(s: np.ndarray) -> np.ndarray:
    """As ``odd_bits`` with 4096 bits: nearly the number of elements in which two sets differ, and never more."""
    odd = (np.bincount((s >> np.uint64(52)).astype(np.int64), minlength=64 * WIDE) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def sets(docs: DataFrame, words: int, scheme: PartEnum) -> DataFrame:
    """(doc_id, t, n_shingles, d1, d2, p0..p7, sigs): hash of the text as it is, set size, 128-bit digest, odd
    bits and PartEnum signatures."""
    names = ["doc_id", "t", "n_shingles", "d1", "d2", *ODD, "sigs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for i, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                s = shingle_set((text.as_py() or "").encode("utf-8", "surrogatepass"), words)
                out.append((i, t, len(s), *set_digest(s), *odd_bits(s).tolist(), scheme.signatures(s)))
                size += len(out[-1][-1])
                if size >= 500_000:
                    yield table(out)
                    out, size = [], 0
            if out:
                yield table(out)

    def table(out):
        ends = np.concatenate([[0], np.cumsum([len(o[-1]) for o in out])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([o[-1] for o in out])))
        return pa.RecordBatch.from_arrays(
            [pa.array([o[j] for o in out], type=pa.int64()) for j in range(len(names) - 1)] + [lists], names=names)
    schema = ", ".join(f"{c} bigint" for c in names[:-1]) + ", sigs array<bigint>"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("t"), "text").mapInArrow(run, schema)


def hashes(docs: DataFrame, words: int) -> DataFrame:
    """(id, d1, s, w): the sorted shingle hashes of each text, half of their digest and their wide odd bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in zip(b.column(0), b.column(1)):
                s = shingle_set((text.as_py() or "").encode("utf-8", "surrogatepass"), words).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array([0, len(s)], type=pa.int32()), pa.array(s))
                d1 = pa.array([set_digest(s.view(np.uint64))[0]], type=pa.int64())
                w = pa.ListArray.from_arrays(pa.array([0, WIDE], type=pa.int32()), pa.array(wide_bits(s.view(np.uint64))))
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], type=pa.int64()), d1, lists, w], names=["id", "d1", "s", "w"])
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").mapInArrow(run, "id bigint, d1 bigint, s array<bigint>, w array<bigint>")


def possible(x: str, y: str, num: int, den: int) -> Column:
    """Whether sets under aliases ``x`` and ``y`` (n, p0..p7) can reach the threshold: by
    their sizes, and because odd bits differ no more than the sets do."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = sum(F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in ODD)
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & (differ * (den + num) <= (n + m) * (den - num))


class Texts:
    """Shingle sets by id, made from the texts when they are first compared."""

    def __init__(self, docs: DataFrame, words: int, apart: bool):
        self.docs, self.words, self.apart, self.paths, self.held = docs, words, apart, [], None

    def sets(self, ids: DataFrame, n_ids: int) -> DataFrame:
        """(id, s, w) of the ``n_ids`` written, distinct ``ids``."""
        new = ids if self.held is None else written(ids.join(self.held.select("id"), "id", "left_anti"))
        n = n_ids if self.held is None else new.count()
        if n or self.held is None:
            numbers = new.select(F.col("id.rep").alias("doc_id")).distinct() if self.apart else new.select(F.col("id").alias("doc_id"))
            texts = self.docs.withColumn("doc_id", F.col("doc_id").cast("bigint")).join(_small(numbers, n), "doc_id", "left_semi")
            made = hashes(texts, self.words)
            if self.apart:
                made = made.withColumn("id", F.struct(F.col("id").alias("rep"), "d1")).join(_small(new, n), "id", "left_semi")
            made = made.groupBy("id").agg(F.first("s").alias("s"), F.first("w").alias("w"))          # a repeated row once
            self.paths.append(scratch_path(self.docs.sparkSession))
            made = written(made, self.paths[-1])
            self.held = made if self.held is None else self.held.unionByName(made)
        return self.made_before(ids, n_ids)

    def made_before(self, ids: DataFrame, n_ids: int) -> DataFrame:
        """As ``sets``, of ids whose sets were made already."""
        return self.held.join(_small(ids, n_ids), "id", "left_semi")

    @staticmethod
    def ids_of(pairs: DataFrame) -> tuple[DataFrame, int]:
        """The distinct ids in ``pairs`` (a, b, ...), written, and how many."""
        ids = written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
        return ids, ids.count()

    def likely(self, pairs: DataFrame, num: int, den: int) -> DataFrame:
        """Those of the written ``pairs`` that wide odd bits let pass, with the bits that ``differ``."""
        ids, n = self.ids_of(pairs)
        s = self.sets(ids, n)
        bits = s.select("id", F.size("s").cast("bigint").alias("n"), "w")
        bits = F.broadcast(bits) if n <= BROADCAST_WIDE else bits
        x, y = bits.alias("x"), bits.alias("y")
        at = pairs.alias("p").join(x, F.col("p.a") == F.col("x.id")).join(y, F.col("p.b") == F.col("y.id"))
        differ = F.aggregate(F.zip_with("x.w", "y.w", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, k: t + k)
        at = at.select("p.*", differ.alias("differ"), (F.col("x.n") + F.col("y.n")).alias("_n"))
        return at.where(F.col("differ") * (den + num) <= F.col("_n") * (den - num)).drop("_n")

    def linked(self, pairs: DataFrame, num: int, den: int) -> DataFrame:
        """Those of ``pairs`` (a, b, ...), a written table of pairs that ``likely`` let pass, whose sets reach the
        threshold, compared exactly."""
        s = self.made_before(*self.ids_of(pairs))
        at = (pairs.join(s.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
                   .join(s.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b"))
        both = F.size(F.array_intersect("sa", "sb")).cast("bigint")
        at = at.withColumn("_i", both).withColumn("_n", (F.size("sa") + F.size("sb")).cast("bigint"))
        return at.where(F.col("_i") * den >= (F.col("_n") - F.col("_i")) * num).select(*pairs.columns)

    def drop(self):
        for path in self.paths:
            discard(self.docs.sparkSession, path)


def _likely(sets_: DataFrame, shared: DataFrame, n: int) -> DataFrame:
    """(id, sig) of the signatures of ``sets_`` (id, sigs) that could be among ``shared`` (sig, ...): all that are, and
    about one in seventy of the others. A filter of 16 bits a shared signature goes to the tasks, so signatures that
    one set alone has are not shuffled again; where it would be too large they all are."""
    m = 1 << (16 * n - 1).bit_length()
    if m > FILTER_BITS:
        return sets_.select("id", F.explode("sigs").alias("sig"))
    places = [F.shiftrightunsigned("sig", k).bitwiseAND(F.lit(m - 1)) + 1 for k in (0, 32)]
    bits = shared.select(F.explode(F.array(*places)).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    held = np.zeros(m // 8, dtype=np.uint8)
    for r in bits.collect():                                 # 4 KB a row, FILTER_BITS in all
        part = np.frombuffer(r["bits"], dtype=np.uint8)
        at = (r["b"] - 1) * len(part)
        held[at:at + len(part)] = part[:len(held) - at]
    filter_ = sets_.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64(m - 1)
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ok = np.ones(len(flat), dtype=bool)
            for k in (0, 32):
                h = (flat >> np.uint64(k)) & mask
                ok &= (filter_.value[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 == 1
            owner = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))[ok]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(flat[ok].view(np.int64))], names=["id", "sig"])
    return sets_.mapInArrow(run, f"id {sets_.schema['id'].dataType.simpleString()}, sig bigint")


def _components_of(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """``rows`` (id, ...) with ``c``: the component, which is the id itself where nothing is linked."""
    at = rows.join(comp.withColumnRenamed("node", "id"), "id", "left")
    return at.withColumn("c", F.coalesce("component", "id")).drop("component")


def _across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components, with them as ca and cb."""
    for side in "ab":
        pairs = _components_of(pairs.withColumnRenamed(side, "id"), comp).withColumnsRenamed({"id": side, "c": f"c{side}"})
    return pairs.where("ca <> cb").select("a", "b", "ca", "cb")


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) once the components that ``links`` (ca, cb), a written table, join are one."""
    if links.isEmpty():
        return comp
    over = written(connected_components(written(links.select("ca", "cb").distinct()), "ca", "cb"))
    nodes = over.join(comp, "node", "left_anti").select("node", F.col("node").alias("component")).unionByName(comp)
    top = over.select(F.col("node").alias("component"), F.col("component").alias("top"))
    return written(nodes.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component")))


def classes(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, **scheme) -> DataFrame:
    """(doc_id, t, n_shingles, component_id, top, first) of every row: ``t`` is a hash of the text, ``top`` tells
    components apart (null: no words or no id), ``first`` marks the rows whose set a component is named by."""
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    tables: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        tables.append(scratch_path(spark))
        return written(df, tables[-1])

    full = scratch_path(spark)
    all_sets = written(sets(docs, words, PartEnum(num, den, **scheme)), full)
    known = all_sets.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    copied = kept(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_rows"))
                       .where("_rows > 1"))
    stats = copied.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("n"),
                       F.coalesce(F.max("_rows"), F.lit(0)).alias("m")).first()
    stats = AggStats(stats["k"], stats["n"], stats["m"])
    # ids of unlike texts may collide: then a set's id is (smallest doc_id, digest)
    apart = known.groupBy("doc_id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo < hi").limit(1).count() > 0
    node = F.struct(F.col("rep"), F.col("d1")) if apart else F.col("rep")
    rows = join_back(known, copied.withColumn("many", F.col("_rows")), ["d1", "d2"], stats, broadcast_keys=BROADCAST_ROWS)
    rows = rows.withColumn("rep", F.coalesce("rep", "doc_id")).withColumn("id", node)
    firsts = rows.where("doc_id = rep").select("id", "many", F.col("n_shingles").alias("n"), *ODD, "sigs")
    firsts = firsts.where("many is null").unionByName(firsts.where("many > 1").dropDuplicates(["id"])).drop("many")

    sigs = firsts.select("id", F.explode("sigs").alias("sig"))
    shared = kept(sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("many"), F.min("id").alias("hub")).where("many > 1"))
    n_shared = shared.count()
    if n_shared > BROADCAST_ROWS:
        sigs = _likely(firsts.select("id", "sigs"), shared, n_shared)
    members = kept(sigs.join(_small(shared, n_shared), "sig"))
    under = kept(members.select("id").distinct())
    n_under = under.count()
    bits = kept(firsts.select("id", "n", *ODD).join(_small(under, n_under), "id", "left_semi"))
    held = F.broadcast(bits) if n_under <= BROADCAST_SETS else bits
    # from here on nothing reads the signatures of single sets again: their table goes
    rows = written(rows.select("doc_id", "t", "n_shingles", F.col("id").alias("node"), "rep"))
    alone = written(all_sets.where(F.col("doc_id").isNull() | (F.col("n_shingles") == 0)).select(
        "doc_id", "t", "n_shingles", F.col("doc_id").alias("component_id"),
        F.lit(None).cast("struct<rep: bigint, d1: bigint>" if apart else "bigint").alias("top"), F.lit(True).alias("first")))
    discard(spark, full)
    texts = Texts(docs, words, apart)

    def near(pairs: DataFrame) -> DataFrame:
        x, y = held.alias("x"), held.alias("y")
        return (pairs.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id"))
                     .where(possible("x", "y", num, den)).select(*pairs.columns))

    def settled(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """``comp`` with the links among the written ``pairs`` (a, b, ca, cb): of two components the pair that differs
        least comes first, and only what that leaves apart is compared further. Without a link it is ``comp`` itself."""
        if pairs.isEmpty():
            return comp
        likely = kept(texts.likely(pairs, num, den))
        if likely.isEmpty():
            return comp
        best = likely.groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(
            F.min(F.struct("differ", "a", "b")).alias("m")).select("m.a", "m.b", "ca", "cb")
        comp = _merged(comp, kept(texts.linked(kept(best), num, den)))
        rest = kept(_across(likely.select("a", "b"), comp).join(best.select("a", "b"), ["a", "b"], "left_anti"))
        return comp if rest.isEmpty() else _merged(comp, kept(texts.linked(rest, num, den)))

    hubs = kept(members.where("id <> hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("k")))
    most = hubs.groupBy(F.col("id").alias("a")).agg(F.min(F.struct(-F.col("k"), "hub")).alias("m")).select("a", F.col("m.hub").alias("b"))
    links = kept(texts.linked(kept(texts.likely(kept(near(most)), num, den)), num, den).select("a", "b"))
    comp = written(connected_components(links, "a", "b"))             # the last of these is read by the result
    others = _across(hubs.select(F.col("id").alias("a"), F.col("hub").alias("b")), comp)
    comp = settled(kept(near(others)), comp)

    # a signature of two sets has had its one comparison
    crowded = kept(members.where("many > 2"))

    def still_open() -> DataFrame:
        """Rows of the signatures that hold several components; of signatures with the same members, one."""
        at = _components_of(crowded, comp)
        ids = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"h{k}") for k in (0, 1)]           # 128 bits of the members
        still = at.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n"), *ids)
        still = kept(still.where("lo < hi").groupBy("h0", "h1", "n").agg(F.min("sig").alias("sig")).select("sig"))
        return kept(at.join(_small(still, still.count()), "sig", "left_semi"))
    opened = still_open()
    for r in range(ROUNDS):
        if opened.isEmpty():
            break
        one = opened.groupBy("sig").agg(F.min(F.struct(F.xxhash64(F.lit(r), "id").alias("h"), F.col("id").alias("b"), F.col("c").alias("d"))).alias("p"))
        met = opened.join(one.select("sig", "p.b", "p.d"), "sig").where("c <> d").select(F.col("id").alias("a"), "b").distinct()
        found = kept(_across(near(met), comp))
        if found.isEmpty():
            break
        before, comp = comp, settled(found, comp)
        if comp is not before:
            opened = still_open()
    if not opened.isEmpty():
        few = opened.where(f"many <= {FEW}").join(held, "id")
        x, y = few.alias("x"), few.alias("y")
        # pairs with the hub were compared above
        open_pair = ((F.col("x.sig") == F.col("y.sig")) & (F.col("x.c") != F.col("y.c")) & (F.col("x.id") > F.col("y.id"))
                     & (F.col("y.id") != F.col("y.hub")) & possible("x", "y", num, den))
        direct = x.join(y, open_pair).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
        crowd = kept(opened.where(f"many > {FEW}").select("id", "c").distinct())
        if not crowd.isEmpty():
            ids = kept(crowd.select("id").distinct())
            direct = direct.unionByName(rare_pairs(crowd.join(held, "id"), texts.sets(ids, ids.count()), num, den)).distinct()
        left = kept(_across(direct, comp))
        comp = settled(left, comp)
    for path in tables:
        discard(spark, path)
    texts.drop()
    out = rows.join(_small(comp, comp.count()), "node", "left").withColumn("top", F.coalesce("component", "node"))
    return out.select("doc_id", "t", "n_shingles", (F.col("top.rep") if apart else F.col("top")).alias("component_id"), "top",
                      ((F.col("top") == F.col("node")) & (F.col("doc_id") == F.col("rep"))).alias("first")).unionByName(alone)


def components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, **scheme) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    return classes(docs, words, num, den, **scheme).select("doc_id", "n_shingles", "component_id")


def rare_pairs(crowd: DataFrame, s: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different components in ``crowd`` (id, c, n, p0..p7) that share one
    of their rarest shingles. Linked sets of sizes x and y share at least
    num / den * x shingles, so any x - ceil(num x / den) + 1 of x hold a common one,
    if both sides order shingles alike: by how many sets of the crowd hold them."""
    own = written(crowd.join(s, "id"))
    held = own.select("id", F.explode("s").alias("h"))
    # a shingle that one set alone holds joins nothing, but takes its place in the prefix
    df = written(held.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    order = F.sort_array(F.collect_list(F.struct("df", "h")))            # one set's shared shingles
    shared = held.join(df, "h").groupBy("id").agg(order.alias("o"))
    need = F.ceil(F.col("n") * num / F.lit(float(den)) - 1e-9)
    # own shingles come first: what they leave of the prefix is filled with the rarest shared ones
    room = (F.size("o") - need + 1).cast("int")
    tokens = own.drop("s").join(shared, "id").where(room > 0).select(
        "id", "c", "n", *ODD, F.explode(F.slice("o", 1, room)).alias("t"))
    tokens = written(tokens.select("id", "c", "n", *ODD, "t.h"))
    x, y = tokens.alias("x"), tokens.alias("y")
    near = (F.col("x.h") == F.col("y.h")) & (F.col("x.c") != F.col("y.c")) & (F.col("x.id") > F.col("y.id"))
    return x.join(y, near & possible("x", "y", num, den)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def first_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without all but the smallest doc_id of each component; its columns are
    unchanged. Rows without a doc_id or without words stay. Of a component's rows that
    share that doc_id one text stays, and of rows equal in doc_id and text one row.
    Texts are only shuffled where too many go to broadcast their ids."""
    at = written(classes(docs, words, num, den, n2=2, width=1, slack=1.25).where("doc_id is not null and n_shingles > 0"))
    firsts = at.where("first").groupBy("top", "doc_id").agg(F.min("t").alias("t"), F.count(F.lit(1)).alias("n"))
    several = written(firsts.where("n > 1").select("top", "doc_id", "t"))       # of one text or of equal sets
    unlike = at.where("first").alias("x").join(several.alias("y"), "top").where("x.t <> y.t").select("x.doc_id", "x.t")
    gone = written(at.where(~F.col("first")).select("doc_id", "t").unionByName(unlike).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col("doc_id").cast("bigint").alias("i"), F.xxhash64("text").alias("t"))

    def among(rows: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
        pairs = _small(pairs.select(F.col("doc_id").alias("i"), "t"), pairs.count())
        return rows.join(pairs, ["i", "t"], how)
    stay = among(rows, gone, "left_anti")
    if several.count():
        stay = among(stay, several, "left_anti").unionByName(among(stay, several, "left_semi").dropDuplicates(["i", "t"]))
    return stay.select("row.*")
