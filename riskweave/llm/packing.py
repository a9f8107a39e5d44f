"""Best-fit packing of token sequences by a configuration linear program.

Documents are encoded and cut into pieces of at most ``capacity`` tokens. Only
the histogram of piece lengths (at most ``capacity`` rows) reaches the driver.
There a configuration is a multiset of lengths that fits one sequence, and the
linear program asks for the least total of configurations that covers the
histogram. It is solved by multiplicative weights: each length has a price, a
knapsack dynamic program finds the dearest configurations, they are taken for
part of the need, and the prices of what they cover fall. Every round's prices
also give a lower bound (``Plan.bound``). Whole parts of the solution are kept,
the rest is solved anew, and what remains at last is packed best fit
decreasing. The plan covers the histogram exactly.

Pieces meet their slots by rank: the k-th piece of a length (input partition by
partition, counted while encoding) takes the k-th slot of that length. Neither
a length's rows nor a sequence's are gathered in one task.

Defined results: a null or empty text is the end id alone; null doc_ids and
repeated rows are packed as documents of their own; an empty table gives an
empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import written
from riskweave.llm.pieces import KEEP, LONG_PIECE, byte_letters, library_tokenizer, vocabulary

CAPACITY = 2048
END_ID = 0
ROUNDS = 60                      # of prices, for each solution of the linear program
PER_ROUND = 2048                 # configurations taken at one set of prices: one for each length
SOLUTIONS = 3                    # of the linear program, each over what rounding left
SHARE = 0.5                      # of a length's need that one configuration takes
RISE = 0.05                       # of a length's need that one set of prices may cover
ETA = 3.0                        # how fast a covered length's price falls
FILLED = 0.9995                  # of a sequence: emptier configurations are left to the next solution


# ---- tokens -------------------------------------------------------------------------------------

#: Characters whose normal form, case and class Python and the library agree on are below U+0180;
#: texts with others, or with an added token, go through the library as a whole.
_OTHER = re.compile("[^\x00-\x1b\x20-įı-ſ]")
_WORDS = re.compile(r"[^\W\d_²³¹¼-¾]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼-¾]|"
                    r"(?:[^\s\w]|_)+")


class WordPieces(dict):
    """Lower-case piece -> ids as little-endian uint32 bytes, for a vocabulary with word ends."""

    def __init__(self, name: str, keep: int = KEEP):
        super().__init__()
        self.library, self.keep = library_tokenizer(vocabulary(name)), keep
        self.model, self.letters = self.library.model, byte_letters()
        self.added = [a.content for a in self.library.get_added_tokens_decoder().values()]

    def __missing__(self, piece: str) -> bytes:
        raw = piece if piece.isascii() else piece.encode().decode("latin-1")
        ids = [x.id for x in self.model.tokenize(raw if raw.isprintable() and raw.isascii() else raw.translate(self.letters))]
        value = array("I", ids).tobytes()
        if len(piece) <= LONG_PIECE:
            if len(self) >= self.keep:
                self.clear()
            self[piece] = value
        return value

    def ids(self, text: str) -> bytes:
        if (not text.isascii() or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text) \
                and _OTHER.search(text) or any(a in text for a in self.added):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, _WORDS.findall(text.lower())))


_MADE: dict[str, WordPieces] = {}


def word_pieces(name: str) -> WordPieces:
    """This process's cache for a vocabulary."""
    if name not in _MADE:
        _MADE[name] = WordPieces(name)
    return _MADE[name]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "word_bpe_49k.json", end_id: int = END_ID,
           ids: bool = False) -> DataFrame:
    """(doc_id, part, nth, piece, start, length, ids_crc32), and ``ids`` if asked for.

    ``part`` is the input partition, ``nth`` the piece's number among those of its length there."""
    schema = "doc_id bigint, part int, nth bigint, piece int, start bigint, length int, ids_crc32 bigint" + (
        ", ids array<int>" if ids else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = word_pieces(vocabulary), array("I", [end_id]).tobytes()
        seen, step = [0] * (capacity + 1), 4 * capacity
        for b in batches:
            out: list[list] = [[] for _ in names]
            for i, text, part in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                raw = cache.ids(text.as_py() or "") + end
                for p, at in enumerate(range(0, len(raw), step)):
                    cut = raw[at:at + step]
                    n = len(cut) // 4
                    for column, v in zip(out, (i, part, seen[n], p, at // 4, n, zlib.crc32(cut), cut)):
                        column.append(v)
                    seen[n] += 1
            if ids:
                ends = np.concatenate([[0], np.cumsum(out[5])]).astype(np.int32)
                out[7] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(out[7]), dtype="<i4")))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(out, types)] + out[7:], names=names)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.spark_partition_id().alias("part"))
    return rows.mapInArrow(run, schema)


# ---- the linear program -------------------------------------------------------------------------

Config = tuple[tuple[int, int], ...]                 # ((length, how many), ...), longest first


@dataclass
class Plan:
    """Configurations with the number of sequences of each, and the bound no plan goes below."""
    configs: list[tuple[Config, int]]
    bound: float

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.configs)


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, last): the dearest multiset within each capacity, and the index of an item in it (-1: none, the
    value is that of one token less). ``sizes`` ascend."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        k = upto[c]
        if k:
            v = value[c - sizes[:k]] + prices[:k]
            j = v.argmax()
            if v[j] > value[c]:
                value[c], last[c] = v[j], j
    return value, last


def _config(first: int, sizes: list[int], last: list[int], capacity: int) -> dict[int, int]:
    """Index -> how many, of the dearest configuration that holds item ``first``."""
    held, c = {first: 1}, capacity - sizes[first]
    while c > 0:
        j = last[c]
        if j < 0:
            c -= 1
        else:
            held[j] = held.get(j, 0) + 1
            c -= sizes[j]
    return held


def relaxed(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = ROUNDS, per_round: int = PER_ROUND,
            seed: int = 1) -> tuple[dict[Config, float], float]:
    """(configuration -> amount, lower bound): a fractional cover of ``need`` that covers nothing twice."""
    rng = np.random.default_rng(seed)
    left, whole, bound = need.astype(float), need.astype(float), 0.0
    taken: dict[Config, float] = {}
    size_list = sizes.tolist()
    for _ in range(rounds):
        open_ = np.flatnonzero(left > 1e-6)
        if not len(open_):
            break
        covered = 1 - left / whole
        # prices start at the lengths, the dual of a perfect fit; a little noise parts equal fits
        prices = sizes * np.exp(-ETA * (covered - covered.min())) * (1 + 1e-4 * rng.random(len(sizes)))
        value, _ = (knapsack(sizes, prices, capacity) if len(open_) == len(sizes) else (None, None))
        if value is not None:
            bound = max(bound, float(whole @ prices) / value[capacity])
        value, last = knapsack(sizes[open_], prices[open_], capacity)
        last_list = last.tolist()
        sizes_open = [size_list[j] for j in open_]
        worth, allowed = (left * sizes)[open_], np.minimum(left, RISE * whole)
        for f in np.argsort(-worth, kind="stable")[:per_round].tolist():
            held = _config(f, sizes_open, last_list, capacity)
            at = open_[list(held)]
            many = np.fromiter(held.values(), dtype=float)
            amount = min(SHARE * left[open_[f]] / held[f], (allowed[at] / many).min())
            if amount <= 1e-9:
                continue
            left[at] -= amount * many
            allowed[at] -= amount * many
            key = tuple(sorted(((size_list[j], int(n)) for j, n in zip(at, many)), reverse=True))
            taken[key] = taken.get(key, 0.0) + amount
    return taken, bound


def best_fit(need: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """Best fit decreasing by counts: equal lengths and equally filled sequences move together."""
    rooms: list[int] = []                                  # free space of the open classes, ascending
    classes: dict[int, list[tuple[Config, int]]] = {}

    def add(room: int, config: Config, n: int):
        if n:
            if room not in classes:
                insort(rooms, room)
                classes[room] = []
            classes[room].append((config, n))

    for size in sorted(need, reverse=True):
        r = need[size]
        while r:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                add(capacity, (), -(-r // (capacity // size)))
                continue
            room = rooms[at]
            config, n = classes[room].pop()
            if not classes[room]:
                del classes[room], rooms[at]
            m = room // size
            full = min(n, r // m)
            add(room - m * size, config + ((size, m),), full)
            r -= full * m
            n -= full
            if n and r:                                    # fewer than m are left: one sequence takes them
                add(room - r * size, config + ((size, r),), 1)
                r, n = 0, n - 1
            add(room, config, n)
    return [c for held in classes.values() for c in held if c[0]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """Sequences for ``histogram`` (length -> how many): the rounded linear program."""
    need = {s: n for s, n in histogram.items() if n and s < capacity}
    full = histogram.get(capacity, 0)
    out = [(((capacity, 1),), full)] if full else []
    bound = 0.0
    for k in range(SOLUTIONS):
        if not need:
            break
        sizes = np.array(sorted(need), dtype=np.int64)
        taken, b = relaxed(sizes, np.array([need[s] for s in sizes.tolist()]), capacity, rounds, seed=k + 1)
        bound = max(bound, b) if k == 0 else bound
        before = len(out)
        for config, amount in taken.items():
            if (n := int(amount + 1e-9)) and sum(s * m for s, m in config) >= FILLED * capacity:
                n = min([n] + [need.get(s, 0) // m for s, m in config])
                if n:
                    out.append((config, n))
                    for s, m in config:
                        need[s] -= n * m
        need = {s: n for s, n in need.items() if n}
        if len(out) == before:
            break
    return Plan(out + best_fit(need, capacity), bound + full)


@dataclass
class Slots:
    """The plan by length: sorted keys (length, rank of the first slot) and what follows from a rank."""
    key: np.ndarray
    first: np.ndarray
    per: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, plan: Plan) -> Slots:
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for config, n in plan.configs:
            offset = 0
            for size, m in config:
                first = used.get(size, 0)
                rows.append((size, first, m, sequence, offset))
                used[size] = first + n * m
                offset += size * m
            sequence += n
        rows.sort()
        size, first, per, seq, off = (np.array(c, dtype=np.int64) for c in (zip(*rows) if rows else [[]] * 5))
        return cls((size << 48) | first, first, per, seq, off)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence_id, offset) of the pieces with these lengths and ranks among their length."""
        at = np.searchsorted(self.key, (length << 48) | rank, side="right") - 1
        k = rank - self.first[at]
        return self.sequence[at] + k // self.per[at], self.offset[at] + k % self.per[at] * length


# ---- the join of pieces and slots -----------------------------------------------------------------

def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (written rows of ``pieces``) with sequence_id and offset."""
    counts = written(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("_n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = Slots.of(plan(histogram, capacity))
    spark = cut.sparkSession
    shared = spark.sparkContext.broadcast(slots)            # rows: at most configurations x lengths in one
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = written(counts.select("length", "part", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before")))
    ranked = cut.join(before, ["length", "part"]).withColumn("_rank", F.col("_before") + F.col("nth"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd
        s, o = shared.value.place(length.to_numpy(dtype=np.int64), rank.to_numpy(dtype=np.int64))
        return pd.DataFrame({"sequence_id": s, "offset": o})
    keep = [c for c in cut.columns if c not in ("part", "nth")]
    return ranked.select(*keep, place("length", "_rank").alias("_p")).select(*keep, "_p.sequence_id", "_p.offset")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "word_bpe_49k.json", end_id: int = END_ID,
         ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset) of every piece."""
    return assign(written(pieces(docs, capacity, vocabulary, end_id, ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences themselves, of ``pack(..., ids=True)``.
    A sequence has at most ``capacity`` tokens, so its group is small."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_r"))
    ids = F.flatten(F.transform("_r", lambda r: r["ids"]))
    return rows.select("sequence_id", F.size(ids).alias("n_tokens"), ids.alias("ids"))
