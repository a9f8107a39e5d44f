"""Exact quantiles with linear interpolation, all ranks of all columns at once.

1. One pass takes a mergeable sketch (KLL) of every column and the counts. With
   many partitions the sketches are merged in two levels, so no task takes one
   from every partition. The sketch gives a bracket of values for each rank.
2. One pass counts the rows below each bracket and at its ends, and adds up equal
   values between them, map side first. A bracket of one value (a flag, a small
   count) has only its counts: no row is made for it.
3. The values inside are few (the brackets' width is a share of the rows that
   the sketch bounds): they come to the driver where their bound is at most
   ``gather``. Where it isn't, they are written, range-partitioned by bracket
   and value, and only the partition that holds a rank is summed up.

The counts show whether a bracket holds its rank; a sketch's error bound holds
in all but about one case in a million, and the bracket is widened then.

Interpolation follows Spark's ``percentile``: position = q*(n-1), value =
(hi-pos)*v[lo] + (pos-lo)*v[hi].
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from riskweave.functions.sizes import partitions_for
from riskweave.session import cut_lineage

SKETCH_K = 4096                  # KLL size: a rank error of about 0.1 % of the rows
RANK_ERROR = 0.0025              # more than the sketch errs in all but rare cases
BRACKET_LIMIT = 200_000          # values brought to the driver
FAN_IN = 64                      # partitions whose sketches one task merges at once
RANGE_ROWS = 500_000             # values in a partition of the ranked table


def _valid(c: str) -> Column:
    col = F.col(c).cast("double")
    return F.when(col.isNotNull() & ~F.isnan(col), col)


def _interp(pos: float, v_lo: float, v_hi: float) -> float:
    lo, hi = math.floor(pos), math.ceil(pos)
    if lo == hi or v_lo == v_hi:
        return float(v_lo)
    return (hi - pos) * float(v_lo) + (pos - lo) * float(v_hi)


@dataclass
class Bracket:
    """Values ``low`` <= v <= ``high`` of a column, among which the ranks (0-based) lie."""
    column: int
    ranks: tuple[int, ...]
    low: float
    high: float
    below: int = 0

    @property
    def wide(self) -> bool:
        """Whether values can lie between its ends."""
        return self.low < self.high

    def inside(self, x: Column) -> Column:
        return (x > F.lit(self.low)) & (x < F.lit(self.high))


def _sketches(df: DataFrame, m: int) -> DataFrame:
    """One row: _rows, and n<j> and s<j> (count and sketch) of each column _0 ... _m-1."""
    count = [F.count(F.lit(1)).alias("_rows"), *[F.count(f"_{j}").alias(f"n{j}") for j in range(m)]]
    sketch = [F.kll_sketch_agg_double(f"_{j}", F.lit(SKETCH_K)).alias(f"s{j}") for j in range(m)]
    parts = partitions_for(df)
    if parts <= FAN_IN:
        return df.agg(*count, *sketch)
    level = df.groupBy((F.spark_partition_id() % max(FAN_IN, math.isqrt(parts))).alias("_g")).agg(*count, *sketch)
    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return level.agg(total("_rows"), *[total(f"n{j}") for j in range(m)],
                     *[F.kll_merge_agg_double(F.when(F.col(f"n{j}") > 0, F.col(f"s{j}"))).alias(f"s{j}") for j in range(m)])


def _counted(df: DataFrame, brackets: list[Bracket], n_rows: int, direct: bool) -> tuple[list | DataFrame | None, list[tuple]]:
    """Rows (k, v, n): how often each value between the ends of bracket k occurs, and the same of the ends themselves;
    sets the brackets' ``below``. The first are collected where ``direct``, else a written table; None if no bracket is wide."""
    names: dict[tuple, str] = {}                              # (column, end, how) -> name of a count

    def asked(column: int, end: float, how: str) -> str:
        return names.setdefault((column, end, how), f"c{len(names)}")
    counts = [(asked(b.column, b.low, "below"), asked(b.column, b.low, "at"), asked(b.column, b.high, "at")) for b in brackets]
    sums = [F.count(F.when(F.col(f"_{j}") < F.lit(v) if how == "below" else F.col(f"_{j}") == F.lit(v), 1)).alias(name)
            for (j, v, how), name in names.items()]
    wide = [F.when(b.inside(F.col(f"_{b.column}")), F.struct(F.lit(k).alias("k"), F.col(f"_{b.column}").alias("v")))
            for k, b in enumerate(brackets) if b.wide]
    out, got = None, {}
    if wide:
        seen = Observation()
        rows = df.observe(seen, F.count(F.lit(1)).alias("n"), *sums)
        rows = rows.select(F.explode(F.array_compact(F.array(*wide))).alias("_x")).select("_x.k", "_x.v")
        rows = rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
        out = rows.collect() if direct else cut_lineage(rows)
        empty = not out if direct else out.isEmpty()
        # a plan without result rows drops what was observed; tasks that ran again after a loss are observed twice
        got = seen.get if not empty else {}
    if got.get("n") != n_rows:
        got = df.agg(*sums).first().asDict()
    ends = []
    for k, (b, (below, low, high)) in enumerate(zip(brackets, counts)):
        b.below = got[below]
        at = {b.low + 0.0: got[low], b.high + 0.0: got[high]}         # no negative zero
        ends += [(k, v, n) for v, n in at.items() if n]
    return out, ends


def _pick(rows: list[tuple[float, int]], want: list[int]) -> dict[int, float]:
    """Values at the places ``want`` (ascending) of the multiset ``rows`` (value, how often); missing if beyond it."""
    out, upto, i = {}, 0, 0
    for v, n in sorted(rows):
        upto += n
        while i < len(want) and want[i] < upto:
            if want[i] >= 0:                       # a place before the bracket is none of its values
                out[want[i]] = v
            i += 1
    return out


def _ranked(table: DataFrame, ends: list[tuple], brackets: list[Bracket]) -> list[dict[int, float]]:
    """As ``_pick`` for each bracket, without bringing the values between its ends to the driver."""
    if ends:
        table = table.unionByName(table.sparkSession.createDataFrame(ends, "k int, v double, n long"))
    parts = max(1, -(-table.count() // RANGE_ROWS))
    ranged = cut_lineage(table.repartitionByRange(parts, "k", "v").withColumn("_p", F.spark_partition_id()))
    sums = ranged.groupBy("k", "_p").agg(F.sum("n").alias("n")).collect()      # at most partitions + brackets rows
    asked = []                                                                 # (bracket, partition, place in it, place)
    for k, b in enumerate(brackets):
        upto = 0
        for r in sorted((r for r in sums if r["k"] == k), key=lambda r: r["_p"]):
            asked += [(k, r["_p"], w - b.below - upto, w) for w in b.ranks if upto <= w - b.below < upto + r["n"]]
            upto += r["n"]
    out: list[dict[int, float]] = [{} for _ in brackets]
    if not asked:
        return out
    # a row per rank, joined: as a condition they would be more code than Spark can compile
    spark = table.sparkSession
    want = spark.createDataFrame([(i, k, p, place) for i, (k, p, place, _) in enumerate(asked)], "_i int, k int, _p int, _place long")
    parts_asked = F.broadcast(want.select("k", "_p").distinct())
    order = Window.partitionBy("k", "_p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.join(parts_asked, ["k", "_p"]).withColumn("_end", F.sum("n").over(order))
    hit = found.join(F.broadcast(want), ["k", "_p"]).where((F.col("_end") > F.col("_place")) & (F.col("_end") - F.col("n") <= F.col("_place")))
    for r in hit.select("_i", "v").collect():                                  # a row per rank
        k, _, _, w = asked[r["_i"]]
        out[k][w - brackets[k].below] = r["v"]
    return out


def exact_quantiles(df: DataFrame, cols, qs, *, bracket_limit: int = BRACKET_LIMIT, counts: dict | None = None,
                    error: float = RANK_ERROR) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles ``qs`` of each column in ``cols``.

    Returns {column: [value per q]} with None for a column without values (null and NaN are none).
    ``counts``, when given, receives {column: number of valid values} and
    ``"__rows__"``: the number of rows (same pass, no extra job).
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    qs = [float(q) for q in ([qs] if isinstance(qs, (int, float)) else qs)]
    if not cols:
        return {}
    narrow = df.select(*[_valid(c).alias(f"_{j}") for j, c in enumerate(cols)])
    probes = sorted({p for q in qs for p in (max(q - error, 0.0), min(q + error, 1.0))})
    ask = F.array(*[F.lit(p) for p in probes])
    sk = _sketches(narrow, len(cols))
    sk = sk.select("_rows", *[f"n{j}" for j in range(len(cols))], *[
        F.when(F.col(f"n{j}") > 0, F.kll_sketch_get_quantile_double(F.col(f"s{j}"), ask)).alias(f"p{j}") for j in range(len(cols))])
    stats = sk.first()
    if counts is not None:                       # valid values per column, and all rows
        counts.update({c: stats[f"n{j}"] for j, c in enumerate(cols)})
        counts["__rows__"] = stats["_rows"]

    asked: dict[tuple, set[int]] = {}             # (column, low, high) -> ranks
    values: dict[tuple[int, int], float] = {}
    for j in range(len(cols)):
        n = stats[f"n{j}"]
        at = dict(zip(probes, stats[f"p{j}"] or []))
        few = n * error < 2                       # the margin is under two rows: all values are looked at
        for q in qs if n else []:
            pos = q * (n - 1)
            # the outer brackets are open, whatever the sketch kept
            low = -math.inf if few or q <= error else at[q - error]
            high = math.inf if few or q >= 1 - error else at[q + error]
            asked.setdefault((j, low, high), set()).update((math.floor(pos), math.ceil(pos)))
    brackets = [Bracket(j, tuple(sorted(ranks)), low, high) for (j, low, high), ranks in asked.items()]
    bound = sum(4 * error * stats[f"n{b.column}"] + 8 for b in brackets if b.wide)
    tries = 0
    while brackets:
        direct = bound <= bracket_limit
        rows, ends = _counted(narrow, brackets, stats["_rows"], direct)
        if direct or rows is None:
            held: list[list[tuple[float, int]]] = [[] for _ in brackets]
            for k, v, n in chain(rows or [], ends):
                held[k].append((v, n))
            picked = [_pick(h, [w - b.below for w in b.ranks]) for h, b in zip(held, brackets)]
        else:
            picked = _ranked(rows, ends, brackets)
        wider: list[Bracket] = []
        for b, got in zip(brackets, picked):
            for w in b.ranks:
                if w - b.below in got:
                    values[b.column, w] = got[w - b.below]
            if any((b.column, w) not in values for w in b.ranks):
                wider.append(Bracket(b.column, b.ranks, -math.inf if tries or b.below > min(b.ranks) else b.low,
                                     math.inf if tries or b.below <= min(b.ranks) else b.high))
        brackets, tries, bound = wider, tries + 1, math.inf
    out: dict[str, list[float | None]] = {}
    for j, c in enumerate(cols):
        n = stats[f"n{j}"]
        out[c] = [_interp(q * (n - 1), values[j, math.floor(q * (n - 1))], values[j, math.ceil(q * (n - 1))]) if n else None
                  for q in qs]
    return out


def exact_quantile(df: DataFrame, col: str, q: float, **kw) -> float | None:
    return exact_quantiles(df, [col], [q], **kw)[col][0]
