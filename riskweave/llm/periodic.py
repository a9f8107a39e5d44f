"""Periodic runs of words, found by recompression (Jez 2015) without suffix arrays.

A run is a stretch of consecutive words with smallest period q, at least
``max(least, 2 q)`` words long, that no neighbouring word extends.

Words are numbered and the sequence is compressed in rounds, in turn by
replacing maximal blocks of one symbol by a (symbol, length) symbol and by
replacing pairs whose first symbol is drawn "left" and second "right". What
results is a run-length grammar of about log n levels. Equal stretches are
parsed alike except near their ends, so the longest common extension of two
places is found by walking up the levels while the symbols agree and down
where they first differ, one step a level; blocks are skipped whole.

Every run of period p and length >= 2 p holds two places of the grid
0, p, 2p, ... one after the other, the first of them among its first p words.
So for each p the grid's neighbours with equal words are candidates (harmonic
numbers: n ln n of them at most), extended exactly to both sides. Of candidates
with the same bounds the smallest period counts.

Texts are handled in groups of about ``GROUP`` words, parted by symbols that
occur once; a longer text is a group by itself. Memory follows the longest text.

Defined results: null, empty and blank texts have no words and no runs; ties
(equal rows) are found each by itself; null doc_ids stay null; an empty table
gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST = 12                           # words in the shortest run
GROUP = 200_000                      # words compressed together
GRID = 4_000_000                     # grid neighbours looked at together
TOP = 32                             # a level this short is the last


@dataclass
class Level:
    """One level of the grammar: its symbols and how the next level covers them."""
    symbols: np.ndarray
    parent: np.ndarray | None = None          # index of the symbol above that holds each
    lo: np.ndarray | None = None              # first symbol below of each symbol above, and the end
    blocks: bool = False                      # whether the next level holds blocks (else pairs)


def _drawn_left(symbols: np.ndarray, salt: int) -> np.ndarray:
    """A coin for each symbol, the same wherever the symbol stands."""
    with np.errstate(over="ignore"):
        z = (symbols.astype(np.uint64) + np.uint64(2 * salt + 1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (z >> np.uint64(40)) & np.uint64(1) == 1


def grammar(symbols: np.ndarray) -> list[Level]:
    """Levels from the words up. ``symbols`` begins and ends with one that occurs once."""
    levels, s = [], symbols.astype(np.int64)
    for salt in range(200):
        if len(s) <= TOP:
            break
        blocks = salt % 2 == 0
        if blocks:
            heads = np.empty(len(s), dtype=bool)
            heads[0] = True
            np.not_equal(s[1:], s[:-1], out=heads[1:])
        else:
            left = _drawn_left(s, salt)
            heads = np.empty(len(s), dtype=bool)
            heads[0] = True
            np.logical_not(left[:-1] & ~left[1:], out=heads[1:])
        starts = np.flatnonzero(heads)
        if len(starts) == len(s):                             # nothing to replace at this level
            continue
        lo = np.append(starts, len(s)).astype(np.int32)
        size = np.diff(lo)
        # a new symbol's name: its first symbol with its length (block) or its second symbol (pair)
        second = size if blocks else np.where(size > 1, s[np.minimum(starts + 1, len(s) - 1)] + 1, 0)
        names = pd.factorize(s[starts] * (int(second.max()) + 1) + second)[0]
        levels.append(Level(s, (np.cumsum(heads) - 1).astype(np.int32), lo, blocks))
        s = names.astype(np.int64)
    levels.append(Level(s))
    return levels


def extension(levels: list[Level], i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
    """How many symbols agree from places i and j on (i < j), forward from them or backward up to them."""
    step = 1 if forward else -1
    a, b = i.astype(np.int64), j.astype(np.int64)
    stop = np.zeros(len(a), dtype=np.int16)                   # level at which the symbols differ
    live = np.arange(len(a))
    for k, level in enumerate(levels):
        s = level.symbols
        if level.parent is None:                              # the top: symbol by symbol
            stop[live] = k
            while len(live):
                live = live[s[a[live]] == s[b[live]]]
                a[live] += step
                b[live] += step
            break
        same = s[a[live]] == s[b[live]]
        stop[live] = k
        live = live[same]
        if not len(live):
            break
        x, y = a[live], b[live]
        px, py = level.parent[x], level.parent[y]
        if forward:
            at_edge = (level.lo[px] == x) & (level.lo[py] == y)
            rx, ry = level.lo[px + 1] - x, level.lo[py + 1] - y
        else:
            at_edge = (level.lo[px + 1] - 1 == x) & (level.lo[py + 1] - 1 == y)
            rx, ry = x - level.lo[px] + 1, y - level.lo[py] + 1
        if level.blocks:
            move, up = np.minimum(rx, ry), at_edge | (rx == ry)
        else:
            move, up = np.ones(len(x), dtype=np.int64), np.ones(len(x), dtype=bool)
        move = np.where(at_edge, 0, move)
        x, y = x + step * move, y + step * move
        a[live], b[live] = np.where(up, level.parent[x], x), np.where(up, level.parent[y], y)
        live = live[up]
    for k in range(len(levels) - 1, 0, -1):                   # down: at most one agreeing step a level
        low = levels[k - 1]
        at = np.flatnonzero(stop >= k)
        if not len(at):
            continue
        edge = 0 if forward else 1
        x = low.lo[a[at] + edge].astype(np.int64) - edge
        y = low.lo[b[at] + edge].astype(np.int64) - edge
        same = low.symbols[x] == low.symbols[y]
        if low.blocks:
            nx, ny = low.lo[a[at] + 1] - low.lo[a[at]], low.lo[b[at] + 1] - low.lo[b[at]]
            move = np.where(same, np.minimum(nx, ny), 0)
        else:
            move = same.astype(np.int64)
        a[at], b[at] = x + step * move, y + step * move
    return (a - i) * step


_GRID: list[np.ndarray] = []


def _neighbours(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of all grid neighbours (place, place + period) that could lie in a run among n words."""
    keep = 1 << 14
    if not _GRID:
        p = np.concatenate([np.full((keep - 1) // q, q, dtype=np.int32) for q in range(1, keep // 2 + 1)])
        k = np.concatenate([np.arange((keep - 1) // q, dtype=np.int32) for q in range(1, keep // 2 + 1)])
        order = np.argsort(p * k + p, kind="stable")          # by the second place: a prefix holds all below n
        place, period = (p * k)[order], p[order]
        _GRID.extend([place, period, np.searchsorted((place + period), np.arange(keep + 1))])
    if n <= keep:
        end = _GRID[2][n]
        place, period = _GRID[0][:end], _GRID[1][:end]
        ok = period <= n // 2
        yield place[ok], period[ok]
        return
    q, half = 1, n // 2
    while q <= half:                                          # long texts: some periods at a time
        last, held = q, 0
        while last <= half and held < GRID:
            held += (n - 1) // last
            last += 1
        period = np.arange(q, last, dtype=np.int64)
        counts = (n - 1) // period
        periods = np.repeat(period, counts)
        nth = np.arange(len(periods)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield periods * nth, periods
        q = last


def group_runs(texts: list[list[str]], least: int = LEAST) -> list[np.ndarray]:
    """For each list of words its runs, rows (start, length, period) by start, then period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    codes = pd.factorize(np.array([w for t in texts for w in t], dtype=object))[0].astype(np.int64)
    ends = np.cumsum(sizes)
    first = ends - sizes + np.arange(1, len(texts) + 1)        # places after the separators before them
    symbols = np.empty(len(codes) + len(texts) + 1, dtype=np.int64)
    top = int(codes.max()) + 1 if len(codes) else 0
    parts = np.append(first - 1, len(symbols) - 1)
    word = np.ones(len(symbols), dtype=bool)
    word[parts] = False
    symbols[word] = codes
    symbols[parts] = top + np.arange(len(parts))
    found: list[tuple[np.ndarray, ...]] = []
    levels: list[Level] | None = None
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0
    for t, (n, f) in enumerate(zip(sizes.tolist(), first.tolist())):
        if n < least:
            continue
        local = symbols[f:f + n]
        for place, period in _neighbours(n):
            same = np.flatnonzero(local[place] == local[place + period])
            if len(same):
                held.append((place[same] + f, period[same], np.full(len(same), t, dtype=np.int32)))
                waiting += len(same)
            if waiting > GRID // 4:                            # very repetitive: extend as we go
                levels = levels or grammar(symbols)
                found.append(_extended(levels, held, least))
                held, waiting = [], 0
    if held:
        levels = levels or grammar(symbols)
        found.append(_extended(levels, held, least))
    out = [np.empty((0, 3), dtype=np.int64)] * len(texts)
    if not found:
        return out
    t, start, length, period = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((period, length, start, t))             # of equal bounds the smallest period comes first
    t, start, length, period = t[order], start[order], length[order], period[order]
    new = np.ones(len(t), dtype=bool)
    new[1:] = (t[1:] != t[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    t, start, length, period = t[new], start[new] - first[t[new]], length[new], period[new]
    order = np.lexsort((period, start, t))
    rows = np.stack([start, length, period], axis=1)[order]
    cut = np.searchsorted(t[order], np.arange(len(texts) + 1))
    for k in np.unique(t).tolist():
        out[k] = rows[cut[k]:cut[k + 1]]
    return out


def _extended(levels: list[Level], held: list, least: int) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of the candidates that are runs, each once."""
    i, p, t = (np.concatenate(c).astype(np.int64) for c in zip(*held))
    j = i + p
    ahead = extension(levels, i, j, True)
    behind = extension(levels, i - 1, j - 1, False)
    length = behind + p + ahead
    ok = (length >= 2 * p) & (length >= least)
    rows = np.unique(np.stack([t, i - behind, length, p], axis=1)[ok], axis=0)
    return tuple(rows.T)


def collapsed(words: list[str], runs: np.ndarray) -> list[str]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return [words[k] for k in keep.tolist()]


_BLANKS = "\t\n\x0b\x0c\r"


def split_words(doc_id: int | None, text: str) -> list[str]:
    """Maximal stretches without ASCII white space."""
    for c in _BLANKS:
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def with_periodic_tail(doc_id: int | None, text: str) -> list[str]:
    """The words of a text, with a periodic tail in a tenth of the ids (those whose crc32 ends in 0)."""
    words = split_words(doc_id, text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a:a + p]
    return words[:a] + (period * ((n - a) // p + 1))[:n - a]


SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, least: int = LEAST,
                  words: Callable[[int | None, str], list[str]] = split_words) -> DataFrame:
    """(doc_id, n_words, runs by start and period, collapsed text) of every document. ``words`` cuts a text."""
    def rows(ids: list, texts: list[list[str]]) -> pa.RecordBatch:
        runs = group_runs(texts, least)
        every = np.concatenate(runs) if runs else np.empty((0, 3), dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
        flat = pa.StructArray.from_arrays([pa.array(every[:, c]) for c in range(3)], fields=list(_RUN))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, type=pa.int64()), pa.array([len(t) for t in texts], type=pa.int64()),
             pa.ListArray.from_arrays(pa.array(ends), flat),
             pa.array([" ".join(collapsed(t, r)) for t, r in zip(texts, runs)], type=pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, held = [], [], 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                w = words(i, text.as_py() or "")
                if ids and held + len(w) > GROUP:
                    yield rows(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(w)
                held += len(w)
            if ids:
                yield rows(ids, texts)
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, SCHEMA)
