"""Token counts per section, from one encoding of the whole document.

A document is encoded once; every token has a character span (offset mapping).
Sections are character intervals, sorted and disjoint; each token is joined to
the sections its span meets by binary search over their starts. A token that
crosses a boundary goes to one section by rule:

* ``start``: the section that holds its first character (default),
* ``end``: the section that holds its last character,
* ``most``: the section that holds most of its characters, the first of equals.

Counts of the sections add up to the document's token count: characters
between sections count for the section before them (for the first one, if
there is none before).

Defined results: a null or empty text has one empty section with no tokens; a
token that is part of one character lies where that character lies; repeated
rows give repeated results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.pieces import PieceCache, library_spans

RULES = ("start", "end", "most")


def token_spans(text: str, cache: PieceCache) -> tuple[np.ndarray, np.ndarray]:
    """Character starts and ends of the tokens of a whole text."""
    pieces = cache.split.findall(text)
    if not pieces:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    got = cache.each(pieces)
    counts = np.fromiter((len(s) for s, _ in got), dtype=np.int64, count=len(got)) // 4
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    base = np.repeat(np.cumsum(lengths) - lengths, counts)
    start = np.frombuffer(b"".join([s for s, _ in got]), dtype="<i4")
    end = np.frombuffer(b"".join([e for _, e in got]), dtype="<i4")
    return base + start, base + end


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str = "start") -> np.ndarray:
    """Tokens per section; ``sections``: sorted starts, the first 0."""
    first = np.searchsorted(sections, starts, side="right") - 1
    last = np.searchsorted(sections, np.maximum(ends - 1, starts), side="right") - 1
    first, last = np.maximum(first, 0), np.maximum(last, 0)
    if rule == "start":
        at = first
    elif rule == "end":
        at = last
    else:
        at = first.copy()
        for j in np.flatnonzero(first != last).tolist():         # only tokens that cross a boundary
            cut = np.concatenate([[starts[j]], sections[first[j] + 1:last[j] + 1], [ends[j]]])
            at[j] = first[j] + int(np.argmax(np.diff(cut)))
    return np.bincount(at, minlength=len(sections))


def line_sections(text: str) -> np.ndarray:
    """Starts of the lines of a text (each with the line feed that ends it)."""
    at, out = text.find("\n"), [0]
    while at >= 0 and at + 1 < len(text):
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(out, dtype=np.int64)


def section_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", rule: str = "start",
                   sections=line_sections) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_doc_tokens): a row per section of every text,
    numbered from 0, with its character interval."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    schema = "doc_id bigint, section int, start bigint, end bigint, n_tokens bigint, n_doc_tokens bigint"
    names = ["doc_id", "section", "start", "end", "n_tokens", "n_doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = library_spans(vocabulary)
        for b in batches:
            out, size = [], 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                s, e = token_spans(text, cache)
                at = sections(text)
                n = attribute(s, e, at, rule)
                out.append((i, at, np.append(at[1:], len(text)), n, len(s)))
                size += len(at)
                if size >= 100_000:
                    yield table(out)
                    out, size = [], 0
            if out:
                yield table(out)

    def table(out) -> pa.RecordBatch:
        k = [len(o[1]) for o in out]
        cols = [pa.array([o[0] for o in out], type=pa.int64()).take(pa.array(np.repeat(np.arange(len(out)), k))),
                pa.array(np.concatenate([np.arange(x) for x in k]).astype(np.int32)),
                *[pa.array(np.concatenate([o[j] for o in out]).astype(np.int64)) for j in (1, 2, 3)],
                pa.array(np.repeat([o[4] for o in out], k).astype(np.int64))]
        return pa.RecordBatch.from_arrays(cols, names=names)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)
