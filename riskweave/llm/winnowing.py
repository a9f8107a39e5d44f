"""Document fingerprints by winnowing (Schleimer, Wilkerson, Aiken 2003).

Rolling hashes of all ``k``-grams of code points; of every window of ``w``
consecutive hashes the smallest is kept, the rightmost of equal ones, with its
position. Two texts that share a run of ``w + k - 1`` code points share a
fingerprint; no match shorter than ``k`` is seen.

Defined results: a null text is empty; an empty text has no fingerprint; a
text shorter than ``k`` has one, the hash of the whole text; two empty texts
are alike (1), an empty and a non-empty one are not (0).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import scattered
from riskweave.llm.shingles import mix64

K, W = 16, 32
_B = np.uint64(0x9E3779B97F4A7C15 | 1)


def gram_hashes(text: str, k: int = K) -> np.ndarray:
    """uint32 hash of every k-gram of code points, in order: the rolling
    polynomial, put together from blocks of doubled length."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(c) - k + 1
    if n < 1:
        return np.empty(0, dtype=np.uint32)
    with np.errstate(over="ignore"):
        block, length, power = c, 1, _B               # block[i]: hash of c[i : i + length]
        total, done, left = None, 0, k
        while left:
            if left & 1:
                piece = block[done:done + n]
                total = piece if total is None else total * power + piece
                done += length
            left >>= 1
            if left:
                block = block[:-length] * power + block[length:]
                power, length = power * power, 2 * length
        return (mix64(total) >> np.uint64(32)).astype(np.uint32)


def window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by blocks of doubled length."""
    length = 1
    while 2 * length <= w:
        v = np.minimum(v[:-length], v[length:])
        length *= 2
    return np.minimum(v[:len(v) - (w - length)], v[w - length:]) if w > length else v


def fingerprint(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes uint32, positions int64), by position. With fewer than ``w``
    k-grams the one window there is gives one fingerprint."""
    if not text:
        return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
    h = gram_hashes(text, k)
    if len(h) == 0:
        h = gram_hashes(text, len(text))
    n = len(h)
    back = np.uint64(n - 1) - np.arange(n, dtype=np.uint64)           # larger position = smaller value: rightmost tie
    v = (h.astype(np.uint64) << np.uint64(32)) | back if n <= 1 << 32 else None
    m = window_min(v, min(w, n))
    m = m[np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))]
    return (m >> np.uint64(32)).astype(np.uint32), (n - 1 - (m & np.uint64(0xFFFFFFFF)).astype(np.int64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints' distinct hashes."""
    a, b = np.unique(a), np.unique(b)
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def packed(hashes: np.ndarray, at: np.ndarray) -> str:
    """Text form: base64 of each hash (4 bytes) and the gap to the position before
    (1 byte up to 254, else 255 and 8 bytes)."""
    gaps = np.diff(at, prepend=0)
    if len(gaps) and gaps.max() > 254:
        raw = b"".join(int(h).to_bytes(4, "little") + (bytes([g]) if g < 255 else b"\xff" + int(g).to_bytes(8, "little"))
                       for h, g in zip(hashes.tolist(), gaps.tolist()))
    else:
        rec = np.empty((len(hashes), 5), dtype=np.uint8)
        rec[:, :4] = hashes.astype("<u4").view(np.uint8).reshape(-1, 4)
        rec[:, 4] = gaps
        raw = rec.tobytes()
    return base64.b64encode(raw).decode()


def unpacked(text: str) -> tuple[list[int], list[int]]:
    """(hashes, positions) of ``packed``'s text."""
    raw, i, hashes, at = base64.b64decode(text), 0, [], []
    while i < len(raw):
        hashes.append(int.from_bytes(raw[i:i + 4], "little"))
        g, i = raw[i + 4], i + 5
        if g == 255:
            g, i = int.from_bytes(raw[i:i + 8], "little"), i + 8
        at.append((at[-1] if at else 0) + g)
    return hashes, at


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """(doc_id, hash, position): the fingerprints of every text, a row each."""
    @F.pandas_udf("array<struct<hash: bigint, position: bigint>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[{"hash": int(h), "position": int(p)} for h, p in zip(*fingerprint(t or "", k, w))]
                             for t in batch])
    return docs.select("doc_id", F.explode(run("text")).alias("_f")).select("doc_id", "_f.*")


FIRST_ID = -(1 << 63)


def with_next(docs: DataFrame, compare, schema: str) -> DataFrame:
    """Apply ``compare(text, next_text) -> tuple`` to every document and the next one by
    ascending doc_id (null first, ties by text; after the last comes the first).

    One shuffle of the texts: id ranges are cut at ids that exist, and each range
    also gets a copy of the document that follows it (the first of the next
    range), so a task walks its sorted range holding two texts at a time."""
    n = scattered(docs)
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST_ID))
    ids = docs.select(key.alias("i")).agg(
        F.percentile_approx("i", [j / n for j in range(1, n)] or [0.5], 20 * max(n, 500)).alias("c"),
        F.min("i").alias("lo")).first()
    if ids["lo"] is None:
        return docs.sparkSession.createDataFrame([], schema)
    cuts = sorted({c for c in ids["c"] if c > ids["lo"]}) if n > 1 else []
    rows = docs.select(key.alias("i"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    edges = np.array(cuts, dtype=np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), side="right").astype(np.int32))

    rows = rows.withColumn("part", place("i"))
    rows = rows.withColumn("head", F.when(F.col("i") == ids["lo"], F.lit(len(cuts)))
                           .when(F.col("i").isin(cuts), F.col("part") - 1))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("head").cast("int").alias("part"), F.lit(True).alias("guest"))
    rows = rows.select("i", "doc_id", "text", F.explode(
        F.when(F.col("head").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("_p"))
    rows = (rows.select("_p.part", "_p.guest", "i", "doc_id", "text")
                .repartitionById(len(cuts) + 1, F.col("part"))
                .sortWithinPartitions("part", "guest", "i", "text"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None                                         # the document that waits for its next one
        for pdf in batches:
            out = []
            for p, g, i, text in zip(pdf["part"], pdf["guest"], pdf["doc_id"], pdf["text"]):
                if held is not None and held[0] == p:
                    out.append((held[1], *compare(held[2], text)))
                held = None if g else (p, i, text)          # of several guests only the first is a next one
            yield pd.DataFrame(out, columns=names)

    names = [f.split()[0] for f in schema.split(", ")]
    return rows.mapInPandas(walk, schema)


def compare_edited(text: str, after: str) -> tuple:
    """(n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)
    for the text, and the text with its last quarter replaced by the next one's start."""
    cut = len(text) // 4
    edited = text[:len(text) - cut] + after[:cut]
    a, b, c = fingerprint(text), fingerprint(edited), fingerprint(after)
    return (len(text), hashlib.sha256(edited.encode()).hexdigest(), packed(*a), packed(*b),
            likeness(a[0], b[0]), likeness(a[0], c[0]))
