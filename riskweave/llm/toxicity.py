"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic
function of its words' weights, and a document's is the noisy-or of its
sentences: 1 - prod(1 - p). Weights are trained from document labels alone,
so the model learns which sentences carry a label; scoring gives both the
document's probability and the sentences that offend.

Training is a classifier fit on a bounded sample: at most ``per_class`` ids of
each label, those of smallest id hash, and of these at most ``max_chars``
characters of text: in hash order, an id whose text does not fit in what is left
is skipped, and only it. Where none fits, the shortest one is taken, so a label
with a document is always learned from. Words are features if at least
``least_docs`` documents hold the word; a sentence without any weighted word
has probability 0, so length alone raises no score.

Defined results: a null or empty text has no sentence and score 0; a null
label is not learned from; with only one label present every score is 0;
labels that repeat a doc_id count as several; only text is read to score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import written

PER_CLASS = 2_000                    # labelled ids of each label in the fit, at most
MAX_CHARS = 12_000_000               # characters of sample text of each label, at most, unless one document is longer
LEAST_DOCS = 5
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"\w+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences: up to a full stop, question or exclamation mark, or line end."""
    return [m.span() for m in _SENTENCE.finditer(text)]


def words(sentence: str) -> set[str]:
    return set(_WORD.findall(sentence.lower()))


def fit(bags: list[list[tuple[str, ...]]], labels: np.ndarray, least_docs: int = LEAST_DOCS, steps: int = 300,
        rate: float = 0.3, l1: float = 2e-4) -> dict[str, float]:
    """Weights by word ("" is the bias): gradient ascent on the noisy-or likelihood,
    both labels weighing the same, small weights shrunk to zero."""
    df: Counter = Counter()
    for bag in bags:
        df.update(set().union(*bag))
    names = sorted(w for w, n in df.items() if n >= least_docs)
    at = {w: j for j, w in enumerate(names)}
    sent, feat, doc = [], [], []
    for i, bag in enumerate(bags):
        for s in bag:
            known = [at[w] for w in s if w in at]
            if known:
                sent += [len(doc)] * len(known)
                feat += known
                doc.append(i)
    if not doc:
        return {}
    sent, feat, doc = np.array(sent), np.array(feat), np.array(doc)
    y = labels.astype(float)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, bias = np.zeros(len(names)), -4.0
    gw, gb = np.full(len(names), 1e-12), 1e-12
    for _ in range(steps):
        z = bias + np.bincount(sent, weights=w[feat], minlength=len(doc))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(bags))     # log prod(1 - p)
        whole = -np.expm1(none)
        # d log L / dz of a sentence: -p for a clean document, p (1 - P) / P for a toxic one
        pull = np.where(y == 1, np.exp(none) / np.maximum(whole, 1e-12), -1.0) * weight
        g = p * pull[doc]
        dw, db = np.bincount(feat, weights=g[sent], minlength=len(names)), g.sum()
        gw += dw * dw
        gb += db * db
        step = rate / np.sqrt(gw)
        w = w + step * dw
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        bias += rate * db / np.sqrt(gb)
    out = {n: float(x) for n, x in zip(names, w) if x}
    out[""] = float(bias)
    return out


def fitting(sizes: list[int], most: int) -> list[int]:
    """Places of those of ``sizes``, in turn, that fit in what is left of ``most``; the first smallest if none does."""
    out, left = [], most
    for i, n in enumerate(sizes):
        if n <= left:
            out.append(i)
            left -= n
    return out or [min(range(len(sizes)), key=sizes.__getitem__)]


def sampled(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, text, toxic) of at most ``per_class`` labelled ids of each label, by id hash,
    and at most ``max_chars`` characters of each label (``fitting``)."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    ids = None
    for y in (0, 1):
        part = rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    sample = written(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"))      # 2 x per_class ids

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id"], kind="stable")
        return pdf.iloc[fitting(pdf["n"].tolist(), max_chars)][["doc_id", "toxic"]]

    # one row per id and label: at most per_class in a group
    sizes = sample.groupBy("toxic", "doc_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n"),
                                                  F.xxhash64("doc_id").alias("h"))
    fit_ids = sizes.groupBy("toxic").applyInPandas(pick, sizes.select("doc_id", "toxic").schema)
    return sample.join(F.broadcast(fit_ids), ["doc_id", "toxic"], "left_semi").select("doc_id", "text", "toxic")


def train(sample: DataFrame, **settings) -> dict[str, float]:
    """Fit on a bounded sample (doc_id, text, toxic). One task fits; what comes back
    is one weight per word, "" being the bias."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["toxic", "doc_id", "text"], kind="stable")
        if pdf["toxic"].nunique() < 2:
            return pd.DataFrame(columns=["word", "weight"])
        same: dict[str, str] = {}                                     # one object per word
        bags = [[tuple(same.setdefault(w, w) for w in words(t[a:b])) for a, b in sentences(t)]
                for t in pdf["text"].fillna("")]
        got = fit(bags, pdf["toxic"].to_numpy(), **settings)
        return pd.DataFrame(sorted(got.items()), columns=["word", "weight"])

    return {r["word"]: r["weight"] for r in
            sample.groupBy(F.lit(0).alias("g")).applyInPandas(run, "word string, weight double").collect()}


def sentence_scores(text: str, weights: dict[str, float]) -> list[tuple[int, int, float]]:
    """(start, end, p) of the sentences with a weighted word."""
    out = []
    for a, b in sentences(text) if weights else []:
        z = [weights[w] for w in words(text[a:b]) if w in weights]
        if z:
            out.append((a, b, float(1 / (1 + np.exp(-(weights[""] + sum(z)))))))
    return out


def score(docs: DataFrame, weights: dict[str, float], cut: float = 0.5, *keep: str) -> DataFrame:
    """(keep..., score, offending): the document's probability and the spans of its
    sentences that alone reach ``cut``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)         # one number per word of the sample
    keep_cols = list(keep) or ["doc_id"]

    @F.pandas_udf("score double, offending array<struct<start: int, end: int, p: double>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for batch in texts:
            out = []
            for text in batch:
                got = sentence_scores(text or "", w)
                p = -float(np.expm1(sum(np.log1p(-min(x, 1 - 1e-12)) for _, _, x in got)))
                out.append((max(0.0, p), [{"start": a, "end": b, "p": x} for a, b, x in got if x >= cut]))
            yield pd.DataFrame(out, columns=["score", "offending"])
    return docs.select(*keep_cols, run("text").alias("_r")).select(*keep_cols, "_r.*")
