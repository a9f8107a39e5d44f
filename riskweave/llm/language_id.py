"""Language ID by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary have one probability per language. A
word's likelihood in a language is the sum over all its segmentations into
pieces of the product of their probabilities (forward algorithm); a text's is
the product over its words. The prediction is the language of largest
posterior, its score that posterior. Runs of letters are scored whole, however
long: the forward column is rescaled as it goes.

Learning is one expectation step per round: each word's expected piece counts
over all segmentations (forward-backward under the current model; at first all
pieces are alike) are added up per language where the documents lie, and only
(language, piece) sums leave a task. The fit reads at most ``per_language``
labelled documents of each language, those of smallest id hash. The model holds
languages x pieces numbers.

Words of one length go through the lattice together as columns of numbers.

Defined results: a null text, or one without a letter, is ``und`` with score
0; ties go to the smallest language name; a character outside the vocabulary
is a piece that no language knows; with nothing to learn from, every text is
``und``; an empty table gives an empty result; repeated rows are predicted alike;
languages are learned from non-null ``lang`` only, and no column but text is read
to predict.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import written
from riskweave.llm.pieces import vocabulary

PER_LANGUAGE = 5_000                  # labelled documents of a language in the fit, at most
BROADCAST_IDS = 500_000               # of sampled ids: above it they are joined by a shuffle
MARK = "▁"                            # the vocabulary's word start
KEEP_TOKENS = 120_000                 # tokens whose scores a process keeps
RESCALE = 8                           # letters between two rescalings of a forward column
AT_ONCE = 250_000                     # letters in the lattice at a time, one word at least
CHUNK = 1 << 20                       # characters of text scored at a time, one text at least
UNSEEN = 0.5                          # added to every piece's count
_B = np.uint64(0x9E3779B97F4A7C15)


def load_pieces(name: str) -> list[str]:
    """The letter pieces of a sentencepiece vocabulary, lower-cased, each once, in its order."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
    every = (sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return list(dict.fromkeys(p for p in every if p == MARK or p.removeprefix(MARK).isalpha()))


def letter_runs(token: str) -> list[str]:
    """Runs of letters, lower-cased, each marked as a word start."""
    if token.isalpha():
        return [MARK + token.lower()]
    return [MARK + r for r in "".join(c if c.isalpha() else " " for c in token).lower().split(" ") if r]


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), -1)


class Lattice:
    """Finds the pieces in many words at once. Piece numbers follow the vocabulary;
    the number after the last stands for a character outside it."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        hashes = np.zeros(self.n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i, p in enumerate(pieces):
                for c in p:
                    hashes[i] = hashes[i] * _B + np.uint64(ord(c) + 1)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def arcs(self, codes: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, rows, pieces) for each span, begins ascending: the words (rows) with a piece there."""
        m, n = codes.shape
        h = np.zeros((m, n), dtype=np.uint64)
        spans: list[list[tuple[int, int, np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        for size in range(1, min(n, self.longest) + 1):
            with np.errstate(over="ignore"):
                h = h[:, :n - size + 1] * _B + (codes[:, size - 1:].astype(np.uint64) + np.uint64(1))
            at = np.minimum(np.searchsorted(self.sorted, h), self.n - 1)
            found = self.sorted[at] == h
            if size == 1:
                piece = np.where(found, self.order[at], self.n)
                every = np.arange(m)
                for b in range(n):
                    spans[b].append((b, b + 1, every, piece[:, b]))
            else:
                for b in np.flatnonzero(found.any(axis=0)).tolist():
                    rows = np.flatnonzero(found[:, b])
                    spans[b].append((b, b + size, rows, self.order[at[rows, b]]))
        return [span for at_begin in spans for span in at_begin]

    def _forward(self, arcs: list, n: int, shape: tuple[int, ...], p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums, logs): the sum over all segmentations of each prefix is ``sums * exp(logs)``."""
        sums, logs = np.zeros((n + 1, *shape)), np.zeros((n + 1, *shape))
        sums[0] = 1
        scale, done = np.zeros(shape), 0
        for b, e, at, piece in arcs:
            while done < b:                                       # places that no later arc ends at
                done += 1
                if done % RESCALE == 0:
                    by = np.where(sums[done] > 0, sums[done], 1.0)
                    sums[done:done + self.longest] /= by
                    scale = scale + np.log(by)
                logs[done] = scale
            sums[e][at] += sums[b][at] * p[piece]
        logs[done + 1:] = scale
        return sums, logs

    def log_likelihood(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """log of the sum over all segmentations, per word and column of ``probs``
        (piece x language; the last row is the unknown character's)."""
        out = np.empty((len(words), probs.shape[1]))
        for rows, codes in _by_length(words):
            sums, logs = self._forward(self.arcs(codes), codes.shape[1], (len(rows), probs.shape[1]), probs)
            out[rows] = np.log(np.maximum(sums[-1], 1e-300)) + logs[-1]
        return out

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected piece counts over all segmentations of words that occur ``counts`` times (forward-backward)."""
        total = np.zeros(self.n + 1)
        for rows, codes in _by_length(words):
            n = codes.shape[1]
            arcs = self.arcs(codes)
            fwd, up = self._forward(arcs, n, (len(rows),), p)
            # the same from the end: places are counted backwards
            back = sorted(((n - e, n - b, at, piece) for b, e, at, piece in arcs), key=lambda a: a[0])
            bwd, down = self._forward(back, n, (len(rows),), p)
            whole = np.log(np.maximum(fwd[n], 1e-300)) + up[n]
            for b, e, at, piece in arcs:
                share = fwd[b][at] * p[piece] * bwd[n - e][at] * np.exp(up[b][at] + down[n - e][at] - whole[at])
                total += np.bincount(piece, weights=share * counts[rows[at]], minlength=self.n + 1)
        return total[:-1]


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the words, their code points) for groups of words of one length."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for n in np.unique(lengths).tolist():
        rows, some_rows = np.flatnonzero(lengths == n), max(1, AT_ONCE // n)
        for i in range(0, len(rows), some_rows):
            some = rows[i:i + some_rows]
            yield some, _codes([words[j] for j in some.tolist()])


@dataclass
class Model:
    """``probs[piece, language]`` (the last row: an unknown character), languages' names, log prior."""
    name: str
    languages: list[str]
    probs: np.ndarray
    prior: np.ndarray


_LATTICE: dict[str, Lattice] = {}


def lattice(name: str) -> Lattice:
    if name not in _LATTICE:
        _LATTICE[name] = Lattice(load_pieces(name))
    return _LATTICE[name]


def _expected_counts(labelled: DataFrame, name: str, model: Model | None) -> DataFrame:
    """(lang, piece, n) expected counts; piece -1 counts documents."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lat = lattice(name)
        flat = np.full(lat.n + 1, 1.0 / lat.n)
        flat[-1] = 1e-7
        probs = {} if model is None else {g: model.probs[:, j] for j, g in enumerate(model.languages)}
        tokens: dict[str, Counter] = {}
        docs: Counter = Counter()
        sums: dict[str, np.ndarray] = {}

        def settle():
            for lang, c in tokens.items():
                words: Counter = Counter()
                for token, n in c.items():
                    for w in letter_runs(token):
                        words[w] += n
                got = lat.expected(list(words), np.array(list(words.values()), dtype=float), probs.get(lang, flat))
                sums[lang] = sums.get(lang, 0) + got
            tokens.clear()

        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"]):
                docs[lang] += 1
                tokens.setdefault(lang, Counter()).update((text or "").split())
                if sum(map(len, tokens.values())) > KEEP_TOKENS:
                    settle()
        settle()
        for lang, v in sums.items():
            q = np.flatnonzero(v)
            yield pd.DataFrame({"lang": lang, "piece": q, "n": v[q]})
        yield pd.DataFrame([(g, -1, float(n)) for g, n in docs.items()], columns=["lang", "piece", "n"])

    return (labelled.mapInPandas(run, "lang string, piece long, n double")
                    .groupBy("lang", "piece").agg(F.sum("n").alias("n")))


def sampled(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(text, lang, n_docs) of at most ``per_language`` labelled documents of each language, those of smallest id
    hash; ``n_docs`` is how many the language has. Of rows that share an id and a language one text is read.

    A language's count gives a hash bound that keeps little more than it needs, so
    that no language is sorted as a whole, however many documents it has."""
    ids = docs.select("doc_id", "lang").where("doc_id is not null and lang is not null").distinct()
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    near = ids.join(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs")), "lang")
    near = near.where(place * F.col("n_docs") < per_language + 8 * per_language ** 0.5 + 16)
    first = Window.partitionBy("lang").orderBy(place, "doc_id")
    ids = near.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= per_language).drop("_k")
    ids = written(ids)                                        # a bounded number for each language
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = docs.select("doc_id", "lang", "text").join(ids, ["doc_id", "lang"])
    return rows.groupBy("doc_id", "lang", "n_docs").agg(F.min("text").alias("text")).select("text", "lang", "n_docs")


def train(labelled: DataFrame, vocabulary: str = "piece_bpe_32k.model", rounds: int = 1) -> Model | None:
    """Learn from rows (text, lang); the prior is by ``n_docs`` (documents of the language) where the rows have it,
    else by the rows. The sums that come back are at most languages x pieces. None if no row has a language."""
    labelled = labelled.where(F.col("lang").isNotNull())
    of = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.max("n_docs").alias("n")).collect()} \
        if "n_docs" in labelled.columns else None
    labelled = labelled.select("text", "lang")
    model, lat = None, lattice(vocabulary)
    for _ in range(rounds):
        got = _expected_counts(labelled, vocabulary, model).collect()
        languages = sorted({r["lang"] for r in got})
        if not languages:
            return None
        at = {g: j for j, g in enumerate(languages)}
        counts, docs = np.zeros((lat.n + 1, len(languages))), np.zeros(len(languages))
        for r in got:
            if r["piece"] < 0:
                docs[at[r["lang"]]] += r["n"]
            else:
                counts[r["piece"], at[r["lang"]]] += r["n"]
        probs = np.float32((counts + UNSEEN) / (counts + UNSEEN).sum(axis=0)).astype(float)   # sums may come in any order
        probs[-1] *= 1e-2
        if of:
            docs = np.array([of[g] for g in languages], dtype=float)
        model = Model(vocabulary, languages, probs, np.log(docs / docs.sum()))
    return model


class Scorer:
    """Log likelihoods of tokens, kept per process up to KEEP_TOKENS."""

    def __init__(self, model: Model):
        self.model, self.lat = model, lattice(model.name)
        self.clear()

    def clear(self):
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.languages) + 1))      # the last column: 1 if the token has a letter

    def learn(self, tokens: list[str]) -> None:
        words, owner = [], []
        got = np.zeros((len(tokens), self.rows.shape[1]))
        for i, t in enumerate(tokens):
            runs = letter_runs(t)
            words += runs
            owner += [i] * len(runs)
        if words:
            np.add.at(got[:, :-1], owner, self.lat.log_likelihood(words, self.model.probs))
            got[owner, -1] = 1
        self.at.update(zip(tokens, range(len(self.at), len(self.at) + len(tokens))))
        self.rows = np.concatenate([self.rows, got])

    def scores(self, texts: list[str]) -> np.ndarray:
        """Per text: log likelihood by language, and the number of tokens with a letter."""
        split = [t.split() for t in texts]
        every = set(chain.from_iterable(split))
        new = [t for t in every if t not in self.at]
        if len(self.at) + len(new) > KEEP_TOKENS:
            self.clear()
            new = list(every)
        if new:
            self.learn(sorted(new))
        out = np.zeros((len(texts), self.rows.shape[1]))
        for i, tokens in enumerate(split):
            if tokens:
                out[i] = self.rows[[self.at[t] for t in tokens]].sum(axis=0)
        return out


def predict(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """(keep..., lang_pred, score) from the text alone."""
    keep_cols = list(keep) or ["doc_id"]
    if model is None:
        return docs.select(*keep_cols, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)       # pieces x languages numbers

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        scorer = Scorer(m)
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            texts, sums, at = [t or "" for t in batch], [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (size == 0 or size + len(texts[end]) <= CHUNK):
                    size += len(texts[end])
                    end += 1
                sums.append(scorer.scores(texts[at:end]))
                at = end
            s = np.concatenate(sums) if sums else np.zeros((0, len(m.languages) + 1))
            total = s[:, :-1] + m.prior
            best = total.argmax(axis=1)                            # the first of equals
            p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            found = s[:, -1] > 0
            yield pd.DataFrame({"lang_pred": names[np.where(found, best, len(m.languages))],
                                "score": np.where(found, p, 0.0)})
    # so marked, it stays in its place: a filter on what it finds would score every text once more
    return docs.select(*keep_cols, run.asNondeterministic()("text").alias("_r")).select(*keep_cols, "_r.*")


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.0) -> DataFrame:
    """``docs`` without the rows that get no language (``und``) or, if asked for, one below
    ``least``; all of them where there was nothing to learn from."""
    if model is None:
        return docs
    cols = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), "text")
    return predict(row, model, "_row").where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("_row.*")


def with_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """``keep_identified``'s rows with the language found as their ``lang``; ``docs`` where there was nothing to learn from."""
    if model is None:
        return docs
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    found = predict(row, model, "_row").where(F.col("lang_pred") != "und")
    return found.select(*[F.col("lang_pred" if c == "lang" else f"_row.`{c}`").alias(c) for c in docs.columns])
