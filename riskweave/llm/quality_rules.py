"""Quality rules: a decision list learned by sequential covering.

Statistics of a text are counted in one pass. From labelled statistics,
conjunctions of thresholds are grown one condition at a time by information
gain on a growing part, pruned backwards on a pruning part, and added while
they are precise; what a rule covers is taken out before the next one grows.
The list is applied as one ordered conditional expression; a text that no rule
covers is kept.

Defined results: a null text has no words and all counts 0; it fails the base
rule. Rows with a null label are not learned from; with one label only, the
list is empty and the base rule decides alone. Repeated rows give repeated
results; only text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import BLANKS
from riskweave.llm.shingles import gram_hashes, word_hashes

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines"]
FEATURES = {                                        # name: numerator and denominator among the counts
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "upper_per_char": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "words": ("n_words", None),
}
MAX_ROWS = 20_000                                   # labelled rows in the fit, at most


def repeat_words(words: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    g = gram_hashes(words, 3)
    if len(g) == 0:
        return 0
    _, where, n = np.unique(g, return_inverse=True, return_counts=True)
    again = n[where] > 1
    cover = np.zeros(len(words), dtype=bool)
    for j in range(3):
        cover[j:j + len(g)] |= again
    return int(cover.sum())


def text_counts(text: str) -> tuple[int, ...]:
    """The counts of COUNTS, in order."""
    words = word_hashes(text.encode("utf-8", "surrogatepass"), fold=False)
    seen, again, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            again += line in seen
            seen.add(line)
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), again,
            repeat_words(words), sum(map(str.isupper, text)), text.count("!") + text.count("?"), lines)


def with_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep..., counts of every whole text)."""
    keep_cols = list(keep) or ["doc_id"]

    @F.pandas_udf(", ".join(f"{c} bigint" for c in COUNTS))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([text_counts(t or "") for t in batch], columns=COUNTS)
    return docs.select(*keep_cols, run("text").alias("_r")).select(*keep_cols, "_r.*")


def feature(name: str) -> Column:
    top, under = FEATURES[name]
    return F.col(top).cast("double") if under is None else F.col(top) / F.greatest(F.col(under), F.lit(1))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool                                      # value > cut, else value <= cut
    cut: float

    def of(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut

    def column(self) -> Column:
        c = feature(self.feature)
        return c > self.cut if self.above else c <= self.cut

    def __str__(self):
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.4g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, dtype=bool)
    for c in rule:
        hit &= c.of(x)
    return hit


def _best(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of largest FOIL gain within ``inside``: bad rows kept, times the rise in log precision."""
    p0, n0 = bad[inside].sum(), inside.sum()
    base = np.log2(max(p0, 1e-9) / n0)
    best: tuple[float, Condition | None] = (1e-9, None)
    for name in sorted(x):
        v = x[name][inside]
        order = np.argsort(v, kind="stable")
        v, b = v[order], bad[inside][order]
        steps = np.flatnonzero(v[1:] > v[:-1])              # a cut between two different values
        if len(steps) == 0:
            continue
        low_p = np.cumsum(b)[steps]
        low_n = steps + 1.0
        for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
            gain = p * (np.log2(np.maximum(p, 1e-9) / n) - base)
            j = int(np.argmax(gain))
            if gain[j] > best[0]:
                best = float(gain[j]), Condition(name, above, float((v[steps[j]] + v[steps[j] + 1]) / 2))
    return best


def grow(x: dict[str, np.ndarray], bad: np.ndarray, longest: int) -> Rule:
    """Add conditions until only bad rows are covered, nothing helps, or ``longest`` is reached."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < longest and not bad[inside].all():
        _, c = _best(x, bad, inside)
        if c is None:
            break
        rule.append(c)
        inside &= c.of(x)
    return tuple(rule)


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that is worth most on held-back rows: (bad - good) / covered."""
    def worth(r: Rule) -> float:
        hit = _covers(r, x, len(bad))
        return (bad[hit].sum() - (~bad)[hit].sum()) / hit.sum() if hit.any() else -1.0
    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=rule)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, least: int = 5, longest: int = 4,
          most_rules: int = 20, seed: int = 3) -> list[tuple[Rule, int, int]]:
    """Ordered rules for bad rows, each with the bad and good rows it covered when
    added. A rule joins if it covers ``least`` bad rows at ``precision`` over all rows left."""
    bad = bad.astype(bool)
    left, out = np.ones(len(bad), dtype=bool), []
    rng = np.random.default_rng(seed)
    hold = rng.random(len(bad)) < 1 / 3
    while len(out) < most_rules and bad[left].any():
        g, p = left & ~hold, left & hold
        if not bad[g].any():
            break
        rule = grow({k: v[g] for k, v in x.items()}, bad[g], longest)
        if not rule:
            break
        rule = prune(rule, {k: v[p] for k, v in x.items()}, bad[p])
        hit = _covers(rule, x, len(bad)) & left
        n_bad, n_good = int(bad[hit].sum()), int((~bad)[hit].sum())
        if n_bad < least or n_bad < precision * (n_bad + n_good):
            break
        out.append((rule, n_bad, n_good))
        left &= ~hit
    return out


def train(labelled: DataFrame, max_rows: int = MAX_ROWS, **settings) -> list[tuple[Rule, int, int]]:
    """Learn from rows with the counts and ``quality`` (0: bad), at most ``max_rows`` of
    them by id hash, without those that fail the base rule. One task learns; the
    rules come back as numbers."""
    rows = labelled.where(F.col("quality").isin(0, 1) & ~base_failed())
    rows = rows.select("doc_id", F.col("quality").cast("int").alias("quality"), *[feature(f).alias(f) for f in FEATURES])
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", *FEATURES], kind="stable")
        x = {f: pdf[f].to_numpy() for f in FEATURES}
        out = [(i, j, c.feature, c.above, c.cut, n_bad, n_good)
               for i, (rule, n_bad, n_good) in enumerate(learn(x, (pdf["quality"] == 0).to_numpy(), **settings))
               for j, c in enumerate(rule)]
        return pd.DataFrame(out, columns=["rule", "place", "feature", "above", "cut", "n_bad", "n_good"])

    got = sample.groupBy(F.lit(0).alias("g")).applyInPandas(
        run, "rule int, place int, feature string, above boolean, cut double, n_bad long, n_good long").collect()
    rules: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r["rule"], r["place"])):
        rules.setdefault(r["rule"], []).append(r)
    return [(tuple(Condition(r["feature"], r["above"], r["cut"]) for r in rs), rs[0]["n_bad"], rs[0]["n_good"])
            for _, rs in sorted(rules.items())]


def verdict(rules: list[tuple[Rule, int, int]]) -> tuple[Column, Column]:
    """(number of the first rule that holds, null if none; its text): ordered conditional expressions."""
    number, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (rule, _, _) in reversed(list(enumerate(rules))):
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column()
        number = F.when(holds, F.lit(i)).otherwise(number)
        text = F.when(holds, F.lit(" and ".join(map(str, rule)))).otherwise(text)
    return number, text


def apply(counted: DataFrame, rules: list[tuple[Rule, int, int]]) -> DataFrame:
    """Counted rows with base_failed, kept, and the rule that rejected a row."""
    number, text = verdict(rules)
    out = counted.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), text))
    return out.withColumn("kept", ~F.col("base_failed") & number.isNull())
