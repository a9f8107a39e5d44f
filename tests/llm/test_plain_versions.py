"""Registered queries and the pipeline against plain Python versions on a small folder of tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from riskweave.llm import language_id, quality_rules, queries, token_files, toxicity, winnowing
from riskweave.llm.common import scratch_path, written
from tests.llm.test_operators import (component_brute, count_brute, fingerprint_brute, line_brute, plain_predict,
                                      target_brute, words_of)

MAKE = {"en": ["the", "and", "thing", "with", "wonder", "house", "tree"], "fr": ["été", "que", "leaux", "monde", "maison", "arbre"]}
SHARED = "A line that several of the documents share as it is"


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels: two languages, copies, near copies, shared lines, junk, nulls, repeated rows."""
    rng = random.Random(11)
    rows, labels = [], []

    def text(lang, n):
        out = " ".join(rng.choice(MAKE[lang]) + rng.choice(["", "", "s", str(rng.randrange(9))]) for _ in range(n))
        return ". ".join(out[i:i + 60] for i in range(0, len(out), 60))
    for i in range(120):
        lang = ("en", "fr")[i % 2]
        t = text(lang, rng.randint(3, 150))
        if i % 9 == 0:
            t = t + "\n" + SHARED + "\nand one more of its own " + str(i)
        if i % 5 == 0:
            t += "\n" + "### $$$ %%% &&& ||| " * rng.randint(12, 30)
        if i % 7 == 0:
            t += ". how vile and rude"
        rows.append((i, t, lang if i % 11 else None, ("web", "book", "news", None)[i % 4], len(t)))
        labels.append((i, int(i % 5 != 0), int(i % 7 == 0)))
    base = rows[10][1] + " " + text("en", 120)
    for j in range(6):                                                # near copies, then copies
        w = base.split(" ")
        w[5 * j + 3] = f"edit{j}"
        rows.append((200 + j, " ".join(w), "en", "web", 0))
    rows += [(210 + j, base, "en", "book", 0) for j in range(4)]
    rows += [(300, None, "en", "web", 0), (301, "", "fr", "news", 0), (302, "12 ?? \n", None, "web", None), rows[3]]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4) \
         .write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, labels


def multiset(rows):
    return collections.Counter(map(tuple, rows))


# ---- op2: the learned list is applied as ordered conditions
def test_op2_query(spark, folder):
    path, rows, labels = folder
    got = queries.op2_quality_rules(spark, path).collect()
    counted = quality_rules.with_counts(spark.read.parquet(f"{path}/documents.parquet"))
    seen = spark.createDataFrame([(i, q) for i, q, _ in labels if not held_out(i)], "doc_id long, quality int")
    rules = quality_rules.train(counted.join(seen, "doc_id"))
    assert rules and sum(bad for _, bad, _ in rules) > 5
    names = dict(zip(quality_rules.COUNTS, range(len(quality_rules.COUNTS))))

    def value(c, counts):
        top, under = quality_rules.FEATURES[c.feature]
        return counts[names[top]] / (1 if under is None else max(1, counts[names[under]]))
    want = []
    for i, t, *_ in rows:
        counts, base = quality_rules.text_counts(t or ""), count_brute(t)
        assert counts[:5] == base
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        hit = any(all((value(c, counts) > c.cut) == c.above for c in rule) for rule, _, _ in rules)
        want.append((i, *base, failed, not failed and not hit))
    assert multiset(tuple(r)[:8] for r in got) == multiset(want)
    assert any(w[7] for w in want) and any(not w[6] and not w[7] for w in want)


# ---- op4: likeness of fingerprints
def test_op4_query(spark, folder):
    path, rows, _ = folder
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0], r[1]))

    def alike(a, b):
        x, y = (set(fingerprint_brute(t, winnowing.K, winnowing.W)[0]) if t else set() for t in (a, b))
        return len(x & y) / len(x | y) if x and y else float(len(x) == len(y))
    want = []
    for j, (i, t) in enumerate(order):
        after = order[(j + 1) % len(order)][1]
        edited = t[:len(t) - len(t) // 4] + after[:len(t) // 4]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(alike(t, edited), 12), round(alike(t, after), 12)))
    got = queries.op4_winnowing(spark, path).collect()
    assert multiset((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 12), round(r.near_next, 12)) for r in got) == multiset(want)
    same = {r.doc_id: r.fingerprint for r in got}
    assert same[210] == same[211] != same[200]


# ---- op8: fit and score by the plain likelihood
def plain_fit(bags, labels, least_docs, steps, rate=0.3, l1=2e-4):
    """Gradient ascent on the noisy-or likelihood with per-weight steps, word by word."""
    df = collections.Counter(w for bag in bags for w in set().union(*bag))
    w = {n: 0.0 for n, k in df.items() if k >= least_docs}
    b, gw, gb = -4.0, {n: 1e-12 for n in w}, 1e-12
    share = {y: 0.5 / max(1, sum(1 for x in labels if x == y)) for y in (0, 1)}
    for _ in range(steps):
        dw, db = dict.fromkeys(w, 0.0), 0.0
        for bag, y in zip(bags, labels):
            sents = [s for s in bag if any(x in w for x in s)]
            ps = [1 / (1 + math.exp(-(b + sum(w[x] for x in s if x in w)))) for s in sents]
            none = math.prod(1 - p for p in ps)
            pull = (none / max(1 - none, 1e-12) if y else -1.0) * share[y]
            for s, p in zip(sents, ps):
                db += p * pull
                for x in s:
                    if x in w:
                        dw[x] += p * pull
        gb += db * db
        b += rate * db / math.sqrt(gb)
        for x in w:
            gw[x] += dw[x] ** 2
            step = rate / math.sqrt(gw[x])
            v = w[x] + step * dw[x]
            w[x] = math.copysign(max(abs(v) - step * l1, 0.0), v)
    return {**{x: v for x, v in w.items() if v}, "": b}


def bag_of(text):
    return [tuple(sorted(set(re.findall(r"\w+", s.lower())))) for s in re.findall(r"[^.!?\n]+[.!?]*", text or "")]


def test_toxicity_fit_is_the_plain_one(folder):
    _, rows, labels = folder
    toxic = {i: y for i, _, y in labels}
    some = [(bag_of(t), toxic[i]) for i, t, *_ in rows[:60]]
    bags, y = [b for b, _ in some], [v for _, v in some]
    got = toxicity.fit(bags, np.array(y), 5, 25)
    want = plain_fit(bags, y, 5, 25)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-9) for k in got)


def test_op8_query(spark, folder):
    path, rows, labels = folder
    got = queries.op8_toxicity(spark, path).collect()
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = spark.createDataFrame([(i, y) for i, _, y in labels if not held_out(i)], "doc_id long, toxic int")
    weights = toxicity.train(toxicity.sampled(docs, seen))
    want = []
    for i, t, *_ in rows:
        p = [1 / (1 + math.exp(-(weights[""] + sum(weights[x] for x in s if x in weights)))) for s in bag_of(t) if any(x in weights for x in s)]
        want.append((i, held_out(i), round(1 - math.prod(1 - x for x in p), 9), sum(x >= 0.5 for x in p)))
    assert multiset((r.doc_id, r.held_out, round(r.score, 9), r.n_offending) for r in got) == multiset(want)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    toxic = {i: y for i, _, y in labels}
    assert all(bool(r.predicted) == bool(toxic[r.doc_id]) for r in got if r.doc_id in toxic)


def test_toxicity_of_awkward_tables(spark):
    """Ties, repeated labels, an empty table, columns with names of the results."""
    schema = "doc_id long, text string, score double, offending int"
    df = spark.createDataFrame([(1, "vile thing", 0.0, 1), (1, "vile thing", 0.0, 1), (2, None, None, None), (3, "calm", 9.0, 9)], schema)
    got = toxicity.score(df.select("doc_id", "text"), {"vile": 9.0, "": -1.0}).collect()
    assert sorted((r.doc_id, r.score > 0.9) for r in got) == [(1, True), (1, True), (2, False), (3, False)]
    assert toxicity.score(df.limit(0).select("doc_id", "text"), {"vile": 9.0, "": -1.0}).collect() == []
    twice = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (3, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    sample = toxicity.sampled(df.select("doc_id", "text"), twice)
    assert {(r.doc_id, r.toxic) for r in sample.collect()} == {(1, 1), (3, 0)}


# ---- op5: what the footers say, and that pages are skipped
def test_op5_query(spark, folder, tmp_path):
    path, rows, _ = folder
    from tokenizers import Tokenizer
    import public_tokenizers
    stock = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for i, t in sorted((i, t or "") for i, t, *_ in rows):
        ids = stock.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op5_token_files(spark, path).collect())) == want


@pytest.mark.parametrize("encoding, expected", [("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_footers_and_page_skipping(spark, tmp_path, encoding, expected):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words for "), F.col("id").cast("string")).alias("text"))
    path = str(tmp_path / encoding)
    token_files.write_tokens(docs.coalesce(1), path, encoding=encoding, row_group_bytes=8 << 10, page_rows=50)
    files = sorted(p for p in (tmp_path / encoding).iterdir() if p.suffix == ".parquet")
    md = pq.ParquetFile(files[0]).metadata
    assert md.num_row_groups > 1
    for g in range(md.num_row_groups):
        for c in range(md.num_columns):
            col = md.row_group(g).column(c)
            assert col.has_offset_index and (col.has_column_index or "ids" in col.path_in_schema)
            if "ids" in col.path_in_schema:
                assert expected in col.encodings
                assert md.row_group(g).num_rows < 4000
    tokens = token_files.read_tokens(spark, path)

    def rows_scanned(df):
        plan = df._jdf.queryExecution().executedPlan()
        df.collect()
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return plan and leaf.metrics().apply("numOutputRows").value()
    one = tokens.where("doc_id = 77").select("doc_id", "n_tokens")
    assert one.count() == 1 and rows_scanned(one) <= 200 < rows_scanned(tokens.select("doc_id"))
    assert "ids" not in one._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


# ---- op6, op7, op9: the queries themselves
def test_op6_query(spark, folder):
    path, rows, _ = folder
    got = queries.op6_token_counts(spark, path).collect()
    per = collections.Counter()
    for r in got:
        per[r.doc_id] += r.n_tokens
    want = collections.Counter()
    from tokenizers import Tokenizer
    import public_tokenizers
    stock = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t, *_ in rows:
        want[i] += len(stock.encode(t or "", add_special_tokens=False).ids)
    assert +per == +want and {r.doc_id for r in got} == {i for i, *_ in rows}


def test_op7_query(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = language_id.train(language_id.sampled(docs.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0")))
    names = {q: i for i, q in enumerate(language_id.load_pieces(model.name))}
    got = queries.op7_language_id(spark, path).collect()
    want = multiset((i, held_out(i), plain_predict(t, model, names)[0]) for i, t, *_ in rows)
    assert multiset((r.doc_id, r.held_out, r.lang_pred) for r in got) == want
    truth = {i: ("en", "fr")[i % 2] for i in range(120)}
    judged = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert sum(judged) >= 0.95 * len(judged)


def byte_bpe():
    import base64
    import public_tokenizers
    import tiktoken
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op9_query(spark, folder):
    path, rows, _ = folder
    own, sha = byte_bpe(), lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert multiset(queries.op9_byte_bpe(spark, path).collect()) == multiset(want)


# ---- the pipeline
def plain_pipeline(rows, model):
    """The five stages over (doc_id, text, source) rows, one after the other, in plain Python."""
    names = {q: i for i, q in enumerate(language_id.load_pieces(model.name))}
    rows = [(i, t, s) for i, t, _, s, _ in rows if plain_predict(t, model, names)[0] != "und"]
    source = {i: s for i, _, s in rows}
    rows = [(i, t) for i, _, _, t in line_brute([(i, t) for i, t, _ in rows])]
    comp = component_brute(rows, 5, 80, 100)
    stay, seen = [], set()
    for i, t in rows:
        if not words_of(t):
            stay.append((i, t))                                       # nothing to compare: it stays
        elif comp[i][1] == i and (i, t) not in seen:
            seen.add((i, t))
            stay.append((i, t))
    sizes = collections.Counter()
    for i, t in stay:
        sizes[source[i]] += len(words_of(t))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = target_brute(sizes, {s: 1 + j % 3 for j, s in enumerate(order)}, 3)
    own, out = byte_bpe(), []
    for s in sizes:
        mine = []
        for i, t in stay:
            if source[i] == s:
                w = words_of(t)
                weight = 0.1 + 0.9 * len(set(w)) / len(w) if w else 0.1
                u = (int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
                mine.append((-math.log(u) / weight, i, len(w), t))
        epochs = min(3, math.floor(target[s] / sizes[s] + 1e-9)) if sizes[s] else 0
        budget, upto = target[s] - epochs * sizes[s], 0
        for _, i, n, t in sorted(mine):
            upto += n
            copies = min(3, epochs + (budget > 0 and upto - n / 2 <= budget))
            out += [(i, s, tuple(own.encode_ordinary(t)))] * (copies if n else 0)
    return out


def test_pipeline_against_the_plain_version(spark, folder):
    import corpus_pipeline as P
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = language_id.train(language_id.sampled(docs.where(~queries.held_out())))
    got = P.run(spark, path).collect()
    assert all(r.exact and r.n_tokens == len(r.ids) for r in got)
    assert multiset((r.doc_id, r.source, tuple(r.ids)) for r in got) == multiset(plain_pipeline(rows, model))
    assert len({r.doc_id for r in got} & set(range(200, 214))) == 1    # of copies and near copies one document stays


def test_pipeline_results_hold_the_language_found(spark, folder):
    """What the first stage finds reaches the token rows: each has the language of its whole text, labelled or not."""
    import corpus_pipeline as P
    path, rows, _ = folder
    model = language_id.train(language_id.sampled(spark.read.parquet(f"{path}/documents.parquet").where(~queries.held_out())))
    names = {q: i for i, q in enumerate(language_id.load_pieces(model.name))}
    want = {i: plain_predict(t, model, names)[0] for i, t, *_ in rows}
    got = P.run(spark, path).collect()
    assert {r.lang for r in got} == {"en", "fr"} and all(r.lang == want[r.doc_id] for r in got)


def test_pipeline_stages_take_awkward_tables(spark, folder):
    """Empty tables and columns with clashing names go through every stage."""
    import corpus_pipeline as P
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    odd = docs.withColumn("t", F.lit(1)).withColumn("row", F.lit("x")).withColumn("copies", F.lit(None).cast("int")).withColumn("_k", F.lit(2))
    for table_ in (docs.limit(0), odd):
        for _, stage in P.STAGES[:4]:
            table_ = written(stage(spark, table_, path))
        assert set(table_.columns) >= set(docs.columns)
        assert P.STAGES[4][1](spark, table_, path).count() == table_.count()
    assert scratch_path(spark).startswith(spark.sparkContext.getCheckpointDir())
