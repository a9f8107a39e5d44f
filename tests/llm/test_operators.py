"""Operators against plain Python versions on small tables with awkward rows."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import (bpe, language_id, line_dedup, mixing, ngram_join, partenum, pieces, quality_rules, shingles,
                           token_counts, token_files, toxicity, winnowing)
from riskweave.llm.common import scratch_path

BLANK = " \t\n\x0b\x0c\r"
# columns whose names the operators use inside, and a null in every column
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, h1 int, part string, sig int, _id int"


def words_of(text):
    return (text or "").encode().split()


def texts():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(40, 160))) for _ in range(12)]
    out = [None, "", "one", "two words", "\n\n", " \t ", "A shared LINE of text\nown line number one", "  a shared line of text  \nx",
           "A shared line of text\nA shared line of text\nlast", "🙂 'll <|endoftext|> ½ ²", "###$$$ %%% 12,000 !!!"]
    for b in base:
        w = b.split(" ")
        out += [b, b, b.upper()]                                         # copies, and one in another case
        for k in (1, 2, 6):
            v = list(w)
            for _ in range(k):
                v[rng.randrange(len(v))] = "edit" + str(rng.randrange(9))
            out.append(" ".join(v))
    out.append("long " * 60_000)
    out.append("x" * 70_000)
    return out


def table(spark, more=()):
    rows = [(i, t, ("en", "fr", None)[i % 3], (None, "a", "b", "ü")[i % 4], None, 1, 2, "p", 3, 4)
            for i, t in enumerate([*texts(), *more])]
    rows.append(rows[6])                                                 # a repeated row
    rows.append((None, "no id at all", None, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


def got(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, r[key] or 0))


# ---- line dedup
def line_brute(rows):
    owner, out = {}, []
    key = lambda s: s.strip(BLANK).translate({c: c + 32 for c in range(65, 91)})
    ids = lambda i: math.inf if i is None else i
    for i, t in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 10:
                owner[key(s)] = min(owner.get(key(s), math.inf), ids(i))
    for i, t in rows:
        ls = (t or "").split("\n")
        stay = [s for s in ls if len(key(s)) < 10 or owner[key(s)] == ids(i)]
        out.append((i, len(ls), len(ls) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2)])
def test_line_dedup(spark, docs, batches, fanout):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = line_dedup.dedup_lines(docs, batches, fanout)
    assert sorted(map(tuple, out.collect()), key=str) == line_brute(rows)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_documents_keeps_columns(spark, docs):
    out = line_dedup.dedup_documents(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {(r.doc_id, r.text) for r in out.collect()} == {(i, t) for i, _, _, t in line_brute(
        [(r.doc_id, r.text) for r in docs.collect()])}


# ---- quality rules
def count_brute(t):
    t = t or ""
    w = words_of(t)
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {j + k for j in range(len(w) - 2) if tri[w[j], w[j + 1], w[j + 2]] > 1 for k in range(3)}
    ls = [s for s in t.split("\n") if s.strip(BLANK)]
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(cover))


def test_quality_counts(docs):
    for r in quality_rules.with_counts(docs, "doc_id", "text").collect():
        assert tuple(r)[2:7] == count_brute(r.text)


def test_quality_rules_learn_a_planted_list():
    rng = np.random.default_rng(1)
    x = {f: rng.random(3000) for f in quality_rules.FEATURES}
    bad = (x["symbols_per_word"] > 0.8) | ((x["marks_per_word"] > 0.7) & (x["upper_per_char"] > 0.6))
    rules = quality_rules.learn(x, bad)
    hit = np.zeros(3000, dtype=bool)
    for rule, n_bad, n_good in rules:
        assert n_bad >= 9 * n_good
        hit |= quality_rules._covers(rule, x, 3000)
    assert (hit == bad).mean() > 0.97 and quality_rules.learn(x, np.zeros(3000)) == []


def test_quality_rules_apply(spark, docs):
    counted = quality_rules.with_counts(docs)
    assert quality_rules.train(counted.withColumn("quality", F.lit(None).cast("int"))) == []
    rule = ((quality_rules.Condition("symbols_per_word", True, 0.5),), 9, 0)
    for r in quality_rules.apply(counted, [rule]).collect():
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == base and r.kept == (not base and r.n_symbols / max(1, r.n_words) <= 0.5)
    assert quality_rules.apply(quality_rules.with_counts(empty(spark)), [rule]).count() == 0


# ---- mixing
def target_brute(sizes, weights, cap):
    target, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
            free.discard(s)
    return target


def test_mixing(spark, docs):
    rows = got(mixing.mix(docs))
    assert rows == got(mixing.mix(docs.repartition(3)))                  # reruns agree
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = target_brute(sizes, {s: 1 + j % 3 for j, s in enumerate(order)}, 3)
    taken = collections.Counter()
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    biggest = max(r["size"] for r in rows)
    assert all(abs(taken[s] - want[s]) <= biggest / 2 + 1 for s in sizes)
    for s in sizes:                                                      # complete epochs, then a prefix by key
        own = sorted((r["key"], r["doc_id"] is None, r["doc_id"], r["copies"]) for r in rows if r["source"] == s)
        copies = [o[3] for o in own]
        assert max(copies) - min(copies) <= 1 and copies == sorted(copies, reverse=True)
    assert mixing.mix(empty(spark)).count() == 0


def test_mixed_documents(docs):
    n = collections.Counter()
    for r in mixing.mix(docs).collect():
        n[r.doc_id] += r.copies * (r.size > 0)
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    assert collections.Counter(r.doc_id for r in out.collect()) == +n


@pytest.mark.parametrize("null_id", [False, True])
def test_mix_of_equal_rows(spark, null_id):
    """A budget that ends among equal rows takes as many of them as it has room for, whatever partition they are in."""
    text = "ten words that are the same in all of them"
    rows = [(None if null_id else 5, text, "a", k) for k in range(100)] + [(k, "w " * 10, "b", 0) for k in range(1000, 1020)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(7)
    for weights in ((1, 2), (1, 9), (7, 1)):
        mixed = mixing.mix(df, weights)
        got_rows = mixed.collect()
        assert len(got_rows) == 120
        for source in "ab":
            own = [r for r in got_rows if r["source"] == source]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5
            assert max(r["copies"] for r in own) - min(r["copies"] for r in own) <= 1
        want = collections.Counter({s: sum(r["copies"] for r in got_rows if r["source"] == s) for s in "ab"})
        out = mixing.mix_documents(df, weights).collect()
        assert collections.Counter(r["source"] for r in out) == want
        assert out and set(out[0].asDict()) == {"doc_id", "text", "source", "size"}


# ---- winnowing
def fingerprint_brute(t, k, w):
    grams = winnowing.gram_hashes(t, k).tolist() or winnowing.gram_hashes(t, len(t)).tolist()
    kept = []
    for j in range(max(1, len(grams) - w + 1)):
        win = grams[j:j + w]
        at = max(i for i, h in enumerate(win) if h == min(win)) + j
        if at not in kept:
            kept.append(at)
    return [grams[i] for i in kept], kept


def test_winnowing_against_every_window():
    rng = random.Random(2)
    for n in (1, 2, 15, 16, 17, 40, 47, 48, 300):
        for alphabet in ("a", "ab", "abcdefgé日"):
            t = "".join(rng.choice(alphabet) for _ in range(n))
            h, p = winnowing.fingerprint(t, 8, 5)
            assert (h.tolist(), p.tolist()) == fingerprint_brute(t, 8, 5)
            assert winnowing.unpacked(winnowing.packed(h, p)) == (h.tolist(), p.tolist())


def test_winnowing_gram_hash_depends_on_the_gram_alone():
    a, b = winnowing.gram_hashes("xxabcdefgh", 7), winnowing.gram_hashes("abcdefgh", 7)
    assert a[2:].tolist() == b.tolist()


def test_winnowing_guarantee():
    rng = random.Random(3)
    for _ in range(50):
        shared = "".join(rng.choice("abcdefgh ") for _ in range(winnowing.K + winnowing.W - 1))
        a = "".join(rng.choice("qrstuv") for _ in range(rng.randint(0, 200)))
        b = "".join(rng.choice("QRSTUV") for _ in range(rng.randint(0, 200)))
        assert set(winnowing.fingerprint(a + shared + b)[0]) & set(winnowing.fingerprint(b + shared + a)[0])


EDITED = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def test_with_next(spark, docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for j, (i, t) in enumerate(rows):
        after, cut = rows[(j + 1) % len(rows)][1], len(t) // 4
        edited = t[:len(t) - cut] + after[:cut]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    out = winnowing.with_next(docs, winnowing.compare_edited, EDITED).collect()
    assert sorted([tuple(r)[:3] for r in out], key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert winnowing.with_next(empty(spark), winnowing.compare_edited, EDITED).count() == 0
    one = spark.createDataFrame([(7, "alone here")], "doc_id long, text string")
    assert winnowing.with_next(one, winnowing.compare_edited, EDITED).first().near_next == 1.0


# ---- token files and counts
@pytest.fixture(scope="module")
def library():
    return pieces.library_tokenizer(pieces.vocabulary("byte_bpe_50k.json"))


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, library, encoding):
    path = scratch_path(spark, "test_tokens")
    token_files.write_tokens(docs, path, encoding=encoding)
    files = token_files.read_tokens(spark, path)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start, want = 0, []
    for i, t in rows:
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [2], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    out = [tuple(r) for r in token_files.index(files).collect()]
    assert sorted(out, key=lambda r: r[1]) == want
    plan = files.where("doc_id = 3").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1] and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in plan


def test_token_files_empty(spark):
    path = scratch_path(spark, "test_tokens")
    token_files.write_tokens(empty(spark), path)
    assert token_files.index(token_files.read_tokens(spark, path)).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, docs, library, rule):
    out = collections.defaultdict(list)
    for r in token_counts.section_counts(docs, rule=rule).where("doc_id is not null and doc_id <> 6").collect():
        out[r.doc_id].append((r.section, r.start, r.end, r.n_tokens, r.n_doc_tokens))
    for d in docs.where("doc_id is not null and doc_id <> 6").collect():
        t = d.text or ""
        spans = library.encode(t, add_special_tokens=False).offsets
        cuts = [0] + [j + 1 for j, c in enumerate(t) if c == "\n" and j + 1 < len(t)]
        ends = cuts[1:] + [len(t)]
        n = [0] * len(cuts)
        for a, b in spans:
            inside = [max(0, min(b, e) - max(a, s)) for s, e in zip(cuts, ends)]
            has = [j for j, (s, e) in enumerate(zip(cuts, ends)) if inside[j] or (a == b and s <= a < e)] or [0]
            n[{"start": has[0], "end": has[-1], "most": max(has, key=lambda j: (inside[j], -j))}[rule]] += 1
        assert sorted(out[d.doc_id]) == [(j, s, e, k, len(spans)) for j, (s, e, k) in enumerate(zip(cuts, ends, n))]
    assert token_counts.section_counts(empty(spark)).count() == 0


# ---- byte-level BPE
def test_bpe(spark, docs):
    import public_tokenizers
    import tiktoken
    with open(pieces.vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d in docs.collect():
        ids = own.encode_ordinary(d.text or "")
        want.append((d.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((d.text or "").encode())))
    assert sorted(map(tuple, bpe.round_trip(docs).collect()), key=str) == sorted(want, key=str)
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in back) == sorted((str(d.doc_id), (d.text or "").encode()) for d in docs.collect())
    assert bpe.round_trip(empty(spark)).count() == 0


def test_encode_checked(spark, docs):
    """A pipeline stage: ids by document with its source, and whether they decode to the text; nulls, empties, repeated rows."""
    want = collections.Counter((d.doc_id, d.source, tuple(bpe.encode_text(d.text or ""))) for d in docs.collect())
    rows = bpe.encode_checked(docs).collect()
    assert collections.Counter((r.doc_id, r.source, tuple(r.ids)) for r in rows) == want
    assert all(r.exact and r.n_tokens == len(r.ids) for r in rows)
    none = bpe.encode_checked(empty(spark))
    assert none.columns == ["doc_id", "source", "n_tokens", "ids", "exact"] and none.collect() == []


def test_encoder_that_forgets(monkeypatch):
    """A cache smaller than a text's pieces, few characters at a time, long pieces never kept: the same ids."""
    ts = [t for t in texts() if t and len(t) < 3000] + ["x" * 600, None, ""]
    plain = [bpe.encode_text(t or "") for t in ts]
    monkeypatch.setattr(bpe, "KEEP", 20)
    monkeypatch.setattr(bpe, "AT_ONCE", 500)
    monkeypatch.setattr(bpe, "LONG_PIECE", 8)
    e = bpe.TextEncoder(bpe.encoder().bpe)
    assert [ids.tolist() for ids in e.encode(ts)] == plain
    assert len(e.kept) <= 20 + max(len(set(e.split.findall(t or ""))) for t in ts) and all(len(p) <= 8 for p in e.kept)


def test_sorted_pieces_share_prefix_tables():
    b, rng = bpe.encoder().bpe, random.Random(5)
    some = {"".join(rng.choice(["er", "in", "the", " ", "ß", "ing", "qu"]) for _ in range(rng.randint(1, 9))) for _ in range(400)}
    assert dict(b.encode_sorted(some)) == {p: b.encode_piece(p.encode()) for p in some}


def test_prefix_table_appends_and_edits():
    b = bpe.encoder().bpe
    rng = random.Random(4)
    for _ in range(60):
        data = bytes(rng.choice(b"abcdeinrst -\n\xc3\xa9") for _ in range(rng.randint(1, 30)))
        last = b.table(data)
        assert all(b.read(last, n) == b.merged(data[:n]) for n in range(1, len(data) + 1))
        more, at = bytes(rng.choice(b"einrst ") for _ in range(5)), rng.randrange(len(data))
        assert b.append(data, last, more) == (data + more, b.table(data + more))
        assert b.replace(data, last, at, at + 1, more)[1] == b.table(data[:at] + more + data[at + 1:])


def test_splitter_agrees_with_the_pattern():
    s, rng = pieces.splitter(), random.Random(6)
    for _ in range(400):
        t = "".join(rng.choice("ab1½²٣ \n\t'sll.é日🙂\x1c\x85 _") for _ in range(rng.randint(0, 40)))
        assert s.findall(t) == s.exact.findall(t)


# ---- n-gram join
def component_brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets[i] = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both * den >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n,num,scheme", [(3, 90, {}), (5, 80, {"n2": 2, "width": 1, "slack": 1.25})])
def test_components(spark, docs, n, num, scheme, monkeypatch):
    want = component_brute([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], n, num, 100)
    for few in (512, 2):                                                 # 2: everything open goes by rare shingles
        monkeypatch.setattr(ngram_join, "FEW", few)
        out = ngram_join.components(docs, n, num, 100, **scheme).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == want
        assert len(out) == docs.count()


def test_components_of_near_copies_around_64_kib(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(5_000)]
    base, size = [], 0
    while size < 65_500:
        base.append(rng.choice(vocab))
        size += len(base[-1]) + 1
    short, long = " ".join(base), " ".join(base + base[:30])
    assert len(short) <= 65_536 < len(long)
    assert shingles.word_hashes(b"word") == shingles.word_hashes(b"word" + b" " * 70_000)
    assert (shingles.word_hashes(short.encode()) == shingles.word_hashes(long.encode())[:len(base)]).all()
    x = "x" * 70_000                                                     # words longer than the factor table stay apart
    assert len(np.unique(shingles.word_hashes(f"{x} {x}y {x[:65_536]} {x[:-1]}y".encode()))) == 4
    rows = [(1, short), (2, long), (3, " ".join(base[:20_000])), (4, short + " " * 70_000), (5, x + " " + short), (6, x)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = component_brute(rows, 3, 90, 100)
    assert want[2][1] == want[4][1] == want[5][1] == 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(df).collect()} == want


@pytest.mark.parametrize("words, num", [(3, 90), (5, 80)])
def test_components_of_texts_with_one_id(spark, words, num):
    """Rows that share a doc_id and differ in text are sets of their own; components are named by the smallest doc_id."""
    rng = random.Random(3)
    a, b, c = (" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(80)) for _ in range(3))
    near = b + " end"
    rows = [(1, a), (1, b), (2, b), (3, near), (1, near), (1, b), (4, c), (4, " " + c.upper()), (None, a), (5, ""), (5, None), (1, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.classes(df, words, num, 100).toPandas()
    assert got["component_id"].fillna(-1).astype(int).tolist().count(1) == 7 and len(got) == len(rows)
    assert set(got[got["component_id"] == 1].dropna(subset="top")["top"].map(str)) == set(
        got[got["doc_id"] == 1]["top"].map(str)) and got["top"].dropna().map(str).nunique() == 3
    out = ngram_join.first_of_each(df, words, num, 100).toPandas()
    kept = [(None if i != i else int(i), t) for i, t in out.itertuples(index=False)]
    assert kept.count((1, a)) == 1 and kept.count((None, a)) == 1 and kept.count((5, "")) == 1 and kept.count((5, None)) == 1
    assert sum(i == 1 and t in (b, near) for i, t in kept) == 1 and sum(i == 4 for i, _ in kept) == 1 and len(kept) == 6


def test_filter_of_signatures(spark, monkeypatch):
    """No shared signature is lost, few of the others pass; beyond its bound the filter lets all pass."""
    rng = np.random.default_rng(3)
    sigs = rng.integers(-(1 << 63), 1 << 63, (400, 50), dtype=np.int64)
    df = spark.createDataFrame([(i, [int(v) for v in r]) for i, r in enumerate(sigs)], "id long, sigs array<long>").repartition(3)
    shared = spark.createDataFrame([(int(v),) for v in sigs[:40].ravel()], "sig long")
    got_rows = {(r.id, r.sig) for r in ngram_join._likely(df, shared, 2000).collect()}
    want = {(i, int(v)) for i in range(40) for v in sigs[i]}
    assert want <= got_rows and len(got_rows - want) < 0.05 * 360 * 50
    monkeypatch.setattr(ngram_join, "FILTER_BITS", 8)
    assert ngram_join._likely(df, shared, 2000).count() == 20_000


def test_components_with_nothing_broadcast(spark, docs, monkeypatch):
    """Every join a shuffle, signatures through the filter, open pairs by rounds: the same components."""
    want = component_brute([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], 3, 90, 100)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    out = ngram_join.components(docs, 3, 90, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == want


def test_sets_just_under_and_over_the_threshold(spark):
    """A group whose sets share most shingles, some pairs linked and some not: rounds and pairs find every link."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in rng.sample(range(120), rng.choice([1, 2, 3])):
            w[j] = f"e{rng.randrange(400)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for words, num in ((5, 80), (3, 90)):
        want = component_brute(rows, words, num, 100)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(df, words, num, 100).collect()} == want


def test_many_near_copies_make_few_pairs(spark, monkeypatch):
    """A group of g near copies is joined through hubs: far fewer comparisons than pairs."""
    rng = random.Random(9)
    base = [rng.choice(["red", "blue", "green", "old", "new", "big"]) + str(rng.randrange(50)) for _ in range(400)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(400)] = f"edit{i}"
        rows.append((i, " ".join(w)))
    compared = []
    plain = ngram_join.Texts.linked

    def counted(self, pairs, num, den):
        compared.append(pairs.count())
        return plain(self, pairs, num, den)
    monkeypatch.setattr(ngram_join.Texts, "linked", counted)
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and sum(compared) < 3 * 300


def test_sets_of_likely_pairs_are_not_looked_for_again(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j k"), (3, "a b c u v w x y z")],
                                 "doc_id bigint, text string")
    texts_ = ngram_join.Texts(docs, 3, False)
    pairs = ngram_join.written(spark.createDataFrame([(1, 2), (2, 3)], "a bigint, b bigint"))
    likely = ngram_join.written(texts_.likely(pairs, 80, 100))
    tables, write = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda *a: tables.append(write(*a)) or tables[-1])
    assert [(r.a, r.b) for r in texts_.linked(likely, 80, 100).collect()] == [(1, 2)]
    assert len(tables) == 1                     # the ids; none of them lacks its set


def test_components_of_no_rows(spark):
    assert ngram_join.components(empty(spark)).count() == 0
    assert ngram_join.first_of_each(empty(spark)).columns == SCHEMA.replace(",", "").split()[::2]


def test_partenum_loses_no_linked_pair():
    rng = np.random.default_rng(0)
    for num, kw in ((90, {}), (80, {"n2": 2, "width": 1, "slack": 1.25}), (80, {"k2": 2, "n2": 4, "slack": 1.5})):
        scheme = partenum.PartEnum(num, 100, **kw)
        for _ in range(300):
            n = int(rng.integers(1, 200))
            s = shingles.mix64(rng.integers(0, 1 << 62, n, dtype=np.uint64))
            gone = int(rng.integers(0, 1 + n * (100 - num) // 100))
            more = int(rng.integers(0, 1 + n * (100 - num) // 100))
            t = np.concatenate([s[gone:], shingles.mix64(rng.integers(0, 1 << 62, more, dtype=np.uint64))])
            both = n - gone
            if gone + more and both * 100 >= num * (n + len(t) - both):
                assert set(scheme.signatures(np.unique(s)).tolist()) & set(scheme.signatures(np.unique(t)).tolist())


# ---- language ID
def test_lattice_sums_all_segmentations():
    lat, known = language_id.Lattice(["a", "b", "ab", "bc", "▁", "▁a"]), {"a": 0, "b": 1, "ab": 2, "bc": 3, "▁": 4, "▁a": 5}
    p = np.array([.1, .2, .3, .05, .15, .2, 1e-3])

    def ways(w):                                                         # (probability, pieces) of each segmentation
        if not w:
            return [(1.0, [])]
        out = []
        for n in range(1, len(w) + 1):
            q = known.get(w[:n], 6 if n == 1 else None)
            if q is not None:
                out += [(p[q] * x, [q, *r]) for x, r in ways(w[n:])]
        return out
    words = ["▁ab", "▁abc", "abab", "▁", "ca", "▁aab"]
    total = [sum(x for x, _ in ways(w)) for w in words]
    assert np.allclose(lat.log_likelihood(words, p[:, None])[:, 0], np.log(total))
    want = np.zeros(6)
    for w, t in zip(words, total):
        for x, r in ways(w):
            for q in r:
                if q < 6:
                    want[q] += 2 * x / t
    assert np.allclose(lat.expected(words, np.full(len(words), 2.0), p), want)


def test_long_runs_are_scored_whole():
    """41 letters and more: exact sums over all segmentations, by fractions; nothing is cut, nothing underflows."""
    from fractions import Fraction
    names = ["a", "b", "ab", "ba", "aba", "bbaab", "▁", "▁a"]
    lat = language_id.Lattice(names)
    p = np.array([[.1, .3], [.2, .01], [.3, .05], [.05, .2], [.15, .1], [.1, .2], [.06, .1], [.04, .04], [1e-9, 1e-7]])
    rng = random.Random(2)
    words = ["▁" + "".join(rng.choice("ab") for _ in range(n)) for n in (40, 41, 41, 64, 300)] + ["▁" + "ab" * 15 + "ü" * 60 + "ba" * 20]

    def exact(w, j):
        at = [Fraction(1)] + [Fraction(0)] * len(w)
        for e in range(1, len(w) + 1):
            for n in range(1, min(5, e) + 1):
                q = w[e - n:e]
                if q in names or n == 1:
                    at[e] += at[e - n] * Fraction(float(p[names.index(q) if q in names else len(names), j]))
        return math.log(at[-1].numerator) - math.log(at[-1].denominator)
    got_logs = lat.log_likelihood(words, p)
    for i, w in enumerate(words):
        for j in range(2):
            assert got_logs[i, j] == pytest.approx(exact(w, j), rel=1e-9)
    # expected counts: each letter of a word is covered once by the pieces that are counted
    lengths = np.array([len(n) for n in names])
    for w in words[:5]:
        assert (lat.expected([w], np.array([3.0]), p[:, 0]) * lengths).sum() == pytest.approx(3 * len(w), rel=1e-9)
    assert language_id.letter_runs("x" * 41) == ["▁" + "x" * 41]


def test_sample_is_bounded_per_language(spark):
    """A rare language is learned however small its share; the bound holds for each; equal rows count once."""
    rows = [(i, f"the thing {i}", "en") for i in range(400)] + [(1000, "que leaux", "fr"), (1001, "leaux que", "fr")]
    rows += [(7, "the thing 7", "en")] * 300 + [(None, "x", "en"), (8, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    some = language_id.sampled(docs, 40).toPandas()
    assert some.groupby("lang").size().to_dict() == {"en": 40, "fr": 2}
    assert some.groupby("lang")["n_docs"].first().to_dict() == {"en": 400, "fr": 2}
    again = language_id.sampled(docs.repartition(9), 40).toPandas()
    assert sorted(some["text"]) == sorted(again["text"])
    model = language_id.train(language_id.sampled(docs, 40))
    assert model.languages == ["en", "fr"] and np.allclose(np.exp(model.prior), [400 / 402, 2 / 402])


def plain_predict(text, model, names):
    """Posterior by a plain sum over segmentations, word by word in Python."""
    import re
    words = ["▁" + r.lower() for r in re.findall(r"[^\W\d_]+", text or "")]
    if not words:
        return "und", 0.0
    total = model.prior.copy()
    for w in words:
        logs = []
        for j in range(len(model.languages)):
            at = [1.0] + [0.0] * len(w)
            for e in range(1, len(w) + 1):
                for b in range(e):
                    q = names.get(w[b:e], len(names) if e - b == 1 else None)
                    if q is not None:
                        at[e] += at[b] * model.probs[q, j]
            logs.append(math.log(at[-1]))
        total = total + np.array(logs)
    post = np.exp(total - total.max())
    return model.languages[int(total.argmax())], float(post.max() / post.sum())


def test_predict_equals_the_plain_version(spark):
    rng = random.Random(7)
    make = {"en": ["the", "and", "thing", "with", "wonder"], "fr": ["été", "que", "leaux", "ç", "monde"], "it": ["che", "gli", "mondo"]}
    rows = [(i, " ".join(rng.choice(make[g]) for _ in range(12)), g, g, 1) for i in range(25) for g in make]
    schema = "doc_id long, text string, lang string, lang_pred string, score int"       # names that clash with the results
    docs = spark.createDataFrame(rows, schema)
    model = language_id.train(language_id.sampled(docs, 20))
    names = {q: i for i, q in enumerate(language_id.load_pieces(model.name))}
    odd = [(1, None), (2, ""), (3, "12 ?? \n"), (4, "the thing"), (5, "che monde"), (6, "mondo, mondo! x2y"), (6, "mondo, mondo! x2y"),
           (7, "thé"), (8, "日本 the"), (9, "que" * 9), (None, "gli"), (10, "le"), (11, "Été QUE")]
    table_ = spark.createDataFrame([(i, t, "zz", "zz", 0) for i, t in odd], schema)
    got_rows = language_id.predict(table_.select("doc_id", "text"), model).collect()
    assert len(got_rows) == len(odd)
    key = lambda r: (r[0] is None, r[0] or 0)                            # noqa: E731
    for r, (i, t) in zip(sorted(got_rows, key=key), sorted(odd, key=key)):
        lang, score = plain_predict(t, model, names)
        assert (r.doc_id, r.lang_pred) == (i, lang) and r.score == pytest.approx(score, abs=1e-9)
    assert language_id.predict(table_.select("doc_id", "text").limit(0), model).collect() == []
    kept = language_id.keep_identified(table_, model)
    assert kept.columns == table_.columns and kept.count() == len(odd) - 3
    tie = language_id.Model(model.name, ["en", "fr"], np.ones((len(names) + 1, 2)) / 9, np.log([.5, .5]))
    assert language_id.predict(table_.where("doc_id = 4").select("doc_id", "text"), tie).first()[1:] == ("en", 0.5)


def test_language_id(spark):
    rng = random.Random(1)
    make = {"en": ["the", "and", "thing", "with"], "fr": ["été", "que", "leaux", "ç"]}
    rows = [(i, " ".join(rng.choice(make[g]) for _ in range(30)), g) for i in range(60) for g in ("en", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(language_id.sampled(docs, 50))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ?? \n"), (4, "the thing"), (5, "que " * 50_000), (6, "日本" * 40)],
                                "doc_id long, text string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, model).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[4][0] == "en" and out[5] == ("fr", 1.0)
    assert all(0 <= s <= 1 for _, s in out.values())
    assert language_id.keep_identified(odd, model).where("doc_id <= 3").count() == 0
    assert language_id.train(empty(spark)) is None
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}


def test_keep_identified_drops_only_texts_without_a_language(spark):
    rows = [(i, "same words here", g) for i, g in enumerate(["en", "fr", "it", "en", "fr", "it"])]
    docs = spark.createDataFrame([*rows, (6, "12 ??", None), (7, None, None)], "doc_id long, text string, lang string")
    model = language_id.train(language_id.sampled(docs))
    assert all(r.score < 0.5 for r in language_id.predict(docs, model).collect())
    assert sorted(r.doc_id for r in language_id.keep_identified(docs, model).collect()) == [0, 1, 2, 3, 4, 5]
    assert language_id.keep_identified(docs, None).count() == 8


def test_a_language_is_found_once_for_each_text(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("12", "en")])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(docs)
    for found in (language_id.with_language(docs, model), language_id.keep_identified(docs, model)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
        assert sorted(map(tuple, found.collect())) == rows[:2]


# ---- toxicity
def test_toxicity_finds_the_sentence(spark):
    rng = random.Random(2)
    calm = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = []
    for i in range(240):
        s = [" ".join(rng.choice(calm) for _ in range(6)) for _ in range(rng.randint(1, 12))]
        if i % 3 == 0:
            j = rng.randrange(len(s))
            s[j] += " vile"
        rows.append((i, ". ".join(s) + ".", int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    weights = toxicity.train(toxicity.sampled(docs, docs, 60))
    out = {r.doc_id: r for r in toxicity.score(docs, weights).collect()}
    assert all((out[i].score >= 0.5) == bool(y) for i, _, y in rows)
    for i, t, y in rows:
        if y:
            assert ["vile" in t[s.start:s.end] for s in out[i].offending] == [True]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "vile " * 40_000), (None, "alpha")], "doc_id long, text string")
    got_ = {r.doc_id: r.score for r in toxicity.score(odd, weights).collect()}
    assert got_[1] == got_[2] == 0.0 and got_[3] >= 0.5 and all(0 <= x <= 1 for x in got_.values())
    assert toxicity.train(toxicity.sampled(docs, docs.where("toxic = 0"))) == {}


def test_toxicity_sample_skips_only_what_does_not_fit(spark):
    rows = [(i, ("vile " if i % 2 else "calm ") * 4, i % 2) for i in range(2, 42)]
    rows += [(0, "calm " * 500, 0), (1, "vile " * 500, 1)]               # the smallest ids are the long ones
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fits = toxicity.sampled(docs, docs, max_chars=1_000)
    assert {r.doc_id for r in fits.collect()} == set(range(2, 42))
    assert toxicity.train(fits)["vile"] > 0
    some = toxicity.sampled(docs, docs, max_chars=100)                   # five of each label, by id hash
    order = [r.doc_id for r in docs.where("doc_id > 1").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    assert {r.doc_id for r in some.collect()} == {i for y in (0, 1) for i in [j for j in order if j % 2 == y][:5]}
    none = toxicity.sampled(docs.where("doc_id in (0, 1, 2)"), docs, max_chars=19)
    assert sorted(r.doc_id for r in none.collect()) == [1, 2]            # a label never goes empty
    assert toxicity.sampled(empty(spark), docs).count() == 0
    long = spark.createDataFrame([(0, "x" * 12_000_001, 1)], "doc_id long, text string, toxic int")
    whole = toxicity.sampled(docs.where("doc_id > 1").unionByName(long), docs)
    assert toxicity.train(whole)["vile"] > 0


def test_pieces_go_to_the_model_as_the_library_has_them(library, monkeypatch):
    texts = ["naïve ÿ­x \x00\x7f\x85   \t\r\n <|endoftext|> it's 12½", "日本 ɑ \U0001f600 ٣", "a" * 1000, "é" * 300,
             "".join(chr(i) + " " + chr(i) for i in range(0x300))]
    cache = pieces.library_ids("byte_bpe_50k.json")
    monkeypatch.setattr(cache, "keep", 3)                                # starts over all the time
    for text in texts * 2:
        ids = np.frombuffer(b"".join(cache.each(cache.split.findall(text))), dtype="<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
    assert len(cache) <= 3


def test_added_tokens_are_the_stock_librarys(spark):
    from tokenizers import Tokenizer
    stock = Tokenizer.from_file(pieces.vocabulary("byte_bpe_50k.json"))
    e = "<|endoftext|>"
    texts = [f"a{e}b", e, e + e, f"x  {e}  y", f" \n{e}\n\nit's 日本 {e}🙂", f"<{e}>", e[:-1], f"{e[:5]}{e}{e[3:]}", f"é{e}é\n{e}z"]
    assert stock.encode(texts[0], add_special_tokens=False).tokens == ["a", e, "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = scratch_path(spark, "test_tokens")
    token_files.write_tokens(docs, path)
    files = {r.doc_id: r.ids for r in token_files.read_tokens(spark, path).collect()}
    counts = {r.doc_id: r.n_doc_tokens for r in token_counts.section_counts(docs).collect()}
    cache = pieces.library_spans("byte_bpe_50k.json")
    for i, t in enumerate(texts):
        want = stock.encode(t, add_special_tokens=False)
        assert files[i] == [*want.ids, token_files.END_ID] and counts[i] == len(want.ids)
        assert list(zip(*map(np.ndarray.tolist, token_counts.token_spans(t, cache)))) == want.offsets
