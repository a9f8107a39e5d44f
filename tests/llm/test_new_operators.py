"""Periodic runs, packing and fill-in-middle against plain Python versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskweave.llm import fill_middle, packing, periodic, queries
from tests.llm.test_operators import docs, empty, table, texts  # noqa: F401  docs is a fixture


def by_id(rows):
    """Rows by (doc_id, ...) as a sorted list, nulls first."""
    return sorted((tuple(r) for r in rows), key=repr)


def saved(tmp_path, df):
    """A folder with ``df`` as its documents table."""
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


# ---- op11 ----------------------------------------------------------------------------------------

def plain_runs(w, least=12):
    out, n = {}, len(w)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j - i >= p and j - i + p >= least:
                out.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, length, p) for (s, length), p in out.items())


def plain_op11(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60).map(lambda w: [str(x) for x in w]), max_size=5),
       st.integers(1, 40), st.integers(0, 30))
def test_runs_of_small_alphabets(docs_, top, repeats):
    held, periodic.TOP = periodic.TOP, top
    try:
        every = docs_ + [d * repeats for d in docs_[:1] if len(d) * repeats < 300]
        assert [[tuple(r) for r in g.tolist()] for g in periodic.group_runs(every)] == [plain_runs(d) for d in every]
    finally:
        periodic.TOP = held


@pytest.mark.parametrize("words", [["a"] * 30_000, ["a", "b", "c"] * 9_000 + ["x"], list("abaab") * 4_000])
def test_runs_of_long_texts(words):
    """Longer than the kept grid: periods are walked in parts; blocks and pairs shrink the grammar."""
    levels = periodic.grammar(np.array([-1] + [ord(w) for w in words] + [-2]))
    assert len(levels) < 60
    q = len(set(words[:3])) if words[0] != "a" or words[1] != "b" or words[3] == "a" and words[2] == "c" else 5
    q = 1 if words[1] == "a" else q
    found = [tuple(r) for r in periodic.group_runs([words])[0].tolist()]
    n = len(words) - (words[-1] == "x")
    assert (0, n, q) in found and all(r[1] >= max(12, 2 * r[2]) for r in found)


def test_extension_is_exact():
    rng = random.Random(2)
    w = [rng.randrange(3) for _ in range(80)] * 2 + [7] * 50 + [rng.randrange(2) for _ in range(100)]
    s = np.array([100] + w + [101])
    levels = periodic.grammar(s)
    i = np.array([rng.randrange(1, len(s) - 2) for _ in range(2000)])
    j = np.array([rng.randrange(a + 1, len(s) - 1) for a in i])
    for forward, step in ((True, 1), (False, -1)):
        got = periodic.extension(levels, i, j, forward)
        for a, b, g in zip(i.tolist(), j.tolist(), got.tolist()):
            k = 0
            while s[a + step * k] == s[b + step * k]:
                k += 1
            assert g == k


def test_op11_rows(spark, tmp_path):
    rng = random.Random(4)
    more = [" ".join(rng.choice("xyz") for _ in range(rng.randrange(200))) for _ in range(120)] + ["tick tock\n" * 40]
    df = table(spark, more)
    want = [plain_op11(r.doc_id, r.text) for r in df.select("doc_id", "text").collect() if len(r.text or "") < 60_000]
    got = queries.op11_periodic_runs(spark, saved(tmp_path, df)).collect()
    assert len(got) == df.count()
    long_ids = {r.doc_id for r in df.where(F.length("text") >= 60_000).collect()}
    assert by_id(r for r in got if r.doc_id not in long_ids) == by_id(want)
    longest = next(r for r in got if r.doc_id in long_ids and r.n_runs)
    assert (longest.start, longest.length, longest.period) == (0, 60_000, 1)


def test_runs_of_no_rows(spark):
    assert periodic.periodic_runs(empty(spark)).collect() == []


# ---- op12 ----------------------------------------------------------------------------------------

def test_word_pieces_are_the_librarys():
    from tokenizers import Tokenizer
    import public_tokenizers
    stock = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    cache = packing.word_pieces("word_bpe_49k.json")
    odd = ["İstanbul ΣΑΣ", "a<|endoftext|>b <|startoftext|>", "é ½²'LL they're", "tab\x1cx\x85y\xa0z", "naïve ÀÉ 日本 🙂", "__a_1 2a"]
    every = [chr(c) + "a" + chr(c) + " " + chr(c) for c in range(0x250)]
    for t in [x or "" for x in texts()[:60]] + odd + every:
        assert np.frombuffer(cache.ids(t), dtype="<u4").tolist() == stock.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=30))
def test_plan_covers_the_histogram(histogram):
    plan = packing.plan(histogram, 64, 20)
    used: dict[int, int] = {}
    for config, n in plan.configs:
        assert n > 0 and sum(s * m for s, m in config) <= 64
        for s, m in config:
            used[s] = used.get(s, 0) + n * m
    assert used == histogram
    assert plan.bound <= plan.sequences + 1e-6
    greedy = sum(n for _, n in packing.best_fit(histogram, 64))
    assert plan.sequences <= greedy * 1.05 + 2


def test_bound_and_plan_meet():
    """Where no cover can be full (three of 30 in 64 never fit), the prices show it."""
    plan = packing.plan({30: 1000, 40: 10}, 64)
    assert plan.sequences == 510 and plan.bound > 500 > (30 * 1000 + 40 * 10) / 64


def test_best_fit_is_best_fit_decreasing():
    rng = random.Random(8)
    for _ in range(40):
        need = {rng.randint(1, 40): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        rooms: list[int] = []
        for size in sorted((s for s, n in need.items() for _ in range(n)), reverse=True):
            fits = [r for r in rooms if r >= size]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - size)
            else:
                rooms.append(40 - size)
        assert sum(n for _, n in packing.best_fit(need, 40)) == len(rooms)


def test_op12_rows(spark, tmp_path):
    from tokenizers import Tokenizer
    import public_tokenizers
    stock = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    df = table(spark, ["several words " * 1023 + "end", "several words " * 1024, "tie a b c"] * 3)
    got = queries.op12_best_fit_packing(spark, saved(tmp_path, df)).toPandas()
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = stock.encode(r.text or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            cut = ids[at:at + 2048]
            want.append((r.doc_id, p, at, len(cut), zlib.crc32(np.array(cut, dtype="<u4").tobytes())))
    have = [(None if i != i else int(i), *map(int, r)) for i, *r in
            got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert by_id(have) == by_id(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all() and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


def test_sequences_hold_the_ids(spark):
    df = table(spark).where("length(text) < 5000 or text is null")
    packed = packing.pack(df, capacity=128, ids=True).cache()
    whole = {}
    for r in packed.collect():
        whole.setdefault(r.sequence_id, []).append((r.offset, list(r.ids)))
    rows = packing.sequences(packed).collect()
    assert {r.sequence_id: list(r.ids) for r in rows} == {k: [i for _, x in sorted(v) for i in x] for k, v in whole.items()}
    assert max(r.n_tokens for r in rows) <= 128
    assert packing.pack(empty(spark)).collect() == []


def test_ranks_of_one_length_spread_over_partitions(spark):
    """All pieces of one length, from many partitions: each gets a slot of its own."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same words here").alias("text")).repartition(7)
    got = packing.pack(df).toPandas()
    assert len(got.drop_duplicates(["sequence_id", "offset"])) == 3000
    assert got.sequence_id.nunique() == -(-3000 // (2048 // int(got.length[0])))


# ---- op13 ----------------------------------------------------------------------------------------

def plain_op13(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", len(x), len(y), sha(f"<S>{z}<P>{x}<M>{y}"), sha(text))
    return (doc_id, n, "psm", len(x), len(y), sha(f"<P>{x}<S>{z}<M>{y}"), sha(text))


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 400_000), max_size=60), st.integers(0, 3), st.integers(0, 200_000))
def test_select_in_every_container(some, kind, start):
    """Sparse values, a run, a dense pattern, and all of them over several containers."""
    if kind == 1:
        some |= set(range(start, start + 70_000))
    if kind == 2:
        some |= set(range(start, start + 60_000, 3))
    values = np.array(sorted(some), dtype=np.int64)
    held = fill_middle.BoundarySet.of(values)
    assert held.size == len(values)
    for k in {0, 1, len(values) // 2, len(values) - 1} & set(range(len(values))):
        assert held.select(k) == values[k]
    for k in random.Random(1).sample(range(len(values)), min(40, len(values))):
        assert held.select(k) == values[k]
    with pytest.raises(IndexError):
        held.select(len(values))


def test_container_forms():
    form = lambda v: type(fill_middle.container(np.array(v, dtype=np.uint16))).__name__
    assert form([1, 5, 900]) == "ArrayContainer"
    assert form(range(100, 9_000)) == "RunContainer"
    assert form(range(0, 65_536, 3)) == "BitmapContainer"


def test_op13_rows(spark, tmp_path):
    rng = random.Random(6)
    more = ["".join(rng.choice("ab \n.<PSM>é日🙂") for _ in range(rng.randrange(60))) for _ in range(300)]
    more += ["a marker <P> inside", "<", "<<S", "P>", "word " * 40_000 + "日", "x, " * 50_000]
    df = table(spark, more)
    got = queries.op13_fill_in_middle(spark, saved(tmp_path, df)).collect()
    assert by_id(got) == by_id(plain_op13(r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert fill_middle.fill_in_middle(empty(spark)).collect() == []
