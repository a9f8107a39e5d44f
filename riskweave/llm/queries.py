"""Queries of the training-data operators: ``QUERIES`` and, where SQL can say it, ``ORACLE``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import (bpe, fill_middle, language_id, line_dedup, mixing, ngram_join, packing, periodic,
                           quality_rules, token_counts, token_files, toxicity, winnowing)
from riskweave.llm.common import held_out, scratch_path, written
from riskweave.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


@query
def op1_line_dedup(spark, sf_dir):
    kept = line_dedup.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLE["op1_line_dedup"] = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_BLANKS}), {_FOLD}) AS k FROM l),
o AS (SELECT k, min(doc_id) AS owner FROM k WHERE length(k) >= 10 GROUP BY k),
j AS (SELECT k.doc_id, pos, line, coalesce(owner <> k.doc_id, false) AS gone FROM k LEFT JOIN o ON k.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""


@query
def op2_quality_rules(spark, sf_dir):
    counted = written(quality_rules.with_counts(documents(spark, sf_dir)))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out())
    rules = quality_rules.train(counted.join(labels, "doc_id"))
    out = quality_rules.apply(counted, rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "rule")


@query
def op3_source_mixing(spark, sf_dir):
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


ORACLE["op3_source_mixing"] = r"""
WITH w AS (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
z AS (SELECT doc_id, source, len(ws) AS size,
        -ln((('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
        / CASE WHEN len(ws) > 0 THEN 0.1::DOUBLE + 0.9::DOUBLE * len(list_distinct(ws)) / len(ws) ELSE 0.1::DOUBLE END AS k FROM w),
s AS (SELECT source, sum(size)::DOUBLE AS ss, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM z GROUP BY source),
r AS (SELECT *, 1 + (n - 1) % 3 AS g, 3 * ss / (1 + (n - 1) % 3) AS r FROM s),
-- the level of a share: for each source, that at which all sources with a smaller cap per weight stand at it
v AS (SELECT a.r, ((SELECT sum(ss) FROM r) - coalesce(sum(3 * b.ss) FILTER (WHERE (b.r, b.n) < (a.r, a.n)), 0))
        / sum(b.g) FILTER (WHERE (b.r, b.n) >= (a.r, a.n)) AS lam, a.n FROM r a CROSS JOIN r b GROUP BY a.r, a.n),
t AS (SELECT source, ss, least(3 * ss, (SELECT arg_min(lam, (v.r, v.n)) FROM v WHERE lam <= v.r) * g) AS target FROM r),
b AS (SELECT *, CASE WHEN ss > 0 THEN least(3, floor(target / ss + 1e-9)) ELSE 0 END AS epochs FROM t),
o AS (SELECT z.*, ss, target, epochs, target - epochs * ss AS budget,
        sum(size) OVER (PARTITION BY z.source ORDER BY k, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM z JOIN b ON z.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size::BIGINT AS size, ss::BIGINT AS source_size, round(target, 6) AS target,
       (size * least(3, epochs + CASE WHEN budget > 0 AND upto - size / 2 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o"""


@query
def op4_winnowing(spark, sf_dir):
    return winnowing.with_next(
        documents(spark, sf_dir), winnowing.compare_edited,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


@query
def op5_token_files(spark, sf_dir):
    path = scratch_path(spark, "token_files")
    token_files.write_tokens(documents(spark, sf_dir), path)
    return token_files.index(token_files.read_tokens(spark, path))


@query
def op6_token_counts(spark, sf_dir):
    return token_counts.section_counts(documents(spark, sf_dir))


@query
def op7_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = language_id.train(language_id.sampled(docs.where(~held_out())))
    marked = docs.select("doc_id", held_out().alias("held_out"), "text")
    return language_id.predict(marked, model, "doc_id", "held_out")


@query
def op8_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    weights = toxicity.train(toxicity.sampled(docs, labels))
    marked = docs.select("doc_id", held_out().alias("held_out"), "text")
    scored = toxicity.score(marked, weights, 0.5, "doc_id", "held_out")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         F.size("offending").alias("n_offending"))


@query
def op9_byte_bpe(spark, sf_dir):
    return bpe.round_trip(documents(spark, sf_dir))


@query
def op10_ngram_join(spark, sf_dir):
    return ngram_join.components(documents(spark, sf_dir))


ORACLE["op10_ngram_join"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS h FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 90 * (nx.n + ny.n - i)),
e AS (SELECT x AS u, y AS v FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT doc_id AS id, doc_id AS r FROM d UNION SELECT e.v, c.r FROM c JOIN e ON c.id = e.u),
m AS (SELECT id, min(r) AS r FROM c GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.r AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.id = d.doc_id"""


@query
def op11_periodic_runs(spark, sf_dir):
    found = periodic.periodic_runs(documents(spark, sf_dir), words=periodic.with_periodic_tail)
    # the longest run, ties by start, then period: the smallest of (-length, start, period)
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("_b", best)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("_b.s").alias("start"),
        (-F.col("_b.l")).alias("length"), F.col("_b.p").alias("period"),
        F.expr("(1000 * -_b.l) div _b.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query
def op12_best_fit_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir)).select(
        "doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "sequence_id", "offset")


@query
def op13_fill_in_middle(spark, sf_dir):
    cut = fill_middle.fill_in_middle(documents(spark, sf_dir))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(fill_middle.restored().cast("binary"), 256).alias("restored_sha256"))


ORACLE["op13_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, ('0x' || substr(h, 1, 8))::BIGINT AS h1,
        ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(w[1:a], '') AS x, array_to_string(w[a + 1:b], '') AS y, array_to_string(w[b + 1:], '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y
                        ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
