"""Queries over the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estimark.llm import bpe, collision, fill_middle, hard_negatives, host_rules, langid, lm, near_vectors, ngram_join, packing, pii, suffix_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0)


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.key_of(spark))
    found = [F.coalesce(F.col("pii")[kind], F.lit(0)).alias(f"n_{kind}") for kind in pii.KINDS]
    return docs.select("doc_id", "text", *found)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_links", "class_id", "kept")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(toxicity.fold(5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(toxicity.fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    found = langid.predict(docs, langid.learn(docs.where(fold != 2)))
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_rules.verdicts(table(spark, sf_dir, "documents"), F.col("source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    "op1_near_vectors": op1_near_vectors,
    "op2_recurrent_lm": op2_recurrent_lm,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_packing": op4_packing,
    "op5_ngram_join": op5_ngram_join,
    "op6_nearest": op6_nearest,
    "op7_toxicity": op7_toxicity,
    "op8_language": op8_language,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_bpe": op10_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_fill_middle": op12_fill_middle,
    "op13_host_rules": op13_host_rules,
}
ORACLE_SQL = {
    "op1_near_vectors": """
WITH RECURSIVE u AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON r.other = l.a),
low AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT low.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, low.vec_id = component_id AS kept
FROM low LEFT JOIN n ON low.vec_id = n.a""",
    "op11_hard_negatives": """
WITH u AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)::INTEGER AS rank,
  n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.a = n.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) <= 3""",
    "op12_fill_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id::VARCHAR) AS h,
    list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]'), lambda u: length(u)) AS chars FROM documents),
h AS (SELECT *, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::UBIGINT::BIGINT) AS h4, len(chars) AS n FROM d),
f AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h4[3] % 100 >= 90 THEN 'plain' WHEN h4[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    coalesce(list_sum(chars[1:least(h4[1] % (n + 1), h4[2] % (n + 1))]), 0)::BIGINT AS a,
    coalesce(list_sum(chars[1:greatest(h4[1] % (n + 1), h4[2] % (n + 1))]), 0)::BIGINT AS b FROM h)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
    ELSE '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM f""",
    "op13_host_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
windows AS (SELECT r, unnest(list_zip(w, w[2:], w[3:], true)) AS t, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, t) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) s(k) GROUP BY r),
c AS (
  SELECT w.r, doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep ON w.r = rep.r),
flags AS (
  SELECT r, source, unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, 10 * n_dup_lines > 3 * n_lines,
    word_chars < 3 * n_words OR word_chars > 10 * n_words]) AS failed, unnest(range(5)) AS rule FROM c WHERE source IS NOT NULL),
hosts AS (SELECT rule, source, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f FROM flags GROUP BY rule, source),
sums AS (SELECT rule, count(*) AS h, sum(n) AS n, sum(n * n) AS s, sum(f) AS f, sum(f * f / n) AS q FROM hosts GROUP BY rule),
mean AS (
  SELECT rule, h, n, f / n AS m, (q - f * f / n) / nullif(h - 1, 0) AS b, (f - q) / nullif(n - h, 0) AS i, (n - s / n) / nullif(h - 1, 0) AS z FROM sums),
prior AS (
  SELECT rule, m, 1 / least(greatest(CASE WHEN b + (z - 1) * i > 0 THEN (b - i) / (b + (z - 1) * i) ELSE 0 END, 1e-6), 1 - 1e-6) - 1 AS k FROM mean),
verdict AS (SELECT source, max((f + m * k) / (hosts.n + k)) <= 0.5 AS host_kept FROM hosts JOIN prior USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(host_kept, true) AS kept
FROM c LEFT JOIN verdict ON c.source = verdict.source""",
}
