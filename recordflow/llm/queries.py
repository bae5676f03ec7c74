"""The registered queries of this subpackage, one per operator, and their SQL where there is some.

Each applies its operator to its whole table with production parameters and derives the digest
columns from what the operator returns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from recordflow.llm import (
    bpe, html_text, lm, near_dup, negatives, quality, quotes, secret_scan, spelling,
    substring_dedup, tiling, toxicity, urls)
from recordflow.llm.common import crc_class, table

VOCABULARY = "byte_bpe_50k.json"

# The rules that pages are judged by.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"),
             ("net", "/de/", "allow"), ("example.net", "/de/8", "block"),
             ("org", "/es/", "block")]

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op4_url_filters", """
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule_host, rule_path, rule_verdict) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
    AND starts_with(path, rule_path))
SELECT parts.page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id AND place = 1
""")
def url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query("op5_bpe")
def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    file = public_tokenizers.path(VOCABULARY)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, file)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                        bpe.ids_digest("ids").alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_secret_scan")
def secrets_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    spans = secret_scan.scan(docs).select("doc_id", "spans")
    count = {k: F.size(secret_scan.of_kinds("spans", k)).cast("bigint").alias(f"n_{k}")
             for k in secret_scan.BASE_KINDS}
    base = secret_scan.listed(secret_scan.of_kinds("spans", *secret_scan.BASE_KINDS))
    return spans.select("doc_id", *count.values(), F.sha2(base, 256).alias("base_sha256"),
                        secret_scan.listed(F.col("spans")).alias("spans"))


@query("op8_quality_rules", r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
wins AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i+2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM wins, range(3) AS t(k) WHERE n > 1 GROUP BY doc_id),
stats AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
    length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS with_letter, len(lines) AS n_lines
  FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
    OR word_chars < 3 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words
    OR 10 * (n_lines - n_dup_lines) < 6 * n_lines OR 10 * with_letter < 7 * n_words) AS kept
FROM stats
""")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.judge(docs).drop("text")


@query("op10_toxicity")
def toxic_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels, crc_class("doc_id", 4) != 2)
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", F.coalesce(crc_class("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op6_simhash_near_dedup")
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_dup.label(docs).select(
        "doc_id", F.lower(F.lpad(F.hex(F.get("fp", 0)), 16, "0")).alias("fingerprint"),
        "component_id")


@query("op3_decontamination")
def benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document and benchmark item that it contains; clean documents have none."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = tiling.matches(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "coverage",
                        F.size("tiles").cast("bigint").alias("n_tiles"))


@query("op2_gru_lm")
def language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = lm.held_out(crc_class("doc_id", 5))
    model, counts = lm.fit(docs.where(~out))
    return lm.score(docs, model, counts).select(
        "doc_id", lm.held_out(crc_class("doc_id", 5)).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.vocabulary.total).cast("bigint").alias("train_tokens"), "base_score", "score")


@query("op9_suffix_array_dedup")
def repeated_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.removals(table(spark, folder, "documents").select("doc_id", "text"))


@query("op1_quotation_linking")
def replies(spark: SparkSession, folder: str) -> DataFrame:
    messages = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return quotes.link(messages).select(
        "conv_id", "turn", "role", "position", "parent_turn", "n_quotes",
        F.size("links").cast("bigint").alias("n_links"), "body")


@query("op11_spelling_variants", r"""
WITH RECURSIVE
remainders AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (
  SELECT run, c, xor(list_reduce(flatten(list_transform(
      string_split(doc_id::VARCHAR || ':' || run, ''), lambda x:
        CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x) - 64] END)),
    lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM runs, remainders),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT c, CASE WHEN h % 31 = 0
      THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
      ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
shorter AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n
  FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top_n,
    min(struct_pack(less := -other_n, other := other)) AS top FROM near GROUP BY word),
known AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN top_n >= 10 * n THEN top.other END AS form,
    CASE WHEN top_n >= 10 * n THEN top_n END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word),
followed AS (
  SELECT word, form, 1 AS steps FROM known WHERE form IS NOT NULL
  UNION ALL
  SELECT followed.word, known.form, steps + 1 FROM followed JOIN known ON known.word = followed.form
  WHERE known.form IS NOT NULL)
SELECT known.word, form, coalesce(root, known.word) AS root, n, n_near, form_n
FROM known LEFT JOIN (
  SELECT word, max_by(form, steps) AS root FROM followed GROUP BY word) r ON known.word = r.word
""")
def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents").select("doc_id", "text"))


@query("op12_html_extraction")
def main_texts(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op13_hard_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS f
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    list_dot_product(a.f, b.f)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER place)::INT AS rank, other AS negative_id,
  positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW place AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER place <= 10
""")
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(
        "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10)
        .otherwise(F.col("label")).alias("label"))
    return negatives.mine(negatives.integer_rows(vectors), "vec_id % 100 = 0")


QUERIES["pipeline"] = corpus_pipeline.run
