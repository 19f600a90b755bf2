"""The queries of this package over the given tables, with their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import cross_polytope, decontaminate, filter_audit, html_text, kneser_ney, mixing, pii, probminhash, quality, secret_scan, suffix_dedup, token_counts, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


@query("op5_decontaminate", r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id::VARCHAR AS id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id::VARCHAR, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), windows AS (
  SELECT DISTINCT id AS item, least(13, len(w)) AS width, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM words WHERE kind = 'b' AND len(w) > 0)
), widths AS (SELECT DISTINCT width FROM windows),
starts AS (
  SELECT id, i, width, array_to_string(w[i:i + width - 1], ' ') AS gram
  FROM (SELECT id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM words, widths WHERE kind = 'd' AND len(w) >= width)
), hits AS (SELECT id, i, s.width, item FROM starts s JOIN windows USING (width, gram)),
covered AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + width)) AS p FROM hits) GROUP BY id),
items AS (SELECT id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM hits GROUP BY id)
SELECT w.id::BIGINT AS doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM words w LEFT JOIN covered USING (id) LEFT JOIN items USING (id) WHERE kind = 'd'
""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text")
    found = decontaminate.find_overlaps(docs, items)
    return decontaminate.judge(found.select("doc_id", "n_words", "_hits"))


@query("op8_secret_scan")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, folder, "documents", "doc_id", "text")).drop("text")


@query("op1_token_counts")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


@query("op10_pii")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(table(spark, folder, "documents", "doc_id", "text")).drop("text")


@query("op3_nearest")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return cross_polytope.nearest(table(spark, folder, "embeddings", "vec_id", "embedding"))


@query("op7_quality")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "labels", "doc_id", "quality")
    return quality.score_quality(docs, labels).drop("text")


@query("op9_near_duplicates")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return probminhash.near_duplicate_classes(table(spark, folder, "documents", "doc_id", "text"))


@query("op2_suffix_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents", "doc_id", "text"))


@query("op6_html_text")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(table(spark, folder, "pages", "page_id", "url", "html")).drop("html")


@query("op4_mixing", mixing.mix_sql())
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.select_mix(table(spark, folder, "documents", "doc_id", "text", "lang", "source"))


@query("op11_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened_components(table(spark, folder, "embeddings", "vec_id", "embedding"))


@query("op12_perplexity")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return kneser_ney.score_documents(table(spark, folder, "documents", "doc_id", "text")).drop("text")


@query("op13_filter_audit", filter_audit.audit_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents", "doc_id", "text", "source"), table(spark, folder, "labels", "doc_id", "quality", "toxic")
    return filter_audit.audit_filters(docs, labels)
