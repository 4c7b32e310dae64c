"""The operators and the pipeline as queries over the test tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, counts, exact, lm, media, neardup, packing, quality, sharding, spelling, substring
from .common import documents

RANKS, VOCABULARY, PIECES = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path(RANKS))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_with_edits(documents(spark, sf_dir), public_tokenizers.path(RANKS))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), width=2)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir)).drop("locator")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(documents(spark, sf_dir))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(turns.unionByName(own))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", F.coalesce(quality.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op11_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECES))


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over the table of pages: every segment, resolved against stored payloads of the references of every other page. There are
    no media in the test tables: the payload of an address is the source of the first page that refers to it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    said = media.parse_pages(pages.where("page_id % 2 = 0")).select("doc_id", F.explode("segments.digest").alias("digest")).where("digest is not null")
    first = said.groupBy("digest").agg(F.min("doc_id").alias("page_id")).join(pages, "page_id")
    known = media.described(media.store(first.select("digest", F.col("html").cast("binary").alias("body"))))
    return media.page_sequences(pages, known)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_lm_scoring, op2_byte_bpe, op3_media_columns, op4_token_counts, op5_minhash_near_dedup, op6_exact_dedup, op7_substring_dedup, op8_chat_formatting,
        op9_quality_classifier, op10_best_fit_packing, op11_external_shuffle, op12_spelling_variants, op13_tokenizer_alignment, media_pages, pipeline,
    )
    return {f.__name__: f for f in every}


_EXACT = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

_CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, coalesce(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), false) AS goes_on,
    length(replace(replace(text, '\', '\\'), '[', '\(')) AS shown,
    length(replace(replace(replace(role, '\', '\\'), '[', '\('), ']', '\)')) AS role_shown FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(shown + CASE WHEN goes_on THEN length('[NEXT]') ELSE role_shown + length('[ROLE:][/ROLE]') END)::BIGINT AS formatted_chars,
  count(*) FILTER (NOT goes_on) AS n_blocks
FROM m GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": _EXACT, "op8_chat_formatting": _CHAT}
