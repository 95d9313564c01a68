"""The subpackage's queries, each over its whole tables with production parameters, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from . import bpe, exact_dedup, html, langid, media, near_dedup, packing, sharding, token_counts, toxicity
from .common import bounded_session, documents

QUERIES, ORACLES = {}, {}


def word_tokenizer() -> str:
    """Path of the tokenizer file that the queries use; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(bounded_session(ship(spark)), sf_dir)
    return f


@_query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(documents(spark, sf_dir))


ORACLES["op6_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""


@_query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


@_query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(documents(spark, sf_dir), word_tokenizer())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


@_query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), word_tokenizer())


@_query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = langid.learn(docs.filter(~langid.held_out()))
    return langid.identify(docs, profiles).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    grammar = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, grammar).select("doc_id", langid.held_out().alias("held_out"), "score", "predicted")


@_query
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


@_query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as flat files of byte-level BPE ids, and the counts that the separator scan finds in these."""
    import public_tokenizers

    separator = 50256  # free in this vocabulary
    blocks, manifest = token_counts.write_flat(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, separator)
    found = token_counts.separator_scan(blocks, separator)
    return manifest.join(found, ["file", "ordinal"]).select(F.col("id").alias("doc_id"), "n_tokens", "file", "ordinal", "start")


@_query
def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


@_query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
