"""Corpus pipeline: toxicity, language ID, exact deduplication, near-duplicate removal and packing, in this order.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of
`documents`. A stage's decisions are joined back by a row number given when its input is read, so that null and repeated ids
are kept apart; inputs are stored tables, whose rows always have the same place. Columns other than those of `documents` are
left out, whatever their names. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import exact_dedup, langid, near_dedup, packing, toxicity
from lodestrata.llm.common import bounded
from lodestrata.llm.registry import word_tokenizer
from lodestrata.plans.store import release, shared_dir, written
from lodestrata.ship import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL expresses learned scores, sketches or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def _columns(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of documents, in a session of bounded batches."""
    ship(spark)
    return bounded(docs.select(*COLUMNS))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the grammar predicts as toxic. Labels come from the labels table beside the documents.

    Null and empty texts match nothing and stay. Rows with a null id teach nothing, but are judged like others; a repeated
    id teaches once. Where labels are missing the grammar's prior weights decide.
    """
    docs = _columns(spark, docs)
    return toxicity.filter_rows(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which no language is found: null texts, texts without a letter, and texts far from all profiles.

    Profiles and floor come from all labelled rows that are not held out. Rows with a null lang or id teach nothing, but are
    judged like others. Without any labelled row only texts without a letter go.
    """
    docs = _columns(spark, docs)
    training = docs.filter(~langid.held_out())
    profiles = langid.learn(training)
    return langid.filter_rows(docs, profiles, least=langid.floor(training, profiles))


def exact_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the smallest id; null ids last, one row of a repeated id."""
    return exact_dedup.keep_first(_columns(spark, docs))


def near_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id; null ids last, one row of a repeated id.

    Texts without words are classes of their own.
    """
    return near_dedup.keep_first(_columns(spark, docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens. Null and empty texts are a piece of the end id alone."""
    return packing.pack_documents(_columns(spark, docs), word_tokenizer())


STAGES = [("toxicity", toxicity_filter), ("language", language_filter), ("exact", exact_filter), ("near", near_filter), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage has written is deleted as soon as the next one has its input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = written(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_dir(spark)
            docs.write.parquet(path)
            release(spark, [p for p in written(spark) if p not in before and p != path])
            docs = spark.read.parquet(path)
    return docs
