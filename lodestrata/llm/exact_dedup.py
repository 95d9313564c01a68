"""Exact deduplication by content-defined chunk recipes.

A text is cut into content-defined chunks; its recipe is the ordered list of their identifiers. A chunk's candidate
identifier is its SHA-256; Spark gathers the distinct chunks and verifies each identifier: all chunks under it must agree in
length and in an independent second digest, or else these join the identifier. Texts are equal when their ordered lists of
verified identifiers are. Only digests are shuffled, about 1/30 of the text, and each distinct recipe only once from a task:
no text is moved at all, however long it is or however many copies it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import cut_points
from .common import bounded, numbered, stored, text_slices, without

_SPACE = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_RECIPE = "array<struct<digest:binary,check:binary,length:int>>"


def one_space(text: bytes) -> bytes:
    """Each run of ASCII white space (0x20, 0x09 to 0x0D) becomes one space; nothing is trimmed."""
    text = text.translate(_SPACE)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def _recipes(carried: list[str]):
    """For mapInArrow: the carried columns, recipe_key, text_sha256 and recipe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            texts = [one_space(x.encode()) if x else b"" for x in part.column("text").to_pylist()]
            data = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.cumsum([len(x) for x in texts])
            recipes, keys, whole = [], [], []
            for text, cuts in zip(texts, cut_points(data, ends), strict=True):
                chunks = [text[a:b] for a, b in zip([0, *cuts], cuts)]
                recipe = [{"digest": hashlib.sha256(c).digest(), "check": hashlib.blake2b(c, digest_size=16).digest(), "length": len(c)} for c in chunks]
                recipes.append(recipe)
                keys.append(hashlib.sha256(b"".join(x["digest"] + x["check"] + x["length"].to_bytes(4, "little") for x in recipe)).digest())
                whole.append(recipe[0]["digest"].hex() if len(recipe) == 1 else hashlib.sha256(text).hexdigest())
            kind = pa.list_(pa.struct([("digest", pa.binary()), ("check", pa.binary()), ("length", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(keys, pa.binary()), pa.array(whole, pa.string()), pa.array(recipes, kind)], names=[*carried, "recipe_key", "text_sha256", "recipe"])

    return run


def _decide(df: DataFrame) -> DataFrame:
    """For columns id, text and perhaps row: id, row, keep_id, keep_row, group_size, text_sha256."""
    carried = [c for c in df.columns if c != "text"]
    shape = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in carried)
    rows = df.mapInArrow(_recipes(carried), f"{shape}, recipe_key binary, text_sha256 string, recipe {_RECIPE}")
    rows = stored(rows if "row" in carried else rows.withColumn("row", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")

    recipes = rows.groupBy("recipe_key").agg(first, F.count("*").alias("n"), F.min_by("recipe", "row").alias("recipe"))
    recipes = stored(recipes)
    parts = recipes.select("recipe_key", F.posexplode("recipe").alias("at", "chunk")).select("recipe_key", "at", "chunk.*")
    told = F.struct("check", "length")
    # read from files, the join with the chunks of all recipes can split a chunk that very many texts share
    chunks = stored(parts.groupBy("digest").agg((F.min(told) == F.max(told)).alias("verified")))
    parts = parts.join(chunks, "digest").select("recipe_key", "at", F.when(F.col("verified"), F.col("digest")).otherwise(F.concat("digest", "check", F.encode(F.hex("length"), "utf-8"))).alias("chunk_id"))
    lists = parts.groupBy("recipe_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    classes = lists.join(recipes.select("recipe_key", "first", "n"), "recipe_key").groupBy("chunk_ids").agg(F.collect_list("recipe_key").alias("keys"), F.min("first").alias("first"), F.sum("n").alias("group_size"))
    classes = classes.select(F.explode("keys").alias("recipe_key"), F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size")
    return rows.drop("recipe").join(classes, "recipe_key").drop("recipe_key")


def deduplicate(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Of equal texts the row with the smallest id is kept; null ids come last, and of rows that
    share the smallest id exactly one is kept. Other columns, whatever their names, are not read. An empty table gives an
    empty result.
    """
    found = _decide(bounded(df).select(F.col(id_column).alias("id"), F.col(text_column).alias("text")))
    return found.select(F.col("id").alias(id_column), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def keep_first(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that deduplicate() keeps, with all their columns, whatever their names. Texts that stay are not shuffled.

    Nulls, repeated ids and empty tables are as there.
    """
    rows, row = numbered(bounded(df))
    found = _decide(rows.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(row).alias("row")))
    return without(rows, stored(found.filter(F.col("row") != F.col("keep_row")).select(F.col("row").alias(row))), row)
