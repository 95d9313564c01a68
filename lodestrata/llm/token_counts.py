"""Token counts of documents in flat token files by a separator scan.

A flat file is a run of token ids without an index; a separator id ends each document. Blocks are scanned on their own for
the separator, all at once with numpy. A prefix scan over the blocks' summaries (tokens, separators, place of the last
separator) then gives each block the number of documents before it and where the document that is open at its start began,
so that documents that span blocks are stitched without reading a token again. The scan has two levels, so that a file of
any length never has its summaries in one task.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, text_slices

#: Tokens of a block, and blocks scanned together on the lower level.
BLOCK, SPAN = 1 << 15, 1024


@functools.cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_flat(df: DataFrame, path: str, pattern: str, separator: int, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK, dtype: str = "<u2") -> tuple[DataFrame, DataFrame]:
    """Encode texts into flat files: the blocks (file, block, tokens) and the manifest (file, ordinal, id), both stored.

    Each task writes one file. A null text counts as empty: its document is a separator alone. The separator must be an id
    that the encoder never gives. Null and repeated ids are documents like others; other columns are not read. A text of any
    length is encoded at once, in one task. An empty table gives no blocks and an empty manifest.
    """
    kind = df.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, file = _encoding(path, pattern), TaskContext.get().partitionId()
        rest, size, number, ordinal = [], 0, 0, 0
        end = np.array([separator], dtype)

        def blocks(last: bool) -> Iterator[bytes]:
            nonlocal rest, size
            tokens = np.concatenate(rest) if rest else np.empty(0, dtype)
            whole = len(tokens) if last else len(tokens) // block * block
            yield from (tokens[i : min(i + block, whole)].tobytes() for i in range(0, whole, block))
            rest, size = [tokens[whole:]], len(tokens) - whole

        def batch(data: list[bytes], ids: pa.Array) -> pa.RecordBatch:
            nonlocal number, ordinal
            n, m = len(data), len(ids)
            at = pa.array([*range(number, number + n), *range(ordinal, ordinal + m)], pa.int64())
            number, ordinal = number + n, ordinal + m
            return pa.RecordBatch.from_arrays([pa.array([True] * n + [False] * m), pa.array([file] * (n + m), pa.int64()), at, pa.array([*data, *[None] * m], pa.binary()), pa.concat_arrays([pa.nulls(n, ids.type), ids])], names=["is_block", "file", "at", "tokens", "id"])

        none = None
        for part in text_slices(batches):
            for text in part.column("text").to_pylist():
                ids = np.asarray(encoding.encode_to_numpy(text, disallowed_special=()) if text else (), dtype)
                rest += [ids, end]
                size += len(ids) + 1
            none = part.column("id").slice(0, 0)
            yield batch([*blocks(False)] if size >= block else [], part.column("id"))
        if size:
            yield batch([*blocks(True)], none)

    shape = f"is_block boolean, file long, at long, tokens binary, id {kind.simpleString()}"
    both = stored(df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, shape), partition_by=["is_block"])
    return both.filter("is_block").select("file", F.col("at").alias("block"), "tokens"), both.filter("not is_block").select("file", F.col("at").alias("ordinal"), "id")


def read_flat(spark: SparkSession, path: str, block: int = BLOCK, dtype: str = "<u2") -> DataFrame:
    """Blocks (file, block, tokens) of binary files of ids, in any store that Spark reads; file is a hash of the path.

    Files of any length are read in Spark's own splits, by many tasks: as lines of raw bytes, cut at the byte 10 wherever it
    is, whose lengths give every split its place in the file. An id that two splits or pieces share is put together from the
    piece's last bytes and the first of the next. A file whose last id is not whole is an error, as is one that changes
    meanwhile. Without any file there is an error, as Spark gives it; empty files have no blocks.
    """
    size = np.dtype(dtype).itemsize
    step = block * size
    lines = spark.read.option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    lines = lines.select(F.col("value").cast("binary").alias("value"), F.xxhash64(meta["file_path"]).alias("file"), meta["file_block_start"].alias("split"), meta["file_size"].alias("size"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of a split in order, each with its place there and the bytes after it that an id may need."""
        held, key, at, number = bytearray(), None, 0, 0

        def pieces(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, at, number
            while len(held) >= step + size or last and held:
                own, more = bytes(held[: step + size - 1]), min(step, len(held))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((key[0], pa.int64()), (key[1], pa.int64()), (key[2], pa.int64()), (number, pa.int64()), (at, pa.int64()), (more, pa.int64()), (own, pa.binary()))], names=names)
                del held[:more]
                at, number = at + more, number + 1

        for batch in batches:
            for value, *now in zip(batch.column("value"), *(batch.column(c).to_pylist() for c in ("file", "split", "size")), strict=True):
                if key != now:
                    yield from pieces(True)
                    key, at, number = now, 0, 0
                held += value.as_buffer()
                held += b"\n"
                yield from pieces(False)
        yield from pieces(True)

    names = ["file", "split", "size", "number", "at", "n", "bytes"]
    parts = stored(lines.mapInArrow(cut, "file long, split long, size long, number long, at long, n long, bytes binary"))
    # one row for each split: where its bytes begin, how many pieces are before it, and the bytes that it begins with
    splits = parts.groupBy("file", "split").agg(F.sum("n").alias("length"), F.count("*").alias("pieces"), F.max("size").alias("size"), F.min_by(F.substring("bytes", 1, size - 1), "number").alias("head"))
    ahead = Window.partitionBy("file").orderBy("split")
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    splits = stored(splits.withColumns({"base": F.coalesce(F.sum("length").over(before), zero), "first": F.coalesce(F.sum("pieces").over(before), zero), "next": F.lead("head").over(ahead)}))
    # the last line's end counts one byte that the file need not have
    files = splits.groupBy("file").agg(F.max("size").alias("size"), F.sum("length").alias("length"))
    wrong = files.filter((F.col("size") % size != 0) | ~(F.col("length") - F.col("size")).isin(0, 1)).first()
    if wrong is not None:
        raise ValueError(f"a flat file of {wrong['size']} bytes ends inside of an id" if wrong["size"] % size else "a flat file has changed while it was read")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for start, n, total, own, following in zip(*(batch.column(c).to_pylist() for c in ("start", "n", "size", "bytes", "next")), strict=True):
                data = (own + (following or b""))[: total - start]  # of a split's last piece the next split has the bytes after it
                first = -start % size
                ids = max(0, -(-(min(n, total - start) - first) // size))
                out.append(data[first : first + ids * size])
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(out, pa.binary())], names=["file", "block", "tokens"])

    placed = parts.join(splits.select("file", "split", "base", "first", "next"), ["file", "split"])
    placed = placed.select("file", (F.col("first") + F.col("number")).alias("block"), (F.col("base") + F.col("at")).alias("start"), "n", "size", "bytes", F.when(F.length("bytes") == F.col("n"), F.col("next")).alias("next"))
    return placed.mapInArrow(align, "file long, block long, tokens binary")


def separator_scan(blocks: DataFrame, separator: int, dtype: str = "<u2", span: int = SPAN) -> DataFrame:
    """Documents of flat files given as blocks (file, block, tokens): file, ordinal, start, n_tokens, complete.

    Blocks of a file are numbered in order and may have any, also different, lengths; null or empty ones hold no tokens.
    start counts tokens from the file's beginning; n_tokens leaves the separator out. Tokens behind a file's last separator
    are one more document that is not complete. An empty table gives an empty result.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for data in batch.column("tokens"):
                tokens = np.frombuffer(data.as_buffer() if data.is_valid else b"", dtype)
                found.append(np.flatnonzero(tokens == separator).astype(np.int32))
                sizes.append(len(tokens))
            ends = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)), pa.array(np.concatenate([*found, np.empty(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(sizes, pa.int64()), ends], names=["file", "block", "n", "ends"])

    summaries = stored(blocks.select("file", "block", "tokens").mapInArrow(scan, "file long, block long, n long, ends array<int>"))
    # last: how many tokens of the block, or of what lies before the next, are behind its last separator; null without one
    summaries = summaries.withColumns({"span": F.floor(F.col("block") / span), "seps": F.size("ends").cast("long"), "last": F.when(F.size("ends") > 0, F.element_at("ends", -1).cast("long") + 1)})

    inner = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    local = summaries.withColumns({"tokens_in": F.coalesce(F.sum("n").over(inner), zero), "seps_in": F.coalesce(F.sum("seps").over(inner), zero)})
    local = local.withColumn("open_in", F.max(F.col("tokens_in") + F.col("last")).over(inner))
    spans = local.groupBy("file", "span").agg(F.sum("n").alias("n"), F.sum("seps").alias("seps"), F.max(F.col("tokens_in") + F.col("last")).alias("last"))
    outer = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumns({"tokens_before": F.coalesce(F.sum("n").over(outer), zero), "seps_before": F.coalesce(F.sum("seps").over(outer), zero)})
    spans = stored(spans.withColumn("open_before", F.coalesce(F.max(F.col("tokens_before") + F.col("last")).over(outer), zero)))

    placed = local.join(spans.select("file", "span", "tokens_before", "seps_before", "open_before"), ["file", "span"])
    base = F.col("tokens_before") + F.col("tokens_in")
    opened = F.coalesce(F.col("tokens_before") + F.col("open_in"), F.col("open_before"))
    begin = lambda i: F.when(i == 0, F.col("opened")).otherwise(F.col("base") + F.get(F.col("ends"), i - 1) + 1)
    documents = placed.select("file", "ends", base.alias("base"), opened.alias("opened"), (F.col("seps_before") + F.col("seps_in")).alias("first"))
    documents = documents.select("file", F.explode(F.transform("ends", lambda e, i: F.struct((F.col("first") + i).alias("ordinal"), begin(i).alias("start"), (F.col("base") + e - begin(i)).alias("n_tokens")))).alias("d")).select("file", "d.*", F.lit(True).alias("complete"))
    files = spans.groupBy("file").agg(F.sum("n").alias("n"), F.sum("seps").alias("ordinal"), F.max(F.coalesce(F.col("tokens_before") + F.col("last"), F.col("open_before"))).alias("start"))
    tails = files.filter("n > start").select("file", "ordinal", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("complete"))
    return documents.unionByName(tails)
