"""Byte-range sources: capture of ranges, newline framing across chunk borders, and completion of chunked records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.temporal import overlap_join

#: Bytes of the smallest cell in which ranges meet.
CELL = 1 << 16


def byte_chunks(df: DataFrame, key: str, data: str, size: int) -> DataFrame:
    """Binary values as contiguous ranges: key, start, end, data. An empty value is one empty range."""
    n = F.octet_length(data)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size)))
    cut = df.select(key, F.col(data).alias("_d"), starts.alias("start"))
    part = F.substring("_d", F.col("start") + 1, F.lit(size))
    return cut.select(key, "start", (F.col("start") + F.octet_length(part)).alias("end"), part.alias("data"))


def frame(chunks: DataFrame, key: str, most: int = 1 << 20) -> DataFrame:
    """Records ended by newlines from contiguous ranges (key, start, end, data), in whatever chunks they come.

    Gives key, record, byte_start, n_bytes (without the newline), data (without a carriage return at its end), ended (false
    for a tail without newline; a tail of no bytes is no record), oversized. Chunks are split on their own; a running count of
    newlines over the chunks, one row each, numbers the pieces, and pieces of one record are put together by number. So a
    record may span any number of chunks, and a source is never read by one task.
    """
    text = F.decode("data", "ISO-8859-1")
    split = chunks.select(key, "start", F.split(text, "\n", -1).alias("pieces"))
    split = split.withColumn("newlines", F.size("pieces") - 1)
    before = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counts = split.select(key, "start", F.coalesce(F.sum("newlines").over(before), F.lit(0)).alias("base"))
    pieces = split.join(counts, [key, "start"]).select(key, "start", "base", "newlines", F.posexplode("pieces").alias("i", "piece"))
    pieces = pieces.select(key, "start", "i", (F.col("base") + F.col("i")).alias("record"), "piece", (F.col("i") < F.col("newlines")).alias("ends"))
    parts = F.sort_array(F.collect_list(F.struct("start", "i", "piece")))
    whole = pieces.groupBy(key, "record").agg(F.array_join(F.transform(parts, lambda x: x["piece"]), "").alias("line"), F.bool_or("ends").alias("ended"))
    whole = whole.withColumn("n_bytes", F.length("line").cast("bigint")).filter("ended OR n_bytes > 0")
    running = Window.partitionBy(key).orderBy("record").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n_bytes") + 1).over(running), F.lit(0))
    return whole.select(key, "record", start.alias("byte_start"), "n_bytes", F.encode(F.regexp_replace("line", "\r$", ""), "ISO-8859-1").alias("data"), "ended", (F.col("n_bytes") > most).alias("oversized"))


def capture(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """What becomes of each range of a batch (key, start, end, sha256): outcome beside its columns.

    `replayed` if the same range with the same bytes is stored; `conflict` if it overlaps a stored range otherwise;
    `accepted` if it continues where the stored ranges end; else `gap`.
    """
    s = stored.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("sha256").alias("_h"))
    same = (F.col("_s") == F.col("start")) & (F.col("_e") == F.col("end")) & (F.col("_h") == F.col("sha256"))
    ranges = batch.select(key, "start", "end", "sha256")
    met = overlap_join(ranges, s.withColumnRenamed("_k", key), key, ("start", "end"), ("_s", "_e"), CELL)
    over = met.groupBy(key, "start", "end").agg(F.bool_and(same).alias("_same"))
    heads = stored.groupBy(key).agg(F.max("end").alias("_head"))
    j = batch.join(over, [key, "start", "end"], "left").join(heads, key, "left")
    outcome = F.when(F.col("_same"), "replayed").when(F.col("_same").isNotNull(), "conflict").when(F.coalesce("_head", F.lit(0)) == F.col("start"), "accepted").otherwise("gap")
    return j.select(*batch.columns, outcome.alias("outcome"))


def completed(chunks: DataFrame, keys: list[str], declared: str) -> DataFrame:
    """Records whose chunks (ordinal, byte_start, byte_end, text) lie gapless from 0 and give the declared SHA-256.

    Gives the keys, complete, n_chunks and text (null while incomplete).
    """
    w = Window.partitionBy(*keys).orderBy("byte_start")
    joined = F.coalesce(F.lag("byte_end").over(w), F.lit(0)) == F.col("byte_start")
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("byte_start", "text"))), lambda x: x["text"]), "")
    g = chunks.withColumn("_joined", joined).groupBy(*keys).agg(F.bool_and("_joined").alias("_all"), F.count("*").alias("n_chunks"), ordered.alias("_text"), F.max(declared).alias("_hash"))
    done = F.col("_all") & (F.sha2("_text", 256) == F.col("_hash"))
    return g.select(*keys, done.alias("complete"), "n_chunks", F.when(done, F.col("_text")).alias("text"))


def fold_commit(outcomes: DataFrame, key: str, cursors: DataFrame | None = None) -> DataFrame:
    """Whether the outcomes of each source (key, start, end, data, sha256) can be committed as a whole: T9.

    They must continue at the source's cursor (key, cursor; 0 without one), follow each other without gap or overlap, and hold
    the bytes that their digests declare. Gives the key, commit, reason (`gap` or `hash`; null if all is well) and the cursor
    after it: moved to the last end, or left where it was. An outcome that lies wholly before the cursor is a repeat and changes
    nothing.
    """
    at = F.coalesce("cursor", F.lit(0).cast("long")).alias("_at")
    rows = outcomes.select(key, "start", "end", (F.sha2("data", 256) == F.col("sha256")).alias("_sound"))
    rows = rows.join(cursors.select(key, "cursor"), key, "left").select(key, "start", "end", "_sound", at) if cursors is not None else rows.withColumn("_at", F.lit(0).cast("long"))
    new = F.col("end") > F.col("_at")
    before = Window.partitionBy(key).orderBy("start", "end")
    joined = F.coalesce(F.max(F.when(new, F.col("end"))).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.col("_at")) == F.col("start")
    got = rows.withColumn("_joined", ~new | joined).groupBy(key).agg(F.bool_and("_joined").alias("_whole"), F.bool_and("_sound").alias("_sound"), F.max("end").alias("_end"), F.max("_at").alias("_at"))
    fine = F.col("_whole") & F.coalesce("_sound", F.lit(False))
    return got.select(key, fine.alias("commit"), F.when(~F.col("_whole"), "gap").when(~fine, "hash").alias("reason"), F.when(fine, F.greatest("_end", "_at")).otherwise(F.col("_at")).cast("long").alias("cursor"))
