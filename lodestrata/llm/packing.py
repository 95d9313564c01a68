"""Best-fit packing by hierarchical residual packing.

Documents become pieces of at most one sequence. Pieces are dealt at random into groups of bounded size; each group packs its
own best-fit, longest first. Nearly full bins are final. Underfull bins go up a tree as items: a node best-fits the underfull
bins of several groups into each other, passes on what stays underfull, and so on to the root. Only bins' fills and member
lists move up, never tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import tokenizer
from .common import stored, text_slices

#: Tokens of a sequence, the id after each document, pieces of a group, groups of a node, and free tokens of a nearly full bin.
CAPACITY, END_ID, GROUP, FAN_IN, NEARLY = 4096, 1, 4096, 16, 0
#: Bins over half full that a node passes up, the emptiest first. Two of them never fit together, so that only the few bins
#: at most half full (one from each group) can use them; the others are final, as no later round would change them.
HOSTS = 256


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, and the bins' fills; items go longest first into the fullest bin with room.

    Bins with the same free space are a stack, and a bit mask of the free spaces that occur gives the least that suffices.
    """
    bins, offsets, fills = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    open_: dict[int, list[int]] = {}
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        rest = mask >> need
        if rest:
            free = need + ((rest & -rest).bit_length() - 1)
            stack = open_[free]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << free)
        else:
            free, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += need
        free -= need
        if free:
            open_.setdefault(free, []).append(b)
            mask |= 1 << free
    return bins, offsets, fills


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents' token runs: id, piece, start, length, ids (little-endian unsigned 32-bit). Only documents longer than a sequence are cut."""
    end = int(end_id).to_bytes(4, "little")
    names = ["id", "piece", "start", "length", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for part in text_slices(batches):
            which, rows = [], []
            for i, ids in enumerate(bpe.encode(part.column("text").to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    run_ = ids[at : at + 4 * capacity]
                    which.append(i)
                    rows.append((k, at // 4, len(run_) // 4, run_))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(which)), *columns], names=names)

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary")


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, fan_in: int = FAN_IN, nearly: int = NEARLY, hosts: int = HOSTS) -> DataFrame:
    """Adds sequence_id and offset to a stored table of items with a unique long `row` and a `length` from 1 to the capacity."""
    groups = max(1, -(-items.count() // group))
    bits = 24  # bins of a group are fewer

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets, fills = best_fit(pdf["length"].to_numpy(), capacity)
        first = int(pdf["part"].iloc[0]) << bits
        return pd.DataFrame({"row": pdf["row"], "part": pdf["part"], "bin": bins + first, "at": offsets, "fill": np.array(fills)[bins]})

    part = F.pmod(F.xxhash64("row", F.lit("part")), F.lit(groups)).alias("part")
    placed = stored(items.select("row", "length", part).groupBy("part").applyInPandas(local, "row long, part long, bin long, at long, fill long"))

    bins = placed.filter(F.col("fill") < capacity - nearly).groupBy("part", "bin").agg(F.first("fill").alias("fill"))
    bins = bins.withColumn("members", F.array(F.struct(F.col("bin"), F.lit(0).cast("long").alias("base")))).withColumn("final", F.lit(False))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", ignore_index=True)
        into, offsets, fills = best_fit(pdf["fill"].to_numpy(), capacity)
        members: list[list[dict]] = [[] for _ in fills]
        for b, at, ms in zip(into.tolist(), offsets.tolist(), pdf["members"], strict=True):
            members[b] += [{"bin": int(m["bin"]), "base": int(m["base"]) + at} for m in ms]
        fill = np.array(fills)
        passed = np.zeros(len(fills), bool)
        low = np.argsort(fill, kind="stable")
        passed[low[: int((2 * fill <= capacity).sum()) + hosts]] = True
        passed &= fill < capacity - nearly
        return pd.DataFrame({"part": pdf["part"].iloc[0], "bin": [m[0]["bin"] for m in members], "fill": fill, "members": members, "final": ~passed})

    shape = "part long, bin long, fill long, members array<struct<bin:long,base:long>>, final boolean"
    done, nodes = [], groups
    while True:
        nodes = -(-nodes // fan_in)
        bins = bins.withColumn("part", F.floor(F.col("part") / fan_in))
        bins = stored(bins.groupBy("part").applyInPandas(merge, shape))
        if nodes == 1:
            done.append(bins)
            break
        done.append(bins.filter("final"))
        bins = bins.filter("not final")
    merged = done[0]
    for more in done[1:]:
        merged = merged.unionByName(more)
    moved = merged.select(F.col("bin").alias("root"), F.explode("members").alias("m")).select("root", F.col("m.bin").alias("bin"), F.col("m.base").alias("base"))
    where = placed.join(moved, "bin", "left").select("row", F.coalesce("root", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("base", F.lit(0))).alias("offset"))
    return items.join(where, "row").drop("row")


def pack_documents(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece of a document: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece that holds the end id alone. Pieces of a sequence lie gapless from offset 0. Repeated
    rows and null ids are packed like any other. Other columns are not read. An empty table gives an empty result.
    """
    rows = pieces(df, path, capacity, end_id, id_column, text_column).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    return pack(rows, capacity).withColumnRenamed("id", id_column)
