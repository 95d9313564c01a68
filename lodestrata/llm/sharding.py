"""Sharding by sampled splitters, with DataFrame functions only.

Records are ordered by (hash of text, hash of id, place): equal texts lie together, whatever files they come from, and yet a text with any number of copies can be divided.
A sample of keys, drawn with a chance in proportion to size, gives quantile boundaries of many ranges; a range that turns out
to hold far more records than its share is subdivided by boundaries sampled from it. Ranges are the unit of parallel work: each is
sorted on its own, and offsets of whole ranges (a bounded number) make the running sum of bytes global. A record goes to the
shard in which the middle of its bytes falls, so that a shard's bytes differ from an equal share by one record at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows of a range aimed at, the fewest and the most ranges, keys sampled for each range, and how far over its share a range may be.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES, SAMPLES, OVERFULL = 1_000_000, 192, 4096, 24, 2.0


def _longs(values: list[int]) -> Column:
    """A literal array, folded from one string: a literal for each value would make plans of thousands of nodes."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(splitters: list[tuple[int, int, int]]) -> Column:
    """How many of the sorted splitters are at most the key (hash, tie, row), by binary search over literal arrays."""
    n = len(splitters)
    if not n:
        return F.lit(0)
    hashes, ties, rows = (_longs(list(x)) for x in zip(*splitters))
    steps = _longs([1 << k for k in reversed(range(n.bit_length()))]).cast("array<int>")

    def go(at: Column, step: Column) -> Column:
        h, t = F.get(hashes, at + step - 1), F.get(ties, at + step - 1)
        passed = (h < F.col("hash")) | ((h == F.col("hash")) & ((t < F.col("tie")) | ((t == F.col("tie")) & (F.get(rows, at + step - 1) <= F.col("row")))))
        return F.when((at + step <= n) & passed, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), go)


def _splitters(df: DataFrame, ranges: int, samples: int, rate: Column) -> list[tuple]:
    """Quantile boundaries of a sample of keys that takes a record at a chance of `rate`; the driver gets about ranges * samples keys."""
    chance = F.pmod(F.xxhash64("row", F.lit("splitters")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    keys = sorted({tuple(r) for r in df.filter(chance < rate).select("hash", "tie", "row").collect()})
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def shard(df: DataFrame, shards: int = 24, id_column: str = "doc_id", text_column: str = "text", overhead: int = 8, range_rows: int = RANGE_ROWS, least_ranges: int = LEAST_RANGES) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard (0 to shards - 1), slot (0, 1, ... in each shard), grown_shard.

    size is the UTF-8 bytes of the text (null: none, with the CRC of no bytes) plus `overhead`. The law is `bytes`: the
    shards' sums of size are as near equal as whole records allow. grown_shard is null under this law. Rows with equal or
    null ids and equal texts are told apart by their place in the input. Other columns are not read. An empty table gives an
    empty result. Slots follow the order of (hash of text, hash of id, place in the input); only rows that are equal in id and
    text can change places when files are laid out anew. Equal texts are neighbours in that order, in one shard or in
    adjoining ones: a group may be larger than a shard's share.
    """
    data = F.encode(F.coalesce(F.col(text_column), F.lit("")), "utf-8")
    id_ = F.col(id_column)
    rows = df.select(id_.alias("id"), (F.length(data) + overhead).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.xxhash64(data).alias("hash"), F.xxhash64(id_).alias("tie"))
    # row: a key's last part, unique, and the same whenever the stored table is read
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    all_bytes, all_rows = int(total[0]), int(total[1])
    ranges = max(least_ranges, min(MOST_RANGES, all_rows // range_rows))

    first = _splitters(rows, ranges, SAMPLES, F.col("size") * F.lit(ranges * SAMPLES / max(1, all_bytes)))
    counted = rows.withColumn("range", _range_of(first))
    full = {r["range"]: r["n"] for r in counted.groupBy("range").agg(F.count("*").alias("n")).collect()}
    fair = OVERFULL * max(all_rows / ranges, 64)
    over = {k: n for k, n in full.items() if n > fair}
    if over:
        pieces = {k: int(n // fair) + 1 for k, n in over.items()}
        rate = F.coalesce(*[F.when(F.col("range") == k, F.lit(p * SAMPLES / over[k])) for k, p in pieces.items()])
        chance = F.pmod(F.xxhash64("row", F.lit("subdivide")), F.lit(1 << 53)) / F.lit(float(1 << 53))
        sample: dict[int, list] = {}
        for r in counted.filter(F.col("range").isin(list(over)) & (chance < rate)).select("range", "hash", "tie", "row").collect():
            sample.setdefault(r["range"], []).append((r["hash"], r["tie"], r["row"]))
        for k, keys in sample.items():
            keys.sort()
            first += [keys[len(keys) * i // pieces[k]] for i in range(1, pieces[k])]
        first = sorted(set(first))

    ranged = rows.withColumn("range", _range_of(first))
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    starts, at_byte, at_row = [(0, 0)] * (len(first) + 1), 0, 0
    for r in sorted(sums.collect(), key=lambda r: r["range"]):  # one row a range
        starts[r["range"]] = (at_byte, at_row)
        at_byte, at_row = at_byte + r["bytes"], at_row + r["n"]
    bytes_before, rows_before = (F.get(_longs(list(x)), F.col("range")) for x in zip(*starts))

    order = Window.partitionBy("range").orderBy("hash", "tie", "row")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumns({"before": before, "nth": F.row_number().over(order) - 1})
    middle = bytes_before + F.col("before") + F.col("size") / 2
    placed = placed.withColumns({"shard": F.least(F.floor(middle * F.lit(shards) / F.lit(max(1, all_bytes))), F.lit(shards - 1)).cast("int"), "rank": rows_before + F.col("nth")})
    placed = stored(placed.select("id", "size", "text_crc32", "shard", "rank"))
    begun = {r["shard"]: r["rank"] for r in placed.groupBy("shard").agg(F.min("rank").alias("rank")).collect()}  # one row a shard
    begin = _longs([begun.get(k, 0) for k in range(shards)])
    return placed.select(F.col("id").alias(id_column), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.get(begin, F.col("shard"))).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
