"""What the operators of this subpackage share: bounded text slices, shared folders, hashing and a bounded filter."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import release, shared_dir, stored  # noqa: F401

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another system's C library
    _libc = None

#: UTF-8 bytes of text that a task turns into arrays at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: The same where arrays are many times the text.
SMALL_SLICE = 1 << 18


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice has at most `budget` bytes of text or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            limit = budget + (int(ends[start - 1]) if start else 0)
            stop = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Return a task's freed memory to the system, as a worker that is kept for other tasks would hold on to it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def bounded_session(spark: SparkSession) -> SparkSession:
    """A session like this one, with Arrow batches of at most 8 MB or 1000 rows, so that long texts don't add up in executors
    and their workers. The given session's settings stay as they are."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return own


def bounded(df: DataFrame) -> DataFrame:
    """The same rows in a session with bounded batches."""
    own = bounded_session(df.sparkSession)
    return DataFrame(own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.logicalPlan()), own)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Bloom:
    """A Bloom filter whose bits follow the number of keys up to a bound, so that its broadcast never grows beyond that.

    A key that was put in is always found; others are found at a rate that rises with the number of keys once the bound is
    reached. Callers must give the same results whatever that rate is: a false find may only cost work.
    """

    #: Bits for each key, and the fewest and the most bits: 8 MB at most, for 6 million keys at the full rate.
    PER_KEY, LEAST, MOST = 10, 1 << 16, 1 << 26
    SHIFTS = (0, 19, 38)

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, df: DataFrame, column: str, bits: int | None = None) -> Bloom:
        """Filter of a long column whose values are hashes; the executors set the bits, the driver gets at most bits/64 words."""
        if bits is None:
            bits = min(cls.MOST, max(cls.LEAST, 1 << (cls.PER_KEY * df.count()).bit_length()))
        key = F.col(column)
        places = F.array(*[F.shiftrightunsigned(key, n).bitwiseAND(F.lit(bits - 1)) for n in cls.SHIFTS])
        word = F.shiftright("p", 6).alias("w")
        bit = F.expr("shiftleft(1L, cast(p & 63 AS int))")
        got = df.select(F.explode(places).alias("p")).groupBy(word).agg(F.bit_or(bit).alias("b")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
        return cls(words)

    def __contains__(self, key: int) -> bool:
        """key: the signed long's bits, as an int of either sign."""
        mask = len(self.words) * 64 - 1
        key &= 0xFFFFFFFFFFFFFFFF
        return all(int(self.words[p >> 6]) >> (p & 63) & 1 for p in ((key >> n) & mask for n in self.SHIFTS))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Which of the signed longs may be in the filter."""
        keys, mask = keys.astype(np.int64).view(np.uint64), np.uint64(len(self.words) * 64 - 1)
        found = np.ones(len(keys), bool)
        for n in self.SHIFTS:
            p = (keys >> np.uint64(n)) & mask
            found &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return found


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is not taken, whatever its case: the given one with as many underscores as it needs."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows with one more column, and its name: unique, never null and the same whenever the rows are read again.

    Rows of files are told apart by file and place in it; others are written to the shared folder with a number.
    """
    row = fresh("row_", df.columns)
    try:
        return df.withColumn(row, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))), row
    except AnalysisException:
        return stored(df.withColumn(row, F.monotonically_increasing_id())), row


def parted(rows: DataFrame, picked: DataFrame, row: str) -> tuple[DataFrame, DataFrame]:
    """Numbered rows as two tables: those whose number is surely not in `picked`, and those whose number may be.

    A Bloom filter of the picked is asked as the rows are read; only hashes go to Python.
    """
    found = Bloom.of(picked.select(F.xxhash64(row).alias("hash")), "hash")

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        return pd.Series(found.find(hashes.to_numpy()))

    seen = maybe(F.xxhash64(row))
    return rows.filter(~seen), rows.filter(seen)


def without(rows: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    """Numbered rows less those whose number, the column `row`, is in `dropped`, and less that column.

    Most rows pass as they are read; only those that may be dropped are shuffled to an anti-join.
    """
    kept, maybe = parted(rows, dropped, row)
    return kept.unionByName(maybe.join(dropped, row, "left_anti")).drop(row)
