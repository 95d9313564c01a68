"""Temporal operators: latest rows, as-of and interval joins, interval unions and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`; partial maxima are taken before the shuffle, so that a hot key moves few rows.

    Filters on the result come after the choice: a hidden latest row never lets an older one through.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an order that needs directions or null places."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, tie: str, bucket: str = "1 day") -> DataFrame:
    """Each left row with the last right row of its key whose time is not later (nulls if there is none).

    Both sides are cut into time buckets and meet in windows over (key, bucket), so that a key with a third of all rows is
    spread over its buckets. What a bucket starts with, the last right row of earlier buckets, comes from a scan over one
    row for each key and bucket. `tie` orders right rows of equal time.
    """
    columns = [c for c in right.columns if c != key]
    row = F.struct(*[F.col(c) for c in [right_time, tie, *[c for c in columns if c not in (right_time, tie)]]])
    span = lambda c: F.window(F.col(c), bucket).start
    r = right.filter(F.col(right_time).isNotNull()).select(F.col(key), span(right_time).alias("_b"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), row.alias("_r"))
    kept = left.columns
    lft = left.filter(F.col(left_time).isNotNull()).select(F.col(key), span(left_time).alias("_b"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*kept).alias("_l"))
    both = r.unionByName(lft, allowMissingColumns=True)
    within = Window.partitionBy(key, "_b").orderBy("_t", "_side", F.col("_r")[tie]).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_in", F.last("_r", ignorenulls=True).over(within)).filter("_side = 1")
    ends = r.groupBy(key, "_b").agg(F.max("_r").alias("_end"))
    starts = both.select(key, "_b").distinct().join(ends, [key, "_b"], "full")
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).select(key, "_b", "_before")
    found = both.join(starts, [key, "_b"], "left").withColumn("_r", F.coalesce("_in", "_before"))
    out = found.select(*[F.col("_l")[c].alias(c) for c in kept], *[F.col("_r")[c].alias(c) for c in columns])
    untimed = left.filter(F.col(left_time).isNull())
    return out.unionByName(untimed.select(*kept, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns]))


def numbered_within(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Numbers the rows of each group 1, 2, ... in an order without ties, however few groups there are.

    Rows are range-partitioned by group and order; each partition numbers its own, and counts of the partitions before give a
    group its first number there.
    """
    dealt = stored(df.repartitionByRange(F.col(group), F.col(order)).withColumn("_p", F.spark_partition_id()))
    sums = dealt.groupBy(group, "_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), before.alias("_before"))
    local = dealt.withColumn(name, F.row_number().over(Window.partitionBy(group, "_p").orderBy(order)))
    met = local.join(stored(sums), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    return met.select(*df.columns, (F.col(name) + F.col("_before")).alias(name))


def overlap_join(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of one key whose half-open integer intervals overlap, by equality of cells and not by a nested loop.

    Cells are of `width` and of its doubles: an interval's own cells are of the first size that is no shorter than itself, so
    that it has two at most, however long it is. Two intervals meet in the larger one's size, where the smaller one is a
    visitor in two cells at most. A pair is reported only in the cell where its later start lies, so that no distinct is needed.
    """
    (ls, le), (rs, re_) = left_span, right_span

    def sized(df: DataFrame, s: str, e: str) -> DataFrame:
        # sizes are counted in whole doublings, so that no rounding of logarithms matters
        many = F.greatest(F.ceil((F.col(e) - F.col(s)) / width).cast("long"), F.lit(1)) - 1
        return df.filter(F.col(e) > F.col(s)).withColumn("_own", F.when(many == 0, 0).otherwise(F.length(F.bin(many))))

    a, b = sized(left, ls, le), sized(right, rs, re_)
    levels = [sorted(r["_own"] for r in x.select("_own").distinct().collect()) for x in (a, b)]  # 64 numbers at most

    def placed(df: DataFrame, s: str, e: str, others: list[int], mark: str) -> DataFrame:
        at = F.array_distinct(F.concat(F.array("_own"), F.filter(F.array(*[F.lit(n) for n in others]).cast("array<int>"), lambda n: n > F.col("_own"))))
        df = df.withColumn("_level", F.explode(at)).withColumn("_size", F.lit(width).cast("long") * F.expr("shiftleft(1L, _level)"))
        cells = F.sequence(F.floor(F.col(s) / F.col("_size")), F.floor((F.col(e) - 1) / F.col("_size")))
        return df.withColumn("_cell", F.explode(cells)).withColumnRenamed("_own", mark)

    a = placed(a, ls, le, levels[1], "_mine")
    b = placed(b, rs, re_, levels[0], "_theirs").drop("_size")
    met = a.join(b, [key, "_level", "_cell"]).filter((F.col("_level") == F.greatest("_mine", "_theirs")) & (F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le)))
    return met.filter(F.floor(F.greatest(ls, rs) / F.col("_size")) == F.col("_cell")).drop("_cell", "_level", "_size", "_mine", "_theirs")


def union_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Maximal intervals of the union of half-open [start, end) in each key; touching intervals join, empty ones don't count."""
    rows = df.filter(F.col(end) > F.col(start)).select(*keys, start, end).distinct()
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", (F.coalesce(F.col(start) > reach, F.lit(True))).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def gaps(covered: DataFrame, keys: list[str], start: str, end: str, low: Column, high: Column) -> DataFrame:
    """What a key's disjoint intervals leave of [low, high): the complement of union_intervals()."""
    w = Window.partitionBy(*keys).orderBy(start)
    inner = covered.withColumns({"_a": F.coalesce(F.lag(end).over(w), low), "_b": F.col(start), "_last": F.lead(start).over(w).isNull()})
    before = inner.select(*keys, F.col("_a").alias(start), F.col("_b").alias(end))
    after = inner.filter("_last").select(*keys, F.col(end).alias(start), high.alias(end))
    return before.unionByName(after).filter(F.col(start) < F.col(end))


def runs(df: DataFrame, keys: list[str], order: str, joined: Column) -> DataFrame:
    """Adds `run`, from 1: a row is in the run of the row before it, in its key by `order`, where `joined` holds.

    `joined` may use prev(c) columns, which the caller makes with lag over the same window.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("run", F.sum(F.when(joined, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
