"""Window functions as queries: ranks, neighbours, row frames, filters inside windows and windows over groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.lowering import filtered_over
from ..plans.results import with_ordinal
from ..plans.store import shared_dir
from ..queries import query, table


def by_user() -> WindowSpec:
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("flagship", """
SELECT o_orderpriority AS priority, CAST(date_trunc('month', o_orderdate) AS VARCHAR)[1:7] AS month, count(*) AS n,
       CAST(sum(count(*)) OVER (PARTITION BY o_orderpriority ORDER BY date_trunc('month', o_orderdate) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderpriority, date_trunc('month', o_orderdate) HAVING count(*) > 0""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Join, group, condition on groups and a running sum over the groups.

    Lines are counted by order before the join, so that only one row of an order meets its order, and the window sees groups.
    """
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    month = F.date_trunc("month", "o_orderdate")
    g = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderpriority").alias("priority"), month.alias("m")).agg(F.sum("k").alias("n"))
    running = F.sum("n").over(Window.partitionBy("priority").orderBy("m").rowsBetween(Window.unboundedPreceding, 0))
    return g.filter("n > 0").select("priority", F.date_format("m", "yyyy-MM").alias("month"), "n", running.alias("running"))


@query("win_row_number", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events")
def win_row_number(spark: SparkSession, d: str) -> DataFrame:
    """Row numbers in a total order."""
    return table(spark, d, "events").select("event_id", F.row_number().over(by_user()).cast("bigint").alias("rn"))


@query("win_rank", "SELECT p_partkey, rank() OVER w AS r, dense_rank() OVER w AS dr FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC NULLS LAST)")
def win_rank(spark: SparkSession, d: str) -> DataFrame:
    """Ranks with ties."""
    w = Window.partitionBy("p_brand").orderBy(F.col("p_size").desc_nulls_last())
    return table(spark, d, "part").select("p_partkey", F.rank().over(w).cast("bigint").alias("r"), F.dense_rank().over(w).cast("bigint").alias("dr"))


@query("win_lag_lead", """
SELECT event_id, lag(event_type, 1, 'none') OVER w AS before, lead(event_id, 2) OVER w AS after, lag(event_id, 0) OVER w AS self, lead(event_id, 64) OVER w AS far
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def win_lag_lead(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours at offsets 0 to 64."""
    return table(spark, d, "events").select("event_id", F.lag("event_type", 1, "none").over(by_user()).alias("before"), F.lead("event_id", 2).over(by_user()).alias("after"), F.lag("event_id", 0).over(by_user()).alias("self"), F.lead("event_id", 64).over(by_user()).alias("far"))


@query("win_rows_frames", """
SELECT event_id, count(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS n, round(sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running,
       min(value) OVER (w ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS lo, max(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS hi, round(avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS mean
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def win_rows_frames(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates over row frames (W6, W7, W13): one sort serves all."""
    frame = lambda a, b: by_user().rowsBetween(a, b)
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    return table(spark, d, "events").select(
        "event_id",
        F.count("value").over(frame(-3, 1)).alias("n"),
        F.round(F.sum("value").over(frame(first, 0)), 4).alias("running"),
        F.min("value").over(frame(0, 5)).alias("lo"),
        F.max("value").over(frame(first, last)).alias("hi"),
        F.round(F.avg("value").over(frame(-2, 2)), 4).alias("mean"),
    )


@query("win_empty_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 FOLLOWING AND 3 FOLLOWING) AS n FROM events")
def win_empty_frame(spark: SparkSession, d: str) -> DataFrame:
    """A frame beyond the partition's end is empty."""
    return table(spark, d, "events").select("event_id", F.count("*").over(by_user().rowsBetween(2, 3)).alias("n"))


@query("win_filter_lowered", """
SELECT event_id, count(*) FILTER (WHERE value > 50) OVER w AS n, max(value) FILTER (WHERE event_type = 'click') OVER w AS hi
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)""")
def win_filter_lowered(spark: SparkSession, d: str) -> DataFrame:
    """FILTER inside a window."""
    w = by_user().rowsBetween(-10, 0)
    return table(spark, d, "events").select("event_id", filtered_over(F.count, F.lit(1), F.col("value") > 50, w).alias("n"), filtered_over(F.max, F.col("value"), F.col("event_type") == "click", w).alias("hi"))


@query("win_over_group", """
SELECT c_mktsegment, c_nationkey, n, CAST(sum(n) OVER (PARTITION BY c_mktsegment ORDER BY n, c_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running
FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL)""")
def win_over_group(spark: SparkSession, d: str) -> DataFrame:
    """Windows over groups' counts."""
    g = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    return g.withColumn("running", F.sum("n").over(Window.partitionBy("c_mktsegment").orderBy("n", "c_nationkey").rowsBetween(Window.unboundedPreceding, 0)))


@query("win_order_only", "SELECT row_number() OVER (ORDER BY k DESC, o_orderkey) AS place, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS k FROM orders WHERE o_totalprice > 3000)")
def win_order_only(spark: SparkSession, d: str) -> DataFrame:
    """A window that only orders (W12): every row's place in that order, without the window's own column."""
    w = Window.partitionBy("o_orderpriority").orderBy("o_totalprice", "o_orderkey")
    keyed = table(spark, d, "orders").filter("o_totalprice > 3000").select("o_orderkey", (-F.row_number().over(w)).alias("_k"))
    return with_ordinal(keyed, ["_k", "o_orderkey"], shared_dir(spark)).select(F.col("row_ref").alias("place"), "o_orderkey")


@query("win_validity", """
SELECT user_id, event_id, CAST(epoch_us(ts) AS BIGINT) AS valid_from, CAST(epoch_us(lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) AS BIGINT) AS valid_to FROM events""")
def win_validity(spark: SparkSession, d: str) -> DataFrame:
    """Validity intervals from event times."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("valid_from"), F.unix_micros(F.lead("ts").over(w).cast("timestamp")).alias("valid_to"))
