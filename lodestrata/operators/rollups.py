"""Accounting, queue and operational rollups as queries; requests, tasks and ledgers are views of the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import temporal
from ..queries import query, table

_USAGE = """SELECT event_id, ts, event_id % 2503 AS intent, user_id % 17 AS run, event_type, CAST(round(value * 100) AS BIGINT) AS micro FROM events"""


def usage(spark: SparkSession, d: str) -> DataFrame:
    """Usage events of request intents: purchases report cost, clicks pay, errors and views are outcomes."""
    return table(spark, d, "events").select("event_id", "ts", (F.col("event_id") % 2503).alias("intent"), (F.col("user_id") % 17).alias("run"), "event_type", F.round(F.col("value") * 100).cast("bigint").alias("micro"))


@query("catalog_cost", """
SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE CAST(ceil(p_size * 1000 * 3 / 1000000.0) + ceil(p_partkey * 150 / 1000000.0) + ceil(p_size * p_partkey * 7 / 1000000.0) + ceil(p_size * 25 / 1000000.0) AS BIGINT) END AS cost FROM part""")
def catalog_cost(spark: SparkSession, d: str) -> DataFrame:
    """Sum of four charges, each rounded up to a microunit; null if an input is (Q1)."""
    size, key = F.when(F.col("p_size") % 10 != 0, F.col("p_size").cast("bigint")), F.col("p_partkey")
    charge = lambda tokens, rate: F.ceil((tokens * rate).cast("decimal(38,0)") / F.lit(1_000_000).cast("decimal(10,0)"))
    return table(spark, d, "part").select("p_partkey", (charge(size * 1000, 3) + charge(key, 150) + charge(size * key, 7) + charge(size, 25)).cast("bigint").alias("cost"))


@query("usage_fold", f"""
WITH u AS ({_USAGE})
SELECT intent, arg_max(micro, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS reported, arg_max(micro, (ts, event_id)) FILTER (WHERE event_type = 'click') AS cash,
       arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type IN ('error', 'view')) AS outcome, string_agg(event_id, ',' ORDER BY ts, event_id) AS events,
       CASE WHEN count(*) FILTER (WHERE event_type = 'click') > 0 THEN 'cash' WHEN count(*) FILTER (WHERE event_type = 'purchase') > 0 THEN 'reported' ELSE 'unknown' END AS basis
FROM u GROUP BY intent""")
def usage_fold(spark: SparkSession, d: str) -> DataFrame:
    """Latest report, payment and outcome of an intent, its ordered events, and what the cost rests on (Q2, Q3): one shuffle."""
    at = F.struct("ts", "event_id")
    kind = lambda *k: F.col("event_type").isin(*k)
    last = lambda c, *k: F.max_by(F.when(kind(*k), F.col(c)), F.when(kind(*k), at))
    g = usage(spark, d).groupBy("intent").agg(
        last("micro", "purchase").alias("reported"),
        last("micro", "click").alias("cash"),
        last("event_type", "error", "view").alias("outcome"),
        F.array_join(F.transform(F.sort_array(F.collect_list(at)), lambda x: x["event_id"].cast("string")), ",").alias("events"),
    )
    return g.withColumn("basis", F.when(F.col("cash").isNotNull(), "cash").when(F.col("reported").isNotNull(), "reported").otherwise("unknown"))


@query("usage_rollup_run", f"""
WITH u AS ({_USAGE}) SELECT run, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, CAST(sum(micro) AS BIGINT) AS micro, count(DISTINCT intent) AS intents FROM u GROUP BY run""")
def usage_rollup_run(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sums of a run (Q4, Q13)."""
    return usage(spark, d).groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("micro").alias("micro"), F.countDistinct("intent").alias("intents"))


@query("usage_rollup_daily", f"WITH u AS ({_USAGE}) SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS operation, count(*) AS n, CAST(sum(micro) AS BIGINT) AS micro FROM u GROUP BY ALL")
def usage_rollup_daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily sums by operation (Q5)."""
    return usage(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("operation")).agg(F.count("*").alias("n"), F.sum("micro").alias("micro"))


@query("reconciliation", f"""
WITH u AS ({_USAGE}), a AS (SELECT CAST(sum(micro) AS BIGINT) AS total FROM u), b AS (SELECT CAST(sum(m) AS BIGINT) AS by_run FROM (SELECT sum(micro) AS m FROM u GROUP BY run)),
c AS (SELECT CAST(sum(m) AS BIGINT) AS by_day FROM (SELECT sum(micro) AS m FROM u GROUP BY strftime(ts, '%Y-%m-%d'))) SELECT total, by_run, by_day, total = by_run AND total = by_day AS parity FROM a, b, c""")
def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Totals of several rollups side by side, and whether they agree (Q6)."""
    u = usage(spark, d)
    total = u.agg(F.sum("micro").alias("total"))
    by_run = u.groupBy("run").agg(F.sum("micro").alias("m")).agg(F.sum("m").alias("by_run"))
    by_day = u.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum("micro").alias("m")).agg(F.sum("m").alias("by_day"))
    return total.crossJoin(by_run).crossJoin(by_day).withColumn("parity", (F.col("total") == F.col("by_run")) & (F.col("total") == F.col("by_day")))


@query("forecast_approval", """
SELECT e.event_id, CASE WHEN EXISTS (SELECT 1 FROM events n WHERE n.user_id = e.user_id AND n.event_type = 'signup' AND n.ts > e.ts) THEN 'stale' WHEN e.props IS NOT DISTINCT FROM '{"k": 69}' THEN 'pinned' ELSE 'approved' END AS status
FROM events e WHERE e.event_type = 'signup'""")
def forecast_approval(spark: SparkSession, d: str) -> DataFrame:
    """Approved unless a newer one exists; pins compare null-safe (Q7). The newest of each key is found without a self-join."""
    e = table(spark, d, "events").filter("event_type = 'signup'")
    newest = e.groupBy("user_id").agg(F.max("ts").alias("newest"))
    return e.join(newest, "user_id").select("event_id", F.when(F.col("newest") > F.col("ts"), "stale").when(F.col("props").eqNullSafe(F.lit('{"k": 69}')), "pinned").otherwise("approved").alias("status"))


@query("pricing_overlap", """
WITH p AS (SELECT event_id, user_id % 30 AS k, event_id * 10 AS a, event_id * 10 + CAST(floor(value) AS BIGINT) AS b FROM events WHERE event_type = 'view')
SELECT x.event_id AS first, y.event_id AS second FROM p x JOIN p y ON x.k = y.k AND x.a < y.b AND y.a < x.b WHERE x.event_id < y.event_id AND x.b > x.a AND y.b > y.a""")
def pricing_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping validity ranges of a price key (Q8)."""
    p = table(spark, d, "events").filter("event_type = 'view'").select("event_id", (F.col("user_id") % 30).alias("k"), (F.col("event_id") * 10).alias("a"), (F.col("event_id") * 10 + F.floor("value")).alias("b"))
    x, y = p.toDF("first", "k", "xa", "xb"), p.toDF("second", "k", "ya", "yb")
    return temporal.overlap_join(x, y, "k", ("xa", "xb"), ("ya", "yb"), 256).filter("first < second").select("first", "second")


_NOW = "TIMESTAMP '2024-02-01'"


@query("priority_order", f"""
SELECT event_id, CAST(user_id % 10 + least(4294967296, floor((epoch_us({_NOW}) - epoch_us(ts)) / 30000000)) AS BIGINT) AS priority FROM events WHERE event_type = 'error' ORDER BY priority DESC, ts, event_id LIMIT 200""")
def priority_order(spark: SparkSession, d: str) -> DataFrame:
    """Ready tasks by a priority that rises with age (Q9, Q10)."""
    age = F.floor((F.unix_micros(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 30_000_000)
    e = table(spark, d, "events").filter("event_type = 'error'").withColumn("priority", (F.col("user_id") % 10 + F.least(F.lit(4294967296), age)).cast("bigint"))
    return e.orderBy(F.desc("priority"), "ts", "event_id").limit(200).select("event_id", "priority")


@query("backoff", """
SELECT event_id, greatest(least(900, 5 * CAST(power(2, least(event_id % 15, 8)) AS BIGINT)) + event_id % 7, user_id) AS wait FROM events""")
def backoff(spark: SparkSession, d: str) -> DataFrame:
    """Exponential waits with a ceiling, jitter and a server's hint as the least (Q11)."""
    n = F.least(F.col("event_id") % 15, F.lit(8))
    return table(spark, d, "events").select("event_id", F.greatest(F.least(F.lit(900).cast("bigint"), 5 * F.pow(F.lit(2), n).cast("bigint")) + F.col("event_id") % 7, F.col("user_id")).alias("wait"))


@query("queue_health", """
SELECT user_id % 5 AS queue, event_type AS kind, count(*) FILTER (WHERE value < 20) AS ready, count(*) FILTER (WHERE value >= 20 AND value < 60) AS leased, count(*) FILTER (WHERE value >= 60) AS dead,
       CAST(epoch_us(min(ts) FILTER (WHERE value < 20)) AS BIGINT) AS oldest FROM events GROUP BY ALL""")
def queue_health(spark: SparkSession, d: str) -> DataFrame:
    """Counts by state and the oldest ready task of each queue and kind (Q12)."""
    v = F.col("value")
    return table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("queue"), F.col("event_type").alias("kind")).agg(
        F.count_if(v < 20).alias("ready"), F.count_if((v >= 20) & (v < 60)).alias("leased"), F.count_if(v >= 60).alias("dead"), F.unix_micros(F.min(F.when(v < 20, F.col("ts"))).cast("timestamp")).alias("oldest")
    )


@query("inbox_status", """
SELECT c.conv_id, CASE WHEN EXISTS (SELECT 1 FROM events e WHERE e.event_id = c.conv_id AND e.event_type = 'error') THEN 'failed'
 WHEN NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id = c.conv_id) THEN 'waiting' ELSE 'captured' END AS status FROM (SELECT DISTINCT conv_id FROM conversations) c""")
def inbox_status(spark: SparkSession, d: str) -> DataFrame:
    """Status from what exists for a capture, by one join (Q14)."""
    e = table(spark, d, "events").groupBy(F.col("event_id").alias("conv_id")).agg(F.bool_or(F.col("event_type") == "error").alias("failed"))
    c = table(spark, d, "conversations").select("conv_id").distinct().join(e, "conv_id", "left")
    return c.select("conv_id", F.when(F.col("failed"), "failed").when(F.col("failed").isNull(), "waiting").otherwise("captured").alias("status"))


@query("fold_inbox", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal, CAST(sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - octet_length(encode(text)) AS BIGINT) AS byte_start FROM conversations")
def fold_inbox(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes in the order of their bytes (Q15)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    size = F.octet_length("text").cast("bigint")
    before = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) - size
    return table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w).cast("bigint").alias("ordinal"), before.alias("byte_start"))


@query("allocation_ledger", f"""
WITH u AS ({_USAGE}) SELECT run, CAST(sum(CASE WHEN event_type = 'purchase' THEN micro WHEN event_type = 'click' THEN -micro ELSE 0 END) AS BIGINT) AS held, CAST(sum(CASE WHEN event_type = 'view' THEN micro ELSE 0 END) AS BIGINT) AS settled,
sum(CASE WHEN event_type = 'purchase' THEN micro WHEN event_type = 'click' THEN -micro ELSE 0 END) > 10000 AS over_quota FROM u GROUP BY run""")
def allocation_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Sums by state against a quota (Q16)."""
    t, m = F.col("event_type"), F.col("micro")
    g = usage(spark, d).groupBy("run").agg(F.sum(F.when(t == "purchase", m).when(t == "click", -m).otherwise(0)).alias("held"), F.sum(F.when(t == "view", m).otherwise(0)).alias("settled"))
    return g.withColumn("over_quota", F.col("held") > 10000)


@query("retention", "SELECT user_id, event_id FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20 AND ts > TIMESTAMP '2024-01-10'")
def retention(spark: SparkSession, d: str) -> DataFrame:
    """The newest 20 of each key that haven't expired (Q17, K3): Spark keeps only 20 of each key before the shuffle."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, d, "events").select("user_id", "event_id", "ts").withColumn("n", n).filter("n <= 20").filter("ts > timestamp_ntz'2024-01-10'").select("user_id", "event_id")


@query("cleanup_status", "SELECT count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-05') AS overdue, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-05' AND value > 90) AS pending, count(*) AS items FROM events")
def cleanup_status(spark: SparkSession, d: str) -> DataFrame:
    """Overdue and pending items."""
    old = F.col("ts") < F.lit("2024-01-05").cast("timestamp_ntz")
    return table(spark, d, "events").agg(F.count_if(old).alias("overdue"), F.count_if(~old & (F.col("value") > 90)).alias("pending"), F.count("*").alias("items"))


@query("forecast_series", f"""
WITH u AS ({_USAGE}), g AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(sum(micro) AS BIGINT) AS micro FROM u GROUP BY 1)
SELECT day, micro, CAST(round(avg(micro) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS forecast, sha256(day || ':' || micro) AS digest FROM g""")
def forecast_series(spark: SparkSession, d: str) -> DataFrame:
    """A forecast series with hashes (Q19); the window runs over days, which are few."""
    g = usage(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum("micro").alias("micro"))
    mean = F.avg("micro").over(Window.orderBy("day").rowsBetween(-6, 0))
    return g.select("day", "micro", F.round(mean, 0).cast("bigint").alias("forecast"), F.sha2(F.concat_ws(":", "day", "micro"), 256).alias("digest"))
