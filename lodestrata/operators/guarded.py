"""Guarded walks, withheld families, claim order, JSON-lines intake and the outbox as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import graph
from ..queries import query, table
from ..sources import records
from ..streaming.assembly import folder
from .derivations import _ANCHORS, _EDGES, _LINKS, anchors, edges


@query("rec_paths_guarded", f"""
WITH RECURSIVE {_LINKS}, ok AS (SELECT event_id FROM events WHERE value < 80), e AS (SELECT x.* FROM ({_EDGES}) x JOIN ok ON ok.event_id = x.dst), p(node, depth, is_cycle, path) AS (
  SELECT node, 0, false, [node] FROM ({_ANCHORS})
  UNION ALL SELECT e.dst, depth + 1, list_contains(path, e.dst), list_append(path, e.dst) FROM p JOIN e ON e.src = p.node WHERE NOT is_cycle AND depth < 3)
SELECT node, depth, is_cycle, count(*) AS paths FROM p GROUP BY ALL""")
def rec_paths_guarded(spark: SparkSession, d: str) -> DataFrame:
    """A walk over support-eligible edges only; an outer group can't change which paths there are."""
    eligible = table(spark, d, "events").filter("value < 80").select(F.col("event_id").alias("dst"))
    guarded = edges(spark, d).join(eligible, "dst", "left_semi")
    return graph.walk_paths(guarded, anchors(spark, d), 3).groupBy("node", "depth", "is_cycle").agg(F.count("*").alias("paths"))


_REACH = f"WITH RECURSIVE {_LINKS}, e AS (SELECT DISTINCT * FROM ({_EDGES})), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)"


@query("root_budget", f"{_REACH}, n AS (SELECT e.event_id, count(r.b) AS reached FROM events e LEFT JOIN r ON r.a = e.event_id GROUP BY e.event_id) SELECT event_id, reached, reached > 12 AS withheld FROM n")
def root_budget(spark: SparkSession, d: str) -> DataFrame:
    """A lineage over its budget withholds its own family and no other (D7g)."""
    sizes = graph.closure(edges(spark, d)).groupBy(F.col("a").alias("event_id")).agg(F.count("*").alias("k"))
    n = F.coalesce("k", F.lit(0).cast("bigint"))
    return table(spark, d, "events").select("event_id").join(sizes, "event_id", "left").select("event_id", n.alias("reached"), (n > 12).alias("withheld"))


@query("derivation_status", f"""
{_REACH}, all_ AS (SELECT a, b FROM r UNION SELECT event_id, event_id FROM events), g AS (SELECT a, bool_or(v.value > 150) AS withdrawn, bool_or(v.value BETWEEN 120 AND 150) AS disputed FROM all_ JOIN events v ON v.event_id = b GROUP BY a)
SELECT a AS node, CASE WHEN withdrawn THEN 'unsupported' WHEN disputed THEN 'indeterminate' ELSE 'qualified' END AS status, CASE WHEN withdrawn THEN 'withdrawn' WHEN disputed THEN 'disputed' END AS gap FROM g""")
def derivation_status(spark: SparkSession, d: str) -> DataFrame:
    """Whether a node's roots are qualified, with the worst gap among all that it rests on."""
    e = table(spark, d, "events")
    every = graph.closure(edges(spark, d)).unionByName(e.select(F.col("event_id").alias("a"), F.col("event_id").alias("b"))).distinct()
    facts = e.select(F.col("event_id").alias("b"), (F.col("value") > 150).alias("w"), F.col("value").between(120, 150).alias("q"))
    g = every.join(facts, "b").groupBy(F.col("a").alias("node")).agg(F.bool_or("w").alias("w"), F.bool_or("q").alias("q"))
    return g.select("node", F.when(F.col("w"), "unsupported").when(F.col("q"), "indeterminate").otherwise("qualified").alias("status"), F.when(F.col("w"), "withdrawn").when(F.col("q"), "disputed").alias("gap"))


@query("claim_order", """
SELECT event_id, user_id % 11 AS class, row_number() OVER (PARTITION BY user_id % 11 ORDER BY value DESC, ts, event_id) AS place FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 11 ORDER BY value DESC, ts, event_id) <= 5""")
def claim_order(spark: SparkSession, d: str) -> DataFrame:
    """The next tasks of each class under a concurrency cap (Q10)."""
    w = Window.partitionBy("class").orderBy(F.desc("value"), "ts", "event_id")
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 11).alias("class"), "value", "ts")
    return e.withColumn("place", F.row_number().over(w)).filter("place <= 5").select("event_id", "class", F.col("place").cast("bigint").alias("place"))


@query("admitted_anchors", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS admitted FROM customer")
def admitted_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Which identifiers a caller may name: those that its frame shows."""
    shown = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("_shown")).distinct()
    return table(spark, d, "customer").select("c_custkey").join(shown, "c_custkey", "left").select("c_custkey", F.coalesce("_shown", F.lit(False)).alias("admitted"))


@query("jsonl_records", "SELECT 'conv/' || conv_id || '/' || turn AS record_key, role AS record_kind, turn AS ordinal, sha256(text) AS digest, false AS is_damaged FROM conversations")
def jsonl_records(spark: SparkSession, d: str) -> DataFrame:
    """Records that went through JSON-lines files under a declared schema."""
    path = folder(spark)
    c = table(spark, d, "conversations").select(F.concat_ws("/", F.lit("conv"), "conv_id", "turn").alias("record_key"), F.col("role").alias("record_kind"), F.col("turn").alias("ordinal"), "text")
    records.write(c, path)
    return records.read(spark, path).select("record_key", "record_kind", "ordinal", F.sha2("text", 256).alias("digest"), F.col("damaged").isNotNull().alias("is_damaged"))


@query("outbox", "SELECT 'chunk' AS kind, CAST(n_nationkey AS VARCHAR) AS key, '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || '}' AS body FROM nation")
def outbox(spark: SparkSession, d: str) -> DataFrame:
    """Outbox rows, published twice and delivered once."""
    path = folder(spark)
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    for _ in range(2):
        records.publish(n, path, "chunk", "n_nationkey")
    return records.delivered(spark, path).select("kind", "key", "body")
