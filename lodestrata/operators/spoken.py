"""Queries in the dialect's own words, each admitted, lowered and run: they show what the dialect means where Spark differs."""

from __future__ import annotations

import string
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import dialect
from ..plans.lowered import Recursion
from ..queries import query, table
from .derivations import _paths, anchors, edges

_FOLD = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"


def _say(spark: SparkSession, d: str, tables: str, sql: str, values: dict[str, Any] | None = None, **more: Any) -> DataFrame:
    """Run a query over views of the named tables; a table t is the relation said_t."""
    names = tables.split()
    for name in names:
        table(spark, d, name).createOrReplaceTempView(f"said_{name}")
    return dialect.run(spark, sql, values or {}, {f"said_{n}" for n in names}, **more)


@query("dialect_division", "SELECT o_orderkey, o_orderkey // 7 AS q, -(o_orderkey // 7) AS r, o_orderkey // 7 // 3 AS s FROM orders")
def dialect_division(spark: SparkSession, d: str) -> DataFrame:
    """A quotient of integers is an integer, cut towards zero."""
    return _say(spark, d, "orders", "SELECT o_orderkey, o_orderkey / :k AS q, -o_orderkey / :k AS r, o_orderkey / :k / :m AS s FROM said_orders", {"k": 7, "m": 3})


@query("dialect_exact", """
SELECT o_orderstatus, CAST(sum(o_orderkey) AS BIGINT) AS total, CAST(sum(o_orderkey) FILTER (WHERE o_custkey > 50) AS BIGINT) AS some,
       CAST(round(CAST(sum(o_orderkey) AS DOUBLE) / count(*)) AS BIGINT) AS mean FROM orders GROUP BY o_orderstatus""")
def dialect_exact(spark: SparkSession, d: str) -> DataFrame:
    """Sums and averages of integers are exact decimals, and casts to integers round."""
    found = _say(spark, d, "orders", """
        SELECT o_orderstatus, sum(o_orderkey) AS total, sum(o_orderkey) FILTER (WHERE o_custkey > :c) AS some, CAST(avg(o_orderkey) AS BIGINT) AS mean
        FROM said_orders GROUP BY o_orderstatus""", {"c": 50})
    assert all(found.schema[c].dataType.simpleString().startswith("decimal") for c in ("total", "some"))
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("total", "some")})


@query("dialect_case", f"SELECT doc_id, upper(source) AS place FROM documents WHERE translate(text, {_FOLD}) LIKE translate('%ÉT%', {_FOLD}) OR translate(text, {_FOLD}) LIKE '% the %'")
def dialect_case(spark: SparkSession, d: str) -> DataFrame:
    """Case and ILIKE are those of the letters A to Z."""
    return _say(spark, d, "documents", "SELECT doc_id, upper(source) AS place FROM said_documents WHERE text ILIKE :p OR text ILIKE :q", {"p": "%ÉT%", "q": "% THE %"})


@query("dialect_nulls", """
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY nullif(event_type, 'click') DESC NULLS FIRST, event_id) AS down,
       row_number() OVER (PARTITION BY user_id ORDER BY nullif(event_type, 'click') NULLS LAST, event_id) AS up FROM events""")
def dialect_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Nulls are greater than all values unless the query says otherwise (O1)."""
    return _say(spark, d, "events", """
        SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY nullif(event_type, :c) DESC, event_id) AS down,
               row_number() OVER (PARTITION BY user_id ORDER BY nullif(event_type, :c), event_id) AS up FROM said_events""", {"c": "click"})


@query("dialect_filter_over", """
SELECT event_id, count(*) FILTER (WHERE event_type = 'click') OVER w AS clicks, CAST(sum(event_id) FILTER (WHERE event_type <> 'click') OVER w AS BIGINT) AS others
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def dialect_filter_over(spark: SparkSession, d: str) -> DataFrame:
    """Window aggregates over the rows of a frame that meet a condition."""
    w = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
    found = _say(spark, d, "events", f"SELECT event_id, count(*) FILTER (WHERE event_type = :c) {w} AS clicks, sum(event_id) FILTER (WHERE event_type <> :c) {w} AS others FROM said_events", {"c": "click"})
    return found.withColumn("others", F.col("others").cast("bigint"))


@query("dialect_any", "SELECT c_custkey FROM customer WHERE c_custkey IN (3, 5, 8) AND NOT false")
def dialect_any(spark: SparkSession, d: str) -> DataFrame:
    """Membership in a bound array; nothing is in an empty one."""
    return _say(spark, d, "customer", "SELECT c_custkey FROM said_customer WHERE c_custkey = ANY(:some) AND NOT c_custkey = ANY(:none)", {"some": [3, 5, 8], "none": []})


@query("dialect_input", "WITH p AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 5) SELECT c_custkey, n FROM p JOIN customer ON c_custkey = k")
def dialect_input(spark: SparkSession, d: str) -> DataFrame:
    """A query over a saved result (S3)."""
    prior = _say(spark, d, "orders", "SELECT o_custkey AS k, count(*) AS n FROM said_orders GROUP BY o_custkey HAVING count(*) > :least", {"least": 5})
    return _say(spark, d, "customer", "SELECT c.c_custkey, prior.n FROM input.prior JOIN said_customer AS c ON c.c_custkey = prior.k", inputs={"prior": prior})


def _walk(reverse: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """A bounded recursion with a cycle clause and guards put in by the dialect."""
        edges(spark, d).createOrReplaceTempView("said_edges")
        anchors(spark, d).createOrReplaceTempView("said_anchors")
        here, there = ("dst", "src") if reverse else ("src", "dst")
        sql = f"""
            WITH RECURSIVE p(node, depth) AS (
              SELECT node AS node, 0 AS depth FROM said_anchors
              UNION ALL SELECT e.{there} AS node, p.depth + 1 AS depth FROM p JOIN said_edges AS e ON e.{here} = p.node WHERE p.depth < :most
            ) CYCLE node SET is_cycle USING path
            SELECT node, depth, path, is_cycle FROM p"""
        found = dialect.run(spark, sql, {"most": 4}, {"said_edges", "said_anchors"}, recursion=Recursion("p", "depth", "node", 4))
        return found.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))

    return run


query("dialect_walk", _paths(False))(_walk(False))
query("dialect_walk_reverse", _paths(True))(_walk(True))
