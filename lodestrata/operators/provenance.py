"""Provenance, sealed results and visibility as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import dialect, graph, lineage, results
from ..plans.store import shared_dir
from ..queries import query, table
from .derivations import _paths, anchors, edges


def _root(spark: SparkSession) -> str:
    return shared_dir(spark, "results-")


@query("lineage_join", """
SELECT o_orderkey, 'customer' AS relation, CAST(c_custkey AS VARCHAR) AS key, 'right' AS side FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT o_orderkey, 'orders', CAST(o_orderkey AS VARCHAR), 'left' FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'""")
def lineage_join(spark: SparkSession, d: str) -> DataFrame:
    """Witnesses of a join of filtered scans (V1, V3, V4)."""
    o = lineage.scan(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), "o_orderpriority"), "orders", ["o_orderkey"])
    c = lineage.scan(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "customer", ["k"])
    j = lineage.join(lineage.where(o, F.col("o_orderpriority") == "1-URGENT"), c, ["k"])
    return j.rows.select("row_ref", "o_orderkey").join(j.witnesses, "row_ref").select("o_orderkey", "relation", "key", "side")


@query("lineage_group", """
SELECT c_nationkey, CAST(c_custkey AS VARCHAR) AS key, CAST(1 AS BIGINT) AS multiplicity FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) > 50)""")
def lineage_group(spark: SparkSession, d: str) -> DataFrame:
    """Members of the groups that pass HAVING (V7)."""
    t = lineage.scan(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "customer", ["c_custkey"])
    g, _ = lineage.group(t, ["c_nationkey"], [F.count("*").alias("n")], F.col("n") > 50)
    return g.rows.select("row_ref", "c_nationkey").join(g.witnesses, "row_ref").select("c_nationkey", "key", "multiplicity")


@query("lineage_having_truth", "SELECT c_nationkey, count(*) AS n, count(*) > 50 AS truth FROM customer GROUP BY c_nationkey")
def lineage_having_truth(spark: SparkSession, d: str) -> DataFrame:
    """HAVING's truth for every group, rejected ones too."""
    t = lineage.scan(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "customer", ["c_custkey"])
    _, truth = lineage.group(t, ["c_nationkey"], [F.count("*").alias("n")], F.col("n") > 50)
    groups = t.rows.groupBy("c_nationkey").agg(F.count("*").alias("n")).withColumn("row_ref", lineage.reference(F.lit("group"), "c_nationkey"))
    return groups.join(truth, "row_ref").select("c_nationkey", "n", "truth")


@query("lineage_set", """
SELECT k, CAST(sum(l) AS BIGINT) AS left_n, CAST(sum(r) AS BIGINT) AS right_n FROM (SELECT nullif(c_nationkey, 7) AS k, 1 AS l, 0 AS r FROM customer UNION ALL SELECT nullif(s_nationkey, 7), 0, 1 FROM supplier) GROUP BY k""")
def lineage_set(spark: SparkSession, d: str) -> DataFrame:
    """Multiplicities of equality classes in both branches of a set operation (V8)."""
    return lineage.set_classes(table(spark, d, "customer").select(F.nullif("c_nationkey", F.lit(7)).alias("k")), table(spark, d, "supplier").select(F.nullif("s_nationkey", F.lit(7)).alias("k")))


@query("lineage_window", """
WITH w AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS ordinal, count(*) OVER (PARTITION BY p_brand) AS n,
 rank() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS peer_from FROM part)
SELECT p_partkey, ordinal, peer_from, peer_from AS peer_to, greatest(1, ordinal - 2) AS frame_from, least(n, ordinal + 1) AS frame_to FROM w""")
def lineage_window(spark: SparkSession, d: str) -> DataFrame:
    """Ordinals, peers' spans and frames' spans (V9)."""
    w = lineage.window_spans(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], [F.col("p_size"), F.col("p_partkey")], 2, 1)
    return w.select("p_partkey", *[F.col(c).cast("bigint").alias(c) for c in ("ordinal", "peer_from", "peer_to", "frame_from", "frame_to")])


@query("lineage_exists", "SELECT c_custkey, count(o_orderkey) AS matches FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def lineage_exists(spark: SparkSession, d: str) -> DataFrame:
    """Match bags of EXISTS, searched absences included (V5, V6)."""
    inner = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return lineage.exists_bag(table(spark, d, "customer").select("c_custkey"), inner, ["c_custkey"])


@query("lineage_tested", "SELECT doc_id, l.toxic = 1 AS truth FROM documents LEFT JOIN labels l USING (doc_id)")
def lineage_tested(spark: SparkSession, d: str) -> DataFrame:
    """Truth of a predicate for each tested row, unknown included."""
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    t = lineage.scan(j, "documents", ["doc_id"])
    return t.rows.select("row_ref", "doc_id").join(lineage.tested(t, F.col("toxic") == 1), "row_ref").select("doc_id", "truth")


@query("result_rows", "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_ref, o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 2500")
def result_rows(spark: SparkSession, d: str) -> DataFrame:
    """A sealed result's rows in their order (S14, R2, R4, O3): numbered without one task seeing all rows."""
    rows = table(spark, d, "orders").filter("o_totalprice > 2500").select("o_orderkey", "o_totalprice")
    return results.with_ordinal(rows, ["o_totalprice", "o_orderkey"], _root(spark))


@query("result_page", "SELECT row_ref, c_custkey, c_name FROM (SELECT row_number() OVER (ORDER BY c_name, c_custkey) AS row_ref, c_custkey, c_name FROM customer) WHERE row_ref BETWEEN 51 AND 100")
def result_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a saved result."""
    run = results.Run(spark, _root(spark))
    saved = run.commit("step", "fingerprint", table(spark, d, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"], 1 << 40)
    return run.rows(saved).filter(F.col("row_ref").between(51, 100))


@query("result_json", """
SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS body FROM nation""")
def result_json(spark: SparkSession, d: str) -> DataFrame:
    """Rows as canonical JSON."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return n.select("n_nationkey", results.encoded(n, n.columns).alias("body"))


@query("visible_scope", "SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) GROUP BY s_nationkey")
def visible_scope(spark: SparkSession, d: str) -> DataFrame:
    """Visibility as a semi-join before anything is counted."""
    grants = table(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"))
    return results.visible(table(spark, d, "supplier"), grants, "s_nationkey").groupBy("s_nationkey").agg(F.count("*").alias("n"))


@query("newly_visible", "SELECT DISTINCT o_custkey AS ref FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def newly_visible(spark: SparkSession, d: str) -> DataFrame:
    """References that no earlier page has shown."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("ref"), "o_orderstatus")
    return o.filter("o_orderstatus = 'F'").select("ref").subtract(o.filter("o_orderstatus = 'O'").select("ref"))


@query("source_slices", "SELECT doc_id, CAST(doc_id % 50 AS BIGINT) AS \"start\", CAST(doc_id % 50 + 40 AS BIGINT) AS \"end\", substring(text, CAST(doc_id % 50 + 1 AS BIGINT), 40) AS slice FROM documents")
def source_slices(spark: SparkSession, d: str) -> DataFrame:
    """Bounded slices of source texts."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return results.own_slices(docs.withColumns({"start": F.col("doc_id") % 50, "end": F.col("doc_id") % 50 + 40}), "doc_id")


@query("closure_recheck", "SELECT n_regionkey, count(*) AS n, true AS unchanged FROM nation GROUP BY n_regionkey")
def closure_recheck(spark: SparkSession, d: str) -> DataFrame:
    """A sealed result is shown only if what it rests on is still there, built anew at its own time."""
    rests = lambda cutoff: table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    run = results.Run(spark, _root(spark))
    found = table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    saved = run.commit("step", "fingerprint", found, ["n_regionkey"], depends=rests(None))
    run.recheck(saved, rests)
    try:
        run.recheck(saved, lambda cutoff: rests(cutoff).filter("n_nationkey <> 3"))
    except results.ResultError:
        return run.rows(saved).select("n_regionkey", "n", F.lit(True).alias("unchanged"))
    raise AssertionError("a missing dependency has not been noticed")


@query("dialect_query", """
WITH per AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey HAVING count(*) > 3)
SELECT c_custkey, n, rank() OVER (PARTITION BY c_nationkey ORDER BY n DESC) AS r FROM per JOIN customer ON c_custkey = k""")
def dialect_query(spark: SparkSession, d: str) -> DataFrame:
    """A query with bound values that is admitted first and then run."""
    for name in ("orders", "customer"):
        table(spark, d, name).createOrReplaceTempView(f"dialect_{name}")
    sql = """
        WITH per(k, n) AS (SELECT o_custkey AS k, count(*) AS n FROM dialect_orders WHERE o_orderstatus = :status GROUP BY o_custkey HAVING count(*) > :least)
        SELECT c.c_custkey, per.n, rank() OVER (PARTITION BY c.c_nationkey ORDER BY per.n DESC) AS r FROM per JOIN dialect_customer AS c ON c.c_custkey = per.k"""
    return dialect.run(spark, sql, {"status": "F", "least": 3}, {"dialect_orders", "dialect_customer"})


@query("lineage_walk", _paths(False).replace("SELECT node, depth, array_to_string(path, '>') AS path, is_cycle FROM p", """, g AS (SELECT path, depth, is_cycle, count(*) AS copies FROM p GROUP BY ALL),
u AS (SELECT path, depth, is_cycle, copies, unnest(range(0, len(path))) AS visit FROM g)
SELECT array_to_string(path, '>') AS path, CAST(visit AS INT) AS visit, CASE WHEN visit = 0 THEN 'seed' ELSE 'step' END AS kind, path[visit + 1] AS node, is_cycle AND visit = depth AS is_cycle, copies FROM u"""))
def lineage_walk(spark: SparkSession, d: str) -> DataFrame:
    """Steps of a bounded walk as witnesses."""
    paths = graph.walk_paths(edges(spark, d), anchors(spark, d), 4)
    named = paths.select(lineage.reference(F.lit("walk"), F.col("path")).alias("row_ref"), F.array_join(F.col("path").cast("array<string>"), ">").alias("path")).distinct()
    return lineage.walk_steps(paths).join(named, "row_ref").select("path", "visit", "kind", "node", "is_cycle", "copies")


@query("lineage_json", """
SELECT c_custkey, '{"operations":[{"op":"scan"},{"op":"join"},{"op":"group"}],"sources":[{"relation":"customer","side":"member","n":' || n || '},{"relation":"orders","side":"member","n":' || n || '}]}' AS provenance
FROM (SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)""")
def lineage_json(spark: SparkSession, d: str) -> DataFrame:
    """Published provenance of the groups of a join (V2, V3, V7, V13), here without its digests."""
    o = lineage.project(lineage.scan(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "orders", ["o_orderkey"]), [F.col("o_custkey").alias("c_custkey")])
    c = lineage.scan(table(spark, d, "customer").select("c_custkey"), "customer", ["c_custkey"])
    g, _ = lineage.group(lineage.join(c, o, ["c_custkey"]), ["c_custkey"], [F.count("*").alias("n")])
    told = lineage.published(g, ["scan", "join", "group"])
    return g.rows.select("row_ref", "c_custkey").join(told, "row_ref").select("c_custkey", F.regexp_replace("provenance", ',"keys":"[0-9a-f]{64}"', "").alias("provenance"))
