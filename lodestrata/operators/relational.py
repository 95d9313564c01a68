"""Relational core as queries over the driver's tables: filters, joins, groups, sets, order and scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lowering import bool_extreme, exact_avg, exact_sum, int_div, lower_ascii, to_int8, trunc_utc, upper_ascii, with_in_truth
from ..plans.results import with_ordinal
from ..plans.store import shared_dir
from ..queries import query, table


@query("filter_compare", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size >= 10 AND p_size <> 15 AND (p_retailprice < 1500 OR p_size > 45)")
def filter_compare(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons under AND and OR (P3, P4, P6 to P9); all reach the scan."""
    p = table(spark, d, "part")
    return p.filter((F.col("p_size") >= 10) & (F.col("p_size") != 15) & ((F.col("p_retailprice") < 1500) | (F.col("p_size") > 45))).select("p_partkey", "p_size", "p_retailprice")


@query("filter_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (0,1,2,3,4,5,6,7,8,9) AND NOT c_nationkey IN (3)")
def filter_in_list(spark: SparkSession, d: str) -> DataFrame:
    """Membership in bound values, short and long lists."""
    c = table(spark, d, "customer")
    return c.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_nationkey").isin(list(range(10))) & ~F.col("c_nationkey").isin(3)).select("c_custkey", "c_mktsegment")


@query("filter_any_array", "SELECT o_orderkey FROM orders WHERE o_orderpriority = ANY(['1-URGENT', '2-HIGH']) AND NOT (o_orderkey = ANY(CAST([] AS BIGINT[])))")
def filter_any_array(spark: SparkSession, d: str) -> DataFrame:
    """Equality with any element of a typed array parameter; an empty array matches nothing."""
    return spark.sql(
        "SELECT o_orderkey FROM {o} WHERE array_contains(:priorities, o_orderpriority) AND NOT array_contains(CAST(:none AS ARRAY<BIGINT>), o_orderkey)",
        args={"priorities": ["1-URGENT", "2-HIGH"], "none": F.array()},
        o=table(spark, d, "orders"),
    )


@query("filter_like_ilike", "SELECT p_partkey, p_name FROM part WHERE (p_name LIKE '%a%' AND p_type NOT LIKE 'ECONOMY%') OR p_brand ILIKE 'brand#1_'")
def filter_like_ilike(spark: SparkSession, d: str) -> DataFrame:
    """Patterns, with and without case."""
    p = table(spark, d, "part")
    return p.filter((F.col("p_name").like("%a%") & ~F.col("p_type").like("ECONOMY%")) | lower_ascii(F.col("p_brand")).like("brand#1_")).select("p_partkey", "p_name")


@query("filter_null_logic", """
SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE NOT (l.toxic = 1 AND d.n_chars > 100) OR (l.toxic IS NULL AND d.lang IS NOT NULL)""")
def filter_null_logic(spark: SparkSession, d: str) -> DataFrame:
    """Three-valued AND, OR and NOT, and tests for null."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    j = docs.join(labels, "doc_id", "left")
    return j.filter(~((F.col("toxic") == 1) & (F.col("n_chars") > 100)) | (F.col("toxic").isNull() & F.col("lang").isNotNull())).select("doc_id", "toxic")


@query("filter_optional", "SELECT n_nationkey FROM nation WHERE (CAST(NULL AS INT) IS NULL OR n_regionkey <> CAST(NULL AS INT)) AND (2 IS NULL OR n_regionkey <> 2)")
def filter_optional(spark: SparkSession, d: str) -> DataFrame:
    """Optional filters: a null parameter lets all rows pass."""
    return spark.sql(
        "SELECT n_nationkey FROM {n} WHERE (:a IS NULL OR n_regionkey <> CAST(:a AS INT)) AND (:b IS NULL OR n_regionkey <> :b)",
        args={"a": None, "b": 2},
        n=table(spark, d, "nation"),
    )


@query("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    """Inner equi-join with the filter pushed below it."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).filter(F.col("o_totalprice") > 1000).select("o_orderkey", "c_name", "o_totalprice")


def _outer(how: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Outer join of customers to their urgent orders: unmatched sides are null."""
        o = table(spark, d, "orders").filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 1000)).select("o_orderkey", (F.col("o_custkey") * 2).alias("k"))
        c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
        return c.join(o, c.c_custkey == o.k, how).select("c_custkey", "c_nationkey", "o_orderkey")

    return run


for _how in ("left", "right", "full"):
    query(f"join_{_how}", f"""
SELECT c_custkey, c_nationkey, o_orderkey FROM customer {_how.upper()} JOIN
  (SELECT o_orderkey, o_custkey * 2 AS k FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 1000) o ON c_custkey = k""")(_outer(_how))


@query("join_self", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
def join_self(spark: SparkSession, d: str) -> DataFrame:
    """Self-join under two aliases."""
    a, b = table(spark, d, "nation").alias("a"), table(spark, d, "nation").alias("b")
    return a.join(b, F.col("a.n_regionkey") == F.col("b.n_regionkey")).filter("a.n_nationkey < b.n_nationkey").select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@query("join_multi_key", """
SELECT a.conv_id, a.turn, b.role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.role = b.role""")
def join_multi_key(spark: SparkSession, d: str) -> DataFrame:
    """Join on several equalities."""
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", "role").join(c.select("conv_id", "turn", "role"), ["conv_id", "turn", "role"])


@query("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_exists(spark: SparkSession, d: str) -> DataFrame:
    """EXISTS as a left semi join."""
    o, c = table(spark, d, "orders").filter(F.col("o_orderstatus") == "F"), table(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_not_exists(spark: SparkSession, d: str) -> DataFrame:
    """NOT EXISTS as a left anti join."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("in_subquery", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def in_subquery(spark: SparkSession, d: str) -> DataFrame:
    """IN over a subquery in a filter."""
    return table(spark, d, "documents").join(table(spark, d, "labels").filter("toxic = 0"), "doc_id", "left_semi").select("doc_id")


@query("not_in_nulls", """
SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT nullif(n_nationkey, 99) FROM nation WHERE n_regionkey = 1)""")
def not_in_nulls(spark: SparkSession, d: str) -> DataFrame:
    """NOT IN over a subquery whose column may be null."""
    return spark.sql("SELECT s_suppkey FROM {s} WHERE s_nationkey NOT IN (SELECT nullif(n_nationkey, 99) FROM {n} WHERE n_regionkey = 1)", s=table(spark, d, "supplier"), n=table(spark, d, "nation"))


@query("in_truth_projected", """
SELECT n_nationkey, n_regionkey IN (SELECT nullif(r_regionkey, 2) FROM region WHERE r_regionkey < 3) AS found FROM nation""")
def in_truth_projected(spark: SparkSession, d: str) -> DataFrame:
    """IN as a value: true, false or unknown."""
    r = table(spark, d, "region").filter("r_regionkey < 3").select(F.nullif("r_regionkey", F.lit(2)).alias("k"))
    return with_in_truth(table(spark, d, "nation"), "n_regionkey", r, "k", "found").select("n_nationkey", "found")


@query("scalar_subquery", """
SELECT c_custkey, (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) AS nation,
       (SELECT r_name FROM region WHERE r_regionkey = c_nationkey) AS region FROM customer""")
def scalar_subquery(spark: SparkSession, d: str) -> DataFrame:
    """Correlated scalar subqueries: null without a row, an error for two."""
    return spark.sql("""
        SELECT c_custkey, (SELECT any_value(n_name) FROM {n} WHERE n_nationkey = c_nationkey HAVING count(*) <= 1) AS nation,
               (SELECT any_value(r_name) FROM {r} WHERE r_regionkey = c_nationkey HAVING count(*) <= 1) AS region FROM {c}""",
        c=table(spark, d, "customer"), n=table(spark, d, "nation"), r=table(spark, d, "region"))


@query("agg_group_having", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price
FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""")
def agg_group_having(spark: SparkSession, d: str) -> DataFrame:
    """Groups with a condition on them."""
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_extendedprice"), 4).alias("price")).filter("n > 10")


@query("agg_filter", """
SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(value) AS n, round(max(value) FILTER (WHERE user_id % 2 = 0), 6) AS even_max
FROM events GROUP BY event_type""")
def agg_filter(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates with FILTER."""
    return spark.sql("SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(value) AS n, round(max(value) FILTER (WHERE user_id % 2 = 0), 6) AS even_max FROM {e} GROUP BY event_type", e=table(spark, d, "events"))


@query("agg_distinct", "SELECT l_shipyear, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n FROM (SELECT year(l_shipdate) AS l_shipyear, l_suppkey FROM lineitem) GROUP BY l_shipyear")
def agg_distinct(spark: SparkSession, d: str) -> DataFrame:
    """count(DISTINCT) beside count(*)."""
    return table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("l_shipyear")).agg(F.countDistinct("l_suppkey").alias("suppliers"), F.count("*").alias("n"))


@query("agg_two_level", """
WITH per AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n, count(*) AS customers, CAST(sum(n) AS BIGINT) AS orders FROM per GROUP BY n""")
def agg_two_level(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates of aggregates."""
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return per.groupBy("n").agg(F.count("*").alias("customers"), F.sum("n").alias("orders"))


@query("agg_empty", "SELECT count(*) AS n, count(o_orderkey) AS k, CAST(sum(o_orderkey) AS BIGINT) AS s, min(o_orderpriority) AS lo FROM orders WHERE o_orderkey < 0")
def agg_empty(spark: SparkSession, d: str) -> DataFrame:
    """A global aggregate of nothing is one row."""
    return table(spark, d, "orders").filter("o_orderkey < 0").agg(F.count("*").alias("n"), F.count("o_orderkey").alias("k"), exact_sum(F.col("o_orderkey")).cast("bigint").alias("s"), F.min("o_orderpriority").alias("lo"))


@query("agg_exact", """
SELECT o_orderstatus, CAST(sum(o_orderkey) AS VARCHAR) AS total, CAST(round(avg(o_custkey), 4) AS DECIMAL(18,4))::VARCHAR AS mean FROM orders GROUP BY o_orderstatus""")
def agg_exact(spark: SparkSession, d: str) -> DataFrame:
    """Sums and averages of integers as exact numbers."""
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(exact_sum(F.col("o_orderkey")).cast("string").alias("total"), F.round(exact_avg(F.col("o_custkey")), 4).cast("decimal(18,4)").cast("string").alias("mean"))


@query("agg_minmax_types", """
SELECT c_mktsegment, min(c_name) AS lo, max(c_nationkey) AS hi, bool_and(c_acctbal > 0) AS all_positive, bool_or(c_acctbal > 0) AS any_positive FROM customer GROUP BY c_mktsegment""")
def agg_minmax_types(spark: SparkSession, d: str) -> DataFrame:
    """Extremes of text, integers and booleans."""
    positive = F.col("c_acctbal") > 0
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.min("c_name").alias("lo"), F.max("c_nationkey").alias("hi"), bool_extreme(positive, False).alias("all_positive"), bool_extreme(positive, True).alias("any_positive"))


@query("agg_ordered_list", """
SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, list(turn ORDER BY turn)::VARCHAR AS turns FROM conversations GROUP BY conv_id""")
def agg_ordered_list(spark: SparkSession, d: str) -> DataFrame:
    """Ordered concatenation and ordered lists."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "role")))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(rows.alias("rows"))
    return g.select("conv_id", F.array_join(F.col("rows.role"), ">").alias("roles"), F.concat(F.lit("["), F.array_join(F.col("rows.turn"), ", "), F.lit("]")).alias("turns"))


@query("series_slots", "SELECT r_regionkey, slot FROM region, generate_series(1, 5) AS g(slot) WHERE slot <= r_regionkey + 1")
def series_slots(spark: SparkSession, d: str) -> DataFrame:
    """Numbered slots for each row."""
    return table(spark, d, "region").select("r_regionkey", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("r_regionkey") + 1)).alias("slot")).filter("slot <= 5")


@query("unnest_ordinal", r"""
SELECT p_partkey, u.word, u.at FROM (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part),
LATERAL (SELECT unnest(ws) AS word, generate_subscripts(ws, 1) AS at) u""")
def unnest_ordinal(spark: SparkSession, d: str) -> DataFrame:
    """Array elements as rows with their places (G15d)."""
    return table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("at", "word")).select("p_partkey", "word", (F.col("at") + 1).cast("bigint").alias("at"))


@query("distinct_rows", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    """Distinct rows."""
    return table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()


def _set(left: DataFrame, right: DataFrame, op: str) -> DataFrame:
    return {"union_all": left.unionAll, "union": lambda r: left.union(r).distinct(), "intersect": left.intersect, "intersect_all": left.intersectAll, "except": left.subtract, "except_all": left.exceptAll}[op](right)


def _sets(op: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Set operations over columns with nulls, which equal each other."""
        c = table(spark, d, "customer").select(F.nullif("c_nationkey", F.lit(7)).alias("k"))
        s = table(spark, d, "supplier").select(F.nullif("s_nationkey", F.lit(7)).alias("k"))
        return _set(c, s, op)

    return run


for _op in ("union_all", "union", "intersect", "intersect_all", "except", "except_all"):
    query(f"set_{_op}", f"SELECT nullif(c_nationkey, 7) AS k FROM customer {_op.upper().replace('_', ' ')} SELECT nullif(s_nationkey, 7) FROM supplier")(_sets(_op))


@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark: SparkSession, d: str) -> DataFrame:
    """Top rows of an order without a full sort."""
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("limit_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 35")
def limit_offset(spark: SparkSession, d: str) -> DataFrame:
    """Limit after offset."""
    return table(spark, d, "customer").select("c_custkey").orderBy("c_custkey").offset(35).limit(20)


@query("nulls_order", """
SELECT row_number() OVER (ORDER BY toxic ASC NULLS LAST, doc_id) AS place, doc_id, toxic FROM (SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""")
def nulls_order(spark: SparkSession, d: str) -> DataFrame:
    """Ascending order puts nulls last (O1); a visible key breaks ties (O3). Every row has its place in that order."""
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return with_ordinal(j, ["toxic", "doc_id"], shared_dir(spark)).withColumnRenamed("row_ref", "place")


@query("fn_text", "SELECT n_nationkey, upper(n_name) AS up, lower(n_name) AS low FROM nation")
def fn_text(spark: SparkSession, d: str) -> DataFrame:
    """Case of ASCII letters (F1)."""
    return table(spark, d, "nation").select("n_nationkey", upper_ascii(F.col("n_name")).alias("up"), lower_ascii(F.col("n_name")).alias("low"))


@query("fn_date_trunc", """
SELECT o_orderkey, CAST(date_trunc('day', o_orderdate) AS VARCHAR)[1:10] AS day, CAST(date_trunc('month', o_orderdate) AS VARCHAR)[1:10] AS month, CAST(date_trunc('year', o_orderdate) AS VARCHAR)[1:10] AS year FROM orders""")
def fn_date_trunc(spark: SparkSession, d: str) -> DataFrame:
    """Starts of day, month and year in UTC."""
    return table(spark, d, "orders").select("o_orderkey", *[F.date_format(trunc_utc(u, F.col("o_orderdate")), "yyyy-MM-dd").alias(u) for u in ("day", "month", "year")])


@query("fn_coalesce_nullif", "SELECT d.doc_id, coalesce(l.toxic, l.quality, -1) AS c, nullif(d.lang, 'en') AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def fn_coalesce_nullif(spark: SparkSession, d: str) -> DataFrame:
    """First value that isn't null, and null for equal values."""
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", F.coalesce("toxic", "quality", F.lit(-1)).alias("c"), F.nullif("lang", F.lit("en")).alias("n"))


@query("fn_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' END AS class FROM part")
def fn_case(spark: SparkSession, d: str) -> DataFrame:
    """Searched CASE without ELSE is null."""
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").alias("class"))


@query("fn_arith_div", "SELECT o_orderkey, o_orderkey // 7 AS q, -o_custkey AS neg, o_orderkey * 2 - o_custkey + 1 AS mix, round(o_totalprice / 3, 6) AS third FROM orders")
def fn_arith_div(spark: SparkSession, d: str) -> DataFrame:
    """Arithmetic; integers divide to integers."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", int_div(k, F.lit(7)).alias("q"), (-c).alias("neg"), (k * 2 - c + 1).alias("mix"), F.round(F.col("o_totalprice") / 3, 6).alias("third"))


@query("fn_cast_round", "SELECT p_partkey, CAST(round(CAST(p_partkey AS DECIMAL(18,1)) / 2 - 50, 0) AS BIGINT) AS half FROM part")
def fn_cast_round(spark: SparkSession, d: str) -> DataFrame:
    """Numeric to integer rounds halves away from zero (F8)."""
    return table(spark, d, "part").select("p_partkey", to_int8(F.col("p_partkey").cast("decimal(18,1)") / 2 - 50).alias("half"))


@query("fn_hash", "SELECT n_nationkey, sha256(n_name) AS h, octet_length(encode(n_name)) AS bytes, length(n_name) AS chars FROM nation")
def fn_hash(spark: SparkSession, d: str) -> DataFrame:
    """Content hashes and lengths."""
    return table(spark, d, "nation").select("n_nationkey", F.sha2("n_name", 256).alias("h"), F.octet_length("n_name").cast("bigint").alias("bytes"), F.char_length("n_name").cast("bigint").alias("chars"))


@query("cte_reuse", """
WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 2000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey),
unused AS (SELECT 1 / 0 AS x)
SELECT b.o_custkey, p.n, round(b.o_totalprice, 2) AS price FROM big b JOIN per p ON p.o_custkey = b.o_custkey WHERE p.n > 1""")
def cte_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Named subqueries, one used twice and one never."""
    return spark.sql("""
        WITH big AS (SELECT o_custkey, o_totalprice FROM {o} WHERE o_totalprice > 2000), per(o_custkey, n) AS (SELECT o_custkey, count(*) FROM big GROUP BY o_custkey),
        unused AS (SELECT 1 div 0 AS x)
        SELECT b.o_custkey, p.n, round(b.o_totalprice, 2) AS price FROM big b JOIN per p ON p.o_custkey = b.o_custkey WHERE p.n > 1""", o=table(spark, d, "orders"))  # fmt: skip


@query("select_from_nothing", "SELECT 7 AS x, 'text' AS y, CAST(NULL AS BIGINT) AS z")
def select_from_nothing(spark: SparkSession, d: str) -> DataFrame:
    """A selection of parameters without a source."""
    return spark.sql("SELECT :x AS x, :y AS y, CAST(NULL AS BIGINT) AS z", args={"x": 7, "y": "text"})


@query("aliased_source", "SELECT k, p FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 3000) AS big(k, p)")
def aliased_source(spark: SparkSession, d: str) -> DataFrame:
    """A derived table with renamed columns."""
    return table(spark, d, "orders").filter("o_totalprice > 3000").select("o_orderkey", "o_totalprice").toDF("k", "p")
