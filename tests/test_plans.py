"""Operators on small hand-made tables: temporal joins, graphs, framing, lineage, results, admission and the catalog."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata import catalog
from lodestrata.functions import lowering
from lodestrata.plans import dialect, graph, results, temporal
from lodestrata.sources import framing, records

T0 = dt.datetime(2024, 1, 1)


def test_asof_join_crosses_buckets(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    left = spark.createDataFrame([(1, "a", at(100)), (2, "a", at(0)), (3, "b", at(5)), (4, "a", None)], "id int, k string, t timestamp")
    right = spark.createDataFrame([("a", at(1), 10), ("a", at(2), 11), ("a", at(2), 12), ("b", at(6), 13)], "k string, rt timestamp, rid int")
    got = {r["id"]: r["rid"] for r in temporal.asof_join(left, right, "k", "t", "rt", "rid").collect()}
    assert got == {1: 12, 2: None, 3: None, 4: None}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 15)), max_size=12))
def test_overlap_join_equals_nested_loop(spark, spans):
    rows = [(1, i, s, s + n) for i, (s, n) in enumerate(spans)]
    a = spark.createDataFrame(rows, "k int, a int, s bigint, e bigint")
    b = a.toDF("k", "b", "rs", "re")
    got = sorted((r["a"], r["b"]) for r in temporal.overlap_join(a, b, "k", ("s", "e"), ("rs", "re"), 7).collect())
    assert got == sorted((x[1], y[1]) for x in rows for y in rows if x[2] < y[3] and y[2] < x[3] and x[3] > x[2] and y[3] > y[2])


def test_union_and_gaps(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 3, 4), (1, 10, 12), (1, 20, 20)], "k int, s bigint, e bigint")
    covered = temporal.union_intervals(df, ["k"], "s", "e")
    assert sorted((r["s"], r["e"]) for r in covered.collect()) == [(0, 7), (10, 12)]
    assert sorted((r["s"], r["e"]) for r in temporal.gaps(covered, ["k"], "s", "e", F.lit(0), F.lit(15)).collect()) == [(7, 10), (12, 15)]


def test_paths_keep_bags_and_flag_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)], "src bigint, dst bigint")
    anchors = spark.createDataFrame([(1,)], "node bigint")
    rows = graph.walk_paths(edges, anchors, 3).collect()
    assert sum(r["node"] == 4 for r in rows) == 2
    assert sum(r["is_cycle"] for r in rows) == 2
    with pytest.raises(ValueError):
        graph.walk_paths(edges, anchors, 9)


def test_resolve_long_chain_and_cycle(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(10)] + [(20, 21), (21, 20)], "node bigint, target bigint")
    nodes = spark.createDataFrame([(0,), (20,), (99,)], "node bigint")
    got = {r["node"]: (r["resolved"], r["is_cycle"]) for r in graph.resolve(chain, nodes).collect()}
    assert got == {0: (10, False), 20: (None, True), 99: (99, False)}


def test_redirects_follow_a_hot_users_views_to_the_end(spark, tmp_path):
    from lodestrata.operators import derivations

    # one user with 3000 views, one with errors (a cycle), in the columns and types of the given table
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = spark.range(3003).selectExpr("id AS event_id", "if(id < 3000, 1L, 2L) AS user_id", "if(id < 3000, 'view', 'error') AS event_type", "timestamp '2000-01-01' AS ts")
    rows = rows.select(*[(rows[c] if c in rows.columns else F.lit(None)).cast(events.schema[c].dataType).alias(c) for c in events.columns])
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = {r["node"]: (r["resolved"], r["hops"], r["is_cycle"]) for r in derivations.redirects_asof(spark, str(tmp_path)).collect()}
    assert got == {i: (0, i, False) for i in range(3000)} | {i: (None, None, True) for i in range(3000, 3003)}


def test_resolve_is_exact_without_a_cap(spark):
    # chains of lengths about powers of two, a loop of one, a loop of three and a tail into it
    pairs = [(1000 * n + i, 1000 * n + i + 1) for n in (1, 2, 3, 4, 5, 7, 8, 9) for i in range(n)] + [(1, 1), (10, 11), (11, 12), (12, 10), (20, 21), (21, 10)]
    target = dict(pairs)
    nodes = sorted({x for p in pairs for x in p} | {99})
    frame = spark.createDataFrame(pairs, "node long, target long")
    for cap in (None, 4, 7):
        want = {}
        for n in nodes:
            at, hops = n, 0
            while at in target and hops <= 50:
                at, hops = target[at], hops + 1
            far = cap is not None and hops > cap
            want[n] = (None, None, True) if at in target else (None if far else at, hops, False)
        got = {r["node"]: (r["resolved"], r["hops"], r["is_cycle"]) for r in graph.resolve(frame, spark.createDataFrame([(n,) for n in nodes], "node long"), cap).collect()}
        assert got == want


def test_bottom_roots(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 4), (5, 6)], "src bigint, dst bigint")
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node bigint")
    got = sorted((r["node"], r["root"]) for r in graph.bottom_roots(edges, nodes).collect())
    assert got == [(1, 2), (2, 2), (3, 2), (4, 4), (5, 6), (6, 6), (7, 7)]


@pytest.mark.parametrize("size", [1, 3, 64])
def test_framing_does_not_depend_on_chunks(spark, size):
    data = "a\r\n\nlöng line\ntail".encode()
    df = spark.createDataFrame([(1, data), (2, b""), (3, b"\n")], "k int, data binary")
    got = framing.frame(framing.byte_chunks(df, "k", "data", size), "k", 8).orderBy("k", "record").collect()
    assert [(r["k"], bytes(r["data"]), r["byte_start"], r["ended"], r["oversized"]) for r in got] == [(1, b"a", 0, True, False), (1, b"", 3, True, False), (1, "löng line".encode(), 4, True, True), (1, b"tail", 15, False, False), (3, b"", 0, True, False)]


def test_in_truth(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    full, none = spark.createDataFrame([(1,), (None,)], "v int"), spark.createDataFrame([], "v int")
    truth = lambda r: {x["k"]: x["t"] for x in lowering.with_in_truth(left, "k", r, "v", "t").collect()}
    assert truth(full) == {1: True, 2: None, None: None}
    assert truth(none) == {1: False, 2: False, None: False}


def test_rounding_cast_and_ascii_case(spark):
    df = spark.sql("SELECT explode(array(2.5, -2.5, 0.4)) AS x")
    assert [r[0] for r in df.select(lowering.to_int8(F.col("x"))).collect()] == [3, -3, 0]
    assert spark.range(1).select(lowering.lower_ascii(F.lit("AİZ"))).first()[0] == "aİz"


def test_results_page_reuse_and_conflict(spark, tmp_path):
    run = results.Run(spark, f"file://{tmp_path}")
    df = spark.range(120).select((F.col("id") * 7 % 120).alias("k"), F.repeat(F.lit("x"), 20).alias("v"))
    saved = run.commit("s", "f", df, ["k"])
    assert run.commit("s", "f", df, ["k"]) == saved
    with pytest.raises(results.ResultError, match="idempotency_conflict"):
        run.commit("s", "g", df, ["k"])
    other = run.commit("t", "f", df.orderBy(F.desc("k")), ["k"])
    assert other.digest == saved.digest
    page, seen = run.page(saved), []
    while True:
        seen += [r["k"] for r in page.rows]
        if page.cursor is None:
            break
        page = run.next_page(page.cursor)
    assert seen == list(range(120))
    # another process with the same root: pages, cursors and steps are there; another owner's are not
    cursor, later = run.page(saved).cursor, results.Run(spark, f"file://{tmp_path}")
    assert later.result(saved.result_id) == saved and [r["k"] for r in later.next_page(cursor).rows] == list(range(50, 100))
    assert later.commit("s", "f", df, ["k"]) == saved
    with pytest.raises(results.ResultError, match="unavailable"):
        results.Run(spark, f"file://{tmp_path}", "someone else")
    with pytest.raises(results.ResultError, match="invalid_request"):
        later.next_page("../run")
    assert len(run.page(saved, most_bytes=200).rows) < 50
    with pytest.raises(results.ResultError, match="budget_exhausted"):
        run.commit("u", "f", df, ["k"], most_bytes=10)
    empty = run.commit("e", "f", df.filter("false"), ["k"])
    assert run.page(empty).rows == [] and run.page(empty).cursor is None
    with pytest.raises(results.ResultError, match="invalid_request"):
        run.purge()
    run.close()
    assert run.purge() == 3
    with pytest.raises(results.ResultError, match="unavailable"):
        run.commit("z", "f", df, ["k"])


def test_checkpoints_compare_and_swap(spark, tmp_path):
    log = results.Checkpoints(spark, f"file://{tmp_path}/log", keep=2)
    first = log.append(None, "a")
    with pytest.raises(results.ResultError):
        log.append(None, "b")
    second = log.append(first, "b")
    log.append(second, "c")
    assert log.read(second) == "b" and results.Checkpoints(spark, f"file://{tmp_path}/log").head() == log.head()
    with pytest.raises(results.ResultError):
        log.read(first)


REFUSED = {
    "SELECT * FROM orders": "star",
    "SELECT o_orderkey FROM orders WHERE o_orderkey = 5": "literal",
    "SELECT o_orderkey FROM orders CROSS JOIN customer": "join",
    "SELECT o_orderkey FROM orders o JOIN customer c ON o.o_custkey < c.c_custkey": "join_condition",
    "SELECT reverse(o_orderkey) AS x FROM orders": "function",
    "SELECT r_name FROM region": "relation",
    "DROP TABLE orders": "DropTable",
    "SELECT sum(DISTINCT o_custkey) AS x FROM orders": "distinct_aggregate",
    "SELECT count(*) FROM orders": "unnamed_output",
    "SELECT o_custkey, o_custkey FROM orders": "duplicate_output",
    "SELECT o_custkey AS x FROM orders GROUP BY CUBE(o_custkey)": "Cube",
    "SELECT sum(o_custkey) OVER (ORDER BY o_orderkey) AS x FROM orders": "window_frame",
    "SELECT lag(o_custkey, 65) OVER (ORDER BY o_orderkey) AS x FROM orders": "structural_integer",
    "SELEC o_custkey": "syntax",
    "SELECT CAST(o_custkey AS STRING) AS x FROM orders": "cast",
    "SELECT CAST(o_orderdate AS DATE) AS x FROM orders": "cast",
    "SELECT sum(count(*)) AS x FROM orders GROUP BY o_custkey": "phase",
    "SELECT sum(avg(o_custkey)) AS x FROM orders": "phase",
    "SELECT c_custkey FROM customer WHERE EXISTS (SELECT o.o_custkey FROM orders o JOIN customer d ON d.c_custkey = o.o_custkey)": "exists_shape",
    "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey)": "in_shape",
    "SELECT c_custkey FROM customer WHERE c_custkey = (SELECT max(o_custkey) AS m FROM orders)": "scalar_subquery",
    "SELECT o_custkey FROM orders OFFSET 20000": "structural_integer",
    "SELECT o_custkey AS a FROM orders UNION ALL SELECT c_custkey AS a, c_name AS b FROM customer": "set_columns",
    "SELECT o_custkey AS a FROM input.x": "input_alias",
    "WITH RECURSIVE p(n, d) AS (SELECT o_custkey AS n, 0 AS d FROM orders UNION ALL SELECT p.n AS n, p.d + 1 AS d FROM p WHERE p.d < 4) SELECT n FROM p": "recursion",
    "SELECT o_custkey AS x FROM orders AS " + "a" * 64: "identifier",
    "SELECT " + ", ".join(f"row_number() OVER (ORDER BY o_custkey) AS x{i}" for i in range(17)) + " FROM orders": "composition_budget",
}


@pytest.mark.parametrize("sql", REFUSED)
def test_dialect_refuses(spark, sql):
    with pytest.raises(dialect.Refusal) as e:
        dialect.admit(spark, sql, {}, {"orders", "customer"})
    assert e.value.construct == REFUSED[sql]


def test_dialect_admits_and_reports(spark):
    a = dialect.admit(spark, "SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice > :p GROUP BY o_custkey ORDER BY n DESC LIMIT 7", {"p": 1}, {"orders"})
    assert (a.outputs, a.limit, a.parameters, a.relations) == (["k", "n"], 7, ["p"], ["orders"])
    assert a.order == [("n", False, True)] and a.coverage == "explicit_limit"
    kinds = catalog.relations()["statements"].kind
    joined = "SELECT s.text AS t FROM statements s JOIN observations o ON {}"
    dialect.admit(spark, joined.format("s.bead_id = o.bead_id"), {}, {"statements", "observations"}, kind_of=kinds)
    for on, construct in (("s.text = o.title", "join_identity"), ("s.bead_id = o.event_id", "reference_type")):
        with pytest.raises(dialect.Refusal, match=construct):
            dialect.admit(spark, joined.format(on), {}, {"statements", "observations"}, kind_of=kinds)
    with pytest.raises(dialect.Refusal, match="unused_parameter"):
        dialect.admit(spark, "SELECT o_custkey FROM orders", {"p": 1}, {"orders"})


@pytest.fixture
def garden(spark):
    """Six observations, five statements and a graph with a cycle, as small relations."""
    make = spark.createDataFrame
    views = {
        "obs": make([(i, "orchard" if i < 4 else None, i % 2 == 0) for i in range(1, 7)], "bead bigint, title string, flag boolean"),
        "said": make([(i, b) for i, b in enumerate([1, 1, 2, 3, 4], 1)], "statement bigint, bead bigint"),
        "edge": make([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (1, 5)], "src bigint, dst bigint"),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return lambda sql, values=None, **more: [tuple(r) for r in dialect.run(spark, sql, values or {}, set(views), **more).collect()]


def test_dialect_joins_windows_and_sets(garden):
    for kind, n in (("INNER", 5), ("LEFT", 7), ("RIGHT", 5), ("FULL", 7)):
        assert len(garden(f"SELECT o.bead AS b, s.statement AS t FROM obs o {kind} JOIN said s ON s.bead = o.bead")) == n
    assert sorted(garden("SELECT bead FROM obs o WHERE NOT EXISTS (SELECT s.bead FROM said s WHERE s.bead = o.bead)")) == [(5,), (6,)]
    ranks = garden("SELECT rank() OVER (ORDER BY title) AS r, dense_rank() OVER (ORDER BY title) AS d, count(*) OVER (ORDER BY bead ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS m, bead FROM obs ORDER BY bead")
    assert [r[:3] for r in ranks] == [(1, 1, 1), (1, 1, 2), (1, 1, 2), (4, 2, 2), (4, 2, 2), (4, 2, 2)]
    running = garden("SELECT bead, sum(count(*)) OVER (ORDER BY bead ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM said GROUP BY bead ORDER BY bead")
    assert [int(n) for _, n in running] == [2, 3, 4, 5]
    left, right = "SELECT title FROM obs WHERE title IS NULL", "SELECT title FROM obs WHERE bead = :b"
    for op, n in (("EXCEPT", 0), ("EXCEPT ALL", 2), ("INTERSECT", 1), ("INTERSECT ALL", 1), ("UNION", 1), ("UNION ALL", 4)):
        assert len(garden(f"{left} {op} {right}", {"b": 4})) == n


def test_dialect_meaning(garden, spark):
    from decimal import Decimal

    assert garden("SELECT bead / :two AS q, -bead / :two AS r FROM obs WHERE bead = :b", {"two": 2, "b": 5}) == [(2, -2)]
    assert garden("SELECT sum(bead) AS s, avg(bead) AS a, sum(bead) FILTER (WHERE bead > :b) AS n FROM obs", {"b": 9}) == [(Decimal(21), Decimal("3.5"), None)]
    assert garden("SELECT CAST(n AS BIGINT) AS i FROM input.prior ORDER BY id", inputs={"prior": spark.sql("SELECT * FROM VALUES (1, 2.5BD), (2, -3.5BD) AS t(id, n)")}) == [(3,), (-4,)]
    assert garden("SELECT upper(title) AS t FROM input.x WHERE title NOT ILIKE :p AND title ILIKE :q", {"p": "%É%", "q": "STRASSE%"}, inputs={"x": spark.sql("SELECT 'strasse é' AS title")}) == [("STRASSE é",)]
    assert [t for (t,) in garden("SELECT title FROM obs ORDER BY title DESC")][:3] == [None] * 3
    assert [t for (t,) in garden("SELECT title FROM obs ORDER BY title DESC NULLS LAST")][:3] == ["orchard"] * 3
    assert garden("SELECT bead FROM obs WHERE bead = ANY(:a) AND flag = :t AND (title = :x OR title IS NULL)", {"a": [1, 2, 4], "t": True, "x": "it's \\ '"}) == [(4,)]
    for sql, construct in (("SELECT bead AS a FROM obs UNION ALL SELECT title AS a FROM obs", "set_types"), ("SELECT CAST(title AS BIGINT) AS a FROM obs", "cast"), ("SELECT bead AS b FROM obs JOIN said ON obs.bead = said.bead", "ambiguous_column"), ("SELECT nothing AS b FROM obs", "unknown_column")):
        with pytest.raises(dialect.Refusal, match=construct):
            garden(sql)


def test_dialect_recursion(garden, spark):
    from lodestrata.plans.lowered import Recursion

    walk = """WITH RECURSIVE w(depth, node) AS (SELECT 0 AS depth, bead AS node FROM obs WHERE bead = ANY(:a)
        UNION ALL SELECT w.depth + 1 AS depth, e.dst AS node FROM w JOIN edge AS e ON e.src = w.node WHERE w.depth < :most) {} SELECT depth, node{} FROM w"""
    cycle = walk.format("CYCLE node SET again USING path", ", again")
    got = sorted(garden(cycle, {"a": [1], "most": 3}, recursion=Recursion("w", "depth", "node", 3)))
    assert got == [(0, 1, False), (1, 2, False), (1, 3, False), (1, 5, False), (2, 4, False), (2, 4, False), (3, 1, True), (3, 1, True)]
    fewer = garden(cycle, {"a": [1], "most": 3}, recursion=Recursion("w", "depth", "node", 3, ("e.dst <> 5",)))
    assert len(fewer) == 7
    found = dialect.admit(spark, walk.format("", ""), {"a": [1], "most": 3}, {"obs", "edge"}, recursion=Recursion("w", "depth", "node", 3))
    assert found.coverage == "explicit_depth"
    for values, rule in (({"a": [1], "most": 4}, Recursion("w", "depth", "node", 3)), ({"a": [1], "most": 9}, Recursion("w", "depth", "node", 9)), ({"a": [1], "most": 3}, Recursion("w", "node", "depth", 3))):
        with pytest.raises(dialect.Refusal, match="recursion"):
            garden(walk.format("", ""), values, recursion=rule)
    with pytest.raises(dialect.Refusal, match="anchors"):
        garden(walk.format("", ""), {"a": [*range(17)], "most": 3}, recursion=Recursion("w", "depth", "node", 3))


@pytest.fixture(scope="module")
def fans(spark):
    """Walks of four depths from 0, with 1 + 110 + 110**2 + 110**3 rows: more than a million."""
    rungs = spark.range(110).selectExpr("explode(sequence(0L, 2L)) AS src")
    rungs.selectExpr("src", "src + 1 AS dst").createOrReplaceTempView("fan")
    spark.sql("SELECT 0L AS node").createOrReplaceTempView("start")
    return 1 + 110 + 110**2 + 110**3


@pytest.mark.parametrize("read", ["SELECT node FROM p", "SELECT q.x FROM p AS q(x, y) ORDER BY q.y", "SELECT r.node FROM (SELECT p.node FROM p) AS r", ", z AS (TABLE p) SELECT z.node FROM z"])
def test_dialect_recursion_has_no_row_limit(fans, spark, read):
    from lodestrata.plans.lowered import Recursion

    walk = "WITH RECURSIVE p(node, depth) AS (SELECT node AS node, 0 AS depth FROM start UNION ALL SELECT f.dst AS node, p.depth + 1 AS depth FROM p JOIN fan AS f ON f.src = p.node WHERE p.depth < :most)"
    sql = walk + " " * (read[0] != ",") + read
    assert dialect.run(spark, sql, {"most": 4}, {"fan", "start"}, recursion=Recursion("p", "depth", "node", 4)).count() == fans


def test_dialect_limits_and_anchors(spark):
    sql = "SELECT o_custkey FROM orders ORDER BY o_custkey LIMIT :n OFFSET :m"
    found = dialect.admit(spark, sql, {"n": 5, "m": 2}, {"orders"})
    assert (found.limit, found.offset, found.coverage) == (5, 2, "explicit_limit")
    assert dialect.admit(spark, "SELECT o_custkey FROM orders ORDER BY o_custkey OFFSET 3", {}, {"orders"}).coverage is None
    for n, m in ((-1, 0), (1, 10001), ("x", 0), (True, 0)):
        with pytest.raises(dialect.Refusal, match="structural_integer"):
            dialect.admit(spark, sql, {"n": n, "m": m}, {"orders"})
    kinds, one = catalog.relations()["statements"].kind, "SELECT text AS t FROM statements WHERE bead_id = :b"
    assert dialect.admit(spark, one, {"b": "b1"}, {"statements"}, kind_of=kinds, anchors=frozenset({"b1"})).parameters == ["b"]
    with pytest.raises(dialect.Refusal, match="reference_parameter"):
        dialect.admit(spark, one, {"b": "b2"}, {"statements"}, kind_of=kinds, anchors=frozenset({"b1"}))


def test_catalog_checks_population(spark):
    known = catalog.relations()
    assert len(known) == 14 and known["statements"].kind("statement_id") == "statement"
    r = known["relation_replacements"]
    good = spark.createDataFrame([("a", "b"), ("a", "c")], r.schema)
    catalog.check(good, r)
    with pytest.raises(catalog.PopulationError, match="repeats"):
        catalog.check(good.unionAll(good), r)
    loose = spark.createDataFrame([("a", None)], "relation_id string, replacement_relation_id string")
    with pytest.raises(catalog.PopulationError, match="nulls"):
        catalog.check(loose, r)
    views = catalog.register(spark, {"relation_replacements": good})
    assert spark.table("relation_replacements").count() == 2 and list(views) == ["relation_replacements"]


def test_deadline_cancels(spark):
    with pytest.raises(results.ResultError, match="cancelled"), results.deadline(spark, 1.0):
        spark.range(10**12).selectExpr("sum(sqrt(id) * sin(id))").collect()
    with results.deadline(spark, 60):
        assert spark.range(5).count() == 5


def test_damaged_records_are_kept_apart(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"record_key":"a","seq":1}\n{oops\n{"record_key":"b","seq":"x"}\n')
    rows = records.read(spark, f"file://{tmp_path}/r.jsonl").cache().collect()
    assert [(r["record_key"], r["damaged"] is not None) for r in rows] == [("a", False), (None, True), ("b", True)]


def test_intermediate_folders_are_shared_and_deleted(spark, tmp_path):
    from lodestrata.plans import store

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "app-on-a-cluster"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.shared_dir(Session)
    Session.sparkContext.master = "local[2]"
    assert store.shared_dir(Session).startswith("file:///")

    before = store.written(spark)
    df = store.stored(spark.range(5))
    (path,) = [p for p in store.written(spark) if p not in before]
    assert df.count() == 5 and store.release(spark, [path]) == 1 and store.written(spark) == before
    import os

    assert not os.path.exists(path.removeprefix("file://"))


def test_overlaps_of_any_length_equal_brute_force(spark):
    import random

    rng = random.Random(21)
    spans = lambda n: [(rng.randint(0, 2), s, s + rng.choice([0, 1, 3, 9, 10, 11, 50, 1000, 10**9])) for s in (rng.randint(0, 300) for _ in range(n))]
    left, right = spans(60), spans(50)
    a = spark.createDataFrame([(*r, i) for i, r in enumerate(left)], "k int, ls long, le long, i int")
    b = spark.createDataFrame([(*r, i) for i, r in enumerate(right)], "k int, rs long, re long, j int")
    got = sorted((r["i"], r["j"]) for r in temporal.overlap_join(a, b, "k", ("ls", "le"), ("rs", "re"), 10).collect())
    want = sorted((i, j) for i, (k, s, e) in enumerate(left) for j, (m, t, u) in enumerate(right) if k == m and s < e and t < u and s < u and t < e)
    assert got == want


def test_numbers_within_a_group_span_partitions(spark):
    rows = [("hot" if i % 10 else None, (i * 7919) % 5000) for i in range(5000)]
    got = temporal.numbered_within(spark.createDataFrame(rows, "g string, o long").repartition(5), "g", "o", "n").collect()
    for g in ("hot", None):
        own = sorted((r["o"], r["n"]) for r in got if r["g"] == g)
        assert [n for _, n in own] == list(range(1, len(own) + 1)) and len(own) == sum(x == g for x, _ in rows)


def test_slices_of_long_spans_lose_nothing(spark):
    text = "é" * 10 + "x" * 95
    df = spark.createDataFrame([(1, text, 5, 100), (2, text, 7, 7)], "k long, text string, start long, end long")
    got = [tuple(r) for r in results.own_slices(df, "k", 40).orderBy("start").collect()]
    assert got == [(1, s, min(s + 40, 100), text[s : min(s + 40, 100)]) for s in (5, 45, 85)]


def test_digests_of_digests(spark, tmp_path, monkeypatch):
    run, df = results.Run(spark, f"file://{tmp_path}"), spark.range(300).withColumnRenamed("id", "k")
    monkeypatch.setattr(results, "BLOCK", 7)
    first = run.commit("a", "f", df, ["k"])
    assert first.digest == run.commit("b", "f", df.repartition(5), ["k"]).digest != run.commit("c", "f", df.filter("k <> 150"), ["k"]).digest
    assert first.n_rows == 300


def test_grants_hold_on_every_relation(spark):
    known = catalog.relations()

    def rows(name, *values):
        schema = known[name].schema
        return spark.createDataFrame([tuple(v.get(f.name, {"bigint": 1, "boolean": True}.get(f.dataType.simpleString(), "x" if f.dataType.simpleString() == "string" else None)) for f in schema) for v in values], T.StructType([T.StructField(f.name, f.dataType) for f in schema]))

    frame = {
        "observations": rows("observations", *({"bead_version_id": f"v{i}", "event_id": f"e{i}"} for i in (1, 2))),
        "statements": rows("statements", *({"statement_id": f"s{i}", "bead_version_id": f"v{i}"} for i in (1, 2))),
        "assessed_relations": rows("assessed_relations", *({"relation_id": f"r{a}{b}", "source_bead_version_id": f"v{a}", "target_bead_version_id": f"v{b}"} for a, b in ((1, 1), (1, 2)))),
        "relation_statements": rows("relation_statements", *({"relation_id": r, "statement_id": r} for r in ("r11", "r12"))),
        "relation_types": rows("relation_types", {"type_key": "t"}),
    }
    grants = spark.createDataFrame([("e1",)], "event_id string")
    views = catalog.register(spark, frame, grants=grants, checked=False)
    seen = {n: sorted(r[known[n].keys[0]] for r in v.collect()) for n, v in views.items()}
    assert seen == {"observations": ["v1"], "statements": ["s1"], "assessed_relations": ["r11"], "relation_statements": ["r11"], "relation_types": ["t"]}
    assert set(known) == catalog.SCOPED | catalog.OPEN | set(catalog.VIA)
    with pytest.raises(catalog.PopulationError, match="observations"):
        catalog.register(spark, {"statements": frame["statements"]}, grants=grants, checked=False)


def test_runs_have_budgets_lifetimes_and_tombstones(spark, tmp_path):
    place = results.Workspace(spark, f"file://{tmp_path}/w")
    run = place.start()
    saved = run.commit("s", "f", spark.range(5).withColumnRenamed("id", "k"), ["k"], depends=spark.range(3).withColumnRenamed("id", "on"))
    assert run.page(saved, rebuild=lambda cutoff: spark.range(3).withColumnRenamed("id", "on")).rows == [{"k": i} for i in range(5)]
    with pytest.raises(results.ResultError, match="dependency"):
        run.page(saved, rebuild=lambda cutoff: spark.range(2).withColumnRenamed("id", "on"))
    assert run.counters()["accesses"] == 2 and run.counters()["results"] == 1 and run.counters()["transport"] > 0
    few = results.Run(spark, run.root, accesses=2)
    with pytest.raises(results.ResultError, match="budget_exhausted"):
        few.page(saved)
    place.start()
    with pytest.raises(results.ResultError, match="open"):
        place.start()
    run.close()
    over = results.Run(spark, f"file://{tmp_path}/w/late", lifetime=-1)
    assert over.closed and place.expire() == 2 and place.expire() == 0
    from lodestrata.plans import store

    assert store.names(spark, f"{run.root}/tombstones") == [f"{saved.result_id}.json"] and not store.names(spark, saved.path)
    rows = spark.range(50)
    assert results.bag_digest(rows.repartition(7)) == results.bag_digest(rows) != results.bag_digest(rows.filter("id <> 7"))


def test_scalar_subqueries_have_one_row(spark):
    from lodestrata.plans import lineage

    outer, inner = spark.range(3).withColumnRenamed("id", "k"), spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    got = {r["k"]: (r["v"], r["matches"]) for r in lineage.scalar(outer, inner, ["k"], "v").collect()}
    assert got == {0: ("a", 1), 1: ("b", 1), 2: (None, 0)}
    with pytest.raises(Exception, match="more than one row"):
        lineage.scalar(outer, inner.unionByName(inner), ["k"], "v").collect()
    assert lineage.limited(7, 7, None, [("n", False, True)])["order"] == [{"column": "n", "direction": "desc", "nulls": "first"}]
