"""Temporal, lifecycle and graph derivations as queries; their inputs are views of the events, conversations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import graph, temporal
from ..queries import query, table

KNOWN_AT = "2024-01-20 00:00:00"


def known_events(spark: SparkSession, d: str) -> DataFrame:
    """Events recorded by the frame's time: late arrivals are cut by when they were recorded, never dropped by a watermark."""
    return table(spark, d, "events").filter(F.col("ts") <= F.lit(KNOWN_AT).cast("timestamp_ntz"))


@query("latest_per_key", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Latest revision of each key."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return temporal.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("latest_then_authorize", """
SELECT user_id, event_id FROM (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS t FROM events GROUP BY user_id) WHERE t <> 'error'""")
def latest_then_authorize(spark: SparkSession, d: str) -> DataFrame:
    """Visibility is tested on the latest row only; an older visible row never stands in (D9g)."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return temporal.latest(e, ["user_id"], ["ts", "event_id"]).filter("event_type <> 'error'").select("user_id", "event_id")


@query("asof_join", """
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, event_id AS click_id FROM events WHERE event_type = 'click')
SELECT l.event_id, l.user_id, r.click_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's last click before it."""
    e = table(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    return temporal.asof_join(left, right, "user_id", "ts", "click_ts", "click_id", "7 days").select("event_id", "user_id", "click_id")


_SPANS = "SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + CAST(floor(value * 60) AS BIGINT) AS e FROM events"


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Half-open intervals in seconds from events."""
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("user_id", "event_id", s.alias("s"), (s + F.floor(F.col("value") * 60)).alias("e"), "event_type")


@query("interval_overlap", f"""
WITH x AS ({_SPANS.replace(" FROM", ", event_type FROM")})
SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM x a JOIN x b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e
WHERE a.event_type = 'purchase' AND b.event_type = 'error' AND a.e > a.s AND b.e > b.s""")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping intervals of a key."""
    x = spans(spark, d)
    a = x.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("a"), F.col("s").alias("a_s"), F.col("e").alias("a_e"))
    b = x.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("b"), F.col("s").alias("b_s"), F.col("e").alias("b_e"))
    return temporal.overlap_join(a, b, "user_id", ("a_s", "a_e"), ("b_s", "b_e"), 6 * 3600).select("user_id", "a", "b")


@query("coverage_union", f"""
WITH x AS (SELECT DISTINCT user_id, s, e FROM ({_SPANS}) WHERE e > s),
n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM x),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT user_id, min(s) AS s, max(e) AS e FROM i GROUP BY user_id, k""")
def coverage_union(spark: SparkSession, d: str) -> DataFrame:
    """Union of half-open intervals."""
    return temporal.union_intervals(spans(spark, d), ["user_id"], "s", "e")


@query("coverage_gaps", f"""
WITH x AS (SELECT DISTINCT user_id, s, e FROM ({_SPANS}) WHERE e > s),
n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM x),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM n),
u AS (SELECT user_id, min(s) AS s, max(e) AS e FROM i GROUP BY user_id, k),
w AS (SELECT user_id, lag(e, 1, 1704067200) OVER (PARTITION BY user_id ORDER BY s) AS s, s AS e FROM u UNION ALL SELECT user_id, max(e), 1706745600 FROM u GROUP BY user_id)
SELECT user_id, s, e FROM w WHERE s < e""")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What the union leaves uncovered of January 2024."""
    covered = temporal.union_intervals(spans(spark, d), ["user_id"], "s", "e")
    return temporal.gaps(covered, ["user_id"], "s", "e", F.lit(1704067200).cast("bigint"), F.lit(1706745600).cast("bigint"))


@query("run_coalescing", """
WITH f AS (SELECT event_id, user_id, ts, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new, event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n, min(event_type) AS event_type FROM r GROUP BY user_id, run""")
def run_coalescing(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal neighbours as one row."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = e.withColumn("_same", F.coalesce(F.lag("event_type").over(w) == F.col("event_type"), F.lit(False)))
    return temporal.runs(e, ["user_id"], "event_id", F.col("_same")).groupBy("user_id", "run").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count("*").alias("n"), F.min("event_type").alias("event_type"))


@query("event_cardinality", """
SELECT c.conv_id, 4 AS declared, count(*) AS actual, count(*) FILTER (WHERE role = 'user') AS users, count(*) <> 4 AS differs FROM conversations c GROUP BY c.conv_id""")
def event_cardinality(spark: SparkSession, d: str) -> DataFrame:
    """Declared and actual counts of an event's units."""
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("actual"), F.count_if(F.col("role") == "user").alias("users"))
    return g.select("conv_id", F.lit(4).alias("declared"), "actual", "users", (F.col("actual") != 4).alias("differs"))


@query("timeline_effective", """
SELECT e.event_id, CASE WHEN e.value > 60 THEN NULL ELSE e.event_id END AS unit_at, o.k AS event_at,
       coalesce(CASE WHEN e.value > 60 THEN NULL ELSE e.event_id END, o.k, -1) AS effective_at,
       CASE WHEN e.value <= 60 THEN 'unit' WHEN o.k IS NOT NULL THEN 'event' ELSE 'capture' END AS basis
FROM events e LEFT JOIN (SELECT DISTINCT conv_id AS k FROM conversations) o ON o.k = e.event_id""")
def timeline_effective(spark: SparkSession, d: str) -> DataFrame:
    """Effective time with the basis that it comes from."""
    units = F.when(F.col("value") <= 60, F.col("event_id"))
    convs = table(spark, d, "conversations").select(F.col("conv_id").alias("event_at")).distinct()
    e = table(spark, d, "events").withColumn("unit_at", units)
    j = e.join(convs, e.event_id == convs.event_at, "left")
    basis = F.when(F.col("unit_at").isNotNull(), "unit").when(F.col("event_at").isNotNull(), "event").otherwise("capture")
    return j.select("event_id", "unit_at", "event_at", F.coalesce("unit_at", "event_at", F.lit(-1).cast("bigint")).alias("effective_at"), basis.alias("basis"))


_CORRECTIONS = "SELECT event_id - user_id % 7 - 1 AS predecessor, event_id AS successor, ts FROM events WHERE event_type = 'signup'"


def _predecessor():
    return (F.col("event_id") - F.col("user_id") % 7 - 1).alias("event_id")


@query("correction_state", f"""
WITH c AS (SELECT * FROM ({_CORRECTIONS}) WHERE ts <= TIMESTAMP '{KNOWN_AT}'),
n AS (SELECT e.event_id, count(c.successor) AS n FROM events e LEFT JOIN c ON c.predecessor = e.event_id WHERE e.ts <= TIMESTAMP '{KNOWN_AT}' GROUP BY e.event_id)
SELECT event_id, n AS successors, CASE WHEN n = 0 THEN 'unsuperseded' WHEN n = 1 THEN 'superseded' ELSE 'branched' END AS state FROM n""")
def correction_state(spark: SparkSession, d: str) -> DataFrame:
    """Successors of an observation at the frame's time; with several it is branched, and none wins by being newer (D3)."""
    e = known_events(spark, d)
    c = e.filter("event_type = 'signup'").groupBy(_predecessor()).agg(F.count("*").alias("k"))
    n = F.coalesce("k", F.lit(0).cast("bigint"))
    return e.select("event_id").join(c, "event_id", "left").select("event_id", n.alias("successors"), F.when(n == 0, "unsuperseded").when(n == 1, "superseded").otherwise("branched").alias("state"))


@query("resolved_view", f"""
SELECT event_id FROM events e WHERE ts <= TIMESTAMP '{KNOWN_AT}' AND NOT EXISTS (SELECT 1 FROM ({_CORRECTIONS}) c WHERE c.predecessor = e.event_id AND c.ts <= TIMESTAMP '{KNOWN_AT}')""")
def resolved_view(spark: SparkSession, d: str) -> DataFrame:
    """The view without any observation that has successors (D3)."""
    e = known_events(spark, d)
    c = e.filter("event_type = 'signup'").select(_predecessor())
    return e.select("event_id").join(c, "event_id", "left_anti")


@query("family_admission", """
WITH bad AS (SELECT DISTINCT conv_id FROM conversations WHERE length(text) < 80) SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM bad)""")
def family_admission(spark: SparkSession, d: str) -> DataFrame:
    """All rows of a family are kept, or none if one of them can't be read (D6, D7g)."""
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn").join(c.filter(F.length("text") < 80).select("conv_id").distinct(), "conv_id", "left_anti")


@query("linked_units", "SELECT conv_id, turn FROM conversations c WHERE EXISTS (SELECT 1 FROM events e WHERE e.event_id = c.conv_id AND e.event_type = 'view')")
def linked_units(spark: SparkSession, d: str) -> DataFrame:
    """Only units that support an admitted observation."""
    return table(spark, d, "conversations").select("conv_id", "turn").join(table(spark, d, "events").filter("event_type = 'view'").select(F.col("event_id").alias("conv_id")), "conv_id", "left_semi")


_CLAIMS = f"""SELECT event_id, ts, event_id % 3001 AS claim, (event_id * 7) % 3001 AS related,
CASE event_type WHEN 'click' THEN 'retract' WHEN 'purchase' THEN 'supersede' WHEN 'error' THEN 'dispute' WHEN 'view' THEN 'resolve' ELSE 'assert' END AS action
FROM events WHERE ts <= TIMESTAMP '{KNOWN_AT}'"""


def claim_events(spark: SparkSession, d: str) -> DataFrame:
    names = {"click": "retract", "purchase": "supersede", "error": "dispute", "view": "resolve"}
    action = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()], F.lit("assert"))
    return known_events(spark, d).select("event_id", "ts", (F.col("event_id") % 3001).alias("claim"), ((F.col("event_id") * 7) % 3001).alias("related"), action.alias("action"))


@query("claim_state", f"""
WITH ev AS ({_CLAIMS}), claims AS (SELECT claim FROM ev UNION SELECT related FROM ev),
gone AS (SELECT DISTINCT claim FROM ev WHERE action = 'retract'),
over AS (SELECT DISTINCT related AS claim FROM ev WHERE action = 'supersede' AND claim NOT IN (SELECT claim FROM gone)),
pairs AS (SELECT claim, related, max(ts) FILTER (WHERE action = 'dispute') AS disputed, max(ts) FILTER (WHERE action = 'resolve') AS resolved FROM ev GROUP BY ALL),
open AS (SELECT DISTINCT claim FROM pairs WHERE disputed IS NOT NULL AND (resolved IS NULL OR resolved <= disputed))
SELECT c.claim, CASE WHEN c.claim IN (SELECT claim FROM gone) THEN 'retracted' WHEN c.claim IN (SELECT claim FROM over) THEN 'superseded' WHEN c.claim IN (SELECT claim FROM open) THEN 'disputed' ELSE 'current' END AS state
FROM claims c""")
def claim_state(spark: SparkSession, d: str) -> DataFrame:
    """State of a claim as of a time: retracted, superseded by one that isn't retracted, disputed, current."""
    ev = claim_events(spark, d)
    is_ = lambda a: F.col("action") == a
    pairs = ev.groupBy("claim", "related").agg(F.bool_or(is_("retract")).alias("gone"), F.bool_or(is_("supersede")).alias("supersedes"), F.max(F.when(is_("dispute"), F.col("ts"))).alias("disputed"), F.max(F.when(is_("resolve"), F.col("ts"))).alias("resolved"))
    pairs = pairs.withColumn("open", F.col("disputed").isNotNull() & (F.col("resolved").isNull() | (F.col("resolved") <= F.col("disputed"))))
    own = pairs.groupBy("claim").agg(F.bool_or("gone").alias("gone"), F.bool_or("open").alias("open"))
    by = pairs.filter("supersedes").select("claim", "related").join(own.filter("not gone").select("claim"), "claim", "left_semi")
    over = by.select(F.col("related").alias("claim"), F.lit(True).alias("over")).distinct()
    claims = pairs.select("claim").unionByName(pairs.select(F.col("related").alias("claim"))).distinct()
    j = claims.join(own, "claim", "left").join(over, "claim", "left")
    return j.select("claim", F.when(F.col("gone"), "retracted").when(F.col("over"), "superseded").when(F.col("open"), "disputed").otherwise("current").alias("state"))


@query("relation_state", f"""
WITH ev AS ({_CLAIMS}), claims AS (SELECT claim FROM ev UNION SELECT related FROM ev),
gone AS (SELECT DISTINCT claim FROM ev WHERE action = 'retract'),
over AS (SELECT DISTINCT related AS claim FROM ev WHERE action = 'supersede' AND claim NOT IN (SELECT claim FROM gone)),
pairs AS (SELECT claim, related, max(ts) FILTER (WHERE action = 'dispute') AS disputed, max(ts) FILTER (WHERE action = 'resolve') AS resolved FROM ev GROUP BY ALL),
open AS (SELECT DISTINCT claim FROM pairs WHERE disputed IS NOT NULL AND (resolved IS NULL OR resolved <= disputed)),
ends AS (SELECT claim, max(ts) AS told FROM ev WHERE action = 'assert' GROUP BY claim), moved AS (SELECT related AS claim, max(ts) AS at FROM ev WHERE action = 'supersede' GROUP BY related),
pending AS (SELECT DISTINCT p.claim FROM pairs p JOIN moved m ON m.claim = p.related LEFT JOIN ends e ON e.claim = p.claim WHERE e.told IS NULL OR e.told <= m.at)
SELECT c.claim, CASE WHEN c.claim IN (SELECT claim FROM gone) THEN 'retracted' WHEN c.claim IN (SELECT claim FROM over) THEN 'superseded' WHEN c.claim IN (SELECT claim FROM open) THEN 'disputed'
       WHEN c.claim IN (SELECT claim FROM pending) THEN 'reassessment_pending' ELSE 'active' END AS state FROM claims c""")
def relation_state(spark: SparkSession, d: str) -> DataFrame:
    """A relation whose end was corrected after it was last asserted waits for reassessment, unless worse holds."""
    ev = claim_events(spark, d)
    told = ev.filter("action = 'assert'").groupBy("claim").agg(F.max("ts").alias("told"))
    moved = ev.filter("action = 'supersede'").groupBy("related").agg(F.max("ts").alias("at"))
    late = ev.select("claim", "related").distinct().join(moved, "related").join(told, "claim", "left").filter("told IS NULL OR told <= at")
    pending = late.select("claim", F.lit(True).alias("pending")).distinct()
    j = claim_state(spark, d).join(pending, "claim", "left")
    return j.select("claim", F.when(F.col("state") != "current", F.col("state")).when(F.col("pending"), "reassessment_pending").otherwise("active").alias("state"))


@query("relation_projection", f"""
WITH ev AS ({_CLAIMS}), agg AS (SELECT claim, bool_or(action = 'retract') AS gone, bool_or(action = 'dispute') AS pending, string_agg(event_id || ':' || action, ',' ORDER BY event_id) AS log FROM ev GROUP BY claim)
SELECT claim, CASE WHEN gone THEN 'retracted' ELSE 'active' END AS state, sha256('{{"claim":' || claim || ',"events":"' || log || '"}}') AS head_token,
       NOT gone AND NOT pending AS support_eligible, CASE WHEN gone THEN 'withdrawn' WHEN pending THEN 'corrected' END AS support_reason FROM agg""")
def relation_projection(spark: SparkSession, d: str) -> DataFrame:
    """State, head token over the ordered events, and whether a relation may support others."""
    ev = claim_events(spark, d)
    log = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "action"))), lambda x: F.concat(x["event_id"].cast("string"), F.lit(":"), x["action"])), ",")
    a = ev.groupBy("claim").agg(F.bool_or(F.col("action") == "retract").alias("gone"), F.bool_or(F.col("action") == "dispute").alias("pending"), log.alias("log"))
    token = F.sha2(F.concat(F.lit('{"claim":'), F.col("claim").cast("string"), F.lit(',"events":"'), "log", F.lit('"}')), 256)
    return a.select("claim", F.when(F.col("gone"), "retracted").otherwise("active").alias("state"), token.alias("head_token"), (~F.col("gone") & ~F.col("pending")).alias("support_eligible"), F.when(F.col("gone"), "withdrawn").when(F.col("pending"), "corrected").alias("support_reason"))


_EDGES = """SELECT event_id AS src, prev AS dst FROM links WHERE prev IS NOT NULL UNION ALL SELECT prev, event_id FROM links WHERE prev IS NOT NULL AND event_type = 'error'
UNION ALL SELECT event_id, click FROM links WHERE click IS NOT NULL AND event_type = 'purchase'"""
_LINKS = """links AS (SELECT event_id, event_type, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS prev,
max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click FROM events)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Events as nodes: each points to the user's event of its type before it, errors also back, purchases also to the click before."""
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    clicks = F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).over(before)
    links = table(spark, d, "events").select("event_id", "user_id", "event_type").withColumns({"prev": F.lag("event_id").over(w), "click": clicks})
    pair = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    ways = F.array(F.when(F.col("prev").isNotNull(), pair("event_id", "prev")), F.when(F.col("prev").isNotNull() & (F.col("event_type") == "error"), pair("prev", "event_id")), F.when(F.col("click").isNotNull() & (F.col("event_type") == "purchase"), pair("event_id", "click")))
    return links.select(F.explode(F.array_compact(ways)).alias("e")).select("e.src", "e.dst")


_ANCHORS = "SELECT event_id AS node FROM events WHERE event_type IN ('signup', 'purchase', 'error') UNION ALL SELECT event_id FROM events WHERE event_type = 'signup' AND value > 50"


def anchors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.filter("event_type IN ('signup', 'purchase', 'error')").select(F.col("event_id").alias("node")).unionAll(e.filter("event_type = 'signup' AND value > 50").select("event_id"))


def _paths(reverse: bool) -> str:
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return f"""
WITH RECURSIVE {_LINKS}, e AS ({_EDGES}), p(node, depth, path, is_cycle) AS (
  SELECT node, 0, [node], false FROM ({_ANCHORS})
  UNION ALL SELECT e.{b}, depth + 1, list_append(path, e.{b}), list_contains(path, e.{b}) FROM p JOIN e ON e.{a} = p.node WHERE NOT is_cycle AND depth < 4)
SELECT node, depth, array_to_string(path, '>') AS path, is_cycle FROM p"""


def _walk(reverse: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Bounded paths with depth, path and cycle flag, a bag even for a repeated anchor."""
        return graph.walk_paths(edges(spark, d), anchors(spark, d), 4, reverse).select("node", "depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "is_cycle")

    return run


query("rec_paths", _paths(False))(_walk(False))
query("rec_paths_reverse", _paths(True))(_walk(True))


@query("rec_paths_sql", _paths(False))
def rec_paths_sql(spark: SparkSession, d: str) -> DataFrame:
    """The same walk as one recursive SQL query with a path array in place of a cycle clause.

    LIMIT ALL, so that Spark doesn't give up after a million rows (C13); the depth ends the walk.
    """
    return spark.sql("""
        WITH RECURSIVE p(node, depth, path, is_cycle) AS (
          SELECT node, 0, array(node), false FROM {a}
          UNION ALL SELECT e.dst, depth + 1, concat(path, array(e.dst)), array_contains(path, e.dst) FROM p JOIN {e} e ON e.src = p.node WHERE NOT is_cycle AND depth < 4)
        SELECT node, depth, array_join(CAST(path AS ARRAY<STRING>), '>') AS path, is_cycle FROM p LIMIT ALL""", e=edges(spark, d), a=anchors(spark, d))  # fmt: skip


@query("transitive_corrections", f"""
WITH RECURSIVE {_LINKS}, e AS (SELECT DISTINCT * FROM ({_EDGES})), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT a, b FROM r""")
def transitive_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Closure with set semantics and cycle protection."""
    return graph.closure(edges(spark, d))


@query("derivation_targets", f"WITH {_LINKS} SELECT DISTINCT src, dst FROM ({_EDGES}) WHERE src <> dst")
def derivation_targets(spark: SparkSession, d: str) -> DataFrame:
    """Distinct edges that aren't loops."""
    return edges(spark, d).filter("src <> dst").distinct()


_ROOTS = f"""
WITH RECURSIVE {_LINKS}, e AS (SELECT DISTINCT * FROM ({_EDGES})), n AS (SELECT src AS n FROM e UNION SELECT dst FROM e),
r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b),
bottom AS (SELECT n FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.a = n AND r.b <> n AND NOT EXISTS (SELECT 1 FROM r q WHERE q.a = r.b AND q.b = n))),
named AS (SELECT n, least(n, coalesce((SELECT min(r.b) FROM r JOIN r q ON q.a = r.b AND q.b = r.a WHERE r.a = bottom.n), n)) AS root FROM bottom),
pairs AS (SELECT a, b FROM r UNION SELECT n, n FROM n), roots AS (SELECT DISTINCT a AS node, root FROM pairs JOIN named ON named.n = b)"""


@query("derivation_roots", f"{_ROOTS} SELECT node, root FROM roots")
def derivation_roots(spark: SparkSession, d: str) -> DataFrame:
    """Roots: least members of the bottom strongly connected components that a node reaches."""
    e = edges(spark, d)
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    return graph.bottom_roots(e, nodes)


@query("independent_root_count", f"{_ROOTS} SELECT node % 10 AS family, count(DISTINCT root) AS roots FROM roots GROUP BY 1")
def independent_root_count(spark: SparkSession, d: str) -> DataFrame:
    """Size of the union of the members' roots."""
    return derivation_roots(spark, d).groupBy((F.col("node") % 10).alias("family")).agg(F.countDistinct("root").alias("roots"))


@query("forbidden_cycles", f"""
WITH RECURSIVE {_LINKS}, e AS (SELECT DISTINCT * FROM ({_EDGES})), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT a AS node FROM r WHERE a = b""")
def forbidden_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that reach themselves."""
    return graph.closure(edges(spark, d)).filter("a = b").select(F.col("a").alias("node"))


_REDIRECTS = f"""SELECT event_id AS node, CASE WHEN event_type = 'error' THEN coalesce(prev, last) ELSE prev END AS target FROM (
SELECT event_id, event_type, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS prev, max(event_id) OVER (PARTITION BY user_id, event_type) AS last FROM events WHERE ts <= TIMESTAMP '{KNOWN_AT}')
WHERE event_type IN ('view', 'error') AND (prev IS NOT NULL OR event_type = 'error')"""


def _redirects(spark: SparkSession, d: str) -> DataFrame:
    """Redirects known at the frame's time: views to the view before, errors too, and the first error to the last (a cycle)."""
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    last = F.max("event_id").over(Window.partitionBy("user_id", "event_type"))
    prev = F.lag("event_id").over(w)
    e = known_events(spark, d).filter("event_type IN ('view', 'error')")
    return e.select(F.col("event_id").alias("node"), F.when(F.col("event_type") == "error", F.coalesce(prev, last)).otherwise(prev).alias("target")).dropna()


@query("redirects_asof", f"""
WITH RECURSIVE e AS ({_REDIRECTS}), n AS (SELECT event_id AS node FROM events),
w(node, here, path) AS (SELECT node, node, [node] FROM n UNION ALL SELECT w.node, e.target, list_append(path, e.target) FROM w JOIN e ON e.node = w.here WHERE NOT list_contains(path, e.target)),
last AS (SELECT node, arg_max(here, len(path)) AS here, max(len(path)) - 1 AS hops FROM w GROUP BY node)
SELECT l.node, CASE WHEN e.node IS NULL THEN l.here END AS resolved, CASE WHEN e.node IS NULL THEN l.hops END AS hops, e.node IS NOT NULL AS is_cycle FROM last l LEFT JOIN e ON e.node = l.here""")
def redirects_asof(spark: SparkSession, d: str) -> DataFrame:
    """Where redirects as of a time end, after any number of hops; null and flagged on a cycle."""
    nodes = table(spark, d, "events").select(F.col("event_id").alias("node"))
    out = graph.resolve(_redirects(spark, d), nodes, None)
    return out.select("node", "resolved", F.col("hops").cast("bigint").alias("hops"), "is_cycle")


@query("unified_assertions", f"""
SELECT 'authored' AS kind, event_id, ts <= TIMESTAMP '{KNOWN_AT}' AS known FROM events WHERE event_type = 'view' AND ts <= TIMESTAMP '{KNOWN_AT}'
UNION ALL SELECT 'assessed', event_id, true FROM events WHERE event_type = 'purchase' AND value > 20 AND ts <= TIMESTAMP '{KNOWN_AT}'""")
def unified_assertions(spark: SparkSession, d: str) -> DataFrame:
    """Authored and accepted assessed assertions as one table."""
    e = known_events(spark, d)
    one = e.filter("event_type = 'view'").select(F.lit("authored").alias("kind"), "event_id", F.lit(True).alias("known"))
    return one.unionByName(e.filter("event_type = 'purchase' AND value > 20").select(F.lit("assessed").alias("kind"), "event_id", F.lit(True).alias("known")))


@query("set_equality", """
SELECT (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS missing, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS extra,
       NOT EXISTS (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) AND NOT EXISTS (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) AS equal""")
def set_equality(spark: SparkSession, d: str) -> DataFrame:
    """Two differences decide whether two sets are equal."""
    a, b = table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").select("doc_id")
    m = a.subtract(b).agg(F.count("*").alias("missing")).crossJoin(b.subtract(a).agg(F.count("*").alias("extra")))
    return m.withColumn("equal", (F.col("missing") == 0) & (F.col("extra") == 0))


@query("manifest_digest", """
WITH r AS (SELECT n_regionkey AS k, sha256(n_nationkey || '|' || n_name) AS h FROM nation) SELECT k, sha256(string_agg(h, '' ORDER BY h)) AS digest, count(*) AS n FROM r GROUP BY k""")
def manifest_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digest of a set of rows that doesn't depend on their order."""
    r = table(spark, d, "nation").select(F.col("n_regionkey").alias("k"), F.sha2(F.concat_ws("|", "n_nationkey", "n_name"), 256).alias("h"))
    return r.groupBy("k").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("digest"), F.count("*").alias("n"))


@query("evidence_refs", """
SELECT doc_id, source, dense_rank() OVER (PARTITION BY source ORDER BY doc_id) AS ref, sha256(doc_id || ':' || source) AS binding FROM (SELECT DISTINCT doc_id, source FROM documents)""")
def evidence_refs(spark: SparkSession, d: str) -> DataFrame:
    """One private reference for each binding."""
    bindings = table(spark, d, "documents").select("doc_id", "source").distinct()
    return temporal.numbered_within(bindings, "source", "doc_id", "ref").select("doc_id", "source", "ref", F.sha2(F.concat_ws(":", "doc_id", "source"), 256).alias("binding"))


@query("inspect_relations", f"""
WITH {_LINKS}, e AS (SELECT DISTINCT * FROM ({_EDGES})) SELECT 'outgoing' AS side, src AS node, dst AS other FROM e UNION ALL SELECT 'incoming', dst, src FROM e""")
def inspect_relations(spark: SparkSession, d: str) -> DataFrame:
    """Incoming and outgoing relations of each node."""
    e = edges(spark, d).distinct()
    out = e.select(F.lit("outgoing").alias("side"), F.col("src").alias("node"), F.col("dst").alias("other"))
    return out.unionByName(e.select(F.lit("incoming").alias("side"), F.col("dst").alias("node"), F.col("src").alias("other")))


@query("sealed_unit_facts", "SELECT doc_id, sha256(text) AS digest, length(text) AS chars, lower(lang) AS lang FROM documents")
def sealed_unit_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a unit that are computed once."""
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.char_length("text").cast("bigint").alias("chars"), F.lower("lang").alias("lang"))


@query("vocabulary", "SELECT event_type AS type_key, count(DISTINCT user_id) AS users, dense_rank() OVER (ORDER BY event_type) AS revision FROM events GROUP BY event_type")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Types as a dimension with revisions."""
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("type_key")).agg(F.countDistinct("user_id").alias("users"))
    return g.withColumn("revision", F.dense_rank().over(Window.orderBy("type_key")).cast("bigint"))
