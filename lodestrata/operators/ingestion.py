"""Ingestion as queries: framing, capture outcomes, turn assembly, intake, completion, packages and keyset pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import temporal
from ..queries import query, table
from ..sources import framing


@query("frame_lines", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL),
o AS (SELECT *, CAST(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) - octet_length(encode(line)) - 1 AS BIGINT) AS byte_start FROM l)
SELECT doc_id, CAST(k - 1 AS BIGINT) AS record, byte_start, CAST(octet_length(encode(line)) AS BIGINT) AS n_bytes, sha256(regexp_replace(line, chr(13) || '$', '')) AS digest, k < n AS ended FROM o WHERE k < n OR octet_length(encode(line)) > 0""")
def frame_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that arrive in chunks of 512 bytes."""
    docs = table(spark, d, "documents").select("doc_id", F.encode("text", "utf-8").alias("data")).filter("data IS NOT NULL")
    return framing.frame(framing.byte_chunks(docs, "doc_id", "data", 512), "doc_id").select("doc_id", "record", "byte_start", "n_bytes", F.sha2("data", 256).alias("digest"), "ended")


@query("capture_ranges", """
WITH s AS (SELECT user_id AS k, event_id * 10 AS a, event_id * 10 + 10 AS b, md5(props) AS h FROM events WHERE event_type = 'view'),
n AS (SELECT user_id AS k, (event_id // 2) * 20 AS a, (event_id // 2) * 20 + 10 AS b, min(md5(props)) AS h FROM events WHERE event_type IN ('view', 'error') GROUP BY ALL)
SELECT n.k, n.a AS "start", CASE WHEN count(s.k) > 0 AND bool_and(s.a = n.a AND s.b = n.b AND s.h = n.h) THEN 'replayed' WHEN count(s.k) > 0 THEN 'conflict' WHEN coalesce(max(h.e), 0) = n.a THEN 'accepted' ELSE 'gap' END AS outcome
FROM n LEFT JOIN s ON s.k = n.k AND s.a < n.b AND n.a < s.b LEFT JOIN (SELECT k, max(b) AS e FROM s GROUP BY k) h ON h.k = n.k GROUP BY n.k, n.a, n.b, n.h""")
def capture_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Exact replays, conflicts, continuations and gaps of captured byte ranges."""
    e = table(spark, d, "events")
    stored = e.filter("event_type = 'view'").select(F.col("user_id").alias("k"), (F.col("event_id") * 10).alias("start"), (F.col("event_id") * 10 + 10).alias("end"), F.md5("props").alias("sha256"))
    half = F.floor(F.col("event_id") / 2) * 20
    batch = e.filter("event_type IN ('view', 'error')").groupBy(F.col("user_id").alias("k"), half.alias("start"), (half + 10).alias("end")).agg(F.min(F.md5("props")).alias("sha256"))
    return framing.capture(stored, batch, "k").select("k", "start", "outcome")


def turns(df: DataFrame) -> DataFrame:
    """Turns of conversations (conv_id, turn, role, text): a user message and what follows up to the next one.

    A turn is exact when it has a user message and a reply; what else there is becomes a transcript span, so that every
    message is in one outcome. At the sealed end an unfinished turn is flushed as a span.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    flagged = df.select("conv_id", "turn", "role", "text").withColumn("_goes_on", (F.col("role") != "user") & (F.row_number().over(w) > 1))
    g = temporal.runs(flagged, ["conv_id"], "turn", F.col("_goes_on")).groupBy("conv_id", "run")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    g = g.agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"), F.bool_or(F.col("role") == "user").alias("asked"), F.bool_or(F.col("role") == "assistant").alias("answered"), F.sha2(text, 256).alias("digest"))
    return g.select("conv_id", "run", "first_turn", "last_turn", "n", F.when(F.col("asked") & F.col("answered"), "exact_turn").otherwise("transcript_span").alias("kind"), "digest")


TURNS_SQL = """
WITH f AS (SELECT *, CASE WHEN role <> 'user' AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM f)
SELECT conv_id, run, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n, CASE WHEN bool_or(role = 'user') AND bool_or(role = 'assistant') THEN 'exact_turn' ELSE 'transcript_span' END AS kind,
       sha256(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM r GROUP BY conv_id, run"""


@query("assemble_turns", TURNS_SQL)
def assemble_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turn assembly in batch."""
    return turns(table(spark, d, "conversations"))


@query("scope_exclusion", """
SELECT event_id, CASE WHEN props = '{"k": 1}' THEN 'missing_source_time' WHEN CAST(ts AS DATE) <> DATE '2024-01-15' AND CAST(ts + INTERVAL 30 MINUTE AS DATE) = DATE '2024-01-15' THEN 'cross_midnight'
 WHEN CAST(ts AS DATE) <> DATE '2024-01-15' THEN 'off_date' ELSE 'in_scope' END AS disposition FROM events""")
def scope_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """What lies outside a date scope gets a disposition with a reason, and isn't dropped."""
    day = F.lit("2024-01-15").cast("date")
    on, near = F.col("ts").cast("date") == day, (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).cast("date") == day
    return table(spark, d, "events").select("event_id", F.when(F.col("props") == '{"k": 1}', "missing_source_time").when(~on & near, "cross_midnight").when(~on, "off_date").otherwise("in_scope").alias("disposition"))


@query("record_intake", """
WITH r AS (SELECT doc_id, doc_id // 256 AS batch, sha256(text) AS h, n_chars FROM documents), s AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE h END AS stored FROM r WHERE doc_id % 3 = 0),
c AS (SELECT r.*, CASE WHEN r.doc_id % 97 = 96 THEN 'retryable' WHEN n_chars > 20000 THEN 'rejected' WHEN stored = h THEN 'already_accepted' WHEN stored IS NOT NULL THEN 'conflict' ELSE 'accepted' END AS outcome FROM r LEFT JOIN s USING (doc_id)),
f AS (SELECT batch, min(doc_id) FILTER (WHERE outcome = 'retryable') AS stop FROM c GROUP BY batch)
SELECT doc_id, c.batch, CASE WHEN doc_id > stop THEN 'unread' ELSE outcome END AS outcome FROM c JOIN f USING (batch)""")
def record_intake(spark: SparkSession, d: str) -> DataFrame:
    """One outcome for each record of a batch; what follows a retryable one is unread."""
    r = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 256).alias("batch"), F.sha2("text", 256).alias("h"), "n_chars")
    s = r.filter("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.col("h")).alias("stored"))
    outcome = F.when(F.col("doc_id") % 97 == 96, "retryable").when(F.col("n_chars") > 20000, "rejected").when(F.col("stored") == F.col("h"), "already_accepted").when(F.col("stored").isNotNull(), "conflict").otherwise("accepted")
    c = r.join(s, "doc_id", "left").withColumn("outcome", outcome)
    stop = c.groupBy("batch").agg(F.min(F.when(F.col("outcome") == "retryable", F.col("doc_id"))).alias("stop"))
    return c.join(stop, "batch").select("doc_id", "batch", F.when(F.col("doc_id") > F.col("stop"), "unread").otherwise(F.col("outcome")).alias("outcome"))


@query("chunk_completion", "SELECT doc_id, NOT (doc_id % 10 = 0 AND length(text) > 256) AS complete, CAST(greatest(1, ceil(length(text) / 256.0)) - CASE WHEN doc_id % 10 = 0 AND length(text) > 256 THEN 1 ELSE 0 END AS BIGINT) AS n_chunks FROM documents WHERE text IS NOT NULL")
def chunk_completion(spark: SparkSession, d: str) -> DataFrame:
    """A record is complete when its chunks are contiguous and give its hash."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text", F.sha2("text", 256).alias("declared"))
    # a text is cut in one pass, and places in bytes are running sums over its pieces
    pieces = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit("(?s).{1,256}"), F.lit(0)))
    cut = docs.select("doc_id", "declared", F.posexplode(pieces).alias("k", "text"))
    ahead = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("byte_start", F.coalesce(F.sum(F.octet_length("text")).over(ahead), F.lit(0)))
    cut = cut.withColumn("byte_end", F.col("byte_start") + F.octet_length("text")).filter("NOT (doc_id % 10 = 0 AND k = 1)")
    return framing.completed(cut, ["doc_id"], "declared").select("doc_id", "complete", "n_chunks")


@query("evidence_packages", """
SELECT conv_id, count(*) AS parts, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, sha256(string_agg(turn || ':' || sha256(text), ',' ORDER BY turn)) AS inventory FROM conversations GROUP BY conv_id""")
def evidence_packages(spark: SparkSession, d: str) -> DataFrame:
    """Packages sealed with a digest of their ordered parts."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.octet_length("text").cast("bigint").alias("b"), F.concat(F.col("turn").cast("string"), F.lit(":"), F.sha2("text", 256)).alias("p"))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "p"))), lambda x: x["p"]), ",")
    return c.groupBy("conv_id").agg(F.count("*").alias("parts"), F.sum("b").alias("bytes"), F.sha2(parts, 256).alias("inventory"))


def keyset_page(df: DataFrame, order: list[str], after: tuple, upto: tuple | None, n: int) -> DataFrame:
    """The next n rows behind a key, none beyond a watermark: a filter that reaches the scan, and a top-n."""
    key = F.struct(*order)
    at = lambda values: F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, values, strict=True)])
    rows = df.filter(key > at(after))
    return (rows.filter(key <= at(upto)) if upto is not None else rows).orderBy(*order).limit(n)


@query("keyset_page", "SELECT conv_id, turn, role FROM conversations WHERE (conv_id > 20 OR conv_id = 20 AND turn > 1) AND (conv_id < 60 OR conv_id = 60 AND turn <= 3) ORDER BY conv_id, turn LIMIT 50")
def keyset_page_query(spark: SparkSession, d: str) -> DataFrame:
    """Resumable reading by keys under a fixed watermark."""
    return keyset_page(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"], (20, 1), (60, 3), 50)


@query("unit_materialization", "SELECT md5(text) AS identity, min(doc_id) AS doc_id, count(*) AS occurrences FROM documents GROUP BY 1")
def unit_materialization(spark: SparkSession, d: str) -> DataFrame:
    """One unit for each identity, whatever is replayed."""
    return table(spark, d, "documents").groupBy(F.md5("text").alias("identity")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("occurrences"))


@query("span_binding", """
WITH u AS (SELECT conv_id, turn, CAST(sum(length(text)) OVER w - length(text) AS BIGINT) AS a, CAST(sum(length(text)) OVER w AS BIGINT) AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
c AS (SELECT conv_id, g AS chunk, g * 300 AS a, least((g + 1) * 300, n) AS b FROM (SELECT conv_id, sum(length(text)) AS n FROM conversations GROUP BY conv_id), generate_series(0, 2000) t(g) WHERE g * 300 < n)
SELECT u.conv_id, u.turn, CAST(c.chunk AS BIGINT) AS chunk, CAST(greatest(u.a, c.a) AS BIGINT) AS s, CAST(least(u.b, c.b) AS BIGINT) AS e FROM u JOIN c ON c.conv_id = u.conv_id AND u.a < c.b AND c.a < u.b WHERE u.b > u.a""")
def span_binding(spark: SparkSession, d: str) -> DataFrame:
    """Chunks bound to the units whose characters they hold."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    n = F.char_length("text").cast("bigint")
    u = table(spark, d, "conversations").select("conv_id", "turn", (F.sum(n).over(w) - n).alias("ua"), F.sum(n).over(w).alias("ub"))
    total = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(n).alias("n")).filter("n > 0")
    c = total.select("conv_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / 300))).alias("chunk"))
    c = c.select("conv_id", "chunk", (F.col("chunk") * 300).alias("ca"), F.least((F.col("chunk") + 1) * 300, F.col("n")).alias("cb"))
    met = temporal.overlap_join(u, c, "conv_id", ("ua", "ub"), ("ca", "cb"), 300)
    return met.select("conv_id", "turn", "chunk", F.greatest("ua", "ca").alias("s"), F.least("ub", "cb").alias("e"))


@query("revision_projection", """
WITH r AS (SELECT user_id AS k, event_id AS rev, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS earlier, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL AS latest FROM events WHERE event_type = 'signup')
SELECT k, rev, earlier, latest FROM r""")
def revision_projection(spark: SparkSession, d: str) -> DataFrame:
    """Revisions with the one that each replaces."""
    w = Window.partitionBy("k").orderBy("rev")
    return table(spark, d, "events").filter("event_type = 'signup'").select(F.col("user_id").alias("k"), F.col("event_id").alias("rev")).select("k", "rev", F.lag("rev").over(w).alias("earlier"), F.lead("rev").over(w).isNull().alias("latest"))


@query("typed_envelopes", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.missing') IS NULL AS lacks FROM events")
def typed_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """JSON envelopes under a declared schema."""
    p = F.from_json("props", "k bigint, missing string")
    return table(spark, d, "events").select("event_id", p["k"].alias("k"), p["missing"].isNull().alias("lacks"))


@query("population_typing", """
SELECT 'duplicate_key' AS fault, count(*) AS n FROM (SELECT conv_id, turn FROM conversations GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'unknown_role', count(*) FILTER (WHERE role NOT IN ('user', 'assistant', 'system')) FROM conversations UNION ALL SELECT 'missing_text', count(*) FILTER (WHERE text IS NULL) FROM conversations""")
def population_typing(spark: SparkSession, d: str) -> DataFrame:
    """Checks of a population's keys, closed sets and nulls."""
    c = table(spark, d, "conversations")
    keys = c.groupBy("conv_id", "turn").count().filter("count > 1").agg(F.lit("duplicate_key").alias("fault"), F.count("*").alias("n"))
    both = c.agg(F.count_if(~F.col("role").isin("user", "assistant", "system")).alias("unknown_role"), F.count_if(F.col("text").isNull()).alias("missing_text"))
    return keys.unionByName(both.unpivot([], ["unknown_role", "missing_text"], "fault", "n"))


@query("fold_commit", """
WITH c AS (SELECT conv_id, turn, octet_length(encode(text)) AS n, sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn) AS hi FROM conversations),
k AS (SELECT conv_id, turn, hi - n AS lo, hi FROM c WHERE n > 0 AND NOT (conv_id % 5 = 0 AND turn = 1)),
j AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY conv_id ORDER BY turn), 0) = lo AS joined, NOT (conv_id % 7 = 0 AND turn = 2) AS sound FROM k)
SELECT conv_id, bool_and(joined) AND bool_and(sound) AS commit, CASE WHEN NOT bool_and(joined) THEN 'gap' WHEN NOT bool_and(sound) THEN 'hash' END AS reason,
       CAST(CASE WHEN bool_and(joined) AND bool_and(sound) THEN max(hi) ELSE 0 END AS BIGINT) AS "cursor" FROM j GROUP BY conv_id""")
def fold_commit(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes are committed when they are contiguous and hold what their digests say, and move the cursor."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.encode("text", "utf-8").alias("data")).filter(F.length("data") > 0)
    end = F.sum(F.length("data").cast("long")).over(Window.partitionBy("conv_id").orderBy("turn"))
    c = c.withColumn("end", end).withColumn("start", F.col("end") - F.length("data"))
    spoiled = F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 2), "").otherwise(F.sha2("data", 256))
    outcomes = c.filter("NOT (conv_id % 5 = 0 AND turn = 1)").withColumn("sha256", spoiled)
    return framing.fold_commit(outcomes, "conv_id")


#: Parts of a batch of complete input at most.
PARTS = 8


def part_batch(df: DataFrame, order: list[str], after: tuple, n: int = PARTS) -> DataFrame:
    """The next parts of complete input behind a key, PARTS at most."""
    if not 1 <= n <= PARTS:
        raise ValueError(f"a batch has 1 to {PARTS} parts")
    return keyset_page(df, order, after, None, n)
