"""Provenance beside results: every output row's sources, as a table of its own and never as an array that grows with a group.

A traced table is a pair: rows with a unique long `row_ref`, and witnesses (row_ref, relation, key, side, multiplicity).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WITNESS = ("row_ref", "relation", "key", "side", "multiplicity")


@dataclass
class Traced:
    """Rows, and the witnesses of each row_ref."""

    rows: DataFrame
    witnesses: DataFrame


def reference(*parts: Column) -> Column:
    """A row's reference from what identifies it; the same wherever and whenever it is computed."""
    return F.xxhash64(*parts)


def scan(df: DataFrame, relation: str, keys: list[str]) -> Traced:
    """V1: a row's witness is its relation and key."""
    rows = df.withColumn("row_ref", reference(F.lit(relation), *keys))
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return Traced(rows, rows.select("row_ref", F.lit(relation).alias("relation"), key.alias("key"), F.lit("self").alias("side"), F.lit(1).cast("bigint").alias("multiplicity")))


def where(t: Traced, keep: Column) -> Traced:
    """V4: rows that pass keep their witnesses."""
    rows = t.rows.filter(keep)
    return Traced(rows, t.witnesses.join(rows.select("row_ref"), "row_ref", "left_semi"))


def tested(t: Traced, predicate: Column) -> DataFrame:
    """Each tested row with the predicate's truth, null included."""
    return t.rows.select("row_ref", predicate.alias("truth"))


def join(left: Traced, right: Traced, on: list[str], how: str = "inner") -> Traced:
    """V3: both sides' witnesses; an absent side has none."""
    a = left.rows.withColumnRenamed("row_ref", "_l")
    b = right.rows.withColumnRenamed("row_ref", "_r")
    rows = a.join(b, on, how).withColumn("row_ref", reference(F.lit("join"), "_l", "_r"))
    links = rows.select("row_ref", "_l", "_r")

    def side(w: DataFrame, ref: str, name: str) -> DataFrame:
        own = w.withColumnRenamed("row_ref", ref)
        return links.filter(F.col(ref).isNotNull()).join(own, ref).select("row_ref", "relation", "key", F.lit(name).alias("side"), "multiplicity")

    return Traced(rows.drop("_l", "_r"), side(left.witnesses, "_l", "left").unionByName(side(right.witnesses, "_r", "right")))


def group(t: Traced, keys: list[str], aggregates: list[Column], having: Column | None = None) -> tuple[Traced, DataFrame]:
    """V7: members with multiplicity; also the truth of HAVING for each group, rejected ones included."""
    ref = reference(F.lit("group"), *keys)
    groups = t.rows.groupBy(*keys).agg(*aggregates).withColumn("row_ref", ref)
    truth = groups.select("row_ref", (having if having is not None else F.lit(True)).alias("truth"))
    rows = groups.filter(having) if having is not None else groups
    members = t.rows.select(F.col("row_ref").alias("_m"), ref.alias("row_ref"))
    found = members.join(t.witnesses.withColumnRenamed("row_ref", "_m"), "_m").groupBy("row_ref", "relation", "key", F.lit("member").alias("side")).agg(F.sum("multiplicity").alias("multiplicity"))
    return Traced(rows, found.join(rows.select("row_ref"), "row_ref", "left_semi").select(*WITNESS)), truth


def set_classes(left: DataFrame, right: DataFrame) -> DataFrame:
    """V8: for each class of equal rows how often each branch has it; nulls are equal."""
    columns = left.columns
    a = left.select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
    b = right.toDF(*columns).select(*columns, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    return a.unionByName(b).groupBy(*columns).agg(F.sum("_l").alias("left_n"), F.sum("_r").alias("right_n"))


def window_spans(df: DataFrame, partition: list[str], order: list[Column], before: int, after: int) -> DataFrame:
    """V9: a row's ordinal, its peers' span and its frame's span, as ordinals and not as lists of members."""
    w = Window.partitionBy(*partition).orderBy(*order)
    size = F.count("*").over(Window.partitionBy(*partition))
    rn, rank = F.row_number().over(w), F.rank().over(w)
    out = df.withColumns({"ordinal": rn, "_rank": rank, "_n": size})
    peers = F.count("*").over(Window.partitionBy(*partition, "_rank"))
    out = out.withColumns({"peer_from": F.col("_rank"), "peer_to": F.col("_rank") + peers - 1})
    return out.withColumns({"frame_from": F.greatest(F.lit(1), F.col("ordinal") - before), "frame_to": F.least(F.col("_n"), F.col("ordinal") + after)}).drop("_rank", "_n")


def exists_bag(outer: DataFrame, inner: DataFrame, on: list[str]) -> DataFrame:
    """V5, V6: for each outer row the number of inner matches; 0 is a searched absence."""
    counts = inner.groupBy(*on).agg(F.count("*").alias("matches"))
    return outer.join(counts, on, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))


def project(t: Traced, columns: list[Column | str]) -> Traced:
    """V2: chosen columns; every row keeps its witnesses, and no row is lost or made."""
    return Traced(t.rows.select("row_ref", *columns), t.witnesses)


def scalar(outer: DataFrame, inner: DataFrame, on: list[str], column: str) -> DataFrame:
    """V6: for each outer row the inner value and the number of inner rows; more than one is an error."""
    found = inner.groupBy(*on).agg(F.count("*").alias("matches"), F.first(column).alias(column))
    joined = outer.join(found, on, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return joined.withColumn(column, F.when(F.col("matches") > 1, F.raise_error(F.lit("more than one row in a scalar subquery"))).otherwise(F.col(column)))


def walk_steps(paths: DataFrame) -> DataFrame:
    """For walked rows (node, depth, path, is_cycle) each step as a witness: row_ref, step, visit, kind, node, is_cycle.

    kind is `seed` for a path's first node and `step` behind it; is_cycle flags the step that came back. Equal paths, which a
    bag may hold, are told apart by `copies`.
    """
    same = paths.groupBy("path", "depth", "is_cycle").agg(F.count("*").alias("copies"))
    rows = same.withColumn("row_ref", reference(F.lit("walk"), F.col("path")))
    steps = rows.select("row_ref", "copies", "depth", F.col("is_cycle").alias("_cycle"), F.posexplode("path").alias("visit", "node"))
    return steps.select("row_ref", "visit", F.when(F.col("visit") == 0, "seed").otherwise("step").alias("kind"), "node", (F.col("_cycle") & (F.col("visit") == F.col("depth"))).alias("is_cycle"), "copies")


def limited(n_rows: int, limit: int | None, offset: int | None, order: list[tuple[str, bool, bool]]) -> dict:
    """What a limit was, what it ordered by, and what decided between rows that the order leaves equal."""
    keys = [{"column": c, "direction": "asc" if up else "desc", "nulls": "first" if first else "last"} for c, up, first in order]
    return {"op": "limit", "limit": limit, "offset": offset or 0, "order": keys, "tie_basis": "witness_ordinal", "rows": n_rows}


#: The operations that a published provenance may name.
OPERATIONS = ("scan", "filter", "project", "join", "group", "distinct", "exists", "set", "window", "recursion", "limit")


def published(t: Traced, operations: list[str]) -> DataFrame:
    """For each row (row_ref) its provenance as JSON: the operations in order, and how many sources of each relation and side.

    Sources are counted by relation and side, and named by one digest of their keys in order, so that no row's JSON grows
    with its sources.
    """
    if unknown := [o for o in operations if o not in OPERATIONS]:
        raise ValueError(f"no such operation: {unknown[0]}")
    # digests of keys add up in any order: no task gathers a group's keys
    h = F.conv(F.substring(F.sha2("key", 256), 1, 8), 16, 10).cast("decimal(38,0)") * F.col("multiplicity")
    sums = t.witnesses.groupBy("row_ref", "relation", "side").agg(F.sum("multiplicity").alias("n"), F.sum(h).cast("string").alias("keys"))
    sources = F.sort_array(F.collect_list(F.struct("relation", "side", "n", F.sha2("keys", 256).alias("keys"))))
    got = sums.groupBy("row_ref").agg(sources.alias("sources"))
    whole = t.rows.select("row_ref").join(got, "row_ref", "left")
    empty = F.array().cast("array<struct<relation:string,side:string,n:bigint,keys:string>>")
    listed = F.array(*[F.struct(F.lit(o).alias("op")) for o in operations])
    return whole.select("row_ref", F.to_json(F.struct(listed.alias("operations"), F.coalesce("sources", empty).alias("sources"))).alias("provenance"))
