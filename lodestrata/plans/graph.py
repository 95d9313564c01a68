"""Bounded path walks and closures over edge tables, as loops of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored


def walk_paths(edges: DataFrame, anchors: DataFrame, max_depth: int, reverse: bool = False) -> DataFrame:
    """All paths from the anchors (node) along edges (src, dst): node, depth, path, is_cycle.

    Bags: parallel edges and repeated anchors keep their multiplicity. A row whose node is on its own path already is flagged
    and not walked on. Depth is 0 for anchors and at most max_depth, 1 to 8.
    """
    if not 1 <= max_depth <= 8:
        raise ValueError("max_depth must be from 1 to 8")
    src, dst = ("dst", "src") if reverse else ("src", "dst")
    steps = stored(edges.select(F.col(src).alias("_from"), F.col(dst).alias("_to")))
    level = anchors.select("node", F.lit(0).alias("depth"), F.array("node").alias("path"), F.lit(False).alias("is_cycle"))
    out = level
    for depth in range(1, max_depth + 1):
        level = level.filter("not is_cycle").join(steps, F.col("node") == F.col("_from"))
        # written, so that no level's plan holds those before it
        level = level.select(F.col("_to").alias("node"), F.lit(depth).alias("depth"), F.concat("path", F.array("_to")).alias("path"), F.array_contains("path", F.col("_to")).alias("is_cycle"))
        level = stored(level)
        out = out.unionByName(level)
    return out


def closure(edges: DataFrame, starts: DataFrame | None = None, most_rounds: int = 64) -> DataFrame:
    """Reachable pairs (a, b) by one or more edges, from every node or from the starts (a); a fixpoint over distinct pairs.

    Each round extends only the pairs that the round before found, and ends when none are new. From every node they are
    extended by all pairs found so far, so that the length covered doubles each round; from given starts by single edges.
    """
    steps = stored(edges.select("src", "dst").distinct())
    new = steps.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    if starts is not None:
        new = new.join(starts.select("a").distinct(), "a", "left_semi")
    new = found = stored(new)
    for _ in range(most_rounds):
        ahead = (found if starts is None else steps).toDF("src", "dst")
        new = stored(new.join(ahead, new.b == ahead.src).select("a", F.col("dst").alias("b")).distinct().join(found, ["a", "b"], "left_anti"))
        if new.isEmpty():
            return found
        found = stored(found.unionByName(new))
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")


def mutual_components(edges: DataFrame) -> DataFrame:
    """Nodes that are joined by edges both ways, in chains of any length: node, label (the least node of its component).

    Labels spread and pointers jump, so that rounds are few; such a component is part of a strongly connected one.
    """
    both = edges.filter("src <> dst").select("src", "dst").distinct()
    both = stored(both.join(both.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi"))
    labels = stored(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("at"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        after = stored(least.join(jump, "at").select("node", F.least("at", "far").alias("now"), "label"))
        labels = after.select("node", F.col("now").alias("label"))
        if after.filter("now < label").isEmpty():
            return labels


def bottom_roots(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each node the roots (node, root): the least nodes of the strongly connected components at the bottom of what it reaches.

    A component is at the bottom if all that it reaches reaches back. A node without edges out is its own root. Nodes that
    edges join both ways are one node to the closure, so that only what is left of the graph is paired.
    """
    all_nodes = nodes.select("node").unionByName(edges.select(F.col("src").alias("node"))).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    named = stored(all_nodes.join(mutual_components(edges), "node", "left").select("node", F.coalesce("label", "node").alias("n")))
    src, dst = (named.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}")) for x in ("src", "dst"))
    reach = closure(edges.join(src, "src").join(dst, "dst").filter("n_src <> n_dst").select(F.col("n_src").alias("src"), F.col("n_dst").alias("dst")))
    back = reach.select(F.col("a").alias("b"), F.col("b").alias("a"))
    one_way = reach.join(back, ["a", "b"], "left_anti").filter("a <> b").select(F.col("a").alias("n")).distinct()
    parts = named.select("n").distinct()
    peers = reach.join(back, ["a", "b"], "left_semi").groupBy(F.col("a").alias("n")).agg(F.min("b").alias("peer"))
    roots = stored(parts.join(one_way, "n", "left_anti").join(peers, "n", "left").select(F.col("n").alias("b"), F.least("n", F.coalesce("peer", "n")).alias("root")))
    reached = reach.unionByName(parts.select(F.col("n").alias("a"), F.col("n").alias("b"))).distinct()
    of_part = reached.join(roots, "b").select(F.col("a").alias("n"), "root").distinct()
    return named.join(of_part, "n").select("node", "root").join(nodes.select("node").distinct(), "node", "left_semi")


def resolve(redirects: DataFrame, nodes: DataFrame, most_hops: int | None = 16) -> DataFrame:
    """Each node with where its redirects (node, target; one for each node) end: node, resolved, hops, is_cycle.

    Pointers double: after round k a pointer has gone 2^k hops, so that few joins follow chains of any length. resolved is null
    on a cycle, which alone is flagged, and after more than most_hops hops, which `hops` then tells.
    """
    jump = stored(redirects.select("node", "target").dropna())
    everyone = nodes.select("node").unionByName(jump.select("node")).unionByName(jump.select(F.col("target").alias("node"))).distinct()
    # open after k rounds: 2^k hops or more from the end. While a chain is open, its node at just 2^k hops is closed by the
    # next round; a round that closes none leaves only nodes that never end.
    there = F.col("target").isNotNull()
    state = stored(everyone.join(jump, "node", "left").select("node", F.coalesce("target", "node").alias("at"), there.cast("bigint").alias("hops"), there.alias("open")))
    left = state.filter("open").count()
    while left:
        ahead = state.select(F.col("node").alias("_n"), F.col("at").alias("_at"), F.col("hops").alias("_h"), F.col("open").alias("_open"))
        state = stored(state.join(ahead, state.at == F.col("_n")).select("node", F.col("_at").alias("at"), (F.col("hops") + F.col("_h")).alias("hops"), F.col("_open").alias("open")))
        before, left = left, state.filter("open").count()
        if left == before:
            break
    done = state.join(nodes.select("node").distinct(), "node", "left_semi")
    ends = ~F.col("open")
    near = ends if most_hops is None else ends & (F.col("hops") <= most_hops)
    return done.select("node", F.when(near, F.col("at")).alias("resolved"), F.when(ends, F.col("hops")).alias("hops"), F.col("open").alias("is_cycle"))
