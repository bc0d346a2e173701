"""Graph kernels over an edge table with columns src and dst (and any others).

All run as joins whose inputs shrink with the frontier; nothing but an emptiness test comes to
the driver, so the edge table may be as large as the cluster holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut, wide

#: The most levels a closure follows and the most edges of a listed chain.
MAX_LEVELS, MAX_CHAIN = 30, 20


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "__dst", "dst": "src"}).withColumnRenamed("__dst", "dst")


def neighbours(edges: DataFrame, nodes: DataFrame, incoming: bool = False) -> DataFrame:
    """Edges that leave (or enter) the nodes; nodes has a column `node`."""
    side = "dst" if incoming else "src"
    return edges.join(nodes.select(F.col("node").alias(side)).distinct(), side, "left_semi")


def degrees(edges: DataFrame, incoming: bool = True) -> DataFrame:
    """node and n, its number of distinct neighbours."""
    node, other = ("dst", "src") if incoming else ("src", "dst")
    return edges.groupBy(F.col(node).alias("node")).agg(F.countDistinct(other).alias("n"))


def closure(edges: DataFrame, seeds: DataFrame, incoming: bool = False, max_levels: int = MAX_LEVELS, stop: DataFrame | None = None) -> DataFrame:
    """node and depth (fewest edges from a seed) of all that can be reached. seeds: column `node`.

    Each level joins only the newest nodes, so the edge table is scanned once a level and only what the
    frontier touches is shuffled; repeated edges do no harm. Nodes in `stop` are reached but not passed.
    Cycles end because a visited node is never new."""
    steps = (reverse(edges) if incoming else edges).select("src", "dst")
    visited = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = visited = cut(visited)
    for depth in range(1, max_levels + 1):
        onward = frontier if stop is None else frontier.join(stop.select("node").distinct(), "node", "left_anti")
        reached = steps.join(onward.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(reached.join(visited, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = cut(visited.unionByName(frontier))
    return visited


def witnesses(edges: DataFrame, seeds: DataFrame, max_levels: int = MAX_LEVELS) -> DataFrame:
    """node and path (array, from its seed's path to the node) of all that can be reached: one of the fewest edges, the
    least by names of several. seeds: node, path. A node keeps one path, so the table grows with nodes, not with paths."""
    steps = edges.select("src", "dst")
    frontier = visited = cut(seeds.groupBy("node").agg(F.min_by("path", F.struct(F.size("path"), "path")).alias("path")))
    for _ in range(max_levels):
        grown = steps.join(wide(frontier.withColumnRenamed("node", "src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("path").alias("path"))
        frontier = cut(grown.join(wide(visited), "node", "left_anti").select("node", F.array_append("path", F.col("node")).alias("path")))
        if frontier.isEmpty():
            break
        visited = cut(visited.unionByName(frontier))
    return visited


PRUNE_AT = 10_000  # open paths from which on a search for ends looks where ends can be reached at all


def leading_to_ends(steps: DataFrame, ends: DataFrame, max_levels: int = MAX_LEVELS) -> DataFrame:
    """node: from which some end can be reached over steps (src, dst), the ends themselves included."""
    return closure(steps, ends, incoming=True, max_levels=max_levels).select("node")


def simple_paths(edges: DataFrame, starts: DataFrame, incoming: bool = False, max_edges: int = MAX_CHAIN, stop: DataFrame | None = None, only_ended: bool = False, first: int | None = None) -> DataFrame:
    """path (array of nodes from a start) and is_end for every simple path of 1 to max_edges edges.

    is_end: the path cannot go on, by lack of an edge or because it stands on a node of `stop`.
    Work grows with the number of paths, which is the result; bound max_edges for dense graphs. With only_ended, paths
    that are ends are all that is asked for: once PRUNE_AT paths are open, those are dropped that stand where no end can
    be reached, as in a cycle that nothing enters, and none is grown into such a place. With `first`, no longer paths are
    grown once so many ends are found."""
    steps = cut((reverse(edges) if incoming else edges).select("src", "dst").distinct())
    open_paths = starts.select(F.array("node").alias("path"))
    sources = steps.select("src").distinct()
    if stop is not None:
        sources = sources.join(stop.select(F.col("node").alias("src")), "src", "left_anti")
    found, ended, pruned = None, 0, not only_ended
    for _ in range(max_edges):
        head = F.element_at("path", -1)
        grown = open_paths.withColumn("src", head).join(steps, "src").where(~F.array_contains("path", F.col("dst")))
        grown = grown.select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("src"))
        grown = cut(grown.join(sources.withColumn("__goes", F.lit(True)), "src", "left").select("path", F.col("__goes").isNull().alias("is_end")))
        sizes = grown.agg(F.count("*").alias("n"), F.count_if(F.col("is_end")).alias("ended")).first()
        if not sizes["n"]:
            break
        kept = grown.where("is_end") if only_ended else grown
        found = kept if found is None else found.unionByName(kept)
        ended += sizes["ended"]
        if first is not None and ended >= first:
            break
        open_paths = grown.where("NOT is_end").select("path")
        if not pruned and sizes["n"] - sizes["ended"] > PRUNE_AT:
            pruned = True
            nodes = steps.select(F.col("src").alias("node")).union(steps.select("dst")).distinct()
            useful = cut(leading_to_ends(steps, nodes.join(sources.withColumnRenamed("src", "node"), "node", "left_anti"), max_edges))
            steps = cut(steps.join(useful.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
            open_paths = open_paths.withColumn("node", F.element_at("path", -1)).join(useful, "node", "left_semi").select("path")
    return found if found is not None else starts.select(F.array("node").alias("path"), F.lit(True).alias("is_end")).limit(0)


def first_paths(edges: DataFrame, starts: DataFrame, max_edges: int) -> DataFrame:
    """node, caller and path (array of line and node, the start first) of every node that a walk of at most max_edges
    edges reaches, by the first such path in the order of lines, then names.

    That is the path by which a depth-first walk in that order meets the node. Only nodes whose path became
    smaller in a round go on in the next; a path around a cycle is longer than its own beginning, so never smaller."""
    steps = edges.select("src", F.struct("line", F.col("dst").alias("node")).alias("__step")).distinct()
    best = frontier = cut(starts.select("node").distinct().select("node", F.lit(None).cast("string").alias("caller"), F.array(F.struct(F.lit(0).cast(edges.schema["line"].dataType).alias("line"), "node")).alias("path")))
    for _ in range(max_edges):
        grown = frontier.select(F.col("node").alias("src"), "path").join(steps, "src").select(F.col("__step.node").alias("node"), F.col("src").alias("caller"), F.array_append("path", F.col("__step")).alias("path"))
        least = grown.groupBy("node").agg(F.min_by(F.struct("caller", "path"), "path").alias("__new"))
        both = best.withColumn("__old", F.struct("caller", "path")).select("node", "__old").join(least, "node", "full")
        better = F.col("__old").isNull() | (F.col("__new.path") < F.col("__old.path"))
        now = cut(both.select("node", F.coalesce(better, F.lit(False)).alias("__moved"), F.when(better, F.col("__new")).otherwise(F.col("__old")).alias("__best")))
        best, frontier = now.select("node", "__best.*"), now.where("__moved").select("node", "__best.*")
        if frontier.isEmpty():
            break
    return best


def chains_to_roots(edges: DataFrame, targets: DataFrame, max_edges: int = MAX_CHAIN, stop: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """Chains from a root (nothing enters it) or stop node to a target: chain (array, root first) and depth (edges); all,
    or the `first` by depth, then names."""
    ended = simple_paths(edges, targets, incoming=True, max_edges=max_edges, stop=stop, only_ended=True, first=first).where("is_end")
    chains = ended.select(F.reverse("path").alias("chain"), (F.size("path") - 1).alias("depth")).distinct()
    return chains if first is None else chains.orderBy("depth", "chain").limit(first)


def two_cycles(edges: DataFrame) -> DataFrame:
    """Unordered pairs a < b with edges both ways."""
    pairs = edges.select("src", "dst").where("src <> dst").distinct()
    low = pairs.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return low.join(pairs.where("src > dst").select(F.col("dst").alias("a"), F.col("src").alias("b")), ["a", "b"], "left_semi")


def roots(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes that no edge enters; a loop to itself does not count as one that enters."""
    entered = edges.where("src <> dst").select(F.col("dst").alias("node")).distinct()
    return nodes.join(entered, "node", "left_anti")


def chain_depth(parents: DataFrame, max_levels: int = MAX_LEVELS) -> DataFrame:
    """node and depth: how many parents can be followed upwards. parents: node, parent; a node has one
    parent at most. A cycle ends at max_levels."""
    up = cut(parents.select("node", "parent"))
    at = up.select("node", F.col("parent").alias("top"), F.lit(1).alias("depth"))
    step = up.select(F.col("node").alias("top"), F.col("parent").alias("__next"))
    for _ in range(max_levels - 1):
        now = at.join(step, "top", "left")
        if now.where("__next IS NOT NULL").isEmpty():
            break
        at = cut(now.select("node", F.coalesce("__next", "top").alias("top"), (F.col("depth") + F.col("__next").isNotNull().cast("int")).alias("depth")))
    return at.select("node", "depth")


def risk(count, low: int, medium: int):
    """none, low (up to `low`), medium (up to `medium`) or high."""
    n = F.col(count) if isinstance(count, str) else count
    return F.when(n == 0, "none").when(n <= low, "low").when(n <= medium, "medium").otherwise("high")
