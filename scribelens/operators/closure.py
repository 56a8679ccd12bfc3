"""Transitive closure of a directed graph, of its pairs or of its strongly connected classes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribelens.functions.layout import stored
from scribelens.session import cut_lineage

GROWTH = 64  # pairs per edge beyond which cycles are looked for


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (src, dst); a component's id is its smallest node.

    Every node is coloured by the first node, in a random order, among those that reach it, and
    by the first among those it reaches. Where both colours are the same node, that node and all
    of that colour reach each other: a component. It is taken out, edges between nodes of
    different colours cannot lie on a cycle and go, and what is left is coloured anew. Colours
    spread along edges and, as a node's colour reaches the node, are replaced by their colour's
    colour; so rounds grow with the logarithm of the longest path, not with its length.
    """
    pairs = edges.select("src", "dst").distinct()
    nodes = stored(pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct(), "nodes")
    active = stored(pairs.where("src <> dst"), "arcs")
    found: list[DataFrame] = []
    while not active.isEmpty():
        colours = _coloured(active)
        both = colours.groupBy("node").pivot("back", [False, True]).agg(F.first("colour")).toDF("node", "fore", "aft")
        both = stored(both, "colours")
        found.append(both.where("fore = aft").select("node", F.col("fore.node").alias("_root")))
        left = both.where("fore <> aft")
        head = left.select(F.col("node").alias("src"), F.col("fore").alias("_f"), F.col("aft").alias("_a"))
        tail = left.select(F.col("node").alias("dst"), F.col("fore").alias("_f"), F.col("aft").alias("_a"))
        within = active.join(head, "src").join(tail, ["dst", "_f", "_a"]).select("src", "dst")
        active = stored(within, "arcs")
    if not found:
        return nodes.select("node", F.col("node").alias("component"))
    roots = reduce(DataFrame.unionByName, found)
    smallest = roots.groupBy("_root").agg(F.min("node").alias("component"))
    named = roots.join(smallest, "_root").select("node", "component")
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _colour(node: str) -> Column:
    """A node with its place in a random order before it."""
    return F.struct(F.xxhash64(node).alias("place"), F.col(node).alias("node"))


def _coloured(arcs: DataFrame) -> DataFrame:
    """(back, node, colour): the first node that reaches a node, or with ``back`` that it reaches."""
    ways = arcs.select(F.lit(False).alias("back"), F.col("src").alias("from"), F.col("dst").alias("node")).unionByName(
        arcs.select(F.lit(True).alias("back"), F.col("dst").alias("from"), F.col("src").alias("node"))
    )
    ways = stored(ways, "ways")
    now = ways.select("back", "node").union(ways.select("back", "from")).distinct()
    now = stored(now.withColumn("colour", _colour("node")), "colours")
    while True:
        spread = now.withColumnRenamed("node", "from").join(ways, ["back", "from"]).select("back", "node", "colour")
        nearer = stored(now.unionByName(spread).groupBy("back", "node").agg(F.min("colour").alias("colour")), "colours")
        jump = nearer.select("back", F.col("node").alias("_at"), F.col("colour").alias("_far"))
        jumped = nearer.withColumn("_at", F.col("colour.node")).join(jump, ["back", "_at"])
        after = stored(jumped.select("back", "node", F.least("colour", "_far").alias("colour")), "colours")
        before = now.select("back", "node", F.col("colour").alias("_before"))
        if after.join(before, ["back", "node"]).where("colour <> _before").isEmpty():
            return after
        now = after


@dataclass(frozen=True)
class Closure:
    """The closure by classes: ``members`` (node, component), and ``reach`` (src, dst) of components.

    A component reaches itself if it holds a cycle. A class of n nodes is n rows, not n squared.
    """

    members: DataFrame
    reach: DataFrame

    def pairs(self) -> DataFrame:
        """All (src, dst) of nodes."""
        start = self.members.select(F.col("node").alias("src"), F.col("component").alias("_c"))
        end = self.members.select(F.col("node").alias("dst"), F.col("component").alias("_d"))
        reach = self.reach.select(F.col("src").alias("_c"), F.col("dst").alias("_d"))
        return start.join(reach, "_c").join(end, "_d").select("src", "dst")


def condensed_closure(edges: DataFrame) -> Closure:
    """Strongly connected components first, then the closure of the graph of components."""
    members = stored(strong_components(edges), "members")
    start = members.select(F.col("node").alias("src"), F.col("component").alias("_c"))
    end = members.select(F.col("node").alias("dst"), F.col("component").alias("_d"))
    arcs = edges.select("src", "dst").join(start, "src").join(end, "dst").select(F.col("_c").alias("src"), F.col("_d").alias("dst"))
    arcs = stored(arcs.distinct(), "arcs")
    between, _ = _doubled(arcs.where("src <> dst"), None)
    return Closure(members, between.unionByName(arcs.where("src = dst")))


def transitive_closure(edges: DataFrame, growth: int = GROWTH) -> DataFrame:
    """All (src, dst) with a path from src to dst. A cycle yields (a, a).

    Pairs are found by doubling. Where they come to more than ``growth`` per edge, cycles may be
    the reason: a class of n nodes that reach each other has n squared pairs, which every further
    round would join again. Then the classes are found and only the graph of classes is closed;
    pairs are formed once, at the end. Use `condensed_closure` where pairs are not needed.
    """
    found, complete = _doubled(edges.select("src", "dst").distinct(), growth)
    return found if complete else condensed_closure(edges).pairs()


def _doubled(edges: DataFrame, growth: int | None) -> tuple[DataFrame, bool]:
    """The pairs of the closure, and whether they are complete: not if there are ``growth`` per edge.

    A path of length d with 2^i < d <= 2^(i+1) is a shortest path of length exactly 2^i
    followed by one of at most 2^i. Keeping the shortest length of every pair therefore
    doubles the reach per round: a graph of depth d takes log2(d) rounds, and each round joins
    only the pairs at exactly the current reach. Every round's new pairs are checkpointed
    once; older rounds are never rewritten.
    """
    found = [cut_lineage(edges.withColumn("d", F.lit(1)))]
    most = None if growth is None else growth * found[0].count()
    pairs, reach = 0, 1
    while True:
        known = reduce(DataFrame.unionByName, found)
        newest = found[-1]
        head = newest.where(F.col("d") == reach).select("src", F.col("dst").alias("mid"))
        tail = known.select(F.col("src").alias("mid"), "dst", "d")
        longer = (
            head.join(tail, "mid")
            .groupBy("src", "dst")
            .agg((F.min("d") + reach).cast("int").alias("d"))
            .join(known.select("src", "dst"), ["src", "dst"], "left_anti")
        )
        fresh = cut_lineage(longer)
        new = fresh.count()
        if not new:
            return known.select("src", "dst"), True
        pairs += new
        if most is not None and pairs > most:
            return known.select("src", "dst"), False
        found.append(fresh)
        reach *= 2


def with_self(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """Closure plus (c, c) for every node of the graph."""
    nodes = edges.select("src").union(edges.select("dst")).distinct()
    return closure.union(nodes.select("src", F.col("src").alias("dst"))).distinct()
