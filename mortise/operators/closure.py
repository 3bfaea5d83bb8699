"""Closures and graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortise.operators.loops import rounds, settled
from mortise.operators.meet import spread


def transitive(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b) for every path of one edge or more; (a, a) only on a cycle.

    Each round joins the new paths with all that are known, on both sides, so lengths double and a
    chain of n edges takes about log2(n) rounds.
    """
    known = delta = settled(edges.select("a", "b").distinct())
    for _ in rounds(most):
        if delta.isEmpty():
            return known
        ahead = delta.join(known.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        behind = known.join(delta.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        delta = settled(ahead.union(behind).distinct().join(known, ["a", "b"], "left_anti"))
        known = known.union(delta)


def reflexive(edges: DataFrame, nodes: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(a, b): b is a or above it; nodes (a) adds nodes without an edge."""
    ends = edges.select("a").union(edges.select("b"))
    ends = ends.union(nodes.select("a")) if nodes is not None else ends
    return transitive(edges, most).union(ends.select("a", F.col("a").alias("b"))).distinct()


def members(instances: DataFrame, up: DataFrame) -> DataFrame:
    """(x, t): x is an instance of t or of a type below it; instances (x, t), up a reflexive closure (a, b)."""
    return instances.join(up, instances["t"] == up["a"]).select("x", F.col("b").alias("t")).distinct()


def mirrored(pairs: DataFrame) -> DataFrame:
    """A symmetric relation: both directions of (a, b)."""
    return spread(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))).distinct()


def components(edges: DataFrame, preferred: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(term, rep) of the equality classes of edges (a, b): the preferred name of a class (least of several), else its least term.

    Large-star and small-star rounds; hubs are aggregated before they are joined.
    """
    now = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in rounds(most):
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen[0] == 0 or seen == mark:
            break
        mark = seen
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        now = settled(large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct())
    classes = now.select(F.col("u").alias("term"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
    if preferred is None:
        return classes.withColumnRenamed("root", "rep")
    names = classes.join(preferred.select("term").distinct(), "term").groupBy("root").agg(F.min("term").alias("name"))
    return classes.join(names, "root", "left").select("term", F.coalesce("name", "root").alias("rep"))


def cycles(up: DataFrame) -> DataFrame:
    """(a, name): mutually reachable nodes share the least of their names; up is a reflexive closure."""
    back = up.select(F.col("a").alias("b"), F.col("b").alias("a"))
    return up.join(back, ["a", "b"]).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("name"))


def widest(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b, s): the strongest route between two nodes, a route being as strong as its weakest edge; edges (a, b, s)."""
    best = delta = settled(edges.groupBy("a", "b").agg(F.max("s").alias("s")))
    for _ in rounds(most):
        if delta.isEmpty():
            return best
        longer = best.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("s").alias("s2"))
        found = delta.join(longer, "b").select("a", F.col("c").alias("b"), F.least("s", "s2").alias("s"))
        found = found.union(best.join(delta.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("s").alias("s2")), "b").select("a", F.col("c").alias("b"), F.least("s", "s2").alias("s"))).groupBy("a", "b").agg(F.max("s").alias("s"))
        old = best.withColumnRenamed("s", "old")
        delta = settled(found.join(old, ["a", "b"], "left").where("old is null or s > old").select("a", "b", "s"))
        best = settled(best.union(delta).groupBy("a", "b").agg(F.max("s").alias("s")))


def separated(declared: DataFrame, up: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(x, y), both orders: types under a declared disjoint pair (a, b), but for excepted pairs."""
    pairs = mirrored(declared)
    if exceptions is not None:
        pairs = pairs.join(mirrored(exceptions), ["a", "b"], "left_anti")
    lo = up.select(F.col("a").alias("x"), F.col("b").alias("a"))
    hi = up.select(F.col("a").alias("y"), F.col("b").alias("b"))
    return pairs.join(lo, "a").join(hi, "b").select("x", "y").distinct()


def clique(group: DataFrame) -> DataFrame:
    """(a, b) of different members of the same group, for groups (g, a) of declared types, which are few."""
    return group.join(group.select("g", F.col("a").alias("b")), "g").where("a <> b").select("a", "b").distinct()


def partners(apart: DataFrame, of: str) -> DataFrame:
    """(y): the types that are separated from one; apart (x, y) in both orders."""
    return apart.where(F.col("x") == of).select("y").distinct()


def witnesses(declared: DataFrame, up: DataFrame, pairs: DataFrame) -> DataFrame:
    """(x, y, a, b): the declared disjoint pairs (a, b) that separate each of pairs (x, y)."""
    lo = up.select(F.col("a").alias("x"), F.col("b").alias("a"))
    hi = up.select(F.col("a").alias("y"), F.col("b").alias("b"))
    return pairs.select("x", "y").join(lo, "x").join(hi, "y").join(mirrored(declared), ["a", "b"]).select("x", "y", "a", "b").distinct()
