"""Contexts: what a reader sees, what is hidden from it, and where a conclusion belongs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible(facts: DataFrame, up: DataFrame, view: str) -> DataFrame:
    """Facts (ctx, ...) of the contexts that `view` sees; up (a, b): a sees b, reflexive."""
    seen = up.where(F.col("a") == view).select(F.col("b").alias("ctx"))
    return facts.join(seen, "ctx", "left_semi")


def readers(facts: DataFrame, up: DataFrame) -> DataFrame:
    """Facts with each reader that sees them, as column `view`."""
    return facts.join(up.select(F.col("a").alias("view"), F.col("b").alias("ctx")), "ctx")


def hidden(excepts: DataFrame, up: DataFrame) -> DataFrame:
    """(view, sid): an exception (sid, ctx) hides the fact from ctx and all that see ctx."""
    return excepts.join(up.select(F.col("a").alias("view"), F.col("b").alias("ctx")), "ctx").select("view", "sid").distinct()


def without_excepted(seen: DataFrame, excepts: DataFrame, up: DataFrame) -> DataFrame:
    """readers() rows (view, sid, ...) but for those that are excepted for the reader."""
    return seen.join(hidden(excepts, up), ["view", "sid"], "left_anti")


def placement(grounds: DataFrame, up: DataFrame) -> DataFrame:
    """(firing, ctx): the most general contexts that see all grounds (firing, ctx) of a firing; none gives no row.

    Contexts that see each other are one place, under the least of their names.
    """
    grounds = grounds.select("firing", "ctx").distinct()
    n = grounds.groupBy("firing").agg(F.count("*").alias("n"))
    sees = up.select(F.col("a").alias("place"), F.col("b").alias("ctx"))
    common = grounds.join(sees, "ctx").groupBy("firing", "place").agg(F.count("*").alias("seen")).join(n, "firing").where("seen = n").select("firing", "place")
    back = up.select(F.col("a").alias("b"), F.col("b").alias("a"))
    strict = up.join(back, ["a", "b"], "left_anti").select(F.col("a").alias("place"), F.col("b").alias("above"))
    over = common.join(strict, "place").join(common.withColumnRenamed("place", "above"), ["firing", "above"]).select("firing", "place").distinct()
    names = up.join(back, ["a", "b"]).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("ctx"))
    return common.join(over, ["firing", "place"], "left_anti").join(names, F.col("place") == names["a"]).select("firing", "ctx").distinct()


def lifted(facts: DataFrame, where: str) -> DataFrame:
    """Facts of a decontextualised predicate, stated in one context for all readers."""
    return facts.withColumn("ctx", F.lit(where)).distinct()


def exactly(facts: DataFrame, ctx: str, mirror: tuple[str, str] | None = None) -> DataFrame:
    """Facts stated in one context itself, nothing inherited; `mirror` names the columns of a symmetric predicate, which hold both ways."""
    own = facts.where(F.col("ctx") == ctx)
    if mirror is None:
        return own
    a, b = mirror
    return own.union(own.select(*(F.col({a: b, b: a}.get(c, c)).alias(c) for c in own.columns))).distinct()


def function_edges(terms: DataFrame, up: DataFrame) -> DataFrame:
    """(a, b): contexts named by functional terms (ctx, function, arg) see those of the same function whose argument is above theirs; up (a, b) is reflexive."""
    low = terms.select(F.col("ctx").alias("low"), "function", F.col("arg").alias("a"))
    high = terms.select(F.col("ctx").alias("high"), "function", F.col("arg").alias("b"))
    return low.join(up, "a").join(high, ["function", "b"]).where("low <> high").select(F.col("low").alias("a"), F.col("high").alias("b")).distinct()


def projected(attitudes: DataFrame, prefix: str = "CxAgent") -> DataFrame:
    """What an agent holds (agent, ...) as facts of the agent's own context: (ctx, ...)."""
    return attitudes.select(F.concat(F.lit(prefix), F.col("agent").cast("string")).alias("ctx"), *(c for c in attitudes.columns if c != "agent")).distinct()
