"""Terms: minted constants, representatives, inverse and preserved arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def minted(function: str, *args: Column) -> Column:
    """The constant of a functional term or of a head's existential: a hash of its text, the same everywhere."""
    return F.concat(F.lit("nat/"), F.sha2(F.concat_ws(" ", F.lit(function), *(a.cast("string") for a in args)), 256))


def corresponding(rows: DataFrame, values: DataFrame, function: str, key: str, out: str) -> DataFrame:
    """rows with `out`: the stated value of function(key) from values (a1, a2), else the minted constant."""
    stated = values.groupBy(F.col("a1").alias(key)).agg(F.min("a2").alias("_stated"))
    return rows.join(stated, key, "left").withColumn(out, F.coalesce(F.col("_stated").cast("string"), minted(function, F.col(key)))).drop("_stated")


def rewritten(facts: DataFrame, rep: DataFrame, *columns: str) -> DataFrame:
    """Facts with each named column replaced by its representative (term, rep); rows that become equal are one."""
    for c in columns:
        facts = facts.join(rep.select(F.col("term").alias(c), F.col("rep").alias("_rep")), c, "left").withColumn(c, F.coalesce("_rep", c)).drop("_rep")
    return facts.distinct()


def superseded(facts: DataFrame, rep: DataFrame, *columns: str) -> DataFrame:
    """Facts that hold a retired spelling in one of the columns."""
    retired = rep.where("term <> rep").select("term")
    out = None
    for c in columns:
        hit = facts.join(retired.withColumnRenamed("term", c), c, "left_semi").select(*facts.columns)
        out = hit if out is None else out.union(hit)
    return out.distinct()


def inverse(pairs: DataFrame, partner: DataFrame | None = None) -> DataFrame:
    """(a, b) of a predicate with the swapped pairs of its inverse."""
    return pairs.select("a", "b").union((partner if partner is not None else pairs).select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def preserved(claims: DataFrame, up: DataFrame) -> DataFrame:
    """(x, z, truth): claims (x, node, truth, s) carried to all z below their node; up (a, b) is a reflexive closure.

    A claim on a strictly lower node displaces an opposite default claim (s = 1) from above; where
    undisplaced claims still disagree there is no answer.
    """
    carried = claims.join(up.select(F.col("a").alias("z"), F.col("b").alias("node")), "node").select("x", "z", "node", "truth", "s").distinct()
    over = up.where("a <> b").select(F.col("a").alias("lower"), F.col("b").alias("node"))
    lower = carried.select("x", "z", F.col("node").alias("lower"), (~F.col("truth")).alias("truth"))
    displaced = carried.where("s = 1").join(over, "node").join(lower, ["x", "z", "lower", "truth"], "left_semi").select("x", "z", "node", "truth", "s").distinct()
    left = carried.join(displaced, ["x", "z", "node", "truth", "s"], "left_anti")
    return left.groupBy("x", "z").agg(F.bool_and("truth").alias("truth"), F.bool_or("truth").alias("any")).where("truth = any").select("x", "z", "truth")


def merged(facts: DataFrame, rep: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(restated, retired): a merge restates facts with a retired spelling under its representative, and retires the old rows.

    What is quoted is left alone: name only the columns that may be rewritten.
    """
    old = superseded(facts, rep, *columns)
    return rewritten(old, rep, *columns).join(facts, facts.columns, "left_anti"), old


def orphans(made: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """Minted constants (term, ...) that stand in no fact table (a1, a2, ...)."""
    for df in facts.values():
        for c in df.columns:
            made = made.join(df.select(F.col(c).cast("string").alias("term")), "term", "left_anti")
    return made


def result_types(made: DataFrame, declared: DataFrame) -> DataFrame:
    """(term, t): the types that a function's declarations (function, t) give its minted constants (term, function, ...)."""
    return made.select("term", "function").join(declared, "function").select("term", "t").distinct()
