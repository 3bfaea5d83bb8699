"""Integrity declarations as violation queries: one DataFrame for each kind, empty when all is well."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def arg_type(values: DataFrame, membership: DataFrame, needed: str) -> DataFrame:
    """Values (x) with a known type but not `needed`; membership (x, t) is closed upwards, the untyped violate nothing."""
    typed = values.join(membership.select("x"), "x", "left_semi")
    return typed.join(membership.where(F.col("t") == needed).select("x"), "x", "left_anti")


def arg_genl(values: DataFrame, up: DataFrame, needed: str) -> DataFrame:
    """Values (x) that are types, but not below `needed`; up (a, b) is a reflexive closure."""
    known = values.join(up.select(F.col("a").alias("x")).distinct(), "x", "left_semi")
    return known.join(up.where(F.col("b") == needed).select(F.col("a").alias("x")), "x", "left_anti")


def inter_arg(pairs: DataFrame, membership: DataFrame, first: str, second: str) -> DataFrame:
    """Pairs (a, b) whose a is a `first` and whose b has types, but not `second`."""
    guarded = pairs.join(membership.where(F.col("t") == first).select(F.col("x").alias("a")), "a", "left_semi")
    bad = arg_type(guarded.select(F.col("b").alias("x")).distinct(), membership, second).withColumnRenamed("x", "b")
    return guarded.join(bad, "b", "left_semi")


def literal_kind(values: DataFrame, column: str, kind: str) -> DataFrame:
    """Rows whose string in `column` isn't written as an Integer, Number or Symbol."""
    pattern = {"Integer": r"^[+-]?\d+$", "Number": r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$", "Symbol": r"^[A-Za-z][A-Za-z0-9_]*$"}[kind]
    return values.where(~F.col(column).rlike(pattern))


def arity(facts: DataFrame, declared: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """Facts (sid, pred, args) whose number of arguments isn't the declared (pred, n)."""
    rows = facts.join(exempt.select("pred"), "pred", "left_anti") if exempt is not None else facts
    return rows.join(F.broadcast(declared), "pred").where(F.size("args") != F.col("n"))


def disjoint(membership: DataFrame, apart: DataFrame) -> DataFrame:
    """(x, t1, t2), t1 < t2: x is in two separated types; apart (x, y) in both orders."""
    pairs = apart.select(F.col("x").alias("t1"), F.col("y").alias("t2")).where("t1 < t2").distinct()
    one, two = membership.select("x", F.col("t").alias("t1")), membership.select("x", F.col("t").alias("t2"))
    return one.join(pairs, "t1").join(two, ["x", "t2"]).select("x", "t1", "t2").distinct()


def functional(pairs: DataFrame, key: str = "a", value: str = "b") -> DataFrame:
    """(key, n): keys with more than one value."""
    return pairs.groupBy(key).agg(F.countDistinct(value).alias("n")).where("n > 1")


def functional_equalities(pairs: DataFrame) -> DataFrame:
    """(a, b): symbolic values of one key of a functional predicate (a, b) are the same thing: each equals the least."""
    least = pairs.groupBy("a").agg(F.min("b").alias("low"))
    return pairs.join(least, "a").where("b <> low").select(F.col("low").alias("a"), "b").distinct()


def asymmetric(pairs: DataFrame) -> DataFrame:
    """(a, b), a <= b, stated in both directions."""
    back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return pairs.join(back, ["a", "b"]).where("a <= b").select("a", "b").distinct()


def irreflexive(pairs: DataFrame) -> DataFrame:
    return pairs.where("a = b").select("a", "b").distinct()


def anti_symmetric(pairs: DataFrame) -> DataFrame:
    """(a, b), a < b, stated in both directions and so equal."""
    return asymmetric(pairs).where("a < b")


def anti_transitive(pairs: DataFrame) -> DataFrame:
    """(a, b, c): a-b, b-c and a-c all hold."""
    p = pairs.select("a", "b").distinct()
    chain = p.join(p.select(F.col("a").alias("b"), F.col("b").alias("c")), "b")
    return chain.join(p.select("a", F.col("b").alias("c")), ["a", "c"]).select("a", "b", "c").distinct()


def report(kinds: dict[str, DataFrame], shown: dict[str, Column]) -> DataFrame:
    """(kind, witness): violations of several declarations in one table."""
    parts = [df.select(F.lit(k).alias("kind"), shown[k].cast("string").alias("witness")) for k, df in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def inferred_types(facts: DataFrame, declared: DataFrame) -> DataFrame:
    """(x, t): what stands at a place has the type that (pred, n, t) declares of it; facts (pred, args array)."""
    each = facts.select("pred", F.posexplode("args").alias("i", "x")).select("pred", (F.col("i") + 1).alias("n"), "x").distinct()
    return each.join(declared, ["pred", "n"]).select("x", "t").distinct()


def generalised(declared: DataFrame, up: DataFrame) -> DataFrame:
    """(pred, n, t): what declarations (pred, n, t) say of supertypes as well; up (a, b) is a reflexive closure."""
    return declared.join(up.select(F.col("a").alias("t"), F.col("b").alias("over")), "t").select("pred", "n", F.col("over").alias("t")).distinct()


def marks_over(marks: DataFrame, up: DataFrame) -> DataFrame:
    """(pred, mark): marks hold of all predicates below the one that carries them; up (a, b) is a reflexive closure."""
    return marks.join(up.select(F.col("a").alias("low"), F.col("b").alias("pred")), "pred").select(F.col("low").alias("pred"), "mark").distinct()


def marked_violations(facts: DataFrame, marks: DataFrame) -> DataFrame:
    """(pred, mark, a, b): facts (pred, a, b) against their predicate's own or inherited marks irreflexive and asymmetric."""
    held = facts.select("pred", "a", "b").distinct()
    of = lambda m: held.join(marks.where(F.col("mark") == m).select("pred").distinct(), "pred", "left_semi")
    both = of("asymmetric")
    back = both.select("pred", F.col("b").alias("a"), F.col("a").alias("b"))
    return of("irreflexive").where("a = b").select("pred", F.lit("irreflexive").alias("mark"), "a", "b").union(both.join(back, ["pred", "a", "b"]).where("a <= b").select("pred", F.lit("asymmetric"), "a", "b"))


def misdeclared(declared: DataFrame, arity_of: DataFrame, kinds: DataFrame, up: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """(pred, problem): argument declarations that contradict what is declared of the predicate.

    declared (pred, n, kind = arg | genlArg | interArg), arity_of (pred, k), kinds (pred, relation =
    instance | type), up (a, b) predicates below predicates, reflexive. A place beyond the own or an
    inherited arity is "place", arg and interArg on a type relation or genlArg on an instance
    relation is "kind", an arity unlike that of a predicate above is "arity". Predicates in
    `exempt` (pred) take any number of arguments. What nothing was said of is no problem.
    """
    above = up.select(F.col("a").alias("pred"), F.col("b").alias("over"))
    takes = above.join(arity_of.select(F.col("pred").alias("over"), "k"), "over")
    if exempt is not None:
        takes = takes.join(exempt.select("pred"), "pred", "left_anti")
    place = declared.join(takes, "pred").where("n > k").select("pred", F.lit("place").alias("problem"))
    wrong = (F.col("kind").isin("arg", "interArg") & (F.col("relation") == "type")) | ((F.col("kind") == "genlArg") & (F.col("relation") == "instance"))
    kind = declared.join(kinds, "pred").where(wrong).select("pred", F.lit("kind"))
    unlike = takes.where("pred <> over").join(arity_of.select("pred", F.col("k").alias("own")), "pred").where("own <> k").select("pred", F.lit("arity"))
    return place.union(kind).union(unlike).distinct()


def refusals(sentences: DataFrame) -> DataFrame:
    """(sid, reason) for sentences (sid, pred, args array<string>) that may not be stored, the first reason that applies.

    no-predicate, variable (not ground), empty (an argument without text) or name (a predicate that
    doesn't start with a letter or holds white space or brackets).
    """
    reason = F.when(F.col("pred").isNull() | (F.col("pred") == ""), "no-predicate").when(F.exists("args", lambda x: x.rlike(r"(^|[\s(])\?")), "variable")
    reason = reason.when(F.exists("args", lambda x: x.isNull() | (F.trim(x) == "")), "empty").when(~F.col("pred").rlike(r"^(not )?[A-Za-z][^\s()]*$"), "name")
    return sentences.select("sid", reason.alias("reason")).where("reason is not null")


def dry_run(checks: dict[str, Callable[[dict[str, DataFrame]], DataFrame]], before: dict[str, DataFrame], proposed: dict[str, DataFrame]) -> DataFrame:
    """(kind, witness): violations that a proposed batch (predicate -> rows) would bring, and not those that are there already.

    A check gives one column, the witness, for the facts that it is handed. Nothing is stored.
    """
    after = dict(before)
    for p, rows in proposed.items():
        after[p] = after[p].unionByName(rows).distinct() if p in after else rows.distinct()
    out = None
    for kind, check in checks.items():
        shaped = lambda df: df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).cast("string").alias("witness")).distinct()  # noqa: E731, B023
        rows = shaped(check(after)).join(shaped(check(before)), ["kind", "witness"], "left_anti")
        out = rows if out is None else out.union(rows)
    return out
