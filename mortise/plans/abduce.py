"""Abduction: the fewest missing facts that would make a goal provable."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortise.operators.loops import settled
from mortise.plans.compile import Facts, answer, column, conjunction, match
from mortise.plans.lang import SPECIAL, Rule, is_var, plain, variables
from mortise.plans.program import unfold


def _without(rows: DataFrame, facts: Facts, lit: tuple) -> DataFrame:
    """Bindings for which a literal has no fact."""
    if lit[0] not in facts:
        return rows
    found = match(facts[lit[0]], lit[1:])
    shared = [c for c in found.columns if c in rows.columns and c != "v_"]
    return rows.join(found, shared, "left_anti") if shared else rows.join(F.broadcast(found.limit(1)), F.lit(True), "left_anti")


def abduce(facts: Facts, goal: tuple | list, abducible: Iterable[str], rules: Iterable[Rule] = (), depth: int = 0) -> DataFrame:
    """(goal variables ..., missing array<string>, n): the least sets of facts that are missing for each binding.

    The goal is unfolded by rules to `depth`; literals of `abducible` predicates may be missing, all
    others must hold. Bindings for which the goal holds already need nothing and are left out. A
    variable that only missing facts have stays open: it is null, and its name in the text of the
    fact ("p a ?x": some fact of that form). Every subset of a conjunction's abducible literals is one plan,
    so their number is 2 to the number of literals, which a person writes; rows don't matter to it.
    """
    literals = [goal] if isinstance(goal, tuple) and isinstance(goal[0], str) else list(goal)
    names, abducible = [v[1:] for v in variables(literals)], set(abducible)
    out = None
    for body in unfold(literals, rules, depth):
        body = plain(body)
        free = [x for x in body if x[0] in abducible]
        if any(x[0] not in abducible and x[0] not in SPECIAL and x[0] not in facts for x in body):
            continue
        for k in range(1, len(free) + 1):
            for lacking in combinations(free, k):
                held = [x for x in body if not any(x is y for y in lacking)]
                known = {v for x in held if x[0] not in SPECIAL for v in variables(x[1:])} | {v for x in held if x[0] == "evaluate" for v in variables(x[1])}
                if any(x[0] in SPECIAL and not set(variables(x[1:])) <= known for x in held) or any(x[0] not in SPECIAL and x[0] not in facts for x in held):
                    continue
                rows = conjunction(facts, held)
                for x in lacking:
                    rows = _without(rows, facts, x)
                value = lambda x: F.col(column(x)).cast("string") if is_var(x) and column(x) in rows.columns else F.lit(str(x))  # noqa: E731, B023
                texts = F.array_sort(F.array_distinct(F.array(*(F.concat_ws(" ", F.lit(x[0]), *map(value, x[1:])) for x in lacking))))
                found = rows.select(*(F.col(f"v_{n}").alias(n) if f"v_{n}" in rows.columns else F.lit(None).alias(n) for n in names), texts.alias("missing"))
                out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no literal of the goal is abducible")
    out = settled(out.withColumn("n", F.size("missing")).distinct())
    for body in unfold(literals, rules, depth, facts) if names else ():
        out = out.join(answer(facts, body, names), names, "left_anti")
    key = F.sha2(F.to_json(F.struct(F.lit(0).alias("_"), *names)), 256)
    least = out.groupBy(key.alias("_key")).agg(F.min("n").alias("_least"))
    return out.withColumn("_key", key).join(least, "_key").where("n = _least").select(*names, "missing", "n").distinct()
