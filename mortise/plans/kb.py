"""A knowledge base: predicate tables, rules, and the doors to query, explain and change them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from mortise.operators.belief import difference
from mortise.operators.loops import settled
from mortise.plans.compile import answer, query_plan, subsumed
from mortise.plans.lang import AGGREGATES, SPECIAL, Rule, variables
from mortise.plans.program import firings, forward, unfold
from mortise.sources import store


def bound_names(body: list[tuple]) -> set[str]:
    """Names of the variables that a conjunction binds."""
    out = set()
    for lit in body:
        out |= set(variables(lit[1:])) if lit[0] not in SPECIAL else set(variables(lit[1])) if lit[0] in ("evaluate", *AGGREGATES) else set()
    return {v[1:] for v in out}


@dataclass(frozen=True)
class KB:
    """Immutable: assertions, retractions and forks give a new one."""

    spark: SparkSession
    facts: dict[str, DataFrame] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()
    genl: tuple[tuple[str, str], ...] = ()

    def tell(self, predicate: str, rows: DataFrame | list[tuple]) -> KB:
        """With more facts of a predicate; a list of tuples or a DataFrame (a1, a2, ...)."""
        if isinstance(rows, list):
            rows = self.spark.createDataFrame(rows, [f"a{i + 1}" for i in range(len(rows[0]))])
        old = self.facts.get(predicate)
        return replace(self, facts=self.facts | {predicate: rows.distinct() if old is None else old.unionByName(rows).distinct()})

    def retract(self, predicate: str, rows: list[tuple]) -> KB:
        old = self.facts[predicate]
        gone = self.spark.createDataFrame(rows, old.schema)
        return replace(self, facts=self.facts | {predicate: old.join(gone, old.columns, "left_anti")})

    def rule(self, *rules: Rule) -> KB:
        return replace(self, rules=(*self.rules, *rules))

    def closed(self) -> dict[str, DataFrame]:
        closed = forward(self.seen(), self.rules)
        return subsumed(closed, list(self.genl)) if self.genl else closed

    def query(self, goal: tuple | list, depth: int | None = None) -> DataFrame:
        """Answers from stated facts; depth expands each literal backwards that deep. Unknown predicates have no answers."""
        literals = [goal] if isinstance(goal, tuple) and isinstance(goal[0], str) else list(goal)
        names = [v[1:] for v in variables(literals)]
        seen = self.seen()
        if depth is None:
            return answer(seen, literals)
        out = None
        for body in unfold(literals, self.rules, depth, seen):
            rows = answer(seen, body, [n for n in names if n in bound_names(body)])
            out = rows if out is None else out.unionByName(rows)
        return answer(seen, literals) if out is None else out.distinct()

    def seen(self) -> dict[str, DataFrame]:
        """Facts as goals read them: a predicate has those of the predicates below it (genl), too."""
        return subsumed(self.facts, list(self.genl)) if self.genl else self.facts

    def below(self, special: str, general: str) -> KB:
        """With a declaration that one predicate is a case of another."""
        return replace(self, genl=(*self.genl, (special, general)))

    def plan(self, goal: tuple | list) -> DataFrame:
        """The join order that statistics give for a goal, with expected rows."""
        return query_plan(self.seen(), [goal] if isinstance(goal, tuple) and isinstance(goal[0], str) else goal)

    def solutions(self, goal: tuple | list) -> Iterator[Row]:
        """Proved answers one at a time, fetched a partition at a time."""
        yield from self.prove(goal).toLocalIterator()

    def page(self, goal: tuple | list, most: int, after: tuple | None = None) -> tuple[DataFrame, str, tuple | None]:
        """(results, status, resume): at most `most` answers in content order after `after`; pass `resume` on for the next ones.

        status is "complete" when none is left, else "partial". Answers must have no null.
        """
        rows = answer(self.seen(), goal)
        if after is not None:
            ahead = F.lit(False)
            for i in reversed(range(len(rows.columns))):
                c = F.col(rows.columns[i])
                ahead = (c > F.lit(after[i])) | ((c == F.lit(after[i])) & ahead)
            rows = rows.where(ahead)
        got = settled(rows.orderBy(*rows.columns).limit(most + 1))
        n = got.count()
        page = got.orderBy(*rows.columns).limit(most)
        last = page.orderBy(*(F.desc(c) for c in rows.columns)).first() if n > most else None
        return page, "partial" if n > most else "complete", tuple(last) if last else None

    def edit(self, tell: dict[str, list[tuple] | DataFrame] | None = None, retract: dict[str, list[tuple]] | None = None) -> KB:
        """Several changes as one: retractions first, then assertions; nothing settles between."""
        kb = self
        for p, rows in (retract or {}).items():
            kb = kb.retract(p, rows)
        for p, rows in (tell or {}).items():
            kb = kb.tell(p, rows)
        return kb

    def mentions(self, *terms: object) -> DataFrame:
        """(predicate, args): stated facts in which all the terms stand, in any place, inside nested terms, too."""
        out = None
        for p, df in sorted(self.facts.items()):
            args = F.array(*(F.col(c).cast("string") for c in df.columns))
            hit = F.lit(True)
            for t in terms:
                word = rf"(^|[\s()]){re.escape(str(t))}($|[\s()])"
                hit = hit & F.exists(args, lambda x: x.rlike(word))  # noqa: B023 (used at once)
            rows = df.where(hit).select(F.lit(p).alias("predicate"), args.alias("args"))
            out = rows if out is None else out.union(rows)
        return out

    def functor(self, *predicates: str) -> DataFrame:
        """(predicate, args): all stated facts of some predicates."""
        out = None
        for p in predicates:
            rows = self.facts[p].select(F.lit(p).alias("predicate"), F.array(*(F.col(c).cast("string") for c in self.facts[p].columns)).alias("args"))
            out = rows if out is None else out.union(rows)
        return out

    def prove(self, goal: tuple | list) -> DataFrame:
        """Answers from all that the rules conclude."""
        return answer(self.closed(), goal)

    def provable(self, goal: tuple | list) -> bool:
        return not self.prove(goal).isEmpty()

    def justifications(self) -> DataFrame:
        closed = self.closed()
        out = None
        for r in self.rules:
            rows = firings(r, closed)
            out = rows if out is None else out.union(rows)
        return out

    def preview(self, other: KB, predicate: str) -> DataFrame:
        """What another state would add to and take from a predicate."""
        return difference(self.closed()[predicate], other.closed()[predicate])

    def counts(self) -> DataFrame:
        """(predicate, n): stored facts."""
        parts = [df.agg(F.count("*").alias("n")).select(F.lit(p).alias("predicate"), "n") for p, df in self.facts.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def terms(self) -> DataFrame:
        """(term, n): every argument value and how often it stands in a stored fact."""
        parts = [df.select(F.explode(F.array(*(F.col(c).cast("string") for c in df.columns))).alias("term")) for df in self.facts.values()]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.groupBy("term").agg(F.count("*").alias("n"))

    def export(self, path: str) -> None:
        store.export(self.facts, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, rules: tuple[Rule, ...] = ()) -> KB:
        return cls(spark, store.load(spark, path), rules)
