"""One goal by more and more machinery: eight levels, each adding one mechanism to the one below."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortise.operators.closure import transitive
from mortise.operators.context import visible
from mortise.plans.compile import answer, subsumed
from mortise.plans.lang import Rule
from mortise.plans.program import forward

#: The levels' names in their order.
NAMES = ("raw", "extent", "local", "visible", "typed", "closed", "solved", "proved")


@dataclass(frozen=True)
class Levels:
    """facts: predicate -> (ctx, a1, a2, ...); up (a, b): context a sees b, reflexive.

    The rest is what the levels switch on: symmetric predicates (2), predicates below others (4),
    transitive predicates (5), computed tables (6) and rules (7).
    """

    facts: dict[str, DataFrame]
    up: DataFrame
    symmetric: tuple[str, ...] = ()
    genl: tuple[tuple[str, str], ...] = ()
    transitive: tuple[str, ...] = ()
    solvers: dict[str, DataFrame] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()

    def tables(self, level: int, view: str) -> dict[str, DataFrame]:
        """What a reader in a context has to match a goal against at a level."""
        out = {}
        for p, df in self.facts.items():
            rows = df if level == 0 else df.where(F.col("ctx") == view) if level < 3 else visible(df, self.up, view)
            out[p] = rows.drop("ctx").distinct()
        if level >= 2:
            out |= {p: out[p].union(out[p].select("a2", "a1")).distinct() for p in self.symmetric if p in out}
        if level >= 4:
            out = subsumed(out, list(self.genl))
        if level >= 5:
            for p in self.transitive:
                if p in out:
                    out[p] = transitive(out[p].select(F.col("a1").alias("a"), F.col("a2").alias("b"))).select(F.col("a").alias("a1"), F.col("b").alias("a2"))
        if level >= 6:
            out |= {p: out[p].unionByName(df).distinct() if p in out else df for p, df in self.solvers.items()}
        return forward(out, self.rules) if level >= 7 else out

    def lookup(self, level: int, goal: tuple, view: str) -> DataFrame:
        """Answers of a goal at a level; levels 0 and 1 don't look at its arguments and give the predicate's rows."""
        if not 0 <= level < len(NAMES):
            raise ValueError(f"no level {level}")
        tables = self.tables(level, view)
        return tables[goal[0]] if level < 2 else answer(tables, goal)

    def explain(self, goal: tuple, view: str) -> DataFrame:
        """(level, name, n): how much each level yields."""
        out = None
        for i, name in enumerate(NAMES):
            row = self.lookup(i, goal, view).agg(F.count("*").alias("n")).select(F.lit(i).alias("level"), F.lit(name).alias("name"), "n")
            out = row if out is None else out.union(row)
        return out

    def escalate(self, goal: tuple, view: str, floor: int = 2) -> tuple[int | None, DataFrame | None]:
        """(level, answers) of the lowest level from `floor` on that answers; (None, None) if none does."""
        for i in range(floor, len(NAMES)):
            found = self.lookup(i, goal, view)
            if not found.isEmpty():
                return i, found
        return None, None
