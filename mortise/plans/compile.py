"""A list of literals as one DataFrame plan."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mortise.functions.scalar import evaluate
from mortise.operators.loops import settled
from mortise.operators.meet import crossed, met, minus, spread
from mortise.operators.terms import minted
from mortise.plans.lang import AGGREGATES, COMPARE, SPECIAL, Rule, is_var, plain, predicates, variables

Facts = Mapping[str, DataFrame]


class Closed(dict):
    """Facts, with `apart`: those tables among them that are known to have no row twice, by predicate."""

    def __init__(self, facts: Facts, apart: Facts):
        super().__init__(facts)
        self.apart = dict(apart)


def column(var: str) -> str:
    return f"v_{var[1:]}"


def _value(x: object) -> Column:
    """A variable's column, a constant, or the minted constant of a functional term (function, argument, ...)."""
    if isinstance(x, tuple):
        return minted(x[0], *map(_value, x[1:]))
    return F.col(column(x)) if is_var(x) else F.lit(x)


def match(facts: DataFrame, args: tuple) -> DataFrame:
    """Rows of a predicate table (a1, a2, ...) that unify with args: constants filter, a repeated variable is an equality.

    ("...", "?rest") as last argument binds the remaining arguments as an array.
    """
    rest = None
    if len(args) >= 2 and args[-2] == "...":
        args, rest = args[:-2], args[-1]
    names = [c for c in facts.columns if c.startswith("a") and c[1:].isdigit()]
    where, out = [], {}
    for c, x in zip(names, args, strict=False):
        if not is_var(x):
            where.append(F.col(c) == F.lit(x))
        elif x in out:
            where.append(F.col(c) == F.col(out[x]))
        else:
            out[x] = c
    if len(args) > len(names) or (len(args) < len(names) and rest is None):
        return facts.limit(0).select(*(F.lit(None).alias(column(v)) for v in dict.fromkeys(variables(args))))
    for w in where:
        facts = facts.where(w)
    made = [F.col(c).alias(column(v)) for v, c in out.items()]
    if rest is not None:
        made.append(F.array(*(F.col(c).cast("string") for c in names[len(args) :])).alias(column(rest)))
    return facts.select(*made) if made else facts.select(F.lit(True).alias("v_")).limit(1)


def _compare(lit: tuple) -> Column:
    xs = [_value(x) for x in lit[1:]]
    steps = [(a < b) if lit[0] == "lessThan" else (a > b) for a, b in zip(xs, xs[1:], strict=False)]
    out = steps[0]
    for s in steps[1:]:
        out &= s
    return out


def _aggregate(rows: DataFrame, lit: tuple, facts: Facts, rep: DataFrame | None) -> DataFrame:
    """A reduction over the distinct values of a body, grouped by the variables bound outside it.

    Counts and sums of nothing are 0, other reductions of nothing give no row. Values are counted by
    their equality representative. Sums are partial sums before the shuffle, so a group of any size
    is never held whole; sums of whole numbers are exact, the last digits of other doubles may
    follow the order of addition.
    """
    kind, result, value, body = lit
    inner = conjunction(facts, body, rep)
    bound = [c for c in inner.columns if c in rows.columns and c != column(value)]
    v = column(value)
    if rep is not None and dict(inner.dtypes)[v] == "string":
        inner = inner.join(rep.select(F.col("term").alias(v), "rep"), v, "left").withColumn(v, F.coalesce("rep", v)).drop("rep")
    distinct = inner.select(*bound, v).distinct()
    whole = dict(inner.dtypes)[v] in ("int", "bigint", "smallint", "tinyint")
    total = (F.sum(F.col(v).cast("decimal(38,0)")) if whole else F.sum(F.col(v).try_cast("double"))).cast("double")
    made = {"agg/count": F.count(v), "agg/sum": total, "agg/min": F.min(v), "agg/max": F.max(v), "agg/avg": total / F.count(v)}[kind]
    grouped = distinct.groupBy(*bound).agg(made.alias("_agg"))
    keep = kind in ("agg/count", "agg/sum")
    joined = rows.join(grouped, bound, "left" if keep else "inner") if bound else rows.join(F.broadcast(grouped), how="cross")
    n = F.coalesce(F.col("_agg"), F.lit(0)) if keep else F.col("_agg")
    if is_var(result) and column(result) not in rows.columns:
        return joined.withColumn(column(result), n).drop("_agg")
    return joined.where(n.cast("double") == _value(result).cast("double")).drop("_agg")


def _apply(rows: DataFrame, lit: tuple, facts: Facts, rep: DataFrame | None) -> DataFrame:
    """One special literal whose inputs are bound."""
    kind = lit[0]
    if kind in COMPARE:
        return rows.where(_compare(lit))
    if kind == "different":
        a, b = _value(lit[1]), _value(lit[2])
        if rep is None:
            return rows.where(a != b)
        for name, x in (("_r1", a), ("_r2", b)):
            rows = rows.withColumn("_t", x).join(rep.select(F.col("term").alias("_t"), F.col("rep").alias(name)), "_t", "left").withColumn(name, F.coalesce(name, "_t")).drop("_t")
        return rows.where("_r1 <> _r2").drop("_r1", "_r2")
    if kind == "evaluate":
        made = evaluate(lit[2], _value)
        if is_var(lit[1]) and column(lit[1]) not in rows.columns:
            return rows.withColumn(column(lit[1]), made).where(F.col(column(lit[1])).isNotNull())
        return rows.where(made == _value(lit[1]))
    if kind in AGGREGATES:
        return _aggregate(rows, lit, facts, rep)
    inner = conjunction(facts, lit[1] if kind == "unknown" else lit[2], rep)
    shared = [c for c in inner.columns if c in rows.columns and (kind == "unknown" or c not in {column(v) for v in lit[1]})]
    if kind == "unknown":
        return rows.join(inner, shared, "left_anti") if shared else rows.join(F.broadcast(inner.limit(1)), F.lit(True), "left_anti")
    return rows.join(inner, shared, "left_semi")


def _ready(lit: tuple, bound: set[str]) -> bool:
    if lit[0] == "evaluate":
        return set(variables(lit[2])) <= bound
    if lit[0] in AGGREGATES:
        return set(variables(lit[3])) & bound != set() or not set(variables(lit[3])) - {lit[2]}
    if lit[0] == "unknown":
        return bool(set(variables(lit[1])) & bound) or not variables(lit[1])
    if lit[0] == "thereExists":
        return set(variables(lit[2])) - set(lit[1]) <= bound
    return set(variables(lit[1:])) <= bound


def nothing(facts: Facts, lit: tuple) -> DataFrame:
    """No bindings of a literal whose predicate has no facts."""
    spark = next(iter(facts.values())).sparkSession
    return spark.range(0).select(*(F.lit(None).cast("string").alias(column(v)) for v in dict.fromkeys(variables(lit[1:]))) or [F.lit(True).alias("v_")])


def statistics(facts: Facts, body: tuple | list) -> dict[str, tuple[int, list[int]]]:
    """predicate -> (rows, approximate number of values of each argument), one aggregation a predicate of the body."""
    out = {}
    for p in dict.fromkeys(p for p, _ in predicates(plain(list(body))) if p in facts):
        names = [c for c in facts[p].columns if c.startswith("a") and c[1:].isdigit()]
        got = facts[p].agg(F.count("*"), *(F.approx_count_distinct(c) for c in names)).first()
        out[p] = (got[0], list(got[1:]))
    return out


def estimated(lit: tuple, stats: dict[str, tuple[int, list[int]]], bound: set[str]) -> float:
    """Rows that a literal is expected to give for one binding of the variables in `bound`."""
    n, values = stats.get(lit[0], (0, []))
    seen: set[str] = set()
    out = float(n)
    for x, k in zip(lit[1:], values, strict=False):
        if not is_var(x) or x in bound or x in seen:
            out /= max(1, k)
        seen |= {x} if is_var(x) else set()
    return out


def planned(body: tuple | list, stats: dict[str, tuple[int, list[int]]]) -> list[tuple[tuple, float]]:
    """(literal, expected rows so far) of the positive literals in the order in which they are to be joined.

    Greedy: of the literals that share a variable with what is bound (or of all where none does),
    the one that gives the fewest rows.
    """
    waiting, bound, rows, out = [x for x in plain(list(body)) if x[0] not in SPECIAL], set(), 1.0, []
    while waiting:
        near = [x for x in waiting if set(variables(x[1:])) & bound] or waiting
        lit = min(near, key=lambda x: estimated(x, stats, bound))
        rows *= estimated(lit, stats, bound)
        waiting.remove(lit)
        bound |= set(variables(lit[1:]))
        out.append((lit, rows))
    return out


def query_plan(facts: Facts, body: tuple | list) -> DataFrame:
    """(step, literal, rows): the planned join order of a goal and the rows that are expected after each step."""
    stats = statistics(facts, body)
    rows = [(i, " ".join(map(str, lit)), est) for i, (lit, est) in enumerate(planned(body, stats))]
    return next(iter(facts.values())).sparkSession.createDataFrame(rows, "step int, literal string, rows double")


def conjunction(facts: Facts, body: tuple | list, rep: DataFrame | None = None, stats: dict | None = None, whole: bool = True) -> DataFrame:
    """Distinct bindings of a conjunction as columns v_<name>; without `whole` they may repeat, for callers that cut them down.

    Positive literals join on shared variables, connected ones first, so a product only comes
    where the goal has disconnected blocks; with `stats` in their planned order. Comparisons,
    evaluations and closed literals follow as soon as their inputs are bound; aggregates and unknown
    come after all positive literals. A predicate without facts has none: the goal has no answer,
    and what is `unknown` of it holds.
    """
    body = plain(list(body))
    waiting, late = [x for x in body if x[0] not in SPECIAL], [x for x in body if x[0] in SPECIAL]
    if stats is not None:
        waiting = [x for x, _ in planned(waiting, stats)]
    rows, bound = None, set()
    while waiting:
        lit = next((x for x in waiting if rows is not None and set(variables(x[1:])) & bound), waiting[0])
        waiting.remove(lit)
        found = match(facts[lit[0]], lit[1:]) if lit[0] in facts else nothing(facts, lit)
        if rows is None:
            rows = found
        else:
            on = [c for c in found.columns if c in rows.columns]
            rows = rows.join(found, on) if on else rows.crossJoin(found)
        bound |= set(variables(lit[1:]))
        for x in [x for x in late if x[0] in (*COMPARE, "different", "evaluate") and _ready(x, bound)]:
            rows, late = _apply(rows, x, facts, rep), [y for y in late if y is not x]
            bound |= set(variables(x[1])) if x[0] == "evaluate" else set()
    if rows is None:
        # Only special literals: they start from one row without bindings.
        rows = next(iter(facts.values())).sparkSession.range(1).select(F.lit(True).alias("v_"))
    while late:
        lit = next((x for x in late if _ready(x, bound)), None)
        if lit is None:
            raise ValueError(f"{late[0][0]}: its inputs aren't bound")
        rows, late = _apply(rows, lit, facts, rep), [y for y in late if y is not lit]
        bound |= set(variables(lit[1])) if lit[0] in ("evaluate", *AGGREGATES) else set()
    return rows.distinct() if whole else rows


def _split(found: DataFrame, kept: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(single, several): the distinct rows whose kept columns have no other row, and all rows of the other ones, None if there are none."""
    free = [c for c in found.columns if c not in kept]
    if not free:
        return spread(found).distinct(), None
    facts = [f(c).alias(f"{n}_{c}") for c in free for n, f in (("_lo", F.min), ("_hi", F.max), ("_n", F.count))]
    by = settled(spread(found, *kept).groupBy(*kept).agg(F.count("*").alias("_all"), *facts))
    one = reduce(lambda a, b: a & b, (F.col(f"_lo_{c}").eqNullSafe(F.col(f"_hi_{c}")) & F.col(f"_n_{c}").isin(0, F.col("_all")) for c in free))
    single, others = by.where(one).select(*kept, *(F.col(f"_lo_{c}").alias(c) for c in free)).select(*found.columns), by.where(~one).select(*kept)
    return single, None if others.isEmpty() else minus(found, single, kept)


def _paired(facts: Facts, body: list, names: list[str], rep: DataFrame | None) -> DataFrame | None:
    """Distinct answers of two literals that share variables, or None if a goal has another form.

    Rows of a literal that are the only one with their kept variables can't give an answer twice, so
    their pairs need no distinct; those of all other rows do. What `different` compares is taken to
    its representatives before the join, which is dealt by the pairs that it gives.
    """
    literals, late = [x for x in body if x[0] not in SPECIAL], [x for x in body if x[0] in SPECIAL]
    if len(literals) != 2 or any(x[0] not in facts for x in literals) or any(x[0] not in (*COMPARE, "different") for x in late):
        return None
    sides = [match(facts[x[0]], x[1:]) for x in literals]
    kept = [[c for c in df.columns if c[2:] in names] for df in sides]
    on = [c for c in sides[0].columns if c in sides[1].columns]
    have = {*sides[0].columns, *sides[1].columns}
    if not on or not all(kept) or "v_" in on or not {column(v) for x in late for v in variables(x[1:])} | {f"v_{n}" for n in names} <= have or have <= {f"v_{n}" for n in names}:
        return None
    if any(kind.startswith("map") or "variant" in kind for df in sides for _, kind in df.dtypes):
        return None
    if rep is not None:
        terms = [column(v) for x in late if x[0] == "different" for v in x[1:] if is_var(v)]
        if any(not is_var(v) for x in late if x[0] == "different" for v in x[1:]):
            return None
        for c in dict.fromkeys(terms):
            i = 0 if c in sides[0].columns else 1
            sides[i] = sides[i].join(rep.select(F.col("term").alias(c), F.col("rep").alias(f"_r{c}")), c, "left").withColumn(f"_r{c}", F.coalesce(f"_r{c}", c))
    # What `different` reads as a representative, and what nothing reads, needn't be carried.
    compared = [column(v) for x in late if x[0] != "different" or rep is None for v in variables(x[1:])]
    sides = [df.select(*(c for c in df.columns if c in (*on, *k, *compared) or c.startswith("_r"))) for df, k in zip(sides, kept, strict=True)]
    (one, more), (two, others) = (_split(df, k) for df, k in zip(sides, kept, strict=True))

    def held(rows: DataFrame) -> DataFrame:
        for x in late:
            if x[0] == "different" and rep is not None:
                rows = rows.where(F.col(f"_r{column(x[1])}") != F.col(f"_r{column(x[2])}"))
            else:
                rows = _apply(rows, x, facts, None)
        return rows.select(*(F.col(f"v_{n}") for n in names))

    out = held(crossed(one, two, on, [c for c in two.columns if c not in (*on, *kept[1])]))
    rest = [held(met(a, b, on)) for a, b in ((more, sides[1]), (one, others)) if a is not None and b is not None]
    return out.union(reduce(DataFrame.union, rest).distinct()) if rest else out


def _listed(facts: Facts, body: list, names: list[str] | None) -> DataFrame | None:
    """The answers of a goal that reads a whole table without repeated rows, which need no distinct; None for other goals."""
    (p, *args), rows = body[0], facts.apart.get(body[0][0]) if isinstance(facts, Closed) and len(body) == 1 else None
    if rows is None or rows is not facts.get(p) or not all(map(is_var, args)) or len(set(args)) != len(args) or len(args) != len(rows.columns):
        return None
    rows = match(rows, tuple(args))
    have = [c[2:] for c in rows.columns]
    names = names or have
    return rows.select(*(F.col(f"v_{n}").alias(n) for n in names)) if set(names) == set(have) and len(rows.columns) == len(args) else None


def answer(facts: Facts, goal: tuple | list, names: list[str] | None = None, rep: DataFrame | None = None) -> DataFrame:
    """The goal's bindings, cut to its variables (or `names`), distinct, with the variables' own names."""
    goal = [goal] if isinstance(goal, tuple) and isinstance(goal[0], str) else list(goal)
    if goal and (whole := _listed(facts, plain(goal), names)) is not None:
        return whole
    if names and (pairs := _paired(facts, plain(goal), list(dict.fromkeys(names)), rep)) is not None:
        return pairs.select(*(F.col(f"v_{n}").alias(n) for n in names))
    rows = conjunction(facts, goal, rep, whole=False)
    names = names or [c[2:] for c in rows.columns if c != "v_"]
    return rows.select(*(F.col(f"v_{n}").alias(n) for n in names)).distinct()


def subsumed(facts: Facts, below: DataFrame | list[tuple[str, str]]) -> dict[str, DataFrame]:
    """Facts in which a predicate also has the facts of those below it: below (special, general), closed here.

    Predicate declarations are vocabulary, not data: they are read to the driver.
    """
    pairs = {(str(a), str(b)) for a, b in (below if isinstance(below, list) else below.collect())}
    while more := {(a, d) for a, b in pairs for c, d in pairs if b == c} - pairs:
        pairs |= more
    out = dict(facts)
    for general in {b for _, b in pairs}:
        parts = [facts[p] for p in sorted({general, *(a for a, b in pairs if b == general)}) if p in facts]
        widths = {len(df.columns) for df in parts}
        if len(widths) > 1:
            raise ValueError(f"predicates below {general} have different numbers of arguments")
        if parts:
            merged = parts[0]
            for df in parts[1:]:
                merged = merged.unionByName(df)
            out[general] = merged.distinct()
    return out


def conclusions(rule: Rule, facts: Facts, rep: DataFrame | None = None) -> DataFrame:
    """What a rule concludes, as (a1, a2, ...) rows: its body, without bindings for which an exception holds."""
    rows = conjunction(facts, list(rule.body), rep, whole=False)
    for e in rule.exceptions:
        rows = _apply(rows, ("unknown", list(e)), facts, rep)
    return rows.select(*(_value(x).alias(f"a{i}") for i, x in enumerate(rule.head[1:], 1))).distinct()
