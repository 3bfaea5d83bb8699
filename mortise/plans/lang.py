"""Goals and rules as plain data, with the checks that need no cluster.

A literal is a tuple (predicate, argument, ...); strings that start with "?" are variables. Special
literals: ("unknown", [literals]), ("thereExists", [variables], [literals]), ("lessThan", a, b, ...),
("greaterThan", ...), ("different", a, b), ("evaluate", "?r", expression), and
("agg/count" | "agg/sum" | "agg/min" | "agg/max" | "agg/avg", "?n", "?v", [literals]).
("not", literal) is a negative fact, which has the table "not predicate"; it is no absence.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

COMPARE = ("lessThan", "greaterThan")
AGGREGATES = ("agg/count", "agg/sum", "agg/min", "agg/max", "agg/avg")
SPECIAL = (*COMPARE, "different", "evaluate", "unknown", "thereExists", *AGGREGATES)


def is_var(x: object) -> bool:
    return isinstance(x, str) and x.startswith("?")


def variables(x: object) -> list[str]:
    """Variables of an argument, expression or literal list, in order of appearance."""
    if is_var(x):
        return [x]
    if isinstance(x, tuple | list):
        return list(dict.fromkeys(v for y in x for v in variables(y)))
    return []


def plain(x: object) -> object:
    """Literals and literal lists with ("not", (p, ...)) as ("not p", ...); two negations cancel."""
    if isinstance(x, tuple) and x and x[0] == "not" and len(x) == 2 and isinstance(x[1], tuple):
        inner = plain(x[1])
        return (inner[0][4:], *inner[1:]) if inner[0].startswith("not ") else (f"not {inner[0]}", *inner[1:])
    if isinstance(x, tuple | list):
        return type(x)(map(plain, x))
    return x


def predicates(body: Iterable[tuple], closed: bool = False) -> Iterator[tuple[str, bool]]:
    """(predicate, whether it is read as a whole: under unknown or an aggregate) of a body."""
    for lit in body:
        if lit[0] == "unknown":
            yield from predicates(lit[1], True)
        elif lit[0] == "thereExists":
            yield from predicates(lit[2], closed)
        elif lit[0] in AGGREGATES:
            yield from predicates(lit[3], True)
        elif lit[0] not in SPECIAL:
            yield lit[0], closed


@dataclass(frozen=True)
class Rule:
    """head <- body, unless one of the exceptions (literal lists) holds. A default rule confers belief that can be defeated."""

    head: tuple
    body: tuple
    default: bool = False
    name: str = ""
    exceptions: tuple = field(default=())

    #: forward rules are closed over, backward ones only expand goals, both do either, inert ones neither.
    direction: str = "both"

    def __post_init__(self):
        for name in ("head", "body", "exceptions"):
            object.__setattr__(self, name, plain(getattr(self, name)))
        if self.direction not in ("forward", "backward", "both", "inert"):
            raise ValueError(f"{self.direction} is no direction")
        bound = set()
        for lit in self.body:
            if lit[0] not in SPECIAL:
                if is_var(lit[0]):
                    raise ValueError(f"{self.head[0]}: an antecedent needs a predicate, not a variable")
                bound |= set(variables(lit[1:]))
            elif lit[0] in ("evaluate", *AGGREGATES):
                bound |= set(variables(lit[1]))
            elif lit[0] == "thereExists":
                bound |= set(variables(lit[2])) - set(lit[1])
        free = [v for v in variables(self.head[1:]) if v not in bound]
        if free:
            raise ValueError(f"{self.head[0]}: {', '.join(free)} isn't bound in the body")


def split_heads(heads: Iterable[tuple], body: tuple, **more) -> list[Rule]:
    """A rule with several conclusions as one rule for each."""
    return [Rule(h, body, **more) for h in heads]


def canonical(literals: Iterable[tuple], symmetric: Iterable[str] = ()) -> tuple:
    """One form for all spellings of a conjunction: equal up to variable names and order give equal results.

    Arguments of symmetric predicates are sorted, greaterThan becomes lessThan, literals are sorted
    by their text without variable names, repeated ones are one, and variables are numbered in the
    order in which they then stand. Literals that look alike but for their variables keep the order
    that gives the least numbering among the first sorted one.
    """
    symmetric = set(symmetric)

    def turned(lit: tuple) -> tuple:
        if lit[0] == "greaterThan":
            return ("lessThan", *reversed(lit[1:]))
        if lit[0] in symmetric or lit[0] == "different":
            return (lit[0], *sorted(lit[1:], key=lambda x: (is_var(x), str(x))))
        return lit

    def blank(x: object) -> str:
        return "?" if is_var(x) else f"({' '.join(map(blank, x))})" if isinstance(x, tuple | list) else f"{type(x).__name__} {x}"

    def named(x: object, names: dict) -> object:
        if is_var(x):
            return names.setdefault(x, f"?{len(names)}")
        return tuple(named(y, names) for y in x) if isinstance(x, tuple | list) else x

    literals = sorted({turned(plain(x)) for x in literals}, key=lambda x: (blank(x), str(x)))
    names: dict = {}
    out = []
    while literals:
        # Of those with the least text, the one whose variables are numbered already goes first.
        least = blank(literals[0])
        lit = min((x for x in literals if blank(x) == least), key=lambda x: tuple(names.get(v, "~") for v in variables(x)))
        literals.remove(lit)
        out.append(named(lit, names))
    return tuple(dict.fromkeys(out))


def strata(rules: Iterable[Rule]) -> list[list[Rule]]:
    """Rules in groups to be closed one after another; a cycle through unknown, an aggregate or an exception raises."""
    rules = list(rules)
    level = {r.head[0]: 0 for r in rules}
    for _ in range(len(level) + 1):
        moved = False
        for r in rules:
            uses = [*predicates(r.body), *((p, True) for e in r.exceptions for p, _ in predicates(e))]
            need = max((level[p] + closed for p, closed in uses if p in level), default=0)
            if need > level[r.head[0]]:
                level[r.head[0]], moved = need, True
        if not moved:
            return [[r for r in rules if level[r.head[0]] == n] for n in sorted(set(level.values()))]
    raise ValueError("a predicate depends on its own absence or aggregate")
