"""Schematic rewriting: equations as rules, oriented by a Knuth-Bendix order, applied to the distinct terms of a column."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortise.sources.store import parse

#: Steps after which a term's rewriting is given up; oriented rules always end, so this only guards memory.
MOST_STEPS = 10_000


def _is_var(t: object) -> bool:
    return isinstance(t, str) and t.startswith("?")


def _symbols(t: object) -> Counter:
    return sum((_symbols(x) for x in t), Counter()) if isinstance(t, list) else Counter([t])


def shown(t: object) -> str:
    return f"({' '.join(map(shown, t))})" if isinstance(t, list) else str(t)


def greater(s: object, t: object) -> bool:
    """Knuth-Bendix: every variable as often in s as in t or more, then the number of symbols, then head and arguments from the left."""
    have, need = _symbols(s), _symbols(t)
    if any(have[v] < n for v, n in need.items() if _is_var(v)):
        return False
    if have.total() != need.total():
        return have.total() > need.total()
    if not isinstance(s, list) or not isinstance(t, list):
        return not _is_var(s) and not _is_var(t) and shown(s) > shown(t)
    if shown(s[0]) != shown(t[0]):
        return shown(s[0]) > shown(t[0])
    if len(s) != len(t):
        return len(s) > len(t)
    for a, b in zip(s[1:], t[1:], strict=True):
        if a != b:
            return greater(a, b)
    return False


def oriented(equations: list[tuple[str, str]]) -> list[tuple[object, object]]:
    """Equations as (from, to) terms, the greater side first; those that no order turns are refused."""
    out = []
    for left, right in equations:
        (a,), (b,) = parse(left), parse(right)
        if greater(a, b):
            out.append((a, b))
        elif greater(b, a):
            out.append((b, a))
        else:
            raise ValueError(f"{left} = {right} can't be oriented")
    return out


def _bound(pattern: object, term: object, into: dict) -> bool:
    if _is_var(pattern):
        return into.setdefault(pattern, term) == term
    if isinstance(pattern, list):
        return isinstance(term, list) and len(pattern) == len(term) and all(_bound(p, t, into) for p, t in zip(pattern, term, strict=True))
    return type(pattern) is type(term) and pattern == term


def _filled(t: object, by: dict) -> object:
    return [_filled(x, by) for x in t] if isinstance(t, list) else by.get(t, t)


def normal_form(term: object, rules: list[tuple[object, object]]) -> object:
    """The term with rules applied, arguments first, until none matches."""
    left = MOST_STEPS

    def go(t: object) -> object:
        nonlocal left
        while True:
            if isinstance(t, list):
                t = [go(x) for x in t]
            for a, b in rules:
                by: dict = {}
                if _bound(a, t, by):
                    left -= 1
                    if left < 0:
                        raise RuntimeError(f"no normal form within {MOST_STEPS} steps")
                    t = _filled(b, by)
                    break
            else:
                return t

    return go(term)


def normalised(df: DataFrame, column: str, equations: list[tuple[str, str]]) -> DataFrame:
    """df with the terms of a column in normal form; null stays null. Each different text is rewritten once."""
    rules = oriented(equations)

    @F.arrow_udf("string")
    def rewritten(terms: pa.Array) -> pa.Array:
        return pa.array([None if t is None else " ".join(shown(normal_form(x, rules)) for x in parse(t)) for t in terms.to_pylist()], pa.string())

    name = f"{column}_normal"
    each = df.select(column).distinct().withColumn(name, rewritten(F.col(column)))
    return df.join(each, column, "left").withColumn(column, F.col(name)).select(*df.columns)
