"""Whitelisted arithmetic of `evaluate`, as Column expressions; what has no value is null and drops the row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _floor_mod(a: Column, b: Column) -> Column:
    return F.when(b != 0, a - b * F.floor(F.try_divide(a, b)))


def _truncated(a: Column, b: Column) -> Column:
    q = F.try_divide(a, b)
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q))


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm; 92 steps are enough for all 64-bit numbers."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.when(s.y == 0, s).otherwise(F.struct(s.y.alias("x"), (s.x % F.when(s.y != 0, s.y)).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s.x)


def _ratio(a: Column, b: Column) -> Column:
    """The exact quotient of whole numbers as text in lowest terms: "3/4", or "2" where it is whole."""
    a, b = a.cast("long"), b.cast("long")
    g = F.when(b < 0, -_gcd(a, b)).when(b > 0, _gcd(a, b))
    whole = lambda x: F.call_function("div", x, g)
    top, bottom = whole(a), whole(b)
    return F.when(b == 0, None).when(bottom == 1, top.cast("string")).otherwise(F.concat_ws("/", top.cast("string"), bottom.cast("string")))


def _minted(function: Column, *args: Column) -> Column:
    return F.concat(F.lit("nat/"), F.sha2(F.concat_ws(" ", function, *(a.cast("string") for a in args)), 256))


#: Name -> function of the argument columns.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "+": lambda *x: reduce(lambda a, b: a + b, x),
    "-": lambda *x: -x[0] if len(x) == 1 else reduce(lambda a, b: a - b, x),
    "*": lambda *x: reduce(lambda a, b: a * b, x),
    "/": lambda a, b: F.try_divide(a, b),
    "ratio": _ratio,
    "minted": _minted,
    "mod": _floor_mod,
    "quot": _truncated,
    "rem": lambda a, b: F.when(b != 0, a - b * _truncated(a, b)),
    "inc": lambda a: a + 1,
    "dec": lambda a: a - 1,
    "min": lambda *x: F.least(*x),
    "max": lambda *x: F.greatest(*x),
    "abs": lambda a: F.abs(a),
    "expt": lambda a, b: F.pow(a, b),
}


def register(name: str, build: Callable[..., Column]) -> None:
    """Adds a value-shaped function for `evaluate`: argument columns -> column."""
    if name in FUNCTIONS:
        raise ValueError(f"{name} is taken")
    FUNCTIONS[name] = build


def evaluate(expression: object, value: Callable[[object], Column]) -> Column:
    """A nested (function, argument, ...) tuple as a Column; value() gives variables and constants."""
    if isinstance(expression, tuple):
        if expression[0] not in FUNCTIONS:
            raise ValueError(f"{expression[0]} isn't a known function")
        return FUNCTIONS[expression[0]](*(evaluate(x, value) for x in expression[1:]))
    return value(expression)
