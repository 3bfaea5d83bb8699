"""Concrete arrangements of qualitative networks, and the statements that an entailment or inconsistency rests on.

A context's network is what one reader sees and is worked on whole, one context a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame

from mortise.operators.qualitative import Calculus, calculus

Net = dict[tuple[str, str], int]


def _through(of: Calculus, one: int, two: int) -> int:
    out = 0
    for r in of.bit.values():
        for q in of.bit.values() if one & r else ():
            if two & q:
                out |= of.compose[r, q]
    return out


def _net(rows: list[tuple[str, str, int]], of: Calculus) -> Net:
    nodes = sorted({x for a, b, _ in rows for x in (a, b)})
    net = {(a, b): of.full for a, b in permutations(nodes, 2)}
    for a, b, m in rows:
        net[a, b] &= m
        net[b, a] &= of.converse(m)
    return net


def _tight(net: Net, of: Calculus) -> Net | None:
    """Path consistency by a queue of changed edges; None where an edge becomes empty."""
    net, nodes, waiting = dict(net), sorted({a for a, _ in net}), list(net)
    if any(not m for m in net.values()):
        return None
    while waiting:
        a, b = waiting.pop()
        for c in nodes:
            if c in (a, b):
                continue
            for x, y, m in ((a, c, _through(of, net[a, b], net[b, c])), (c, b, _through(of, net[c, a], net[a, b]))):
                less = net[x, y] & m
                if less != net[x, y]:
                    if not less:
                        return None
                    net[x, y], net[y, x] = less, of.converse(less)
                    waiting += [(x, y), (y, x)]
    return net


def _arrangements(net: Net, of: Calculus) -> Iterator[Net]:
    """All atomic networks inside a tight one, in the order of edge names and relation bits."""
    open_ = next((e for e in sorted(net) if net[e].bit_count() > 1), None)
    if open_ is None:
        yield net
        return
    a, b = open_
    for r in of.bit.values():
        if net[open_] & r:
            inner = _tight(net | {(a, b): r, (b, a): of.converse(r)}, of)
            if inner is not None:
                yield from _arrangements(inner, of)


def scenarios(stated: DataFrame, name: str, most: int) -> DataFrame:
    """(ctx, scenario, a, b, relation), a < b: the first `most` atomic arrangements of each context, numbered from 0.

    stated (ctx, a, b, mask) by the named calculus. An inconsistent context gives no row.
    """

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        of, out = calculus(name), []
        named = {b: n for n, b in of.bit.items()}
        net = _tight(_net(list(zip(rows["a"], rows["b"], rows["mask"].astype(int), strict=True)), of), of)
        for i, made in enumerate(_arrangements(net, of) if net is not None else ()):
            if i == most:
                break
            out += [(rows["ctx"].iloc[0], i, a, b, named[m]) for (a, b), m in sorted(made.items()) if a < b]
        return pd.DataFrame(out, columns=["ctx", "scenario", "a", "b", "relation"])

    rows = stated.selectExpr("cast(ctx as string) ctx", "cast(a as string) a", "cast(b as string) b", "mask")
    return rows.groupBy("ctx").applyInPandas(each, "ctx string, scenario int, a string, b string, relation string")


def culprits(stated: DataFrame, name: str, goal: tuple[str, str, str] | None = None) -> DataFrame:
    """(ctx, sid): a least set of statements (ctx, sid, a, b, mask) that makes a context inconsistent.

    With a goal (a, relation, b): one that entails it, for consistent contexts. Statements are let go in
    the order of sid while the result stands, so that none of those left can be spared.
    """

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        of = calculus(name)
        held = sorted(zip(rows["sid"], rows["a"], rows["b"], rows["mask"].astype(int), strict=True))

        def stands(some: list) -> bool:
            tight = _tight(_net([x[1:] for x in some], of), of) if some else {}
            if goal is None:
                return tight is None
            return tight is not None and (goal[0], goal[2]) in tight and not tight[goal[0], goal[2]] & ~of.mask(goal[1])

        if not stands(held):
            held = []
        for x in list(held):
            fewer = [y for y in held if y is not x]
            if stands(fewer):
                held = fewer
        return pd.DataFrame([(rows["ctx"].iloc[0], x[0]) for x in held], columns=["ctx", "sid"])

    rows = stated.selectExpr("cast(ctx as string) ctx", "cast(sid as string) sid", "cast(a as string) a", "cast(b as string) b", "mask")
    return rows.groupBy("ctx").applyInPandas(each, "ctx string, sid string")
