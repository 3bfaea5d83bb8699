"""Levels, abduction, upkeep, functional terms, declarations and choices on small fixtures."""

import random
from itertools import chain, combinations
from math import gcd

import pytest
from pyspark.sql import functions as F

from mortise.operators import belief, closure, constraints, context, solve, terms
from mortise.plans import census
from mortise.plans.abduce import abduce
from mortise.plans.compile import answer
from mortise.plans.kb import KB
from mortise.plans.lang import Rule
from mortise.plans.levels import Levels
from mortise.plans.program import extended, forward


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_ratio_is_exact(spark):
    pairs = [(3, 4), (6, 4), (-6, 4), (6, -3), (0, 5), (7, 0), (2**62, 6), (9007199254740993, 3), (433494437, 267914296)]
    facts = {"p": spark.createDataFrame(pairs, "a1 long, a2 long")}
    got = {(r.a, r.b): r.r for r in answer(facts, [("p", "?a", "?b"), ("evaluate", "?r", ("ratio", "?a", "?b"))], ["a", "b", "r"]).collect()}

    def text(a, b):
        g = gcd(a, b) * (1 if b > 0 else -1)
        return str(a // g) if b // g == 1 else f"{a // g}/{b // g}"

    assert got == {(a, b): text(a, b) for a, b in pairs if b}


def test_functional_heads_both_ways(spark):
    kb = KB(spark).tell("person", [("Ann",), ("Bob",)]).rule(Rule(("owns", "?x", ("purse", "?x")), (("person", "?x"),)), Rule(("rich", "?p"), (("owns", "?x", "?p"),)))
    for goal in (("owns", "?x", "?p"), ("owns", "Ann", "?p"), ("rich", "?p")):
        got, want = kb.query(goal, depth=2), kb.prove(goal)
        assert rows(got.select(*want.columns)) == rows(want) and want.count()
    assert rows(kb.prove(("owns", "Ann", "?p"))) == rows(spark.range(1).select(terms.minted("purse", F.lit("Ann"))))


@pytest.mark.parametrize("seed", range(3))
def test_extended_is_forward_over_everything(spark, seed):
    r = random.Random(seed)
    edge = lambda n: [(r.randrange(6), r.randrange(6)) for _ in range(n)]
    table = lambda x: spark.createDataFrame(x, "a1 long, a2 long").distinct()
    old, new, other = edge(5), edge(4), edge(3)
    rules = [Rule(("path", "?x", "?y"), (("e", "?x", "?y"),)), Rule(("path", "?x", "?z"), (("path", "?x", "?y"), ("path", "?y", "?z")))]
    late = [Rule(("both", "?x"), (("path", "?x", "?y"), ("f", "?x", "?y")))]
    got = extended(forward({"e": table(old), "f": table(other)}, rules), rules, {"e": table(new)}, late)
    want = forward({"e": table(old + new), "f": table(other)}, rules + late)
    for p in ("path", "both"):
        assert got[p].count() == got[p].distinct().count() and rows(got[p]) == rows(want[p])
    again = extended(got, rules + late, {"f": table([(0, 1), (1, 0)])})
    assert rows(again["both"]) == rows(forward({"e": table(old + new), "f": table([*other, (0, 1), (1, 0)])}, rules + late)["both"])
    with pytest.raises(ValueError):
        extended(got, [Rule(("lone", "?x"), (("f", "?x", "?y"), ("unknown", [("e", "?x", "?y")])))], {"e": table(new)})


def test_levels(spark):
    ctx = lambda xs: spark.createDataFrame(xs, "ctx string, a1 string, a2 string")
    stack = Levels(
        {"near": ctx([("low", "a", "b"), ("high", "b", "c"), ("aside", "x", "y")]), "beside": ctx([("high", "c", "d")])},
        closure.reflexive(spark.createDataFrame([("low", "high")], "a string, b string")), ("near",), (("beside", "near"),), ("near",),
        {"near": spark.createDataFrame([("m", "n")], "a1 string, a2 string")}, (Rule(("near", "?x", "all"), (("near", "?x", "?y"),)),),
    )
    find = lambda n, *g: rows(stack.lookup(n, ("near", *g), "low"))
    assert len(find(0, "a", "?y")) == 3 and find(1, "?x", "c") == {("a", "b")}
    assert find(2, "b", "?y") == {("a",)} and find(3, "b", "?y") == {("a",), ("c",)}
    assert find(3, "c", "?y") == {("b",)} and find(4, "c", "?y") == {("b",), ("d",)}
    assert ("d",) not in find(4, "a", "?y") and ("d",) in find(5, "a", "?y") and find(6, "m", "?y") == {("n",)}
    assert stack.escalate(("near", "m", "?y"), "low")[0] == 6 and stack.escalate(("near", "?x", "all"), "low")[0] == 7
    assert stack.escalate(("near", "q", "?y"), "low") == (None, None)
    with pytest.raises(ValueError):
        stack.lookup(8, ("near", "?x", "?y"), "low")


@pytest.mark.parametrize("seed", range(3))
def test_abduction_against_all_subsets(spark, seed):
    r = random.Random(seed)
    names = [*"abcde"]
    held = {p: {x for x in names if r.random() < 0.5} for p in ("base", "p", "q")}
    held["base"] |= {"a"}
    facts = {p: spark.createDataFrame([(x,) for x in xs], "a1 string") for p, xs in held.items()}
    rules = [Rule(("ok", "?x"), (("base", "?x"), ("p", "?x"), ("q", "?x"))), Rule(("ok", "?x"), (("base", "?x"), ("q", "?x"), ("greaterThan", "?x", "c")))]
    got = {(x.x, tuple(x.missing), x.n) for x in abduce(facts, ("ok", "?x"), ["p", "q"], rules, 1).collect()}
    want = set()
    for x in held["base"]:
        proved = lambda more: ("p", x) in more | {("p", y) for y in held["p"]} and ("q", x) in more | {("q", y) for y in held["q"]} or ("q", x) in more | {("q", y) for y in held["q"]} and x > "c"  # noqa: E731, B023
        sets = [s for s in chain.from_iterable(combinations([("p", x), ("q", x)], k) for k in range(3)) if proved(set(s))]
        least = min(map(len, sets))
        want |= {(x, tuple(" ".join(f) for f in s), least) for s in sets if len(s) == least and least}
    assert got == want


def test_abduction_leaves_open_variables(spark):
    facts = {"base": spark.createDataFrame([("a",), ("b",)], "a1 string"), "likes": spark.createDataFrame([("a", "z")], "a1 string, a2 string")}
    got = abduce(facts, [("base", "?x"), ("likes", "?x", "?y")], ["likes"])
    assert rows(got.select("x", "y", F.array_join("missing", ";"), "n")) == {("b", None, "likes b ?y", 1)}
    with pytest.raises(ValueError):
        abduce(facts, ("base", "?x"), ["likes"])


def test_contexts(spark):
    facts = spark.createDataFrame([("c", 1, 2), ("d", 3, 4), (None, 5, 6)], "ctx string, a long, b long")
    assert rows(context.exactly(facts, "c")) == {("c", 1, 2)} and rows(context.exactly(facts, "c", ("a", "b"))) == {("c", 1, 2), ("c", 2, 1)}
    assert rows(context.projected(spark.createDataFrame([("Ann", "p"), ("Ann", "p")], "agent string, fact string"))) == {("CxAgentAnn", "p")}


def test_terms(spark):
    rep = spark.createDataFrame([("b", "a"), ("a", "a")], "term string, rep string")
    facts = spark.createDataFrame([("b", "b"), ("a", "b"), ("c", "c")], "x string, said string")
    restated, retired = terms.merged(facts, rep, "x")
    assert rows(restated) == set() and rows(retired) == {("b", "b")} and rows(terms.rewritten(facts, rep, "x")) == {("a", "b"), ("c", "c")}
    made = spark.createDataFrame([("k1", "f"), ("k2", "g")], "term string, function string")
    assert rows(terms.orphans(made, {"p": spark.createDataFrame([("k1", 1)], "a1 string, a2 long")})) == {("k2", "g")}
    assert rows(terms.result_types(made, spark.createDataFrame([("f", "t")], "function string, t string"))) == {("k1", "t")}


def test_declarations(spark):
    up = closure.reflexive(spark.createDataFrame([("father", "parent")], "a string, b string"))
    declared = spark.createDataFrame([("father", 3, "arg"), ("parent", 2, "genlArg"), ("any", 9, "arg")], "pred string, n int, kind string")
    takes = spark.createDataFrame([("parent", 2), ("any", 1)], "pred string, k int")
    kinds = spark.createDataFrame([("parent", "instance")], "pred string, relation string")
    exempt = spark.createDataFrame([("any",)], "pred string")
    assert rows(constraints.misdeclared(declared, takes, kinds, up, exempt)) == {("father", "place"), ("parent", "kind")}
    said = spark.createDataFrame([(1, "p", ["a"]), (2, None, ["a"]), (3, "p", ["(f ?x)"]), (4, "p", [""]), (5, "p q", ["a"]), (6, "not p", [None])], "sid long, pred string, args array<string>")
    assert rows(constraints.refusals(said)) == {(2, "no-predicate"), (3, "variable"), (4, "empty"), (5, "name"), (6, "empty")}
    now = {"p": spark.createDataFrame([(1, 1), (2, 3)], "a1 long, a2 long")}
    bad = {"irreflexive": lambda f: f["p"].where("a1 = a2").select("a1")}
    assert rows(constraints.dry_run(bad, now, {"p": spark.createDataFrame([(1, 1), (4, 4), (5, 6)], "a1 long, a2 long")})) == {("irreflexive", "4")}


def test_sweep_and_revival(spark):
    just = spark.createDataFrame([("j1", "b", ["a"], 2), ("j2", "c", ["b"], 1)], "jid string, conseq string, ante array<string>, s int")
    facts = spark.createDataFrame([("a",), ("b",), ("c",)], "sid string")
    stated = spark.createDataFrame([("a", 2)], "sid string, s int")
    assert rows(belief.sweep(facts, stated.limit(0), just)) == set() and rows(belief.sweep(facts, stated, just)) == {("a",), ("b",), ("c",)}


def test_dilemmas_give_up_the_fewest(spark):
    bad = spark.createDataFrame([("n1", "a"), ("n1", "b"), ("n2", "b"), ("n2", "c"), ("n3", "y"), ("n3", "x")], "nid string, sid string")
    assert rows(solve.settled_dilemmas(bad)) == {("b",), ("x",)}


def test_gloss(spark):
    facts = {"likes": spark.createDataFrame([("Ann {1}", "Bob")], "a1 string, a2 string"), "odd": spark.createDataFrame([(3,)], "a1 long")}
    assert ("odd", "odd of 3") in rows(census.glossed(facts, {"likes": "{1} likes {2}."}))


@pytest.mark.parametrize("seed", range(2))
def test_resolve_against_relabelling_from_scratch(spark, seed):
    r = random.Random(seed)
    names = [f"f{i}" for i in range(14)]
    just = [(f"j{i}", r.choice(names), r.sample(names, r.randrange(3)), r.choice([1, 2])) for i in range(16)]
    stated = [(n, r.choice([1, 2])) for n in r.sample(names, 6)]
    facts = [(n, f"b{i // 2}", i % 2 == 0) for i, n in enumerate(names)]

    def labelled(out):
        s = {}
        while True:
            new = {n: k for n, k in stated if n not in out}
            for _, c, ante, k in just:
                if c not in out and all(a in s for a in ante):
                    new[c] = max(new.get(c, 0), min([k, *(s[a] for a in ante)]))
            if new == s:
                return s
            s = new

    out = set()
    while True:
        s = labelled(out)
        pairs = [(a, b) for a, b in zip(names[::2], names[1::2], strict=True) if a in s and b in s and s[a] != s[b]]
        weak = {min(p, key=s.get) for p in pairs}
        if not weak:
            break
        out |= weak
    held, defeated, _ = belief.resolve(
        spark.createDataFrame(stated, "sid string, s int"), spark.createDataFrame(just, "jid string, conseq string, ante array<string>, s int"), spark.createDataFrame(facts, "sid string, body string, truth boolean")
    )
    assert rows(held) == set(s.items()) and rows(defeated) == {(n,) for n in out}
