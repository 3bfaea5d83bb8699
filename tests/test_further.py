"""Definitions, rule generators, rewriting, scenarios, culprits and reports on small fixtures."""

import random
from itertools import product

import pytest

from mortise.operators import belief, closure, qualitative, rewrite, scenarios
from mortise.plans import registry
from mortise.plans.lang import Rule
from mortise.plans.program import definition, firings, forward, rule_report, stamped


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_definition(spark):
    body = (("parent", "?x", "?y"), ("tall", "?x"))
    assert [r.head for r in definition("iff", ("giant", "?x"), body)] == [("giant", "?x"), ("tall", "?x")]
    assert definition("necessary", ("giant", "?x"), body) == [Rule(("tall", "?x"), (("giant", "?x"),))]
    with pytest.raises(ValueError):
        definition("other", ("giant", "?x"), body)
    facts = {"parent": spark.createDataFrame([(1, 2)], "a1 long, a2 long"), "tall": spark.createDataFrame([(1,), (3,)], "a1 long")}
    assert rows(forward(facts, definition("sufficient", ("giant", "?x"), body))["giant"]) == {(1,)}


def test_rule_generator(spark):
    facts = {"likes": spark.createDataFrame([(1, 2)], "a1 long, a2 long"), "symmetricLike": spark.createDataFrame([("likes", "liked")], "a1 string, a2 string")}
    made = stamped(facts, (("symmetricLike", "?P", "?Q"),), ("?Q", "?y", "?x"), (("?P", "?x", "?y"),), name="turn")
    assert [r.name for r in made] == ["turn likes liked"] and rows(forward(facts, made)["liked"]) == {(2, 1)}
    with pytest.raises(ValueError):
        stamped(facts, (("symmetricLike", "?P", "?Q"),), ("?Q", "?y", "?x"), (("?P", "?x", "?y"),), most=0)


def test_rule_report(spark):
    facts = {"p": spark.createDataFrame([(1, 2), (1, 3)], "a1 long, a2 long")}
    rules = [Rule(("q", "?x"), (("p", "?x", "?y"),)), Rule(("r", "?x"), (("p", "?x", 9),), name="none")]
    assert rows(rule_report(rules, facts)) == {("q", 2, 1), ("none", 0, 0)}


def test_rule_report_without_firings(spark):
    """Firings are counted along the join tree, as many as are listed; large products need no list."""
    r = random.Random(5)
    table = lambda n, m: spark.createDataFrame(sorted({(r.randrange(m), r.randrange(m)) for _ in range(n)}), "a1 long, a2 long")
    facts = {"p": table(30, 8), "q": table(30, 8), "s": table(20, 8), "t": spark.createDataFrame([(1,), (None,), (2,)], "a1 long")}
    bodies = [
        (("q", "?x"), (("p", "?x", "?y"), ("q", "?z", "?y"), ("s", "?z", "?w"))),
        (("h", "?y", "?z"), (("p", "?x", "?y"), ("q", "?z", "?y"), ("s", "?z", 3))),
        (("h", "?x"), (("p", "?x", "?y"), ("t", "?z"))),
        (("h", "?x", "?z"), (("p", "?x", "?y"), ("p", "?z", "?y"))),
        (("h", "?x"), (("p", "?x", "?y"), ("q", "?y", "?z"), ("s", "?z", "?x"))),
        (("h", "?x", "?w"), (("p", "?x", "?y"), ("q", "?y", "?w"))),
        (("h", "?x"), (("p", "?x", "?y"), ("s", 99, "?z"))),
        (("h", 7), (("p", "?x", "?y"), ("q", "?y", "?z"))),
        (("h", "?x"), (("p", "?x", "?y"), ("absent", "?y"))),
    ]
    rules = [Rule(h, b, name=str(i)) for i, (h, b) in enumerate(bodies)]
    listed = set()
    for rule in rules:
        made = firings(rule, facts).select("jid", "conseq").collect()
        listed.add((rule.name, len(made), len({x.conseq for x in made})))
    assert rows(rule_report(rules, facts)) == listed
    wide = {"p": spark.range(100_000).selectExpr("id a1", "id % 2 a2"), "q": spark.range(100_000).selectExpr("id a1", "id % 2 a2")}
    assert rows(rule_report([Rule(("h", "?x"), (("p", "?x", "?n"), ("q", "?y", "?n")))], wide)) == {("h", 5_000_000_000, 100_000)}


def test_firings_are_one_for_each_set_of_grounds(spark):
    """Also where nulls, spaces or a predicate read twice give the same grounds; whole numbers need no distinct over keys."""
    numbers = {"p": spark.createDataFrame([(1, None, 5), (1, 5, None), (1, 5, 6), (2, 5, 6), (1, 5, 6)], "a1 long, a2 long, a3 long"), "q": spark.createDataFrame([(1,), (2,)], "a1 long")}
    words = {"p": spark.createDataFrame([("a b", "c"), ("a", "b c"), ("a", "b")], "a1 string, a2 string")}
    cases = [(Rule(("h", "?x"), (("p", "?x", "?y", "?z"), ("q", "?x"))), numbers, 3), (Rule(("h", 1), (("p", "?x", "?y"),)), words, 2), (Rule(("h", "?z"), (("q", "?x"), ("q", "?z"))), numbers, 4), (Rule(("h", 1), (("q", "?x"), ("q", "?z"))), numbers, 3)]
    for rule, facts, n in cases:
        made = firings(rule, facts).collect()
        assert len(made) == len({x.jid for x in made}) == n
    text = firings(Rule(("h", "?x"), (("q", "?x"),)), numbers)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in text[: text.index("sha2")]


def test_dealt_by_size(spark, tmp_path):
    """Tables, mirrored pairs and firings are dealt into partitions in proportion to what is read; small ones stay."""
    from mortise.operators import meet

    spark.range(200_000).selectExpr("id a", "xxhash64(id) b").repartition(1).write.parquet(str(tmp_path / "big"))
    df = spark.read.parquet(str(tmp_path / "big"))
    assert meet.parts(spark.range(9)) == 1 and meet.parts(df) > 1 and meet.parts(df.union(df)) > meet.parts(df)
    assert meet.spread(df).rdd.getNumPartitions() == meet.parts(df) and meet.spread(spark.range(9)).rdd.getNumPartitions() == spark.range(9).rdd.getNumPartitions()
    for made in (closure.mirrored(df), registry.rel(spark, "/root/testdata/sf0.1", "lineitem", "l_suppkey", "l_partkey")):
        assert "RepartitionByExpression" in made._jdf.queryExecution().optimizedPlan().toString()


def test_rewriting(spark):
    rules = rewrite.oriented([("?x", "(plus ?x zero)"), ("(pred (succ ?x))", "?x")])
    assert rules[0][1] == "?x"
    with pytest.raises(ValueError):
        rewrite.oriented([("(plus ?x ?y)", "(plus ?y ?x)")])
    df = spark.createDataFrame([(1, "(plus (pred (succ a)) zero)"), (2, None), (3, ""), (4, "b"), (5, "b")], "i int, t string")
    assert rows(rewrite.normalised(df, "t", [("?x", "(plus ?x zero)"), ("(pred (succ ?x))", "?x")])) == {(1, "a"), (2, None), (3, ""), (4, "b"), (5, "b")}


def test_scenarios_against_all_models(spark):
    """Arrangements of four instants are those of all numberings that meet the statements."""
    of, r = qualitative.calculus("point"), random.Random(3)
    nodes = "abcd"
    for _ in range(3):
        said = [(x, y, r.choice([1, 2, 3, 5, 6])) for x, y in (("a", "b"), ("b", "c"), ("a", "d"))]
        df = spark.createDataFrame([("c0", *s) for s in said], "ctx string, a string, b string, mask int")
        found = {}
        for row in scenarios.scenarios(df, "point", 1000).collect():
            found.setdefault(row.scenario, set()).add((row.a, row.b, row.relation))
        want = set()
        for at in product(range(4), repeat=4):
            place = dict(zip(nodes, at, strict=True))
            rel = lambda x, y, place=place: qualitative.POINT[(place[x] > place[y]) - (place[x] < place[y]) + 1]
            if all(of.bit[rel(x, y)] & m for x, y, m in said):
                want.add(frozenset((x, y, rel(x, y)) for x in nodes for y in nodes if x < y))
        assert {frozenset(v) for v in found.values()} == want and len(found) == len(want)
    empty = df.limit(0)
    assert scenarios.scenarios(empty, "point", 5).count() == 0


def test_culprits(spark):
    of = qualitative.calculus("allen")
    m = of.mask("before")
    said = [("x", "1", "a", "b", m), ("x", "2", "b", "c", m), ("x", "3", "c", "a", m), ("x", "4", "a", "d", m), ("y", "5", "a", "b", m), ("y", "6", "b", "c", m), ("y", "7", "c", "d", m)]
    df = spark.createDataFrame(said, "ctx string, sid string, a string, b string, mask int")
    assert rows(scenarios.culprits(df, "allen")) == {("x", "1"), ("x", "2"), ("x", "3")}
    assert rows(scenarios.culprits(df, "allen", ("a", "before", "c"))) == {("y", "5"), ("y", "6")}


def test_derived_relations():
    for name in ("rcc8", "cardinal", "relative", "distance"):
        of = qualitative.calculus(name)
        held = [n for n, bases in qualitative.DERIVED.items() if set(bases) <= set(of.names)]
        assert held and all(0 < of.mask(n) < of.full for n in held)
    of = qualitative.calculus("relative")
    assert of.converse(of.mask("leftwardOf")) == of.mask("rightwardOf") and of.converse(of.mask("frontwardOf")) == of.mask("rearwardOf")


def test_status_and_metas(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "sid string")
    assert rows(belief.status(ids("a", "b", "c"), ids("a", "b"), ids("a"), ids("a"))) == {("a", True, True, True, False), ("b", True, False, False, False), ("c", False, False, False, False)}
    metas = spark.createDataFrame([("m1", "a"), ("m2", "m1"), ("m3", "b")], "sid string, target string")
    assert rows(belief.following(metas, ids("a"))) == {("m1",), ("m2",)}
    just = spark.createDataFrame([("j", "c", ["a", "b"])], "jid string, conseq string, ante array<string>")
    assert rows(belief.dependents(just, ids("b"))) == {("j", "c")}
