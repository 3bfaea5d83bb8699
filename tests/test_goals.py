"""Goals, rules and contexts: unfolding against forward chaining, negation, plans, caps that are gone."""

import random

import pytest
from pyspark.sql import functions as F

from mortise.operators import belief, closure, metric_time
from mortise.plans.compile import answer, query_plan
from mortise.plans.kb import KB
from mortise.plans.lang import Rule, canonical, plain
from mortise.plans.program import forward, forward_in, unfold


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def family(spark):
    kb = KB(spark).tell("parent", [("Tom", "Ann"), ("Ann", "Bob"), ("Bob", "Cid"), ("Tom", "Eve")]).tell("tall", [("Ann",), ("Cid",)])
    return kb.rule(
        Rule(("grand", "?x", "?z"), (("parent", "?x", "?y"), ("parent", "?y", "?z"))),
        Rule(("color", "?x", "red"), (("tall", "?x"),)),
        Rule(("same", "?z", "?z"), (("tall", "?z"),)),
        Rule(("odd", "?x"), (("parent", "?x", "?y"),), exceptions=((("tall", "?x"),),)),
        Rule(("never", "?x"), (("nowhere", "?x", "?y"),)),
    )


@pytest.mark.parametrize("goal", [
    ("color", "?y", "?c"), ("color", "?y", "blue"), ("color", "Ann", "red"), ("same", "?a", "?b"), ("same", "Ann", "?b"), ("odd", "?x"), ("never", "?x"),
    [("grand", "?x", "?z"), ("tall", "?z")], [("parent", "?x", "?y"), ("color", "?y", "?c")], [("same", "?a", "?b"), ("parent", "?a", "?d"), ("odd", "?d")],
    [("grand", "?x", "?z"), ("color", "?z", "?c"), ("unknown", [("tall", "?x")])],
])
def test_unfolded_goals_are_proved_goals(family, goal):
    got, want = family.query(goal, depth=2), family.prove(goal)
    assert rows(got.select(*sorted(got.columns))) == rows(want.select(*sorted(want.columns)))


def test_conjunction_reads_every_literal(spark):
    kb = KB(spark).tell("p", [(1, 2), (3, 4)]).tell("q", [(1,)])
    assert rows(kb.query([("p", "?x", "?y"), ("q", "?x")], depth=1)) == {(1, 2)}
    assert unfold([("p", "?x"), ("q", "?x")], [Rule(("q", "?x"), (("r", "?x"),))], 1, ["p", "r"]) == [[("p", "?x"), ("r", "?x")]]


def test_random_programs_both_ways(spark):
    r = random.Random(5)
    for _ in range(4):
        kb = KB(spark).tell("e", [(r.randrange(5), r.randrange(5)) for _ in range(7)]).tell("u", [(r.randrange(5),) for _ in range(2)])
        made = []
        for head, below in (("a", ["e", "u"]), ("b", ["e", "u", "a"])):
            for _ in range(2):
                body = tuple((p, "?x", "?y") if p != "u" else ("u", "?x") for p in r.sample(below, 2))
                made.append(Rule((head, "?x", r.choice(["?y", 7, "?x"]) if any(len(b) == 3 for b in body) else "?x"), body))
        kb = kb.rule(*made)
        goal = [("b", "?m", "?n"), ("e", "?m", "?k")]
        got, want = kb.query(goal, depth=2), kb.prove(goal)
        assert rows(got.select(*want.columns)) == rows(want)


def test_negative_literals_and_absence(spark):
    kb = KB(spark).tell("flies", [("Tweety",)]).tell("not flies", [("Pingu",)]).tell("bird", [("Tweety",), ("Pingu",), ("Unknown",)])
    assert rows(kb.query(("not", ("flies", "?x")))) == {("Pingu",)}
    assert rows(kb.query([("bird", "?x"), ("unknown", [("flies", "?x")]), ("unknown", [("not", ("flies", "?x"))])])) == {("Unknown",)}
    assert rows(kb.rule(Rule(("not", ("good", "?x")), (("not", ("flies", "?x")),))).prove(("not", ("good", "?x")))) == {("Pingu",)}
    assert plain(("not", ("not", ("p", "?x")))) == ("p", "?x")
    assert rows(kb.query([("bird", "?x"), ("unknown", [("absent", "?x")])])) == {("Tweety",), ("Pingu",), ("Unknown",)} and kb.query(("absent", "?x")).count() == 0


def test_predicates_below_others(spark):
    kb = KB(spark).tell("mother", [("Ann", "Bob")]).tell("father", [("Tom", "Bob")]).below("mother", "parent").below("father", "parent").below("parent", "kin")
    assert rows(kb.query(("kin", "?x", "Bob"))) == {("Ann",), ("Tom",)} and rows(kb.prove(("parent", "?x", "?y"))) == {("Ann", "Bob"), ("Tom", "Bob")}


def test_contexts_of_conclusions(spark):
    """Cx1 and Cx2 see Root, Both sees Cx1 and Cx2; Alone sees only itself."""
    edges = spark.createDataFrame([("Cx1", "Root"), ("Cx2", "Root"), ("Both", "Cx1"), ("Both", "Cx2")], "a string, b string")
    up = closure.reflexive(edges, spark.createDataFrame([("Alone",)], "a string"))
    facts = {
        "p": spark.createDataFrame([("Cx1", 1), ("Root", 2), ("Alone", 3)], "a1 string, a2 int"),
        "q": spark.createDataFrame([("Cx2", 1), ("Cx1", 2), ("Root", 3)], "a1 string, a2 int"),
    }
    rules = [Rule(("r", "?x"), (("p", "?x"), ("q", "?x"))), Rule(("s", "?x"), (("r", "?x"),)), Rule(("ist", "Root", ("t", "?x")), (("r", "?x"),)), Rule(("s", "?x"), (("s", "?x"), ("p", "?x")))]
    got = forward_in(facts, rules, up)
    assert rows(got["r"]) == {("Both", 1), ("Cx1", 2)} and rows(got["s"]) == rows(got["r"]) and rows(got["t"]) == {("Root", 1), ("Root", 2)}


def test_directions(spark, family):
    kb = KB(spark).tell("p", [(1,)]).rule(Rule(("f", "?x"), (("p", "?x"),), direction="forward"), Rule(("b", "?x"), (("p", "?x"),), direction="backward"), Rule(("i", "?x"), (("p", "?x"),), direction="inert"))
    assert [kb.prove((h, "?x")).count() for h in "fbi"] == [1, 0, 0] and [kb.query((h, "?x"), depth=1).count() for h in "fbi"] == [0, 1, 0]
    with pytest.raises(ValueError):
        Rule(("p", "?x"), (("q", "?x"),), direction="sideways")


def test_canonical_forms():
    a = [("p", "?b", "?a"), ("q", "?a", 3), ("greaterThan", "?a", "?b"), ("kin", "?b", "?a"), ("kin", "x", "?a")]
    b = [("kin", "?n", "x"), ("lessThan", "?m", "?n"), ("kin", "?n", "?m"), ("q", "?n", 3), ("p", "?m", "?n"), ("q", "?n", 3)]
    assert canonical(a, ["kin"])[:1] == canonical(b, ["kin"])[:1] and {x[0] for x in canonical(a)} == {"p", "q", "lessThan", "kin"}
    assert canonical([("p", "?x", "?y")]) == canonical([("p", "?u", "?v")]) != canonical([("p", "?x", "?x")])


def test_pages_mentions_and_edits(spark):
    kb = KB(spark).tell("p", [(i, f"t{i}") for i in range(5)]).tell("q", [("(f t1)",), ("t10",)])
    first, status, resume = kb.page(("p", "?x", "?y"), 3)
    rest, done, none = kb.page(("p", "?x", "?y"), 3, resume)
    assert status == "partial" and done == "complete" and none is None and rows(first) | rows(rest) == {(i, f"t{i}") for i in range(5)} and first.count() == 3
    assert {(r.predicate, *r.args) for r in kb.mentions("t1").collect()} == {("p", "1", "t1"), ("q", "(f t1)")} and kb.mentions("t1", "f").count() == 1
    assert kb.edit({"p": [(9, "t9")]}, {"p": [(0, "t0")]}).counts().where("predicate = 'p'").first().n == 5
    assert {r[0] for r in kb.functor("q").select("predicate").collect()} == {"q"} and len(list(kb.solutions(("p", "?x", "?y")))) == 5


def test_plans_start_with_the_rarest(spark):
    kb = KB(spark).tell("big", [(i, i % 3) for i in range(60)]).tell("few", [(1,), (2,)])
    plan = query_plan(kb.facts, [("big", "?x", "?y"), ("few", "?x")]).orderBy("step").collect()
    assert [r.literal.split()[0] for r in plan] == ["few", "big"] and plan[1].rows < 60


def test_long_chains_close(spark):
    edges = spark.range(150).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert closure.transitive(edges).count() == 150 * 151 // 2
    just = spark.range(20).select(F.col("id").cast("string").alias("jid"), F.concat(F.lit("f"), F.col("id") + 1).alias("conseq"), F.array(F.concat(F.lit("f"), "id")).alias("ante"))
    held = spark.range(21).select(F.concat(F.lit("f"), "id").alias("sid"))
    root = spark.createDataFrame([("f20",)], "sid string")
    assert belief.why(just, held, root).count() == 20 and belief.why(just, held, root, depth=3).count() == 3


def test_idle_rules(spark):
    out = forward({"p": spark.range(2).toDF("a1")}, [Rule(("q", "?x"), (("absent", "?x"), ("p", "?x"))), Rule(("r", "?x"), (("p", "?x"),))])
    assert out["q"].count() == 0 and out["r"].count() == 2


def test_overlap_window(spark):
    spans = spark.createDataFrame([("a", 0.0, 1.0, 5.0, 6.0), ("b", 4.0, 4.0, 9.0, 9.0), ("c", 7.0, 8.0, 9.0, 9.0)], "i string, start_lo double, start_hi double, end_lo double, end_hi double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "z")], "i string, j string")
    assert rows(metric_time.overlap_window(spans, pairs)) == {("a", "b", 1.0, 2.0), ("a", "c", 0.0, 0.0)}


def test_pairs_of_two_literals(spark):
    """Answers of two literals that share variables are distinct, also where what is cut off has several values, repeats or is null."""
    r = random.Random(11)
    pick = lambda n: r.choice([None, *range(n)])
    for n in (3, 40):
        p, q = ([(pick(9), pick(n), pick(4)) for _ in range(40)] for _ in range(2))
        p += p[:5]
        facts = {k: spark.createDataFrame(v, "a1 long, a2 long, a3 long") for k, v in (("p", p), ("q", q))}
        for a, b in ((p, q), (p, p)):
            goal = [("p", "?x", "?k", "?u"), ("q" if b is q else "p", "?y", "?k", "?w")]
            some = [(x, u, y, w) for x, k, u in a for y, m, w in b if k == m and k is not None]
            for extra, keep in (([], lambda t: True), ([("lessThan", "?u", "?w")], lambda t: None not in (t[1], t[3]) and t[1] < t[3]), ([("different", "?x", "?y")], lambda t: None not in (t[0], t[2]) and t[0] != t[2])):
                got = answer(facts, goal + extra, ["x", "y"]).collect()
                want = {(t[0], t[2]) for t in some if keep(t)}
                assert len(got) == len(want) and {tuple(t) for t in got} == want
    named = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, 5, "c"), (4, 5, None), (5, 6, "a"), (1, 5, "c")], "a1 long, a2 long, a3 string")
    rep = spark.createDataFrame([("a", "a"), ("b", "a")], "term string, rep string")
    got = answer({"n": named}, [("n", "?x", "?k", "?s"), ("n", "?y", "?k", "?t"), ("different", "?s", "?t")], ["x", "y"], rep).collect()
    assert sorted(tuple(t) for t in got) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]


def test_pairs_need_no_distinct(spark):
    """Pairs over few hot values come from the join as they are: nothing after it is dealt or aggregated again."""
    facts = {"p": spark.range(2000).selectExpr("id a1", "id % 2 a2").distinct()}
    plan = answer(facts, [("p", "?x", "?n"), ("p", "?y", "?n"), ("different", "?x", "?y")], ["x", "y"])
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in text[: text.index("Join Inner")] and plan.count() == 2 * 1000 * 999


def test_pairs_are_compared_by_class(spark):
    """Where a few values decide on many pairs, rows of one value are joined as arrays: the comparison is part of the join, and no pair is lost or comes twice."""
    from mortise.operators.meet import crossed

    left = [(i if i % 11 else None, None if i % 50 == 0 else 7 if i % 3 else i % 5, f"c{i % 4}" if i % 13 else None) for i in range(200)]
    right = [(*row, i if i % 17 else None) for i, row in enumerate(left)]
    a, b = spark.createDataFrame(left, "x long, k long, l string"), spark.createDataFrame(right, "y long, k long, r string, z long")
    order = lambda rows: sorted(map(str, rows))
    want = [(x, c, y, d, z) for x, k, c in left for y, m, d, z in right if k == m and k is not None and None not in (c, d) and c != d]
    for pairs, rows in ((100, 7), (100, 1), (5000, 1000), (10_000_000, 2048)):
        two = crossed(a, b, ["k"], ["r"], pairs, rows).where("l <> r")
        assert order(tuple(t) for t in two.select("x", "l", "y", "r", "z").collect()) == order(want)
        one = crossed(a, b.drop("z"), ["k"], ["r"], pairs, rows).where("l <> r")
        assert order(tuple(t) for t in one.select("x", "l", "y", "r").collect()) == order(t[:4] for t in want)
    sizes = crossed(a, b, ["k"], ["r"], 100, 7).rdd.glom().map(len).collect()
    assert max(sizes) < sum(sizes) / 8
    facts = {"p": spark.range(4000).selectExpr("id a1", "id % 2 a2", "concat('n', id % 10) a3").distinct()}
    rep = spark.createDataFrame([("n2", "n0"), ("n3", "n1")], "term string, rep string")
    found = answer(facts, [("p", "?x", "?k", "?s"), ("p", "?y", "?k", "?t"), ("different", "?s", "?t")], ["x", "y"], rep)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Generate explode(_rows") < text.index("Join Inner")
    line = next(line for line in text.splitlines() if "Join Inner" in line)
    assert "NOT (_rv_s" in line and "rightHint=(strategy=merge)" in line
    assert found.count() == found.distinct().count() == 2 * (2000 * 2000 - 800 * 800 - 3 * 400 * 400)
