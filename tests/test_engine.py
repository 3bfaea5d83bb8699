"""The engine against SQL on the small tables, and against small brute-force versions."""

import random
from itertools import product

import duckdb
import pytest

from mortise.operators import belief, closure, constraints, context, metric_time, qualitative
from mortise.plans import further, registry  # noqa: F401 (further adds queries)
from mortise.plans.compile import answer
from mortise.plans.kb import KB
from mortise.plans.lang import Rule, split_heads, strata
from mortise.plans.program import forward
from mortise.sources import store
from mortise.streaming.feed import Feed

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("~" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_is_its_sql(spark, sql, name):
    got, expected = registry.queries()[name](spark, SF).toPandas(), sql.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and rows(got) == rows(expected)


def pairs(spark, edges):
    return spark.createDataFrame(list(edges), "a long, b long")


def test_closure_on_random_graphs(spark):
    r = random.Random(1)
    edges = {(r.randrange(12), r.randrange(12)) for _ in range(18)}
    reach = set(edges)
    while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
        reach |= more
    assert {tuple(x) for x in closure.transitive(pairs(spark, edges)).collect()} == reach
    names = {x.a: x["name"] for x in closure.cycles(closure.reflexive(pairs(spark, edges))).collect()}
    assert all(names[a] == min([a] + [b for b in range(12) if (a, b) in reach and (b, a) in reach]) for a in names)


def test_preferred_names(spark):
    got = closure.components(pairs(spark, [(1, 2), (2, 3), (7, 8)]), spark.createDataFrame([(3,), (2,)], "term long"))
    assert {x.term: x.rep for x in got.collect()} == {1: 2, 2: 2, 3: 2, 7: 7, 8: 7}


def test_order_of_rules_and_rows_does_not_matter(spark):
    facts = [(1, 2), (2, 3), (3, 1), (3, 4)]
    rules = [Rule(("p", "?x", "?y"), (("e", "?x", "?y"),)), Rule(("p", "?x", "?z"), (("p", "?x", "?y"), ("p", "?y", "?z"))), Rule(("q", "?x"), (("p", "?x", "?x"), ("different", "?x", 2)))]
    seen = set()
    for seed in range(3):
        r = random.Random(seed)
        kb = KB(spark).tell("e", r.sample(facts, 4)).rule(*r.sample(rules, 3))
        out = kb.closed()
        seen.add((frozenset(map(tuple, out["p"].collect())), frozenset(map(tuple, out["q"].collect()))))
    assert len(seen) == 1 and next(iter(seen))[1] == {(1,), (3,)}


def test_rules_are_checked():
    with pytest.raises(ValueError):
        Rule(("p", "?x", "?y"), (("e", "?x", "?x"),))
    with pytest.raises(ValueError):
        Rule(("p", "?x"), (("?r", "?x", "?x"),))
    with pytest.raises(ValueError):
        strata([Rule(("p", "?x"), (("e", "?x"), ("unknown", [("q", "?x")]))), Rule(("q", "?x"), (("p", "?x"),))])
    assert [r.head[0] for r in split_heads([("a", "?x"), ("b", "?x")], (("e", "?x"),))] == ["a", "b"]


def test_aggregates_take_distinct_values(spark):
    kb = {"team": spark.createDataFrame([("t",), ("none",)], "a1 string"), "score": spark.createDataFrame([("t", v) for v in (3.0, 1.0, 4.0, 1.0, 5.0)], "a1 string, a2 double").distinct()}
    for kind, value, empty in (("count", 4, 0), ("sum", 13, 0), ("min", 1, None), ("max", 5, None), ("avg", 3.25, None)):
        got = {x.t: x.n for x in answer(kb, [("team", "?t"), (f"agg/{kind}", "?n", "?v", [("score", "?t", "?v")])], ["t", "n"]).collect()}
        assert got == ({"t": value} if empty is None else {"t": value, "none": empty})


def brute_labels(premises, just):
    now = {}
    while True:
        new = dict(premises)
        for conseq, ante, s in just:
            if all(a in now for a in ante):
                new[conseq] = max(new.get(conseq, 0), min([s, *(now[a] for a in ante)]))
        if new == now:
            return now
        now = new


def test_labels_against_brute_force(spark):
    r = random.Random(4)
    names = [f"n{i}" for i in range(14)]
    premises = {n: r.randint(1, 2) for n in r.sample(names, 4)}
    just = [(r.choice(names), tuple(r.sample(names, r.randint(1, 2))), r.randint(1, 2)) for _ in range(20)]
    got = belief.labels(spark.createDataFrame(list(premises.items()), "sid string, s int"), spark.createDataFrame([(f"j{i}", c, list(a), s) for i, (c, a, s) in enumerate(just)], "jid string, conseq string, ante array<string>, s int"))
    assert {x.sid: x.s for x in got.collect()} == brute_labels(premises, just)


def test_clashes_defeat_the_weakest(spark):
    premises = spark.createDataFrame([("bird", 2), ("penguin", 2)], "sid string, s int")
    just = spark.createDataFrame([("j1", "flies", ["bird"], 1), ("j2", "not flies", ["penguin"], 2), ("j3", "travels", ["flies"], 2)], "jid string, conseq string, ante array<string>, s int")
    facts = spark.createDataFrame([("flies", "flies", True), ("not flies", "flies", False)], "sid string, body string, truth boolean")
    held, defeated, left = belief.resolve(premises, just, facts)
    assert {x.sid for x in held.collect()} == {"bird", "penguin", "not flies"} and [x.sid for x in defeated.collect()] == ["flies"] and left.isEmpty()
    proof = belief.why(just, held, spark.createDataFrame([("not flies",)], "sid string"))
    assert [tuple(x) for x in proof.collect()] == [("j2", "not flies", "penguin")]


def test_placement_meets_contexts(spark):
    up = closure.reflexive(spark.createDataFrame([("leaf", "a"), ("leaf", "b"), ("deep", "leaf"), ("a", "top"), ("b", "top")], "a string, b string"))
    grounds = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "top"), (3, "top")], "firing int, ctx string")
    assert {tuple(x) for x in context.placement(grounds, up).collect()} == {(1, "leaf"), (2, "a"), (3, "top")}


def test_constraints(spark):
    p = pairs(spark, [(1, 2), (2, 1), (3, 3), (2, 3), (1, 3), (1, 4)])
    assert {tuple(x) for x in constraints.asymmetric(p).collect()} == {(1, 2), (3, 3)}
    assert {tuple(x) for x in constraints.irreflexive(p).collect()} == {(3, 3)}
    assert (1, 2, 3) in {tuple(x) for x in constraints.anti_transitive(p).collect()}
    assert {tuple(x) for x in constraints.functional_equalities(p.where("a = 1")).collect()} == {(2, 3), (2, 4)}


def test_composition_tables():
    allen, rcc = qualitative.calculus("allen"), qualitative.calculus("rcc8")
    assert sum(m.bit_count() for m in allen.compose.values()) == 409 and sum(m.bit_count() for m in rcc.compose.values()) == 193
    for of in (allen, rcc, qualitative.calculus("point"), qualitative.calculus("cardinal")):
        assert all(of.converse(m) == of.compose[of.converse_of[b], of.converse_of[a]] for (a, b), m in of.compose.items())
        assert all(of.converse(of.converse(m)) == m for m in of.compose.values())


def test_path_consistency_is_sound(spark):
    of, r = qualitative.calculus("allen"), random.Random(6)
    spans = [tuple(sorted(r.sample(range(9), 2))) for _ in range(6)]
    stated = [(0, a, b, of.bit[qualitative.allen_of(spans[a], spans[b])]) for a, b in product(range(6), repeat=2) if a < b and r.random() < 0.6]
    tight = qualitative.path_consistent(spark.createDataFrame(stated, "ctx int, a int, b int, mask int"), of)
    assert all(x["mask"] & of.bit[qualitative.allen_of(spans[x.a], spans[x.b])] for x in tight.collect())
    bad = spark.createDataFrame([(1, 0, 1, of.mask("before")), (1, 1, 2, of.mask("before")), (1, 2, 0, of.mask("before"))], "ctx int, a int, b int, mask int")
    assert not qualitative.path_consistent(bad, of).where("mask = 0").isEmpty()


def test_bounds_and_inconsistency(spark):
    gaps = [(0, "a", "b", 1.0, 2.0), (0, "b", "c", 3.0, 4.0), (0, "a", "c", 0.0, 5.0), (1, "x", "y", 2.0, 3.0), (1, "y", "x", 2.0, 3.0)]
    got = {(x.ctx, x.p, x.q): (x.lo, x.hi) for x in metric_time.bounds(spark.createDataFrame(gaps, "ctx int, p string, q string, lo double, hi double")).collect()}
    assert got[0, "a", "c"] == (4.0, 5.0) and not any(c == 1 for c, *_ in got)


def test_dump_round_trip_and_text(spark, tmp_path):
    kb = KB(spark).tell("e", [(1, 2), (2, 3)])
    kb.export(str(tmp_path / "kb"))
    assert rows(KB.load(spark, str(tmp_path / "kb")).facts["e"].toPandas()) == rows(kb.facts["e"].toPandas())
    (tmp_path / "f.txt").write_text("; a comment\n(parentOf Tom Ann)\n(parentOf Ann Bob) ; more\n(dog Rex)\n(parentOf Tom Ann)\n(parentOf Sue) (not (dog Tom))\n(owns Tom\n  (sonOf Ann))\n(says Tom \"a;b (c\")\n(likes ?x Tom)")
    (tmp_path / "g.txt").write_text("(broken")
    read = store.read_sentences(spark, [str(tmp_path / "f.txt"), str(tmp_path / "g.txt")])
    assert {tuple(x) for x in read.where("reason is not null").select("reason").collect()} == {("not ground",), ("a bracket is missing",)}
    facts = store.read_facts(spark, str(tmp_path / "f.txt"), "CxTest")
    assert {tuple(x) for x in facts["parentOf", 2].collect()} == {("CxTest", "Tom", "Ann"), ("CxTest", "Ann", "Bob")} and facts["dog", 1].count() == 1
    assert {k: [tuple(x)[1:] for x in facts[k].collect()] for k in facts if k[0] in ("owns", "says", "not dog") or k[1] == 1 and k[0] == "parentOf"} == {("owns", 2): [("Tom", "(sonOf Ann)")], ("says", 2): [("Tom", "a;b (c")], ("not dog", 1): [("Tom",)], ("parentOf", 1): [("Sue",)]}
    assert store.parse('(a (b 1) "c d") ; x') == [["a", ["b", 1], "c d"]]
    assert store.generated(spark, 5, 10)["genl"].count() == 4


def test_feed_follows_a_stream(spark, tmp_path):
    seen = []
    feed = Feed(lambda stated: stated.where("x > 1"))
    feed.watch("all", lambda changes, n: seen.append((n, sorted((r.x, r.change) for r in changes.collect()))))
    feed.watch("big", lambda changes, n: seen.append(("big", changes.count())), "x > 5")
    for i, batch in enumerate(([(1, "assert"), (2, "assert")], [(2, "retract"), (7, "assert")])):
        spark.createDataFrame(batch, "x int, op string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("x int, op string").parquet(str(tmp_path / "in"))
        q = feed.start(stream, str(tmp_path / "ck"))
        q.processAllAvailable()
        q.stop()
    assert seen == [(0, [(2, "added")]), ("big", 0), (1, [(2, "removed"), (7, "added")]), ("big", 1)]


@pytest.mark.parametrize("seed", range(4))
def test_linear_closure_over_classes(spark, seed):
    """p <- p q and closures of blocks give all pairs, without a round for each step of a block."""
    r, n = random.Random(seed), 14
    edge = {(r.randrange(n), r.randrange(n)) for _ in range(12)}
    edge |= {(b, a) for a, b in list(edge)[:6]} | {(3, None), (None, 4)}
    start = {(r.choice([None, *range(n)]), r.choice([None, *range(n + 3)])) for _ in range(9)}
    table = lambda x: spark.createDataFrame(sorted(x, key=str), "a1 long, a2 long")
    got = forward({"s": table(start), "q": table(edge)}, [Rule(("p", "?x", "?y"), (("s", "?x", "?y"),)), Rule(("p", "?a", "?c"), (("q", "?b", "?c"), ("p", "?a", "?b")))])["p"].collect()
    want = set(start)
    while more := {(x, z) for x, y in want for a, z in edge if y == a and y is not None} - want:
        want |= more
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    owns = {(r.choice([None, *range(n)]), r.choice([None, *range(7)])) for _ in range(16)} | ({(None, 99)} if seed else set())
    rules = [Rule(("shares", "?x", "?y"), (("owns", "?x", "?k"), ("owns", "?y", "?k"))), Rule(("reach", "?x", "?y"), (("shares", "?x", "?y"),)), Rule(("reach", "?x", "?z"), (("reach", "?x", "?y"), ("shares", "?y", "?z")))]
    got = forward({"owns": table(owns)}, rules)["reach"].collect()
    shares = {(a, b) for a, k in owns for b, m in owns if k == m and k is not None}
    want = set(shares)
    while more := {(x, z) for x, y in want for a, z in shares if y == a and y is not None} - want:
        want |= more
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    alone = forward({"owns": table({(None, 1), (None, 2)})}, rules)["reach"].collect()
    assert [tuple(x) for x in alone] == [(None, None)]


def test_hot_keys_are_dealt(spark):
    """A key of many pairs is cut into chunks; all pairs come, none twice."""
    from mortise.operators.meet import met

    left, right = ([(i, None if i % 50 == 0 else 7 if i % 3 else i % 5, v) for i in range(200)] for v in ("l", "r"))
    a, b = spark.createDataFrame(left, "x long, k long, l string"), spark.createDataFrame(right, "y long, k long, r string")
    want = sorted((x, y) for x, k, _ in left for y, m, _ in right if k == m and k is not None)
    for pairs in (100, 10_000_000):
        assert sorted((t.x, t.y) for t in met(a, b, ["k"], pairs).collect()) == want
    sizes = met(a, b, ["k"], 100).rdd.glom().map(len).collect()
    assert max(sizes) < len(want) / 8


def test_a_closure_of_blocks_is_answered_without_a_shuffle_of_its_pairs(spark):
    """Its pairs are apart already: none comes twice, by whatever names."""
    from mortise.operators.loops import settled

    rules = [Rule(("shares", "?x", "?y"), (("owns", "?x", "?k"), ("owns", "?y", "?k"))), Rule(("reach", "?x", "?y"), (("shares", "?x", "?y"),)), Rule(("reach", "?x", "?z"), (("reach", "?x", "?y"), ("shares", "?y", "?z")))]
    n = 300
    owns = [(i, j) for i in range(n) for j in (i, i + 2)] * 2 + [(None, 1)]
    closed = forward({"owns": spark.createDataFrame(owns, "a1 long, a2 long").repartition(3)}, rules)
    sides = [{i for i in range(n) if i % 2 == 0}, {i for i in range(n) if i % 2} | {None}]
    want = {(a, b) for s in sides for a in s for b in s}
    for got in (answer(closed, ("reach", "?x", "?y")), answer(closed, ("reach", "?x", "?y"), ["y", "x"])):
        rows = [tuple(x) for x in got.collect()]
        assert len(rows) == len(want) and set(rows) == want
        assert got._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() != "Aggregate"
    # Other goals, and tables put in its place, are still made distinct.
    assert answer(closed, ("reach", "?x", "?y"), ["x"]).count() == n + 1
    assert [tuple(x) for x in answer(closed, ("reach", "?x", "?x")).where("x = 4").collect()] == [(4,)]
    assert {tuple(x) for x in answer(closed, ("reach", 0, "?y")).collect()} == {(i,) for i in sides[0]}
    closed["reach"] = settled(spark.createDataFrame([(1, 2), (1, 2)], "a1 long, a2 long"))
    assert answer(closed, ("reach", "?x", "?y")).count() == 1
