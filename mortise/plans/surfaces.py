"""Further registered queries: levels, abduction, networks in goals, upkeep, terms, declarations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from mortise.operators import belief, closure, constraints, context, metric_time, qualitative, solve, terms
from mortise.operators.meet import spread
from mortise.plans import abduce, census
from mortise.plans.compile import answer
from mortise.plans.further import chained
from mortise.plans.kb import KB
from mortise.plans.lang import Rule, split_heads
from mortise.plans.levels import Levels
from mortise.plans.program import extended, firings, forward, forward_in
from mortise.plans.registry import OPINIONS, SPANS, TYPE_EDGES, context_facts, contexts, opinions, query, read, rel, trade, type_edges


def tag(p: str, c: str, name: str | None = None):
    """A key with a letter before it, so that keys of several tables don't meet."""
    out = F.concat(F.lit(p), F.col(c).cast("string"))
    return out.alias(name) if name else out


# --- goals


@query("b3_exact_context", "SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier WHERE s_nationkey = 3 UNION SELECT s_suppkey + 1, s_suppkey FROM supplier WHERE s_nationkey = 3")
def b3(spark, sf):
    """Neighbouring suppliers, stated in the nation's context; the relation is symmetric."""
    facts = read(spark, sf, "supplier").select(tag("n", "s_nationkey", "ctx"), F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    return context.exactly(facts, "n3", ("a", "b")).select("a", "b")


@query("b8_believed", f"SELECT 'good ' || doc_id AS sid FROM {OPINIONS} WHERE toxic = 0 UNION ALL SELECT 'not good ' || doc_id FROM {OPINIONS} WHERE toxic = 1")
def b8(spark, sf):
    """A reader only gets facts that are believed and visible."""
    premises, just, facts = opinions(spark, sf)
    held = belief.resolve(premises, just, facts)[0]
    return belief.status(facts, facts, held, facts.limit(0)).where("visible").select("sid")


NOUN = "string_split(p_name, ' ')[-1]"


@query("b10_retired", f"SELECT p_partkey AS p, p_name AS name FROM part x WHERE p_name <> (SELECT min(p_name) FROM part q WHERE {NOUN.replace('p_name', 'q.p_name')} = {NOUN.replace('p_name', 'x.p_name')})")
def b10(spark, sf):
    """Names of one noun were merged: facts under a retired spelling are filtered out, here listed."""
    part = read(spark, sf, "part").select(F.col("p_partkey").alias("p"), F.col("p_name").alias("name"))
    return terms.superseded(part, _names(spark, sf), "name")


def _names(spark, sf):
    """(term, rep): part names that share their noun are equal; they are linked in a chain."""
    part = read(spark, sf, "part").select("p_name", F.element_at(F.split("p_name", " "), -1).alias("noun")).distinct()
    later = part.select("noun", F.col("p_name").alias("b"))
    links = part.join(later, "noun").where("p_name < b").groupBy("p_name").agg(F.min("b").alias("b"))
    return closure.components(links.select(F.col("p_name").alias("a"), "b"))


@query("b12_different_classes", f"SELECT DISTINCT x.p_partkey AS p, y.p_partkey AS q FROM part x JOIN part y ON x.p_size = y.p_size AND x.p_brand = y.p_brand WHERE {NOUN.replace('p_name', 'x.p_name')} <> {NOUN.replace('p_name', 'y.p_name')}")
def b12(spark, sf):
    """`different` is about equality classes: names of one noun aren't different."""
    t = {"made": rel(spark, sf, "part", "p_partkey", "p_brand", "p_size", "p_name")}
    goal = [("made", "?p", "?b", "?z", "?n"), ("made", "?q", "?b", "?z", "?m"), ("different", "?n", "?m")]
    return answer(t, goal, ["p", "q"], _names(spark, sf))


@query("b14_quoted", f"SELECT DISTINCT p_partkey AS p, (SELECT min(p_name) FROM part q WHERE {NOUN.replace('p_name', 'q.p_name')} = {NOUN.replace('p_name', 'x.p_name')}) AS name, p_name AS quoted FROM part x")
def b14(spark, sf):
    """What is used is rewritten to its representative, what is mentioned stays as written."""
    part = read(spark, sf, "part").select(F.col("p_partkey").alias("p"), F.col("p_name").alias("name"), F.col("p_name").alias("quoted"))
    return terms.rewritten(part, _names(spark, sf), "name")


@query("c2_ask", "SELECT DISTINCT s_suppkey AS s, n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT s_suppkey, -1 FROM supplier")
def c2(spark, sf):
    """Stated facts, closures and computed tables answer together, without any rule."""
    nation = read(spark, sf, "nation").select(F.lit("here").alias("ctx"), tag("n", "n_nationkey", "a1"), tag("r", "n_regionkey", "a2"))
    stated = read(spark, sf, "supplier").select(F.lit("here").alias("ctx"), tag("s", "s_suppkey", "a1"), tag("n", "s_nationkey", "a2"))
    world = stated.select("a1", F.lit("r-1").alias("a2")).distinct()
    up = spark.createDataFrame([("here", "here")], "a string, b string")
    found = Levels({"partOf": stated.union(nation)}, up, transitive=("partOf",), solvers={"partOf": world}).lookup(6, ("partOf", "?s", "?r"), "here")
    key = lambda c: F.substring(c, 2, 20).cast("int").alias(c)
    return found.where("s like 's%' and r like 'r%'").select(F.substring("s", 2, 20).cast("long").alias("s"), key("r"))


_S3, _N3, _R = "(SELECT count(*) FROM supplier WHERE s_nationkey = 3)", "(SELECT count(*) FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3))", "(SELECT count(*) FROM region)"


@query(
    "c7_levels",
    f"SELECT * FROM (VALUES (0, 'raw', {_R}), (1, 'extent', 0), (2, 'local', 0), (3, 'visible', {_R}), (4, 'typed', {_R} + {_S3} + {_N3}), (5, 'closed', {_R} + 3 * {_S3} + 2 * {_N3}), "
    f"(6, 'solved', 1 + {_R} + 3 * {_S3} + 2 * {_N3}), (7, 'proved', 1 + 2 * {_R} + 4 * {_S3} + 3 * {_N3})) AS t(level, name, n)",
)
def c7(spark, sf):
    """Regions are part of the world; nations and suppliers become so by one mechanism after another."""
    facts = {
        "partOf": read(spark, sf, "region").select(F.lit("root").alias("ctx"), tag("r", "r_regionkey", "a1"), F.lit("world").alias("a2")),
        "inRegion": read(spark, sf, "nation").select(tag("r", "n_regionkey", "ctx"), tag("n", "n_nationkey", "a1"), tag("r", "n_regionkey", "a2")),
        "inNation": read(spark, sf, "supplier").select(tag("n", "s_nationkey", "ctx"), tag("s", "s_suppkey", "a1"), tag("n", "s_nationkey", "a2")),
    }
    stack = Levels(
        facts, contexts(spark, sf), genl=(("inRegion", "partOf"), ("inNation", "partOf")), transitive=("partOf",),
        solvers={"partOf": spark.createDataFrame([("world", "universe")], "a1 string, a2 string")},
        rules=(Rule(("partOf", "?x", "nature"), (("partOf", "?x", "world"),)),),
    )
    return stack.explain(("partOf", "?x", "?y"), "n3")


_BIG = "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"


@query(
    "c10_abduction",
    f"SELECT c_custkey AS c, CASE WHEN c_acctbal > 5000 THEN 'big ' || c_custkey WHEN {_BIG} THEN 'rich ' || c_custkey ELSE 'big ' || c_custkey || ',rich ' || c_custkey END AS missing, "
    f"CASE WHEN c_acctbal > 5000 OR {_BIG} THEN 1 ELSE 2 END AS n FROM customer WHERE NOT (c_acctbal > 5000 AND {_BIG})",
)
def c10(spark, sf):
    """What each customer lacks to be a prime one: a big order, riches, or both."""
    t = trade(spark, sf)
    t["big"] = answer(t, [("ordered", "?c", "?o"), ("price", "?o", "?p"), ("lessThan", 400000, "?p")], ["c"]).toDF("a1")
    t["rich"] = t["balance"].where("a2 > 5000").select("a1")
    prime = Rule(("prime", "?c"), (("customer", "?c"), ("big", "?c"), ("rich", "?c")))
    return abduce.abduce(t, ("prime", "?c"), ["big", "rich"], [prime], 1).select("c", F.array_join("missing", ",").alias("missing"), "n")


@query("c12_query_plan", "SELECT * FROM (VALUES (0, 'inRegion ?n 0'), (1, 'inNation ?s ?n'), (2, 'supplies ?s ?p')) AS t(step, literal)")
def c12(spark, sf):
    """Join order by statistics: the literal with a constant goes first, though it is written last."""
    return KB(spark, trade(spark, sf)).plan([("supplies", "?s", "?p"), ("inNation", "?s", "?n"), ("inRegion", "?n", 0)]).select("step", "literal")


@query("d14_probe", "SELECT DISTINCT l_orderkey AS o FROM lineitem WHERE l_suppkey = 5 AND l_quantity = 10")
def d14(spark, sf):
    """Two constants narrow one scan."""
    return answer({"line": rel(spark, sf, "lineitem", "l_orderkey", "l_suppkey", "l_quantity")}, ("line", "?o", 5, 10), ["o"])


@query("d8_network_join", "SELECT s_suppkey AS s, b.n_nationkey AS b FROM supplier JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def d8(spark, sf):
    """A rule body reads what the network of a region's nations entails."""
    of = qualitative.calculus("allen")
    tight = qualitative.path_consistent(chained(spark, sf, of, "before"), of)
    t = trade(spark, sf) | {"before": qualitative.entailed(tight, of, "before").select(F.col("a").alias("a1"), F.col("b").alias("a2"))}
    rule = Rule(("sellsBefore", "?s", "?b"), (("inNation", "?s", "?a"), ("before", "?a", "?b")))
    return answer(forward(t, [rule]), ("sellsBefore", "?s", "?b"))


@query("d9_preserved_join", f"SELECT DISTINCT l_suppkey AS s FROM lineitem JOIN part ON p_partkey = l_partkey WHERE {NOUN} <> 'widget'")
def d9(spark, sf):
    """Things are sold by default and widgets aren't: a goal joins on the inherited claim."""
    claims = spark.createDataFrame([("sold", "thing", True, 1), ("sold", "widget", False, 1)], "x string, node string, truth boolean, s int")
    sold = terms.preserved(claims, closure.reflexive(type_edges(spark, sf))).where("truth").select(F.col("z").alias("a1"))
    t = trade(spark, sf) | {"named": rel(spark, sf, "part", "p_partkey", "p_name"), "sold": sold}
    return answer(t, [("supplies", "?s", "?p"), ("named", "?p", "?n"), ("sold", "?n")], ["s"])


# --- rules and upkeep


@query("e2_fire_on_fact", "SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey")
def e2(spark, sf):
    """Orders of a later year fire the rule over what was closed before them; the end is as if all were there at once."""
    t = trade(spark, sf)
    orders = read(spark, sf, "orders")
    own = lambda when: orders.where(when).select(F.col("o_custkey").alias("a1"), F.col("o_orderkey").alias("a2")).distinct()
    cut = "o_orderdate < timestamp_ntz'1996-01-01'"
    facts = {"ordered": own(cut), "customerIn": t["customerIn"], "inNation": t["inNation"], "sold": rel(spark, sf, "lineitem", "l_orderkey", "l_suppkey")}
    rules = [Rule(("soldFrom", "?o", "?b"), (("sold", "?o", "?s"), ("inNation", "?s", "?b"))), Rule(("buysFrom", "?a", "?b"), (("ordered", "?c", "?o"), ("soldFrom", "?o", "?b"), ("customerIn", "?c", "?a")))]
    return answer(extended(forward(facts, rules), rules, {"ordered": own(f"not ({cut})")}), ("buysFrom", "?a", "?b"))


@query("e3_fire_on_rule", "SELECT s_suppkey AS s FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2")
def e3(spark, sf):
    """A rule that arrives last meets all that the others concluded."""
    t = {k: v for k, v in trade(spark, sf).items() if k in ("inNation", "inRegion")}
    first = [Rule(("sellsIn", "?s", "?r"), (("inNation", "?s", "?n"), ("inRegion", "?n", "?r")))]
    return answer(extended(forward(t, first), first, new_rules=[Rule(("second", "?s"), (("sellsIn", "?s", 2),))]), ("second", "?s"))


@query("e4_record_firing", "SELECT 'from' AS rule, count(*) AS n, count(DISTINCT p || ' ' || n) AS heads, 2 AS grounds FROM (SELECT DISTINCT l_suppkey, l_partkey AS p, s_nationkey AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)")
def e4(spark, sf):
    rule = Rule(("suppliedFrom", "?p", "?n"), (("supplies", "?s", "?p"), ("inNation", "?s", "?n")), name="from")
    made = KB(spark, {k: v for k, v in trade(spark, sf).items() if k in ("supplies", "inNation")}, (rule,)).justifications()
    # Each justification is one row, so only what they conclude has to be told apart.
    heads = spread(made.select("rule", "conseq", F.size("ante").alias("grounds")), "rule", "conseq").groupBy("rule", "conseq").agg(F.count("*").alias("n"), F.max("grounds").alias("grounds"))
    return heads.groupBy("rule").agg(F.sum("n").alias("n"), F.count("*").alias("heads"), F.max("grounds").alias("grounds"))


@query("e6_directed", "SELECT DISTINCT 'audit' AS ctx, s_suppkey AS s FROM supplier")
def e6(spark, sf):
    """A head that names its context is placed there, wherever its grounds stand."""
    sells = read(spark, sf, "supplier").select(tag("n", "s_nationkey", "a1"), F.col("s_suppkey").alias("a2"))
    out = forward_in({"sells": sells}, [Rule(("ist", "audit", ("seen", "?s")), (("sells", "?s"),))], contexts(spark, sf))
    return out["seen"].select(F.col("a1").alias("ctx"), F.col("a2").alias("s"))


@query("e7_conjunctive_heads", "SELECT DISTINCT s_suppkey AS x, 'seller' AS t FROM supplier UNION SELECT DISTINCT s_suppkey, 'firm' FROM supplier")
def e7(spark, sf):
    out = forward(trade(spark, sf), split_heads([("seller", "?x"), ("firm", "?x")], (("supplier", "?x"),)))
    return out["seller"].select(F.col("a1").alias("x"), F.lit("seller").alias("t")).union(out["firm"].select("a1", F.lit("firm")))


@query("e8_directions", "SELECT 'prove' AS door, count(*) AS n FROM supplier UNION ALL SELECT 'query', count(*) FROM customer")
def e8(spark, sf):
    """A forward rule only concludes, a backward one only answers queries, an inert one does neither."""
    kb = KB(spark, trade(spark, sf)).rule(
        Rule(("known", "?x"), (("supplier", "?x"),), direction="forward"), Rule(("known", "?x"), (("customer", "?x"),), direction="backward"), Rule(("known", "?x"), (("size", "?x", "?z"),), direction="inert")
    )
    rows = lambda df, door: df.agg(F.count("*").alias("n")).select(F.lit(door).alias("door"), "n")
    return rows(kb.prove(("known", "?x")), "prove").union(rows(kb.query(("known", "?x"), depth=1), "query"))


@query("e10_strength", "SELECT CASE WHEN s = 1 THEN 'default' ELSE 'strict' END AS class, count(*) AS n FROM (SELECT s_suppkey, min(CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END) AS s FROM supplier GROUP BY s_suppkey) GROUP BY 1")
def e10(spark, sf):
    """A conclusion is as strong as its weakest ground: a strict rule over default premises gives defaults."""
    t = {"supplier": trade(spark, sf)["supplier"]}
    just = firings(Rule(("firm", "?x"), (("supplier", "?x"),)), t)
    key = F.sha2(F.concat_ws(" ", F.lit("supplier"), F.col("a1").cast("string")), 256)
    premises = t["supplier"].select(key.alias("sid"), F.when(F.col("a1") % 2 == 0, 2).otherwise(1).alias("s"))
    held = belief.labels(premises, just).join(just.select(F.col("conseq").alias("sid")), "sid", "left_semi")
    return held.groupBy(F.when(F.col("s") == 1, "default").otherwise("strict").alias("class")).agg(F.count("*").alias("n"))


@query("e11_head_existential", "SELECT c_custkey AS c, 'nat/' || sha256('accountOf ' || c_custkey) AS account FROM customer WHERE c_acctbal > 0")
def e11(spark, sf):
    """A functional term in a head names what must exist, the same for the same arguments."""
    rule = Rule(("holds", "?c", ("accountOf", "?c")), (("balance", "?c", "?b"), ("lessThan", 0, "?b")))
    return answer(forward({"balance": trade(spark, sf)["balance"]}, [rule]), ("holds", "?c", "?account"))


@query("f3_closure_goal", f"WITH RECURSIVE e AS (SELECT * FROM ({TYPE_EDGES}) WHERE a <> b), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT DISTINCT a AS x FROM c WHERE b = 'thing'")
def f3(spark, sf):
    edges = type_edges(spark, sf).select(F.lit("here").alias("ctx"), F.col("a").alias("a1"), F.col("b").alias("a2"))
    return Levels({"genl": edges}, spark.createDataFrame([("here", "here")], "a string, b string"), transitive=("genl",)).lookup(5, ("genl", "?x", "thing"), "here")


@query("f11_separating", f"SELECT DISTINCT p_name AS x, 'bolt' AS y, 'widget' AS a, 'bolt' AS b FROM part WHERE {NOUN} = 'widget' UNION SELECT 'widget', 'bolt', 'widget', 'bolt' FROM part WHERE {NOUN} = 'widget'")
def f11(spark, sf):
    """Why no widget is a bolt: the declaration that separates them."""
    declared, up = spark.createDataFrame([("widget", "bolt")], "a string, b string"), closure.reflexive(type_edges(spark, sf))
    apart = closure.partners(closure.separated(declared, up), "bolt").select(F.col("y").alias("x"), F.lit("bolt").alias("y"))
    return closure.witnesses(declared, up, apart)


@query("f14_meets", "SELECT a.n_nationkey AS a, b.r_regionkey AS b, 'n' || a.n_nationkey AS meet FROM nation a JOIN region b ON b.r_regionkey = a.n_regionkey")
def f14(spark, sf):
    """The most general context that sees a nation and a region: the nation, if it is of that region, else none."""
    nation, region = read(spark, sf, "nation"), read(spark, sf, "region")
    pairs = nation.crossJoin(F.broadcast(region)).select("n_nationkey", "r_regionkey", F.concat_ws("|", "n_nationkey", "r_regionkey").alias("firing"))
    both = pairs.select("firing", F.explode(F.array(tag("n", "n_nationkey"), tag("r", "r_regionkey"))).alias("ctx"))
    return context.placement(both, contexts(spark, sf)).join(pairs, "firing").select(F.col("n_nationkey").alias("a"), F.col("r_regionkey").alias("b"), F.col("ctx").alias("meet"))


# --- belief


@query("g2_defeat_class", "SELECT doc_id AS d, CASE WHEN max(quality) = 1 THEN 2 ELSE 1 END AS s FROM labels GROUP BY doc_id")
def g2(spark, sf):
    """Of several supports the strongest counts."""
    known = read(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    premises = known.select(tag("doc ", "doc_id", "sid"), F.lit(2).alias("s"))
    by = lambda j, df, s: df.select(tag(j, "doc_id", "jid"), tag("ok ", "doc_id", "conseq"), F.array(tag("doc ", "doc_id")).alias("ante"), F.lit(s).alias("s"))
    held = belief.labels(premises, by("weak ", known, 1).union(by("strong ", known.where("quality = 1"), 2)))
    return held.where("sid like 'ok %'").select(F.substring("sid", 4, 20).cast("long").alias("d"), "s")


@query("g8_sweep", f"SELECT 'good ' || doc_id AS sid FROM {OPINIONS}")
def g8(spark, sf):
    """Retracting the toxic marks takes the last support from what rests on them."""
    premises, just, facts = opinions(spark, sf)
    return belief.sweep(facts, premises.where("sid not like 'toxic %'"), just).select("sid")


@query("g11_edit", "SELECT DISTINCT l_partkey AS p FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 7 UNION SELECT 0")
def g11(spark, sf):
    """One edit takes a supplier's fact out and puts others in; rules see the end only."""
    t = {k: v for k, v in trade(spark, sf).items() if k in ("supplies", "inNation")}
    kb = KB(spark, t).rule(Rule(("fromSeven", "?p"), (("supplies", "?s", "?p"), ("inNation", "?s", 7))))
    gone = kb.edit(retract={"inNation": [(1, 7)]}, tell={"inNation": [(-1, 7)], "supplies": [(-1, 0)]})
    return gone.edit(tell={"inNation": read(spark, sf, "supplier").where("s_suppkey = 1").select(F.col("s_suppkey").alias("a1"), F.col("s_nationkey").alias("a2"))}).prove(("fromSeven", "?p"))


@query("g12_contradictions", f"SELECT 'conflict' AS verdict, 'good ' || doc_id || ',not good ' || doc_id AS sids FROM {OPINIONS} WHERE toxic = 1")
def g12(spark, sf):
    """With strict rules on both sides neither gives way."""
    premises, just, facts = opinions(spark, sf)
    _, _, still = belief.resolve(premises, just.withColumn("s", F.lit(2)), facts)
    pairs = belief.clashes(facts, belief.labels(premises, just)).select(F.concat_ws("|", "pos", "neg").alias("nid"), F.explode(F.array("pos", "neg")).alias("sid"))
    return belief.contradictions(still, pairs).select("verdict", F.array_join("sids", ",").alias("sids"))


@query("h11_rejoined", "SELECT o_custkey AS c, count(DISTINCT o_orderkey) + 1 AS n FROM orders GROUP BY o_custkey")
def h11(spark, sf):
    """When an extent grows, rules over its aggregate are joined anew."""
    rule = Rule(("busy", "?c", "?n"), (("buyer", "?c"), ("agg/count", "?n", "?o", [("ordered", "?c", "?o")])))
    ordered = trade(spark, sf)["ordered"]
    kb = KB(spark).tell("ordered", ordered).tell("buyer", ordered.select("a1")).rule(rule)
    one_more = ordered.select("a1").distinct().select("a1", (-F.col("a1")).alias("a2"))
    return kb.tell("ordered", one_more).prove(("busy", "?c", "?n"))


# --- terms and computed values


@query("i2_ratio", "SELECT p_partkey AS p, CASE WHEN p_partkey // gcd(p_size::BIGINT, p_partkey::BIGINT) = 1 THEN (p_size // gcd(p_size::BIGINT, p_partkey::BIGINT))::VARCHAR ELSE (p_size // gcd(p_size::BIGINT, p_partkey::BIGINT))::VARCHAR || '/' || (p_partkey // gcd(p_size::BIGINT, p_partkey::BIGINT))::VARCHAR END AS r FROM part WHERE p_partkey > 0")
def i2(spark, sf):
    return answer(trade(spark, sf), [("size", "?p", "?z"), ("lessThan", 0, "?p"), ("evaluate", "?r", ("ratio", "?z", "?p"))], ["p", "r"])


@query("i10_merge", f"SELECT DISTINCT 'restated' AS state, p_brand AS brand, (SELECT min(p_name) FROM part q WHERE {NOUN.replace('p_name', 'q.p_name')} = {NOUN.replace('p_name', 'x.p_name')}) AS name FROM part x WHERE p_name <> (SELECT min(p_name) FROM part q WHERE {NOUN.replace('p_name', 'q.p_name')} = {NOUN.replace('p_name', 'x.p_name')}) AND NOT EXISTS (SELECT 1 FROM part y WHERE y.p_brand = x.p_brand AND y.p_name = (SELECT min(p_name) FROM part q WHERE {NOUN.replace('p_name', 'q.p_name')} = {NOUN.replace('p_name', 'x.p_name')})) UNION ALL SELECT DISTINCT 'retired', p_brand, p_name FROM part x WHERE p_name <> (SELECT min(p_name) FROM part q WHERE {NOUN.replace('p_name', 'q.p_name')} = {NOUN.replace('p_name', 'x.p_name')})")
def i10(spark, sf):
    """A merge restates facts under the representative and retires the old spelling."""
    facts = read(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("name")).distinct()
    restated, retired = terms.merged(facts, _names(spark, sf), "name")
    return restated.select(F.lit("restated").alias("state"), "brand", "name").union(retired.select(F.lit("retired"), "brand", "name"))


def _accounts(spark, sf):
    """(term, function, c): an account for each customer, and a store for each tenth of them."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("c"))
    return c.select(terms.minted("accountOf", F.col("c")).alias("term"), F.lit("accountOf").alias("function"), "c").union(c.where("c % 10 = 0").select(terms.minted("storeOf", F.col("c")), F.lit("storeOf"), "c"))


@query("i11_orphans", "SELECT 'accountOf' AS function, c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'storeOf', c_custkey FROM customer WHERE c_custkey % 10 = 0")
def i11(spark, sf):
    """Accounts that no order uses any more, and stores, which none ever did."""
    used = read(spark, sf, "orders").select(F.col("o_orderkey").alias("a1"), terms.minted("accountOf", F.col("o_custkey")).alias("a2"))
    return terms.orphans(_accounts(spark, sf), {"paidFrom": used}).select("function", "c")


@query("i12_result_types", "SELECT 'nat/' || sha256('accountOf ' || c_custkey) AS term, unnest(['account', 'thing']) AS t FROM customer UNION ALL SELECT 'nat/' || sha256('storeOf ' || c_custkey), 'store' FROM customer WHERE c_custkey % 10 = 0")
def i12(spark, sf):
    declared = spark.createDataFrame([("accountOf", "account"), ("accountOf", "thing"), ("storeOf", "store")], "function string, t string")
    return terms.result_types(_accounts(spark, sf), declared)


@query("i14_context_terms", "SELECT 'CxViewFn n' || n_nationkey AS a, 'CxViewFn r' || n_regionkey AS b FROM nation UNION SELECT 'CxViewFn n' || n_nationkey, 'CxViewFn root' FROM nation UNION SELECT 'CxViewFn r' || r_regionkey, 'CxViewFn root' FROM region")
def i14(spark, sf):
    """Views of places are contexts that stand to each other as the places do."""
    up = contexts(spark, sf)
    made = up.select(F.concat(F.lit("CxViewFn "), "a").alias("ctx"), F.lit("CxViewFn").alias("function"), F.col("a").alias("arg")).distinct()
    return context.function_edges(made, up)


@query("i15_modal", "SELECT DISTINCT 'CxAgent' || user_id AS ctx, event_type AS fact FROM events")
def i15(spark, sf):
    """What users have done, as facts of their own contexts."""
    held = read(spark, sf, "events").select(F.col("user_id").alias("agent"), F.col("event_type").alias("fact"))
    return context.projected(held)


@query("i16_inferred_types", "SELECT DISTINCT l_suppkey AS x, 'supplier' AS t FROM lineitem UNION SELECT DISTINCT l_partkey, 'part' FROM lineitem")
def i16(spark, sf):
    """(arg supplies 1 supplier) and (arg supplies 2 part) type what stands there."""
    declared = spark.createDataFrame([("supplies", 1, "supplier"), ("supplies", 2, "part")], "pred string, n int, t string")
    return constraints.inferred_types(rel(spark, sf, "lineitem", "l_suppkey", "l_partkey").select(F.lit("supplies").alias("pred"), F.array("a1", "a2").alias("args")), declared)


@query("i17_meta_constraints", f"SELECT DISTINCT 'stocks' AS pred, 2 AS n, p_name AS t FROM part UNION SELECT 'stocks', 2, {NOUN} FROM part UNION SELECT 'stocks', 2, 'thing' FROM part")
def i17(spark, sf):
    """What is declared of a type holds of all types above it."""
    declared = read(spark, sf, "part").select(F.lit("stocks").alias("pred"), F.lit(2).alias("n"), F.col("p_name").alias("t")).distinct()
    return constraints.generalised(declared, closure.reflexive(type_edges(spark, sf)))


@query("i18_gloss", "SELECT DISTINCT 'sellsIn' AS predicate, s_name || ' is a supplier in ' || n_name || '.' AS sentence FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT 'region', 'region of ' || r_name FROM region")
def i18(spark, sf):
    sells = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("a1"), F.col("n_name").alias("a2")).distinct()
    return census.glossed({"sellsIn": sells, "region": rel(spark, sf, "region", "r_name")}, {"sellsIn": "{1} is a supplier in {2}."})


# --- declarations


@query("j15_marked", "SELECT 'click' AS pred, 'asymmetric' AS mark, x.a, x.b FROM (SELECT DISTINCT user_id % 20 AS a, event_id % 20 AS b FROM events WHERE event_type = 'click') x JOIN (SELECT DISTINCT user_id % 20 AS a, event_id % 20 AS b FROM events WHERE event_type = 'click') y ON x.a = y.b AND x.b = y.a WHERE x.a <= x.b")
def j15(spark, sf):
    """Clicks are below acts, which are asymmetric; views aren't and may go both ways."""
    facts = read(spark, sf, "events").where("event_type in ('click', 'view')").select(F.col("event_type").alias("pred"), (F.col("user_id") % 20).alias("a"), (F.col("event_id") % 20).alias("b"))
    marks = constraints.marks_over(spark.createDataFrame([("act", "asymmetric")], "pred string, mark string"), closure.reflexive(spark.createDataFrame([("click", "act")], "a string, b string")))
    return constraints.marked_violations(facts, marks)


@query("j16_misdeclared", "SELECT DISTINCT event_type AS pred, 'place' AS problem FROM events WHERE event_type = 'click' UNION SELECT DISTINCT event_type, 'kind' FROM events WHERE event_type = 'view' UNION SELECT DISTINCT event_type, 'arity' FROM events WHERE event_type = 'purchase'")
def j16(spark, sf):
    """Event types as predicates of two places below an act of two; some are declared wrongly."""
    kinds = read(spark, sf, "events").select(F.col("event_type").alias("pred")).distinct()
    declared = kinds.select("pred", F.when(F.col("pred") == "click", 3).otherwise(1).alias("n"), F.lit("arg").alias("kind"))
    takes = kinds.select("pred", F.when(F.col("pred") == "purchase", 3).otherwise(2).alias("k")).union(spark.createDataFrame([("act", 2)], "pred string, k int"))
    up = closure.reflexive(kinds.select(F.col("pred").alias("a"), F.lit("act").alias("b")))
    relation = kinds.select("pred", F.when(F.col("pred") == "view", "type").otherwise("instance").alias("relation"))
    return constraints.misdeclared(declared, takes, relation, up)


@query("j17_refusals", "SELECT p_partkey AS sid, CASE p_size % 4 WHEN 1 THEN 'variable' WHEN 2 THEN 'empty' ELSE 'name' END AS reason FROM part WHERE p_size % 4 <> 0")
def j17(spark, sf):
    """Part rows as sentences, three quarters of them spoilt in one way each."""
    k = F.col("p_size") % 4
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("sid"), F.when(k == 3, "1st (name)").otherwise("name").alias("pred"), F.array(F.col("p_brand"), F.when(k == 1, "?x").when(k == 2, " ").otherwise(F.col("p_name"))).alias("args"))
    return constraints.refusals(rows)


@query("j19_assertive", "SELECT DISTINCT s_nationkey AS x FROM supplier UNION SELECT c_nationkey FROM customer")
def j19(spark, sf):
    """Assertive declarations conclude: what suppliers and customers are in is a nation."""
    facts = read(spark, sf, "supplier").select(F.lit("inNation").alias("pred"), F.array(F.col("s_suppkey").cast("long"), F.col("s_nationkey").cast("long")).alias("args")).union(read(spark, sf, "customer").select(F.lit("customerIn"), F.array(F.col("c_custkey").cast("long"), F.col("c_nationkey").cast("long"))))
    declared = spark.createDataFrame([("inNation", 2, "nation"), ("customerIn", 2, "nation")], "pred string, n int, t string")
    made = constraints.inferred_types(facts, declared).select(F.col("x").alias("a1"), F.col("t").alias("a2"))
    return answer({"isa": made}, ("isa", "?x", "nation")).select(F.col("x").cast("int").alias("x"))


@query("j20_dry_run", "SELECT 'functional' AS kind, s_suppkey::VARCHAR AS witness FROM supplier WHERE s_nationkey <> 0")
def j20(spark, sf):
    """A proposed batch puts every supplier into nation 0 as well: those who aren't there would break the declaration; nothing is stored."""
    t = {"inNation": trade(spark, sf)["inNation"]}
    proposed = t["inNation"].select("a1", F.lit(0).alias("a2"))
    checks = {"functional": lambda f: constraints.functional(f["inNation"], "a1", "a2").select("a1"), "irreflexive": lambda f: f["inNation"].where("a1 = a2 and a1 < 0").select("a1")}
    return constraints.dry_run(checks, t, {"inNation": proposed})


# --- networks, choices, reports


@query("k13_overlap_window", f"SELECT x.u AS i, y.u AS j, greatest(0, least(x.b, y.b) - greatest(x.a, y.a) - 20)::DOUBLE AS lo, greatest(0, least(x.b, y.b) - greatest(x.a, y.a) + 20)::DOUBLE AS hi FROM {SPANS} x JOIN {SPANS} y ON y.u = x.u + 1")
def k13(spark, sf):
    """Spans whose ends are only known to ten seconds."""
    t = F.expr("unix_micros(cast(ts as timestamp)) div 1000000").cast("double")
    span = read(spark, sf, "events").groupBy(F.col("user_id").alias("i")).agg(F.min(t).alias("a"), (F.max(t) + 1).alias("b"))
    rough = span.select("i", (F.col("a") - 10).alias("start_lo"), (F.col("a") + 10).alias("start_hi"), (F.col("b") - 10).alias("end_lo"), (F.col("b") + 10).alias("end_hi"))
    return metric_time.overlap_window(rough, span.select("i", (F.col("i") + 1).alias("j")))


def _brands(spark, sf):
    """Dilemmas between the first parts of neighbouring sizes within a brand: chains that share members."""
    part = read(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("p")).where("p_size <= 3")
    sid = F.format_string("%s|%02d", F.col("p_brand"), F.col("p_size"))
    later = part.select("p_brand", (F.col("p_size") - 1).alias("p_size"), F.format_string("%s|%02d", F.col("p_brand"), F.col("p_size")).alias("b"))
    return part.withColumn("a", sid).join(later, ["p_brand", "p_size"]).select(F.concat_ws("&", "a", "b").alias("nid"), F.explode(F.array("a", "b")).alias("sid"))


_HAS = "SELECT p_brand AS b, bool_or(p_size = 1) AS s1, bool_or(p_size = 2) AS s2, bool_or(p_size = 3) AS s3 FROM part GROUP BY p_brand"


@query("l5_settled_dilemmas", f"SELECT CASE WHEN s1 AND s3 THEN b || '|02' WHEN s1 THEN b || '|01' ELSE b || '|02' END AS sid FROM ({_HAS}) WHERE s2 AND (s1 OR s3)")
def l5(spark, sf):
    """Of three in a chain only the middle one must go."""
    return solve.settled_dilemmas(_brands(spark, sf))


@query("l7_optima", f"SELECT CASE WHEN s1 THEN b || '|01' ELSE b || '|02' END AS component, (CASE WHEN s1 AND s3 THEN 1 ELSE 2 END)::BIGINT AS n FROM ({_HAS}) WHERE s2 AND (s1 OR s3)")
def l7(spark, sf):
    bad = _brands(spark, sf)
    needs = bad.groupBy("nid").agg(F.array_sort(F.collect_set("sid")).alias("atoms")).select("atoms")
    atoms = bad.select(F.col("sid").alias("atom")).distinct()
    return solve.optima(solve.label(atoms, needs, needs.limit(0), atoms.select(F.array("atom").alias("atoms"), F.lit(1.0).alias("cost"))))


@query(
    "n8_census",
    "SELECT 'extent' AS report, 'inNation' AS subject, count(*) AS n FROM (SELECT DISTINCT s_suppkey, s_nationkey FROM supplier) UNION ALL SELECT 'extent', 'inRegion', count(*) FROM nation UNION ALL SELECT 'extent', 'sellsIn', count(*) FROM supplier UNION ALL SELECT 'extent', 'inWorld', count(*) FROM supplier "
    f"UNION ALL SELECT 'idle', 'never', 0 UNION ALL SELECT * FROM (VALUES ('chain', 'sellsIn', 1), ('chain', 'inWorld', 2), ('chain', 'lost', 1)) UNION ALL SELECT 'taxonomy', b, count(*) FROM ({TYPE_EDGES}) WHERE a <> b GROUP BY b "
    "UNION ALL SELECT 'declaration', 'inRegion', count(*) FROM nation UNION ALL SELECT 'declaration', 'sold', 0 UNION ALL SELECT 'extent', 'lost', 0",
)
def n8(spark, sf):
    t = {k: v for k, v in trade(spark, sf).items() if k in ("inNation", "inRegion")}
    rules = [Rule(("sellsIn", "?s", "?r"), (("inNation", "?s", "?n"), ("inRegion", "?n", "?r")), name="sells"), Rule(("inWorld", "?s"), (("sellsIn", "?s", "?r"),), name="world"), Rule(("lost", "?s"), (("inNation", "?s", -1),), name="never")]
    return census.census(forward(t, rules), rules, type_edges(spark, sf), spark.createDataFrame([("inRegion",), ("sold",)], "pred string"))


@query("a3_functor_scan", "SELECT DISTINCT 'clickedBy' AS predicate, event_id || ',' || user_id AS args FROM events WHERE event_type = 'click' UNION SELECT 'inRegion', n_nationkey || ',' || n_regionkey FROM nation")
def a3(spark, sf):
    kb = KB(spark).tell("clickedBy", read(spark, sf, "events").where("event_type = 'click'").select(F.col("event_id").alias("a1"), F.col("user_id").alias("a2")))
    kb = kb.tell("inRegion", rel(spark, sf, "nation", "n_nationkey", "n_regionkey")).tell("other", [("left out",)])
    return kb.functor("clickedBy", "inRegion").select("predicate", F.array_join("args", ",").alias("args"))


@query("a6_vocabulary", "SELECT term, count(*) AS n FROM (SELECT unnest([o_custkey::VARCHAR, o_orderkey::VARCHAR]) AS term FROM orders) GROUP BY term")
def a6(spark, sf):
    return KB(spark).tell("ordered", trade(spark, sf)["ordered"]).terms()


@query("c17_ist", "SELECT s_suppkey AS sid FROM supplier WHERE s_nationkey = 3")
def c17(spark, sf):
    """(ist n3 fact): what the context itself or one above says of suppliers, read from the root."""
    return context.visible(context_facts(spark, sf), contexts(spark, sf), "n3").where("ctx like 'n%'").select("sid")
