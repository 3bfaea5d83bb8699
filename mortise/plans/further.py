"""More registered queries of the engine: scans, definitions, rule generators, explanations, declarations and networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from mortise.functions import measures
from mortise.operators import belief, closure, constraints, context, qualitative, rewrite, scenarios
from mortise.operators.loops import settled
from mortise.plans.compile import answer
from mortise.plans.kb import KB
from mortise.plans.lang import Rule
from mortise.plans.program import definition, forward, rule_report, stamped
from mortise.plans.registry import OPINIONS, SUPPLY, TYPE_EDGES, context_facts, contexts, opinions, query, read, rel, supply, trade, type_edges
from mortise.streaming.feed import Feed

# --- scans and doors


@query("a4_argument_scan", "SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_partkey = 5")
def a4(spark, sf):
    return answer({"supplies": trade(spark, sf)["supplies"]}, ("supplies", "?s", 5))


@query("a15_bulk_load", "SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def a15(spark, sf):
    kb = KB(spark).tell("contains", rel(spark, sf, "lineitem", "l_orderkey", "l_partkey"))
    return kb.counts().select("n")


@query(
    "b5_subsumption",
    "SELECT 'c' || o_custkey AS x, 'o' || o_orderkey AS y FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem",
)
def b5(spark, sf):
    """A goal of the super-predicate reads the facts of all predicates below it."""
    tag = lambda p, c, a: F.concat(F.lit(p), F.col(c).cast("string")).alias(a)
    kb = KB(spark).tell("ordered", read(spark, sf, "orders").select(tag("c", "o_custkey", "a1"), tag("o", "o_orderkey", "a2")))
    kb = kb.tell("contains", read(spark, sf, "lineitem").select(tag("o", "l_orderkey", "a1"), tag("p", "l_partkey", "a2")))
    return kb.below("ordered", "relatedTo").below("contains", "relatedTo").query(("relatedTo", "?x", "?y"))


@query("c1_query_depth", "SELECT DISTINCT l_partkey AS p FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 3")
def c1(spark, sf):
    kb = KB(spark, trade(spark, sf)).rule(Rule(("from", "?p", "?n"), (("supplies", "?s", "?p"), ("inNation", "?s", "?n"))))
    return kb.query(("from", "?p", 3), depth=1)


@query("c3_prove", "SELECT DISTINCT n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 1")
def c3(spark, sf):
    t = {k: v for k, v in trade(spark, sf).items() if k in ("inNation", "inRegion")}
    return KB(spark, t).rule(Rule(("sellsIn", "?s", "?r"), (("inNation", "?s", "?n"), ("inRegion", "?n", "?r")))).prove(("sellsIn", 1, "?r"))


@query("c15_belief_status", f"SELECT 'good ' || doc_id AS sid, true AS stored, toxic = 0 AS believed, doc_id % 7 = 0 AS excepted, toxic = 0 AND doc_id % 7 <> 0 AS visible FROM {OPINIONS}")
def c15(spark, sf):
    premises, just, facts = opinions(spark, sf)
    good = facts.where("truth")
    return belief.status(good, facts, belief.resolve(premises, just, facts)[0], good.where("cast(substring(sid, 6) as long) % 7 = 0"))


@query("c16_dependents", f"SELECT 'j-bad ' || doc_id AS jid, 'not good ' || doc_id AS conseq FROM {OPINIONS} WHERE toxic = 1")
def c16(spark, sf):
    premises, just, _ = opinions(spark, sf)
    return belief.dependents(just, premises.where("sid like 'toxic %'"))


@query("c18_contexts_of", "SELECT s_suppkey AS sid, 'n' || s_nationkey AS ctx FROM supplier WHERE s_suppkey = 5")
def c18(spark, sf):
    return context_facts(spark, sf).where("sid = 5")


# --- joins and rules


@query("d6_mirror_join", "WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem), m AS (SELECT a, b FROM e UNION SELECT b, a FROM e) SELECT DISTINCT s_suppkey AS s, b AS y FROM supplier JOIN m ON a = s_suppkey")
def d6(spark, sf):
    t = trade(spark, sf)
    both = closure.mirrored(t["supplies"].select(F.col("a1").alias("a"), F.col("a2").alias("b"))).select(F.col("a").alias("a1"), F.col("b").alias("a2"))
    return answer({"supplier": t["supplier"], "tradesWith": both}, [("supplier", "?s"), ("tradesWith", "?s", "?y")])


@query("e12_rule_generator", "SELECT DISTINCT o_custkey AS x, 'buyer' AS role FROM orders UNION SELECT DISTINCT s_suppkey, 'seller' FROM supplier")
def e12(spark, sf):
    """A declaration (roleOf predicate type) makes a rule that types first arguments."""
    t = trade(spark, sf)
    t = {"orderedBy": t["ordered"], "locatedSeller": t["inNation"], "roleOf": spark.createDataFrame([("orderedBy", "buyer"), ("locatedSeller", "seller")], "a1 string, a2 string")}
    rules = stamped(t, (("roleOf", "?P", "?T"),), ("?T", "?x"), (("?P", "?x", "?y"),))
    out = forward(t, rules)
    return out["buyer"].select(F.col("a1").alias("x"), F.lit("buyer").alias("role")).union(out["seller"].select("a1", F.lit("seller"))).distinct()


@query("e13_definition", "SELECT DISTINCT s_suppkey AS x FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2")
def e13(spark, sf):
    t = {k: v for k, v in trade(spark, sf).items() if k in ("inNation", "inRegion")}
    rules = definition("sufficient", ("regional_seller", "?x"), (("inNation", "?x", "?n"), ("inRegion", "?n", 2)))
    return answer(forward(t, rules), ("regional_seller", "?x"))


@query("e15_rule_report", "SELECT 'home' AS rule, count(*) AS firings, count(DISTINCT c) AS conclusions FROM (SELECT DISTINCT c_custkey AS c, s_suppkey FROM customer JOIN supplier ON s_nationkey = c_nationkey) UNION ALL SELECT 'idle', 0, 0")
def e15(spark, sf):
    rules = [Rule(("atHome", "?c"), (("customerIn", "?c", "?n"), ("inNation", "?s", "?n")), name="home"), Rule(("giant", "?p"), (("size", "?p", 100000),), name="idle")]
    return rule_report(rules, trade(spark, sf))


@query("f2_context_cycles", "SELECT 'n' || a.n_nationkey AS a, 'n' || b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def f2(spark, sf):
    """Nations of a region see each other in a ring: the closure of a cycle."""
    nation = read(spark, sf, "nation").select("n_regionkey", "n_nationkey")
    after = nation.join(nation.select("n_regionkey", F.col("n_nationkey").alias("b")), "n_regionkey")
    ring = after.groupBy("n_regionkey", "n_nationkey").agg(F.coalesce(F.min(F.when(F.col("b") > F.col("n_nationkey"), F.col("b"))), F.min("b")).alias("b"))
    return closure.reflexive(ring.select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("n"), "b").alias("b")))


@query("f9_reflexive", "SELECT DISTINCT s_nationkey AS a, s_nationkey AS b FROM supplier UNION SELECT c_nationkey, s_nationkey FROM customer JOIN supplier ON s_nationkey = c_nationkey")
def f9(spark, sf):
    """(sameNation a a) holds of everything the relation is about."""
    n = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("a"))
    return closure.reflexive(n.select("a", F.col("a").alias("b")), n).distinct()


@query(
    "f13_scoped_equality",
    "SELECT n_regionkey AS view, n_nationkey AS term, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS rep FROM nation",
)
def f13(spark, sf):
    """Each region's reader sees only its own equations: nodes are (view, term), so that classes can't mix."""
    nation = read(spark, sf, "nation")
    low = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("low"))
    key = lambda c: F.format_string("%06d|%06d", F.col("n_regionkey"), F.col(c))
    found = closure.components(nation.join(low, "n_regionkey").select(key("n_nationkey").alias("a"), key("low").alias("b")))
    part = lambda c, i: F.element_at(F.split(c, r"\|"), i).cast("int")
    return found.select(part("term", 1).alias("view"), part("term", 2).alias("term"), part("rep", 2).alias("rep"))


# --- belief


@query("g3_negation_nogoods", f"SELECT 'good ' || doc_id AS pos, 'not good ' || doc_id AS neg FROM {OPINIONS} WHERE toxic = 1")
def g3(spark, sf):
    premises, just, facts = opinions(spark, sf)
    return belief.clashes(facts, belief.labels(premises, just))


@query("g4_definitional_nogoods", f"SELECT 'seller ' || a AS nid, 'seller ' || a || ' ' || b AS sid FROM {SUPPLY} WHERE a = b")
def g4(spark, sf):
    """An irreflexive relation's self tuples, each a nogood of one member."""
    bad = constraints.irreflexive(supply(spark, sf))
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    return bad.select(F.concat(F.lit("seller "), a).alias("nid"), F.concat(F.lit("seller "), a, F.lit(" "), b).alias("sid"))


@query("g9_supersession", "SELECT p_name AS term FROM (SELECT DISTINCT p_name FROM part) WHERE p_name <> (SELECT min(p_name) FROM part q WHERE string_split(q.p_name, ' ')[-1] = string_split(part.p_name, ' ')[-1])".replace("part.p_name", "x.p_name").replace("FROM part)", "FROM part) x"))
def g9(spark, sf):
    """Part names of one noun are equal; all but the least spelling of each are superseded."""
    names = read(spark, sf, "part").select("p_name", F.element_at(F.split("p_name", " "), -1).alias("noun")).distinct()
    least = names.groupBy("noun").agg(F.min("p_name").alias("low"))
    rep = closure.components(names.join(least, "noun").select(F.col("low").alias("a"), F.col("p_name").alias("b")))
    return rep.where("term <> rep").select("term")


@query("g14_inert", f"SELECT 'toxic ' || doc_id AS sid FROM {OPINIONS} WHERE toxic = 1 UNION ALL SELECT 'doc ' || doc_id FROM {OPINIONS} WHERE doc_id % 2 = 0")
def g14(spark, sf):
    """A stored fact without a premise mark is never believed: here the documents with odd ids."""
    premises, just, _ = opinions(spark, sf)
    marked = premises.where("sid not like 'doc %' or cast(substring(sid, 5) as long) % 2 = 0")
    return belief.labels(marked, just.limit(0)).select("sid")


@query("g15_following_metas", "SELECT 'o' || o_orderkey AS sid FROM orders WHERE o_custkey = 7 UNION SELECT 'l' || l_orderkey || '-' || l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 7")
def g15(spark, sf):
    """Orders are about their customer, lines about their order: all go with the customer."""
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    metas = read(spark, sf, "orders").select(text("o", "o_orderkey").alias("sid"), text("c", "o_custkey").alias("target")).union(read(spark, sf, "lineitem").select(F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")), text("o", "l_orderkey")))
    return belief.following(metas, spark.createDataFrame([("c7",)], "sid string"))


# --- aggregates, terms, declarations


@query("h6_aggregate_check", "SELECT o_custkey AS c FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) = 10")
def h6(spark, sf):
    return answer(trade(spark, sf), [("customer", "?c"), ("agg/count", 10, "?o", [("ordered", "?c", "?o")])], ["c"])


@query("h8_census_by_context", "SELECT 'n' || n_nationkey AS view, count(DISTINCT sid) AS n FROM nation JOIN (SELECT s_suppkey AS sid, s_nationkey AS k, -1 AS r FROM supplier UNION ALL SELECT 100000 + r_regionkey, -1, r_regionkey FROM region) ON k = n_nationkey OR r = n_regionkey GROUP BY n_nationkey UNION ALL SELECT 'r' || r_regionkey, 1 FROM region")
def h8(spark, sf):
    return context.readers(context_facts(spark, sf), contexts(spark, sf)).groupBy("view").agg(F.countDistinct("sid").alias("n"))


@query("i5_measure_comparison", "SELECT a.p_partkey AS x, b.p_partkey AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND abs(a.p_size * CASE WHEN a.p_partkey % 2 = 0 THEN 60.0 ELSE 3600.0 END - b.p_size * CASE WHEN b.p_partkey % 2 = 0 THEN 60.0 ELSE 3600.0 END) <= 1e-9")
def i5(spark, sf):
    """Equal quantities of one brand in minutes and hours; the equality joins on the base unit's value."""
    units = spark.createDataFrame([("Minute", "Second", 60.0), ("Hour", "Second", 3600.0)], "unit string, base string, factor double")
    part = read(spark, sf, "part")
    size = F.col("p_size").cast("double")
    rows = measures.normalised(part.select("p_partkey", "p_brand", size.alias("lo"), size.alias("hi"), F.when(F.col("p_partkey") % 2 == 0, "Minute").otherwise("Hour").alias("unit")), units)
    other = rows.select("p_brand", F.col("p_partkey").alias("y"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.round("lo").alias("at"))
    same = rows.withColumn("at", F.round("lo")).join(other, ["p_brand", "at"])
    return same.where(measures.same_quantity(F.col("lo"), F.col("hi"), F.col("lo2"), F.col("hi2"))).select(F.col("p_partkey").alias("x"), "y")


@query("i8_schematic_rewriting", "SELECT p_partkey AS p, CASE p_partkey % 3 WHEN 0 THEN 's' || p_size WHEN 1 THEN '(succ s' || p_size || ')' ELSE 'zero' END AS term FROM part")
def i8(spark, sf):
    equations = [("(plus ?x zero)", "?x"), ("(plus zero ?x)", "?x"), ("(times ?x zero)", "zero"), ("(pred (succ ?x))", "?x")]
    s = F.concat(F.lit("s"), F.col("p_size").cast("string"))
    made = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("(plus (plus zero "), s, F.lit(") zero)"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("(pred (succ (succ "), s, F.lit(")))"))).otherwise(F.concat(F.lit("(times (plus "), s, F.lit(" one) zero)")))
    return rewrite.normalised(read(spark, sf, "part").select(F.col("p_partkey").alias("p"), made.alias("term")), "term", equations)


@query("j6_variable_arity", "SELECT event_id AS sid FROM events WHERE event_type = 'click' AND event_id % 3 <> 2")
def j6(spark, sf):
    """Clicks should have two arguments; views may have any number."""
    facts = read(spark, sf, "events").where("event_type in ('click', 'view')").select(F.col("event_id").alias("sid"), F.col("event_type").alias("pred"), F.slice(F.array(*[F.lit("x")] * 3), 1, (F.col("event_id") % 3).cast("int")).alias("args"))
    declared = spark.createDataFrame([("click", 2), ("view", 2)], "pred string, n int")
    return constraints.arity(facts, declared, spark.createDataFrame([("view",)], "pred string")).select("sid")


@query("j14_equivalence", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey")
def j14(spark, sf):
    """An equivalence relation is symmetric, transitive and reflexive: stated with the least of each nation, read as its classes."""
    supplier = read(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    low = supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("low"))
    stated = supplier.join(low, "s_nationkey").select(F.col("s_suppkey").alias("a"), F.col("low").alias("b"))
    own = stated.select(F.col("a").alias("term"), F.col("a").alias("own"))
    rep = settled(own.join(closure.components(stated), "term", "left").select("term", F.coalesce("rep", "own").alias("rep")))
    return rep.select(F.col("term").alias("x"), "rep").join(rep.select(F.col("term").alias("y"), "rep"), "rep").select("x", "y")


@query("j15_inherited_marks", f"WITH RECURSIVE e AS (SELECT * FROM ({TYPE_EDGES}) WHERE a <> b), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a AS p, 'irreflexive' AS mark FROM c WHERE b = 'thing' UNION SELECT 'thing', 'irreflexive'")
def j15(spark, sf):
    up = closure.reflexive(type_edges(spark, sf))
    marks = spark.createDataFrame([("thing", "irreflexive")], "b string, mark string")
    return up.join(F.broadcast(marks), "b").select(F.col("a").alias("p"), "mark").distinct()


@query("j21_exposed_clashes", "SELECT DISTINCT doc_id AS x, 'junk' AS t1, 'good' AS t2 FROM labels WHERE false UNION ALL SELECT DISTINCT doc_id, 'good', 'toxic' FROM labels WHERE quality = 1 AND toxic = 1")
def j21(spark, sf):
    labels = read(spark, sf, "labels")
    kinds = labels.where("quality = 1").select(F.col("doc_id").alias("x"), F.lit("good").alias("t")).union(labels.where("quality = 0").select("doc_id", F.lit("junk"))).union(labels.where("toxic = 1").select("doc_id", F.lit("toxic"))).distinct()
    apart = closure.separated(spark.createDataFrame([("good", "toxic")], "a string, b string"), closure.reflexive(spark.createDataFrame([("good", "thing"), ("toxic", "thing"), ("junk", "thing")], "a string, b string")))
    return constraints.disjoint(kinds, apart)


# --- networks

_LATER = "FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"


def chained(spark, sf, of: qualitative.Calculus, *names: str):
    """(ctx, a, b, mask): the nations of each region, each related to the next."""
    nation = read(spark, sf, "nation").select("n_regionkey", "n_nationkey")
    after = nation.select("n_regionkey", F.col("n_nationkey").alias("b")).join(nation, "n_regionkey").where("n_nationkey < b").groupBy("n_regionkey", "n_nationkey").agg(F.min("b").alias("b"))
    return after.select(F.col("n_regionkey").alias("ctx"), F.col("n_nationkey").alias("a"), "b", F.lit(of.mask(*names)).alias("mask"))


@query("k5_cardinal", f"SELECT a.n_nationkey AS a, b.n_nationkey AS b {_LATER}")
def k5(spark, sf):
    of = qualitative.calculus("cardinal")
    return qualitative.entailed(qualitative.path_consistent(chained(spark, sf, of, "northOf", "northEastOf"), of), of, "northwardOf").select("a", "b")


@query("k6_relative", f"SELECT a.n_nationkey AS a, b.n_nationkey AS b {_LATER}")
def k6(spark, sf):
    of = qualitative.calculus("relative")
    return qualitative.entailed(qualitative.path_consistent(chained(spark, sf, of, "behindLeftOf", "frontLeftOf"), of), of, "leftwardOf").select("a", "b")


@query("k8_possible_relations", f"SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN b.n_nationkey = (SELECT min(c.n_nationkey) FROM nation c WHERE c.n_regionkey = a.n_regionkey AND c.n_nationkey > a.n_nationkey) THEN 'before,meets' ELSE 'before' END AS possible {_LATER}")
def k8(spark, sf):
    """What is possible between the intervals of a chain of `precedes`."""
    of = qualitative.calculus("allen")
    tight = qualitative.path_consistent(chained(spark, sf, of, "precedes"), of)
    return tight.where("a < b").select("a", "b", F.array_join(of.named("mask"), ",").alias("possible"))


@query("k9_scenarios", "SELECT n_regionkey::VARCHAR AS ctx, 2 ** (count(*) - 1) AS n FROM nation GROUP BY n_regionkey")
def k9(spark, sf):
    """A chain of n instants, each not after the next, has 2 to the n - 1 arrangements."""
    of = qualitative.calculus("point")
    found = scenarios.scenarios(chained(spark, sf, of, "instantNotAfter"), "point", 1 << 20)
    return found.groupBy("ctx").agg(F.countDistinct("scenario").cast("double").alias("n"))


@query("k10_culprits", f"SELECT r::VARCHAR AS ctx, x || '-' || y AS sid FROM (SELECT a.n_regionkey AS r, a.n_nationkey AS x, min(b.n_nationkey) AS y {_LATER} GROUP BY 1, 2) UNION ALL SELECT n_regionkey::VARCHAR, 'back' FROM nation GROUP BY n_regionkey")
def k10(spark, sf):
    """A chain of `before` and one statement from its end back to its start: all are needed; one about another pair isn't."""
    of = qualitative.calculus("allen")
    chain = chained(spark, sf, of, "before")
    ends = chain.groupBy("ctx").agg(F.max("b").alias("a"), F.min("a").alias("b"))
    sid = lambda df, c: df.select("ctx", c.alias("sid"), "a", "b", F.lit(of.mask("before")).alias("mask"))
    aside = ends.select("ctx", F.lit("aside").alias("sid"), F.lit(1000).alias("a"), F.lit(1001).alias("b"), F.lit(of.mask("during")).alias("mask"))
    stated = sid(chain, F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string"))).union(sid(ends, F.lit("back"))).union(aside)
    return scenarios.culprits(stated, "allen")


@query("m2_standing_query", "SELECT user_id, 'click' AS event_type, 'added' AS change FROM events WHERE event_type = 'click' GROUP BY user_id HAVING min(ts) >= TIMESTAMP '2024-01-02'")
def m2(spark, sf):
    """A watcher's condition filters the change that the events after the first day make."""
    events = read(spark, sf, "events").select("user_id", "event_type", "ts")
    seen = []
    feed = Feed(lambda stated: stated.select("user_id", "event_type").distinct())
    feed.watch("clicks", lambda changes, _: seen.append(changes), "event_type = 'click'")
    for n, part in enumerate(("ts < timestamp_ntz'2024-01-02'", "ts >= timestamp_ntz'2024-01-02'")):
        feed.apply(events.where(part).withColumn("op", F.lit("assert")), n)
    return seen[-1]


@query("n9_vocabulary_audit", "SELECT 'customer' AS term, 'used' AS state UNION ALL SELECT 'order', 'inert'")
def n9(spark, sf):
    """Declared predicates that hold of nothing are inert."""
    t = {"customer": trade(spark, sf)["customer"], "order": spark.createDataFrame([], "a1 long")}
    return KB(spark, t).counts().select(F.col("predicate").alias("term"), F.when(F.col("n") > 0, "used").otherwise("inert").alias("state"))


@query("k12_endpoints", "SELECT x.user_id AS i, y.user_id AS j FROM (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id) x JOIN (SELECT user_id, min(ts) AS c, max(ts) AS d FROM events GROUP BY user_id) y ON y.user_id = x.user_id + 1 WHERE x.a > y.c AND x.b < y.d")
def k12(spark, sf):
    """Endpoints narrow Allen relations: `during` between the spans of neighbouring users."""
    span = read(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    other = span.select((F.col("user_id") - 1).alias("user_id"), F.col("user_id").alias("j"), F.col("a").alias("c"), F.col("b").alias("d"))
    rel_ = qualitative.allen_relation(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    return span.join(other, "user_id").where(rel_ == "during").select(F.col("user_id").alias("i"), "j")


