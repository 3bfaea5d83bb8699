"""The registered queries of the engine, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mortise.functions import measures
from mortise.operators import belief, closure, constraints, context, metric_time, qualitative, solve, terms
from mortise.operators.meet import spread
from mortise.plans.compile import answer
from mortise.plans.kb import KB
from mortise.plans.lang import Rule
from mortise.plans.program import firings, forward, forward_in, unfold
from mortise.sources import store

FLAGSHIP = "d1_conjunctive_join"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rel(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """Distinct columns of a table as a predicate (a1, a2, ...)."""
    return spread(read(spark, sf, name).select(*(F.col(c).alias(f"a{i}") for i, c in enumerate(columns, 1)))).distinct()


def trade(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The business tables as predicates."""
    return {
        "supplies": rel(spark, sf, "lineitem", "l_suppkey", "l_partkey"),
        "inNation": rel(spark, sf, "supplier", "s_suppkey", "s_nationkey"),
        "customerIn": rel(spark, sf, "customer", "c_custkey", "c_nationkey"),
        "ordered": rel(spark, sf, "orders", "o_custkey", "o_orderkey"),
        "price": rel(spark, sf, "orders", "o_orderkey", "o_totalprice"),
        "inRegion": rel(spark, sf, "nation", "n_nationkey", "n_regionkey"),
        "supplier": rel(spark, sf, "supplier", "s_suppkey"),
        "customer": rel(spark, sf, "customer", "c_custkey"),
        "quantity": rel(spark, sf, "lineitem", "l_orderkey", "l_quantity"),
        "balance": rel(spark, sf, "customer", "c_custkey", "c_acctbal"),
        "size": rel(spark, sf, "part", "p_partkey", "p_size"),
    }


# --- scans and counts


@query("a2_context_scan", "SELECT event_id, user_id FROM events WHERE event_type = 'click'")
def a2(spark, sf):
    return read(spark, sf, "events").where("event_type = 'click'").select("event_id", "user_id")


@query("a5_term_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7 OR o_custkey = 7")
def a5(spark, sf):
    kb = KB(spark).tell("orderOf", rel(spark, sf, "orders", "o_orderkey", "o_custkey"))
    return kb.mentions(7).select(F.col("args")[0].cast("long").alias("o_orderkey"), F.col("args")[1].cast("long").alias("o_custkey"))


@query(
    "a7_counts",
    "SELECT 'supplies' AS predicate, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) "
    "UNION ALL SELECT 'inNation', count(*) FROM (SELECT DISTINCT s_suppkey, s_nationkey FROM supplier)",
)
def a7(spark, sf):
    t = trade(spark, sf)
    return KB(spark, {k: t[k] for k in ("supplies", "inNation")}).counts()


@query("a14_foreign_reader", "SELECT n_nationkey AS n, n_regionkey AS r FROM nation")
def a14(spark, sf):
    if "nations" not in store.READERS:
        store.register("nations", lambda s, path: {"inRegion": rel(s, path, "nation", "n_nationkey", "n_regionkey")})
    return answer(store.foreign(spark, "nations", sf), ("inRegion", "?n", "?r"))


@query(
    "a19_fork",
    "SELECT n_nationkey AS sid, n_name AS name FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT 1000 + r_regionkey, r_name FROM region",
)
def a19(spark, sf):
    nation = read(spark, sf, "nation")
    base = nation.select(F.col("n_nationkey").alias("sid"), F.col("n_name").alias("name"))
    tombs = nation.where("n_regionkey = 0").select(F.col("n_nationkey").alias("sid"))
    return store.fork(base, tombs, read(spark, sf, "region").select((F.col("r_regionkey") + 1000).alias("sid"), F.col("r_name").alias("name")))


# --- matching and joins


@query("b1_repeated_variable", "SELECT DISTINCT l_partkey AS x FROM lineitem WHERE l_partkey = l_suppkey")
def b1(spark, sf):
    return answer({"supplies": trade(spark, sf)["supplies"]}, ("supplies", "?x", "?x"))


@query("b11_comparison_chain", "SELECT DISTINCT p_partkey AS p, p_size AS s FROM part WHERE 10 < p_size AND p_size < 20")
def b11(spark, sf):
    return answer(trade(spark, sf), [("size", "?p", "?s"), ("lessThan", 10, "?s", 20)])


@query(
    "b12_different",
    "SELECT DISTINCT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey <> b.s_suppkey",
)
def b12(spark, sf):
    return answer(trade(spark, sf), [("inNation", "?x", "?n"), ("inNation", "?y", "?n"), ("different", "?x", "?y")], ["x", "y"])


@query(
    FLAGSHIP,
    "SELECT DISTINCT l.l_partkey AS p, s.s_nationkey AS n FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey",
)
def d1(spark, sf):
    t = trade(spark, sf)
    out = forward(t, [Rule(("suppliedFrom", "?p", "?n"), (("supplies", "?s", "?p"), ("inNation", "?s", "?n")))])
    return answer(out, ("suppliedFrom", "?p", "?n"))


@query(
    "d3_theta",
    "SELECT DISTINCT a.o_custkey AS c, a.o_orderkey AS x, b.o_orderkey AS y FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_totalprice < b.o_totalprice",
)
def d3(spark, sf):
    orders = rel(spark, sf, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    return answer({"order": orders}, [("order", "?c", "?x", "?p"), ("order", "?c", "?y", "?q"), ("lessThan", "?p", "?q")], ["c", "x", "y"])


@query("d4_exists", "SELECT DISTINCT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def d4(spark, sf):
    return answer(trade(spark, sf), [("customer", "?c"), ("thereExists", ["?o"], [("ordered", "?c", "?o")])], ["c"])


@query("d5_unknown", "SELECT DISTINCT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def d5(spark, sf):
    return answer(trade(spark, sf), [("customer", "?c"), ("unknown", [("ordered", "?c", "?o"), ("price", "?o", "?p"), ("lessThan", 400000, "?p")])], ["c"])


@query(
    "d13_product",
    "SELECT DISTINCT a.n_nationkey AS n, r.r_regionkey AS r FROM nation a CROSS JOIN region r",
)
def d13(spark, sf):
    t = {"nation": rel(spark, sf, "nation", "n_nationkey"), "region": rel(spark, sf, "region", "r_regionkey")}
    return answer(t, [("nation", "?n"), ("region", "?r")])


@query(
    "f7_symmetric",
    "SELECT DISTINCT s_nationkey AS a, s_suppkey AS b FROM supplier UNION SELECT DISTINCT s_suppkey, s_nationkey FROM supplier",
)
def f7(spark, sf):
    return closure.mirrored(trade(spark, sf)["inNation"].select(F.col("a1").cast("long").alias("a"), F.col("a2").cast("long").alias("b")))


@query(
    "d10_placement",
    "WITH up AS (SELECT 'n' || n_nationkey AS a, 'n' || n_nationkey AS b FROM nation UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation "
    "UNION SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region UNION SELECT 'r' || r_regionkey, 'root' FROM region UNION SELECT 'n' || n_nationkey, 'root' FROM nation UNION SELECT 'root', 'root'), "
    "g AS (SELECT s_suppkey AS firing, 'n' || s_nationkey AS ctx FROM supplier UNION SELECT s_suppkey, 'r' || n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey), "
    "c AS (SELECT firing, a AS place FROM g JOIN up ON b = ctx GROUP BY firing, a HAVING count(*) = 2) "
    "SELECT firing, place AS ctx FROM c WHERE NOT EXISTS (SELECT 1 FROM c d JOIN up ON up.a = c.place AND up.b = d.place WHERE d.firing = c.firing AND d.place <> c.place)",
)
def d10(spark, sf):
    nation, supplier = read(spark, sf, "nation"), read(spark, sf, "supplier")
    grounds = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    both = grounds.select(F.col("s_suppkey").alias("firing"), F.concat(F.lit("n"), "n_nationkey").alias("ctx")).union(grounds.select("s_suppkey", F.concat(F.lit("r"), "n_regionkey")))
    return context.placement(both, contexts(spark, sf))


def contexts(spark, sf) -> DataFrame:
    """Nations see their region, regions see the root; reflexive closure (a, b)."""
    nation, region = read(spark, sf, "nation"), read(spark, sf, "region")
    edges = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b")).union(region.select(F.concat(F.lit("r"), "r_regionkey"), F.lit("root")))
    return closure.reflexive(edges)


@query(
    "b4_visible",
    "SELECT s_suppkey AS sid, 'n' || s_nationkey AS ctx FROM supplier WHERE s_nationkey = 3 UNION ALL "
    "SELECT 100000 + r_regionkey, 'r' || r_regionkey FROM region WHERE r_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)",
)
def b4(spark, sf):
    facts = context_facts(spark, sf)
    return context.visible(facts, contexts(spark, sf), "n3").select("sid", "ctx")


def context_facts(spark, sf) -> DataFrame:
    supplier, region = read(spark, sf, "supplier"), read(spark, sf, "region")
    return supplier.select("s_suppkey", F.concat(F.lit("n"), "s_nationkey")).toDF("sid", "ctx").union(region.select((F.col("r_regionkey") + 100000).cast("long"), F.concat(F.lit("r"), "r_regionkey")))


@query(
    "b9_except",
    "SELECT 'n' || n_nationkey AS view, 100000 + n_regionkey AS sid FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'r' || r_regionkey, 100000 + r_regionkey FROM region WHERE r_regionkey <> 1 "
    "UNION ALL SELECT 'n' || s_nationkey, s_suppkey FROM supplier",
)
def b9(spark, sf):
    up, facts = contexts(spark, sf), context_facts(spark, sf)
    excepts = facts.where("ctx = 'r1'").select("sid", "ctx")
    return context.without_excepted(context.readers(facts, up), excepts, up).select("view", "sid")


# --- aggregates over distinct values


@query("h1_count_zero", "SELECT c_custkey AS c, count(DISTINCT o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def h1(spark, sf):
    return answer(trade(spark, sf), [("customer", "?c"), ("agg/count", "?n", "?o", [("ordered", "?c", "?o")])], ["c", "n"])


@query("h2_sum_distinct", "SELECT o_orderkey AS o, coalesce(sum(DISTINCT l_quantity), 0)::DOUBLE AS n FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def h2(spark, sf):
    t = trade(spark, sf)
    t["order"] = rel(spark, sf, "orders", "o_orderkey")
    return answer(t, [("order", "?o"), ("agg/sum", "?n", "?q", [("quantity", "?o", "?q")])], ["o", "n"]).withColumn("n", F.col("n").cast("double"))


@query("h3_min", "SELECT o_custkey AS c, min(o_totalprice) AS n FROM orders GROUP BY o_custkey")
def h3(spark, sf):
    return answer(trade(spark, sf), [("customer", "?c"), ("agg/min", "?n", "?p", [("ordered", "?c", "?o"), ("price", "?o", "?p")])], ["c", "n"])


@query("h3_max", "SELECT o_custkey AS c, max(o_totalprice) AS n FROM orders GROUP BY o_custkey")
def h3b(spark, sf):
    return answer(trade(spark, sf), [("customer", "?c"), ("agg/max", "?n", "?p", [("ordered", "?c", "?o"), ("price", "?o", "?p")])], ["c", "n"])


@query("h4_avg", "SELECT l_orderkey AS o, sum(DISTINCT l_quantity)::DOUBLE / count(DISTINCT l_quantity) AS n FROM lineitem GROUP BY l_orderkey")
def h4(spark, sf):
    t = trade(spark, sf)
    t["order"] = rel(spark, sf, "lineitem", "l_orderkey")
    return answer(t, [("order", "?o"), ("agg/avg", "?n", "?q", [("quantity", "?o", "?q")])], ["o", "n"])


@query("h7_having", "SELECT o_custkey AS c, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) > 12")
def h7(spark, sf):
    return answer(trade(spark, sf), [("customer", "?c"), ("agg/count", "?n", "?o", [("ordered", "?c", "?o")]), ("lessThan", 12, "?n")], ["c", "n"])


# --- recursion and graphs


TYPE_EDGES = (
    "SELECT DISTINCT p_name AS a, string_split(p_name, ' ')[-1] AS b FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[-1], 'thing' FROM part"
)


def type_edges(spark, sf) -> DataFrame:
    """Part names as types: each below its noun, nouns below thing."""
    part, noun = read(spark, sf, "part"), F.element_at(F.split("p_name", " "), -1)
    return part.select(F.col("p_name").alias("a"), noun.alias("b")).union(part.select(noun, F.lit("thing"))).where("a <> b").distinct()


@query("f1_genl_closure", f"WITH RECURSIVE e AS (SELECT * FROM ({TYPE_EDGES}) WHERE a <> b), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM c UNION SELECT a, a FROM e UNION SELECT b, b FROM e")
def f1(spark, sf):
    return closure.reflexive(type_edges(spark, sf))


@query(
    "b13_isa",
    f"WITH RECURSIVE e AS (SELECT * FROM ({TYPE_EDGES}) WHERE a <> b), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a), u AS (SELECT a, b FROM c UNION SELECT a, a FROM e UNION SELECT b, b FROM e) "
    "SELECT DISTINCT p_partkey AS x, b AS t FROM part JOIN u ON a = p_name",
)
def b13(spark, sf):
    return closure.members(read(spark, sf, "part").select(F.col("p_partkey").alias("x"), F.col("p_name").alias("t")), closure.reflexive(type_edges(spark, sf)))


@query(
    "f4_transitive",
    "SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 's' || s_suppkey, 'r' || n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey",
)
def f4(spark, sf):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = read(spark, sf, "supplier").select(tag("s", "s_suppkey").alias("a"), tag("n", "s_nationkey").alias("b")).union(read(spark, sf, "nation").select(tag("n", "n_nationkey"), tag("r", "n_regionkey")))
    return closure.transitive(edges)


@query(
    "e1_semi_naive",
    "WITH RECURSIVE s AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS p FROM lineitem), e AS (SELECT DISTINCT x.a, y.a AS b FROM s x JOIN s y USING (p)), "
    "c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a AS x, b AS y FROM c",
)
def e1(spark, sf):
    """Suppliers reachable over shared parts."""
    rules = [
        Rule(("shares", "?x", "?y"), (("supplies", "?x", "?p"), ("supplies", "?y", "?p"))),
        Rule(("reach", "?x", "?y"), (("shares", "?x", "?y"),)),
        Rule(("reach", "?x", "?z"), (("reach", "?x", "?y"), ("shares", "?y", "?z"))),
    ]
    return answer(forward(trade(spark, sf), rules), ("reach", "?x", "?y"))


@query("e18_stratified", "SELECT s_suppkey AS s FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def e18(spark, sf):
    rules = [
        Rule(("inZero", "?s"), (("inNation", "?s", "?n"), ("inRegion", "?n", 0))),
        Rule(("elsewhere", "?s"), (("supplier", "?s"), ("unknown", [("inZero", "?s")]))),
    ]
    return answer(forward(trade(spark, sf), rules), ("elsewhere", "?s"))


@query("e5_placed", "SELECT 'n' || s_nationkey AS ctx, s_suppkey AS s FROM supplier")
def e5(spark, sf):
    """Suppliers are stated in their nation, openness in each region: only the nation sees both."""
    sells = read(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("a1"), F.col("s_suppkey").alias("a2"))
    opened = read(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("a1"), F.lit("open").alias("a2"))
    out = forward_in({"sells": sells, "state": opened}, [Rule(("active", "?s"), (("sells", "?s"), ("state", "open")))], contexts(spark, sf))
    return out["active"].select(F.col("a1").alias("ctx"), F.col("a2").alias("s"))


@query("e14_evaluate", "SELECT DISTINCT o_orderkey AS o, o_totalprice * 2 + 1 AS r FROM orders WHERE o_totalprice * 2 + 1 > 500000")
def e14(spark, sf):
    return answer(trade(spark, sf), [("price", "?o", "?p"), ("evaluate", "?r", ("+", ("*", "?p", 2), 1)), ("lessThan", 500000, "?r")], ["o", "r"])


@query("i1_floor_mod", "SELECT DISTINCT p_partkey AS p, (p_size - 25) - 7 * floor((p_size - 25) / 7.0)::BIGINT AS m, (p_size - 25) % 7 AS r FROM part")
def i1(spark, sf):
    goal = [("size", "?p", "?z"), ("evaluate", "?d", ("-", "?z", 25)), ("evaluate", "?m", ("mod", "?d", 7)), ("evaluate", "?r", ("rem", "?d", 7))]
    return answer(trade(spark, sf), goal, ["p", "m", "r"])


@query("f12_equality", "SELECT doc_id AS term, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1")
def f12(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    low = docs.groupBy("h").agg(F.min("doc_id").alias("low"))
    return closure.components(docs.join(low, "h").select(F.col("low").alias("a"), F.col("doc_id").alias("b")))


@query(
    "f15_cycles",
    "SELECT 'n' || n_nationkey AS a, 'n' || min(n_nationkey::VARCHAR) OVER (PARTITION BY n_regionkey) AS name FROM nation",
)
def f15(spark, sf):
    nation = read(spark, sf, "nation").select("n_regionkey", F.concat(F.lit("n"), "n_nationkey").alias("a"))
    edges = nation.join(nation.select("n_regionkey", F.col("a").alias("b")), "n_regionkey").where("a <> b").select("a", "b")
    return closure.cycles(closure.reflexive(edges))


@query("f5_widest", "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b, 1 + n_nationkey % 2 AS s FROM nation), c AS (SELECT a, b, s FROM e UNION SELECT c.a, e.b, least(c.s, e.s) FROM c JOIN e ON c.b = e.a) SELECT a, b, max(s) AS s FROM c GROUP BY a, b")
def f5(spark, sf):
    k = F.col("n_nationkey")
    return closure.widest(read(spark, sf, "nation").select(k.alias("a"), ((k + 1) % 25).alias("b"), (1 + k % 2).alias("s")))


@query("f10_disjoint", f"WITH RECURSIVE e AS (SELECT * FROM ({TYPE_EDGES}) WHERE a <> b), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a), u AS (SELECT a, b FROM c UNION SELECT a, a FROM e UNION SELECT b, b FROM e) SELECT DISTINCT x.a AS x, y.a AS y FROM u x, u y WHERE (x.b = 'widget' AND y.b = 'bolt') OR (x.b = 'bolt' AND y.b = 'widget')")
def f10(spark, sf):
    declared = spark.createDataFrame([("widget", "bolt")], "a string, b string")
    return closure.separated(declared, closure.reflexive(type_edges(spark, sf)))


@query("c5_unfolded", "SELECT DISTINCT l_partkey AS p, n_regionkey AS r FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey")
def c5(spark, sf):
    rules = (Rule(("suppliedFrom", "?p", "?n"), (("supplies", "?s", "?p"), ("inNation", "?s", "?n"))), Rule(("partRegion", "?p", "?r"), (("suppliedFrom", "?p", "?n"), ("inRegion", "?n", "?r"))))
    return KB(spark, trade(spark, sf), rules).query(("partRegion", "?p", "?r"), depth=2)


# --- belief


def opinions(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(premises, just, facts): every labelled document is good by default, toxic ones are not, strictly."""
    labels = read(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = F.col("doc_id").cast("string")
    key = lambda p: F.concat(F.lit(p), d)
    toxic = labels.where("toxic = 1")
    premises = labels.select(key("doc ").alias("sid"), F.lit(2).alias("s")).union(toxic.select(key("toxic "), F.lit(2)))
    just = labels.select(key("j-good ").alias("jid"), key("good ").alias("conseq"), F.array(key("doc ")).alias("ante"), F.lit(1).alias("s")).union(toxic.select(key("j-bad "), key("not good "), F.array(key("toxic ")), F.lit(2)))
    facts = labels.select(key("good ").alias("sid"), key("good ").alias("body"), F.lit(True).alias("truth")).union(toxic.select(key("not good "), key("good "), F.lit(False)))
    return premises, just, facts


OPINIONS = "(SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id)"


@query("g1_labels", f"SELECT 'doc ' || doc_id AS sid, 2 AS s FROM {OPINIONS} UNION ALL SELECT 'good ' || doc_id, 1 FROM {OPINIONS} UNION ALL SELECT 'toxic ' || doc_id, 2 FROM {OPINIONS} WHERE toxic = 1 UNION ALL SELECT 'not good ' || doc_id, 2 FROM {OPINIONS} WHERE toxic = 1")
def g1(spark, sf):
    premises, just, _ = opinions(spark, sf)
    return belief.labels(premises, just)


@query("g6_resolve", f"SELECT 'good ' || doc_id AS sid, 'defeated' AS state FROM {OPINIONS} WHERE toxic = 1 UNION ALL SELECT 'good ' || doc_id, 'believed' FROM {OPINIONS} WHERE toxic = 0 UNION ALL SELECT 'not good ' || doc_id, 'believed' FROM {OPINIONS} WHERE toxic = 1")
def g6(spark, sf):
    premises, just, facts = opinions(spark, sf)
    held, defeated, _ = belief.resolve(premises, just, facts)
    return defeated.select("sid", F.lit("defeated").alias("state")).union(held.join(facts, "sid", "left_semi").select("sid", F.lit("believed")))


@query("g5_dilemmas", "SELECT 'good ' || doc_id || '|' || 'not good ' || doc_id AS nid, 'dilemma' AS verdict FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(toxic) = 1)")
def g5(spark, sf):
    premises, just, facts = opinions(spark, sf)
    return belief.resolve(premises, just.withColumn("s", F.lit(1)), facts)[2]


@query("g7_except_when", f"SELECT doc_id AS d FROM {OPINIONS} WHERE toxic = 0")
def g7(spark, sf):
    labels = read(spark, sf, "labels").select(F.col("doc_id").alias("a1"), F.col("toxic").alias("a2")).distinct()
    rule = Rule(("good", "?d"), (("label", "?d", "?t"),), default=True, exceptions=((("label", "?d", 1),),))
    return answer(forward({"label": labels}, [rule]), ("good", "?d"))


@query("c9_argue", f"SELECT doc_id AS key, CASE WHEN toxic = 1 THEN 'false' ELSE 'true' END AS verdict FROM {OPINIONS}")
def c9(spark, sf):
    labels = read(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).select(F.col("doc_id").alias("key"), "toxic")
    return belief.argue(labels.select("key", F.lit(1).alias("s")), labels.where("toxic = 1").select("key", F.lit(2).alias("s")), labels.select("key"))


@query("c13_why", "SELECT DISTINCT l_partkey AS p, count(DISTINCT l_suppkey) AS proofs FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 3 GROUP BY l_partkey")
def c13(spark, sf):
    t = trade(spark, sf)
    rule = Rule(("suppliedFrom", "?p", "?n"), (("supplies", "?s", "?p"), ("inNation", "?s", "?n")), name="from")
    t["inNation"] = t["inNation"].where("a2 = 3")
    made = firings(rule, t)
    heads = answer(forward(t, [rule]), ("suppliedFrom", "?p", "?n"))
    sid = F.sha2(F.concat_ws(" ", F.lit("suppliedFrom"), F.col("p").cast("string"), F.col("n").cast("string")), 256)
    return made.groupBy("conseq").agg(F.count("*").alias("proofs")).join(heads.select("p", sid.alias("conseq")), "conseq").select("p", "proofs")


@query("c14_why_not", f"SELECT 'good ' || doc_id AS sid, CASE WHEN toxic = 1 THEN 'defeated' ELSE 'believed' END AS reason FROM {OPINIONS} UNION ALL SELECT 'good -1', 'not-stored'")
def c14(spark, sf):
    premises, just, facts = opinions(spark, sf)
    held, defeated, _ = belief.resolve(premises, just, facts)
    good = facts.where("truth").select("sid")
    asked = good.union(spark.createDataFrame([("good -1",)], "sid string"))
    return belief.why_not(asked, good, held, defeated, good.limit(0), good.limit(0))


@query("g13_preview", "SELECT o_custkey AS x, 'removed' AS change FROM orders GROUP BY o_custkey HAVING max(o_orderdate) < TIMESTAMP '1997-01-01'")
def g13(spark, sf):
    orders = read(spark, sf, "orders")
    active = Rule(("active", "?x"), (("ordered", "?x", "?o"),))
    now, then = (KB(spark).tell("ordered", df.select(F.col("o_custkey").alias("a1"), F.col("o_orderkey").alias("a2"))).rule(active) for df in (orders, orders.where("o_orderdate >= timestamp_ntz'1997-01-01'")))
    return now.preview(then, "active").withColumnRenamed("a1", "x")


# --- constraints


@query("j9_functional", "SELECT user_id AS a, count(DISTINCT event_type) AS n FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def j9(spark, sf):
    return constraints.functional(read(spark, sf, "events").select(F.col("user_id").alias("a"), F.col("event_type").alias("b")).distinct())


@query("j7_disjoint", "SELECT DISTINCT doc_id AS x, 'good' AS t1, 'toxic' AS t2 FROM labels WHERE quality = 1 AND toxic = 1")
def j7(spark, sf):
    labels = read(spark, sf, "labels")
    member = labels.where("quality = 1").select(F.col("doc_id").alias("x"), F.lit("good").alias("t")).union(labels.where("toxic = 1").select("doc_id", F.lit("toxic"))).distinct()
    return constraints.disjoint(member, spark.createDataFrame([("good", "toxic"), ("toxic", "good")], "x string, y string"))


SUPPLY = "(SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)"


def supply(spark, sf) -> DataFrame:
    """(a, b): customers in nation a buy from suppliers in nation b."""
    t = trade(spark, sf)
    t["sold"] = rel(spark, sf, "lineitem", "l_orderkey", "l_suppkey")
    return answer(t, [("sold", "?o", "?s"), ("inNation", "?s", "?b"), ("ordered", "?c", "?o"), ("customerIn", "?c", "?a")], ["a", "b"])


@query("j10_asymmetric", f"SELECT x.a, x.b FROM {SUPPLY} x JOIN {SUPPLY} y ON x.a = y.b AND x.b = y.a WHERE x.a <= x.b")
def j10(spark, sf):
    return constraints.asymmetric(supply(spark, sf))


@query("j11_irreflexive", f"SELECT a, b FROM {SUPPLY} WHERE a = b")
def j11(spark, sf):
    return constraints.irreflexive(supply(spark, sf))


@query("j13_anti_transitive", f"SELECT x.a, x.b, y.b AS c FROM {SUPPLY} x JOIN {SUPPLY} y ON x.b = y.a JOIN {SUPPLY} z ON z.a = x.a AND z.b = y.b")
def j13(spark, sf):
    return constraints.anti_transitive(supply(spark, sf))


@query("j1_arg_type", "SELECT DISTINCT l_partkey AS x FROM lineitem JOIN part ON p_partkey = l_partkey WHERE string_split(p_name, ' ')[-1] <> 'widget'")
def j1(spark, sf):
    values = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("x")).distinct()
    member = closure.members(read(spark, sf, "part").select(F.col("p_partkey").alias("x"), F.col("p_name").alias("t")), closure.reflexive(type_edges(spark, sf)))
    return constraints.arg_type(values, member, "widget")


@query("j5_arity", "SELECT p_partkey AS sid, (p_size % 4)::BIGINT AS words FROM part WHERE p_size % 4 <> 2")
def j5(spark, sf):
    args = F.slice(F.array(*[F.lit("x")] * 3), 1, (F.col("p_size") % 4).cast("int"))
    facts = read(spark, sf, "part").select(F.col("p_partkey").alias("sid"), F.lit("name").alias("pred"), args.alias("args"))
    return constraints.arity(facts, spark.createDataFrame([("name", 2)], "pred string, n int")).select("sid", F.size("args").cast("long").alias("words"))


@query("j4_literal_kind", "SELECT p_partkey, p_name AS w FROM part WHERE p_size <= 25 AND NOT regexp_matches(p_name, '^[A-Za-z][A-Za-z0-9_]*$')")
def j4(spark, sf):
    """Names of two words are no symbols, their nouns are."""
    word = F.when(F.col("p_size") > 25, F.element_at(F.split("p_name", " "), -1)).otherwise(F.col("p_name"))
    return constraints.literal_kind(read(spark, sf, "part").select("p_partkey", word.alias("w")), "w", "Symbol")


# --- reasoners


SPANS = "(SELECT user_id AS u, min(epoch_us(ts)) // 1000000 AS a, max(epoch_us(ts)) // 1000000 + 1 AS b FROM events GROUP BY user_id)"


@query(
    "k2_allen",
    f"SELECT x.u AS i, y.u AS j, CASE WHEN x.b < y.a THEN 'before' WHEN x.b = y.a THEN 'meets' WHEN y.b < x.a THEN 'after' WHEN y.b = x.a THEN 'metBy' WHEN x.a = y.a AND x.b = y.b THEN 'intervalEqual' "
    "WHEN x.a = y.a AND x.b < y.b THEN 'starts' WHEN x.a = y.a THEN 'startedBy' WHEN x.b = y.b AND x.a > y.a THEN 'finishes' WHEN x.b = y.b THEN 'finishedBy' WHEN x.a > y.a AND x.b < y.b THEN 'during' "
    f"WHEN x.a < y.a AND x.b > y.b THEN 'contains' WHEN x.a < y.a THEN 'overlaps' ELSE 'overlappedBy' END AS rel FROM {SPANS} x JOIN {SPANS} y ON y.u = x.u + 1",
)
def k2(spark, sf):
    t = F.expr("unix_micros(cast(ts as timestamp)) div 1000000")
    span = read(spark, sf, "events").groupBy(F.col("user_id").alias("u")).agg(F.min(t).alias("a"), (F.max(t) + 1).alias("b"))
    other = span.select((F.col("u") - 1).alias("u"), F.col("u").alias("j"), F.col("a").alias("c"), F.col("b").alias("d"))
    return span.join(other, "u").select(F.col("u").alias("i"), "j", qualitative.allen_relation(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("rel"))


@query("k1_path_consistency", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def k1(spark, sf):
    """Nations of a region stated in a chain of `before`; all later pairs follow."""
    of = qualitative.calculus("allen")
    nation = read(spark, sf, "nation").select("n_regionkey", "n_nationkey")
    after = nation.select("n_regionkey", F.col("n_nationkey").alias("b")).join(nation, "n_regionkey").where("n_nationkey < b").groupBy("n_regionkey", "n_nationkey").agg(F.min("b").alias("b"))
    stated = after.select(F.col("n_regionkey").alias("ctx"), F.col("n_nationkey").alias("a"), "b", F.lit(of.mask("before")).alias("mask"))
    return qualitative.entailed(qualitative.path_consistent(stated, of), of, "before").select("a", "b")


@query("k7_distance", "SELECT o_orderkey AS o, CASE WHEN d <= 0 THEN 'coLocatedWith' WHEN d <= 1 THEN 'veryCloseTo' WHEN d <= 10 THEN 'closeTo' WHEN d <= 100 THEN 'nearTo' WHEN d <= 1000 THEN 'moderatelyFarFrom' WHEN d <= 10000 THEN 'farFrom' ELSE 'veryFarFrom' END AS c FROM (SELECT o_orderkey, abs(o_totalprice - 1000 * o_custkey) AS d FROM orders)")
def k7(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("o"), qualitative.distance_class(F.abs(F.col("o_totalprice") - 1000 * F.col("o_custkey"))).alias("c"))


@query("k11_bounds", "SELECT a.n_nationkey AS p, b.n_nationkey AS q, (sum(c.n_nationkey % 5))::DOUBLE AS lo, (sum(c.n_nationkey % 5) + b.n_nationkey - a.n_nationkey)::DOUBLE AS hi FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey JOIN nation c ON c.n_nationkey >= a.n_nationkey AND c.n_nationkey < b.n_nationkey GROUP BY 1, 2")
def k11(spark, sf):
    k = F.col("n_nationkey")
    gaps = read(spark, sf, "nation").where("n_nationkey < 24").select(F.lit(0).alias("ctx"), k.alias("p"), (k + 1).alias("q"), (k % 5).cast("double").alias("lo"), (k % 5 + 1).cast("double").alias("hi"))
    return metric_time.bounds(gaps).where("p < q").select("p", "q", "lo", "hi")


@query("k14_total_duration", "SELECT c_nationkey AS grp, sum(c_custkey % 10)::DOUBLE AS lo, sum(c_custkey % 10 + 1)::DOUBLE AS hi FROM customer GROUP BY c_nationkey")
def k14(spark, sf):
    c = read(spark, sf, "customer")
    m = (F.col("c_custkey") % 10).cast("double")
    return metric_time.total_duration(c.select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("i")), c.select(F.col("c_custkey").alias("i"), m.alias("lo"), (m + 1).alias("hi")))


@query("i6_measures", "SELECT p_partkey AS p, p_size * CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 60.0 ELSE 3600.0 END AS seconds FROM part WHERE p_size * CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 60.0 ELSE 3600.0 END < 600 - 1e-9")
def i6(spark, sf):
    units = spark.createDataFrame([("Second", "Second", 1.0), ("Minute", "Second", 60.0), ("Hour", "Second", 3600.0)], "unit string, base string, factor double")
    unit = F.element_at(F.array(F.lit("Second"), F.lit("Minute"), F.lit("Hour")), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = read(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("lo"), F.col("p_size").cast("double").alias("hi"), unit.alias("unit"))
    return measures.normalised(rows, units).where(measures.less_than(F.col("hi"), F.lit(600.0))).select(F.col("p_partkey").alias("p"), F.col("lo").alias("seconds"))


@query("i7_datetime", "SELECT o_orderkey AS o FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1996-03'")
def i7(spark, sf):
    day = F.date_format(F.col("o_orderdate").cast("timestamp_ntz").cast("timestamp"), "yyyy-MM-dd")
    return read(spark, sf, "orders").where(measures.subinterval(day, F.lit("1996-03"))).select(F.col("o_orderkey").alias("o"))


@query("l4_classify", "SELECT p_brand AS head, CASE WHEN count(DISTINCT p_size) = (SELECT count(DISTINCT p_size) FROM part) THEN 'forced' ELSE 'supportable' END AS verdict FROM part GROUP BY p_brand UNION ALL SELECT 'Brand#none', 'excluded'")
def l4(spark, sf):
    """Each part size is a stored labelling; a brand is forced if it is in all of them."""
    stored = read(spark, sf, "part").select(F.col("p_size").alias("labeling"), F.col("p_brand").alias("atom"))
    heads = stored.select("atom").distinct().union(spark.createDataFrame([("Brand#none",)], "atom string"))
    return solve.classify(stored, heads).select(F.col("atom").alias("head"), "verdict")


@query("m1_belief_diff", "SELECT user_id, 'added' AS change FROM (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-29' EXCEPT SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02') UNION ALL SELECT user_id, 'removed' FROM (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02' EXCEPT SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-29')")
def m1(spark, sf):
    events = read(spark, sf, "events")
    early, late = events.where("ts < timestamp_ntz'2024-01-02'"), events.where("ts >= timestamp_ntz'2024-01-29'")
    return belief.difference(early.select("user_id").distinct(), late.select("user_id").distinct())


# --- terms, preserved arguments, further literals


@query("b7_negative_literal", f"SELECT doc_id AS d FROM {OPINIONS} WHERE toxic = 1")
def b7(spark, sf):
    known = read(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    kb = KB(spark).tell("good", known.where("toxic = 0").select(F.col("doc_id").alias("a1"))).tell("not good", known.where("toxic = 1").select(F.col("doc_id").alias("a1")))
    return kb.query(("not", ("good", "?d")))


@query("c8_budget", "SELECT o_orderkey AS o FROM orders ORDER BY o_orderkey LIMIT 20")
def c8(spark, sf):
    """The first 20 answers in content order: the result bound is the feature."""
    return answer({"order": rel(spark, sf, "orders", "o_orderkey")}, ("order", "?o")).orderBy("o").limit(20)


@query("d7_hierarchical_join", f"WITH RECURSIVE e AS (SELECT * FROM ({TYPE_EDGES}) WHERE a <> b), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a), u AS (SELECT a, b FROM c UNION SELECT a, a FROM e UNION SELECT b, b FROM e) SELECT DISTINCT l_suppkey AS s, b AS t FROM lineitem JOIN part ON p_partkey = l_partkey JOIN u ON a = p_name")
def d7(spark, sf):
    isa = read(spark, sf, "part").select(F.col("p_partkey").alias("a1"), F.col("p_name").alias("a2"))
    up = closure.reflexive(type_edges(spark, sf)).select(F.col("a").alias("a1"), F.col("b").alias("a2"))
    t = trade(spark, sf) | {"isa": isa, "genl": up}
    return answer(t, [("supplies", "?s", "?p"), ("isa", "?p", "?n"), ("genl", "?n", "?t")], ["s", "t"])


@query("e11_skolem", "SELECT c_custkey AS c, 'nat/' || sha256('accountOf ' || c_custkey) AS account FROM customer")
def e11(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("c"), terms.minted("accountOf", F.col("c_custkey")).alias("account"))


@query("f6_preserved", "SELECT DISTINCT p_name AS z, string_split(p_name, ' ')[-1] <> 'widget' AS truth FROM part")
def f6(spark, sf):
    """Things are sold by default, widgets aren't: the lower claim wins for all widget names."""
    claims = spark.createDataFrame([("sold", "thing", True, 1), ("sold", "widget", False, 1)], "x string, node string, truth boolean, s int")
    up = closure.reflexive(type_edges(spark, sf))
    names = read(spark, sf, "part").select(F.col("p_name").alias("z")).distinct()
    return terms.preserved(claims, up).join(names, "z", "left_semi").select("z", "truth")


@query("f8_inverse", "SELECT s_suppkey AS a, s_nationkey::BIGINT AS b FROM supplier UNION SELECT c_nationkey::BIGINT, c_custkey FROM customer")
def f8(spark, sf):
    long = lambda df, a, b: df.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    return terms.inverse(long(read(spark, sf, "supplier"), "s_suppkey", "s_nationkey"), long(read(spark, sf, "customer"), "c_custkey", "c_nationkey"))


@query("g10_retract", "SELECT DISTINCT l_partkey AS p FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey <> 1")
def g10(spark, sf):
    kb = KB(spark, trade(spark, sf)).rule(Rule(("available", "?p"), (("supplies", "?s", "?p"), ("supplier", "?s"))))
    return kb.retract("supplier", [(1,)]).prove(("available", "?p"))


@query("h9_measure_sum", "SELECT p_brand AS b, sum(DISTINCT p_size * CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 60.0 ELSE 3600.0 END)::DOUBLE AS seconds FROM part GROUP BY p_brand")
def h9(spark, sf):
    units = spark.createDataFrame([("Second", "Second", 1.0), ("Minute", "Second", 60.0), ("Hour", "Second", 3600.0)], "unit string, base string, factor double")
    unit = F.element_at(F.array(F.lit("Second"), F.lit("Minute"), F.lit("Hour")), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = measures.normalised(read(spark, sf, "part").select("p_brand", F.col("p_size").cast("double").alias("lo"), F.col("p_size").cast("double").alias("hi"), unit.alias("unit")), units)
    t = {"brand": rows.select(F.col("p_brand").alias("a1")).distinct(), "lasts": rows.select(F.col("p_brand").alias("a1"), F.col("lo").alias("a2")).distinct()}
    return answer(t, [("brand", "?b"), ("agg/sum", "?seconds", "?v", [("lasts", "?b", "?v")])], ["b", "seconds"])


@query("i9_rewritten", "SELECT DISTINCT min(doc_id) OVER (PARTITION BY text) AS doc, lang FROM documents")
def i9(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    low = docs.groupBy("h").agg(F.min("doc_id").alias("low"))
    rep = closure.components(docs.join(low, "h").select(F.col("low").alias("a"), F.col("doc_id").alias("b")))
    return terms.rewritten(docs.select(F.col("doc_id").alias("doc"), "lang"), rep, "doc")


@query("i13_corresponding", "SELECT c_custkey AS c, coalesce((SELECT min(o_orderkey)::VARCHAR FROM orders WHERE o_custkey = c_custkey), 'nat/' || sha256('firstOrder ' || c_custkey)) AS v FROM customer")
def i13(spark, sf):
    customers = read(spark, sf, "customer").select(F.col("c_custkey").alias("c"))
    return terms.corresponding(customers, trade(spark, sf)["ordered"], "firstOrder", "c", "v")


@query("j2_arg_genl", "SELECT DISTINCT p_name AS x FROM part WHERE string_split(p_name, ' ')[-1] <> 'widget'")
def j2(spark, sf):
    return constraints.arg_genl(read(spark, sf, "part").select(F.col("p_name").alias("x")).distinct(), closure.reflexive(type_edges(spark, sf)), "widget")


@query("j3_inter_arg", "SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE s_nationkey = 3 AND string_split(p_name, ' ')[-1] <> 'widget'")
def j3(spark, sf):
    """Suppliers of nation 3 may only supply widgets."""
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    made = closure.members(read(spark, sf, "part").select(tag("p", "p_partkey").alias("x"), F.col("p_name").alias("t")), closure.reflexive(type_edges(spark, sf)))
    member = made.union(read(spark, sf, "supplier").select(tag("s", "s_suppkey"), tag("nation", "s_nationkey")))
    pairs = read(spark, sf, "lineitem").select(tag("s", "l_suppkey").alias("a"), tag("p", "l_partkey").alias("b")).distinct()
    bad = constraints.inter_arg(pairs, member, "nation3", "widget")
    return bad.select(F.substring("a", 2, 20).cast("long").alias("a"), F.substring("b", 2, 20).cast("long").alias("b"))


@query("j8_clique", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_name <> b.n_name")
def j8(spark, sf):
    return closure.clique(read(spark, sf, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_name").alias("a")))


@query("j12_anti_symmetric", f"SELECT x.a, x.b FROM {SUPPLY} x JOIN {SUPPLY} y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")
def j12(spark, sf):
    return constraints.anti_symmetric(supply(spark, sf))


@query("j18_lifted", "SELECT DISTINCT s_suppkey AS sid, 'CxUniverse' AS ctx FROM supplier UNION SELECT 100000 + r_regionkey, 'CxUniverse' FROM region")
def j18(spark, sf):
    return context.lifted(context_facts(spark, sf), "CxUniverse")


@query("k3_points", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
def k3(spark, sf):
    """A chain of instantBefore in each region; path consistency gives all later pairs."""
    of = qualitative.calculus("point")
    nation = read(spark, sf, "nation").select("n_regionkey", "n_nationkey")
    after = nation.select("n_regionkey", F.col("n_nationkey").alias("b")).join(nation, "n_regionkey").where("n_nationkey < b").groupBy("n_regionkey", "n_nationkey").agg(F.min("b").alias("b"))
    stated = after.select(F.col("n_regionkey").alias("ctx"), F.col("n_nationkey").alias("a"), "b", F.lit(of.mask("instantBefore")).alias("mask"))
    return qualitative.entailed(qualitative.path_consistent(stated, of), of, "instantBefore").select("a", "b")


@query("k4_regions", "SELECT 's' || s_suppkey AS a, 'r' || n_regionkey AS b FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def k4(spark, sf):
    """Suppliers are inside nations, nations inside regions: non-tangential parts compose."""
    of = qualitative.calculus("rcc8")
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    inside = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    # One context for each supplier keeps every network small.
    stated = inside.select(F.col("s_suppkey").alias("ctx"), tag("s", "s_suppkey").alias("a"), tag("n", "n_nationkey").alias("b")).union(inside.select("s_suppkey", tag("n", "n_nationkey"), tag("r", "n_regionkey")))
    tight = qualitative.path_consistent(stated.withColumn("mask", F.lit(of.mask("nonTangentialProperPart"))), of)
    return qualitative.entailed(tight, of, "nonTangentialProperPart").where("a like 's%' and b like 'r%'").select("a", "b")


@query("k15_overlap", f"SELECT x.u AS i, y.u AS j, greatest(0, least(x.b, y.b) - greatest(x.a, y.a))::DOUBLE AS seconds FROM {SPANS} x JOIN {SPANS} y ON y.u = x.u + 1")
def k15(spark, sf):
    t = F.expr("unix_micros(cast(ts as timestamp)) div 1000000").cast("double")
    span = read(spark, sf, "events").groupBy(F.col("user_id").alias("u")).agg(F.min(t).alias("a"), (F.max(t) + 1).alias("b"))
    other = span.select((F.col("u") - 1).alias("u"), F.col("u").alias("j"), F.col("a").alias("c"), F.col("b").alias("d"))
    return span.join(other, "u").select(F.col("u").alias("i"), "j", metric_time.overlap(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("seconds"))


@query("l3_label", "SELECT n_regionkey::VARCHAR AS region, min(n_nationkey)::VARCHAR AS nation FROM nation GROUP BY n_regionkey")
def l3(spark, sf):
    """One nation of each region is chosen at the least cost; no two of one region."""
    nation = read(spark, sf, "nation").select("n_regionkey", "n_nationkey", F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("atom"))
    two = nation.select("n_regionkey", F.col("atom").alias("other"))
    hard = nation.join(two, "n_regionkey").where("atom < other").select(F.array("atom", "other").alias("atoms"))
    needs = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("atom")).alias("atoms")).select("atoms")
    soft = nation.select(F.array("atom").alias("atoms"), F.col("n_nationkey").cast("double").alias("cost"))
    chosen = solve.label(nation.select("atom"), needs, hard, soft)
    return chosen.join(nation, "atom").select(F.col("n_regionkey").cast("string").alias("region"), F.col("n_nationkey").cast("string").alias("nation"))


__all__ = ["FLAGSHIP", "oracle_sql", "queries", "unfold"]
