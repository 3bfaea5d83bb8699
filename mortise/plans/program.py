"""Forward chaining: rules closed stratum by stratum, semi-naively, with their justifications."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortise.operators.closure import components
from mortise.operators.context import placement
from mortise.operators.loops import grow, rounds, settled
from mortise.operators.meet import crossed, met, minus, spread
from mortise.plans.compile import Closed, Facts, _value, column, conclusions, conjunction, match, nothing
from mortise.plans.lang import SPECIAL, Rule, is_var, plain, predicates, strata

DELTA = "*"
#: Members of a class that its pairs run through in turn; files hold short cycles in less space.
CYCLE = 1 << 9
Conclude = Callable[[Rule, Facts, DataFrame | None], DataFrame]


def _swapped(rule: Rule, at: int) -> Rule:
    """The rule with its literal `at` reading only what the last round added."""
    body = tuple((lit[0] + DELTA, *lit[1:]) if i == at else lit for i, lit in enumerate(rule.body))
    return Rule(rule.head, body, rule.default, rule.name, rule.exceptions)


def _functor(rule: Rule) -> str:
    """What a rule concludes about; a head ("ist", context, literal) is placed in that context."""
    return plain(rule.head[2])[0] if rule.head[0] == "ist" else rule.head[0]


def absorbed(known: dict[str, DataFrame], found: dict[str, list[DataFrame]]) -> dict[str, DataFrame]:
    """predicate -> its new rows among those `found`; `known` grows by them."""
    delta = {}
    for p, parts in found.items():
        new = parts[0]
        for x in parts[1:]:
            new = new.unionByName(x)
        new = new.distinct()
        if p in known:
            new = new.join(known[p], new.columns, "left_anti")
        new = settled(new)
        if not new.isEmpty():
            delta[p] = new
        known[p] = known[p].unionByName(new) if p in known else new
    return delta


def _close(known: dict[str, DataFrame], delta: dict[str, DataFrame], rules: list[Rule], rep: DataFrame | None, most: int | None, conclude: Conclude) -> None:
    """Closes `known` under rules, given what has just been added to it: a round reads each literal's growth once."""
    for _ in rounds(most):
        seen = known | {p + DELTA: d for p, d in delta.items()}
        found: dict[str, list[DataFrame]] = {}
        for r in rules:
            for i, lit in enumerate(r.body):
                if lit[0] in delta:
                    found.setdefault(_functor(r), []).append(conclude(_swapped(r, i), seen, rep))
        if not found:
            return
        delta = absorbed(known, found)


def extended(closed: Facts, rules: Iterable[Rule], added: Facts | None = None, new_rules: Iterable[Rule] = (), rep: DataFrame | None = None, most: int | None = None) -> dict[str, DataFrame]:
    """Closed facts after more facts (predicate -> rows) and more rules, joining only what they reach.

    A new rule is joined in full once, everything else over growth. More facts can't take a
    conclusion away unless a rule reads a predicate as a whole (unknown, aggregates, exceptions):
    then this refuses, and forward() over all that is stated is the way.
    """
    active = [r for r in (*rules, *new_rules) if r.direction in ("forward", "both")]
    if any(r.exceptions or any(whole for _, whole in predicates(r.body)) or any(x[0] == "thereExists" for x in r.body) for r in active):
        raise ValueError("a rule reads a predicate as a whole: close all stated facts anew")
    known = dict(closed)
    delta = absorbed(known, {p: [df] for p, df in (added or {}).items()})
    found: dict[str, list[DataFrame]] = {}
    for r in new_rules:
        if r.direction in ("forward", "both"):
            found.setdefault(_functor(r), []).append(conclusions(r, known, rep))
    for p, new in absorbed(known, found).items():
        delta[p] = delta[p].unionByName(new) if p in delta else new
    _close(known, delta, active, rep, most, conclusions)
    return known


def _linear(rule: Rule) -> str | None:
    """The relation q of a rule p(x, z) <- p(x, y), q(y, z)."""
    if len(rule.head) != 3 or len(rule.body) != 2 or rule.exceptions:
        return None
    (x, z), p = rule.head[1:], rule.head[0]
    for first, second in (rule.body, rule.body[::-1]):
        if len(first) == len(second) == 3 and first[0] == p != second[0] and second[0] not in SPECIAL:
            y = first[2]
            if all(map(is_var, (x, y, z))) and len({x, y, z}) == 3 and first[1] == x and second[1:] == (y, z):
                return second[0]
    return None


def _blocks(rule: Rule) -> tuple[tuple, list[str], str] | None:
    """(literal, keys, member) of a rule q(x, y) <- r(x, keys), r(y, keys), which relates all members of a block."""
    if len(rule.head) != 3 or len(rule.body) != 2 or rule.exceptions or rule.body[0][0] in SPECIAL:
        return None
    (x, y), (one, two) = rule.head[1:], rule.body
    if not (is_var(x) and is_var(y)) or x == y or one.count(x) != 1 or y in one or tuple(y if a == x else a for a in one) != two or "..." in one:
        return None
    keys = [v for v in dict.fromkeys(one[1:]) if is_var(v) and v != x]
    return (one, keys, x) if keys else None


def _of_blocks(block: tuple[tuple, list[str], str], facts: Facts) -> DataFrame:
    """(a1, a2): members of blocks that are connected over blocks, each pair once; a null member belongs to its block and connects none.

    Pairs come in runs of one a1 and short cycles of a2, which files hold in little space.
    """
    literal, keys, member = block
    keys = [column(v) for v in keys]
    rows = (match(facts[literal[0]], literal[1:]) if literal[0] in facts else nothing(facts, literal)).dropna(subset=keys).withColumnRenamed(column(member), "y")
    low = spread(rows, *keys).groupBy(*keys).agg(F.min("y").alias("low"), F.max(F.col("y").isNull()).alias("odd"))
    linked = rows.join(low.select(*keys, "low"), keys).where("y is not null").select(F.col("low").alias("a"), F.col("y").alias("b"))
    linked = settled(linked.distinct())
    names = components(linked).select(F.col("term").alias("b"), "rep")
    classes = settled(linked.select("b").distinct().join(names, "b", "left").select(F.coalesce("rep", "b").alias("c"), "b"))
    # Blocks with a null member give their class one; if none has other members, it is alone.
    odd = low.where("odd").select(F.col("low").alias("b")).distinct().join(classes, "b", "left").select("c", F.lit(None).cast(classes.schema["b"].dataType).alias("b"))
    odd = settled(odd.distinct())
    alone = odd.groupBy().agg(F.count("*").alias("n"), F.count("c").alias("k"), F.max("b").alias("b")).where("n > 0 and k = 0").select("b", "b")
    every = classes.union(odd.where("c is not null"))
    return crossed(every.withColumnRenamed("b", "a1"), every.withColumnRenamed("b", "a2"), ["c"], [], rows=CYCLE).select("a1", "a2").union(alone)


def _reached(stated: DataFrame, relation: DataFrame, most: int | None) -> DataFrame:
    """(a1, a2) of a linear rule p <- p q, each once: pairs of p, followed by any number of q's.

    Members that q relates in both directions are one class: (x, class) is closed over q between
    classes, and classes are spelled out once, at the end.
    """
    pair = lambda df, a, b: df.select(F.col(df.columns[0]).alias(a), F.col(df.columns[1]).alias(b))
    stated, edges = settled(pair(stated, "x", "y").distinct()), settled(pair(relation, "y", "z").where("y is not null").distinct())
    ends = edges.where("z is not null")
    twins = ends.join(ends.select(F.col("z").alias("y"), F.col("y").alias("z")), ["y", "z"]).where("y < z")
    names = components(twins.select(F.col("y").alias("a"), F.col("z").alias("b"))).select(F.col("term").alias("y"), "rep")
    classes = settled(edges.select("y").union(ends.select("z")).distinct().join(names, "y", "left").select("y", F.coalesce("rep", "y").alias("c")))
    between = ends.join(classes, "y").select(F.col("c").alias("a"), F.col("z").alias("y")).join(classes, "y").select("a", F.col("c").alias("b"))
    between = settled(between.where("a <> b").distinct())
    at = grow(stated.join(classes, "y").select("x", "c").distinct(), lambda delta, _: delta.join(between, F.col("c") == F.col("a")).select("x", F.col("b").alias("c")), most)
    # What q relates to null belongs to a class's members; nothing follows a pair whose second has no class.
    members = classes.select("c", F.col("y").alias("z")).union(edges.where("z is null").join(classes, "y").select("c", "z").distinct())
    out = met(at, members, ["c"]).select("x", "z")
    out = out if edges.where("z is null").isEmpty() else out.distinct()
    return minus(stated, out.select("x", F.col("z").alias("y")), ["x", "y"]).union(out).toDF("a1", "a2")


def forward(facts: Facts, rules: Iterable[Rule], rep: DataFrame | None = None, most: int | None = None, conclude: Conclude = conclusions) -> dict[str, DataFrame]:
    """All facts with what the rules conclude, as predicate -> (a1, a2, ...).

    Strata without a cycle are plain plans, written only where several rules read them. In a cyclic
    stratum a rule runs in full once, then once a round for each literal whose predicate grew, over
    that growth only; what is known is anti-joined, so cycles end. No new row ends the loop. A rule
    over a predicate without facts is idle. Rules that make new numbers may never end: `most` bounds
    their rounds and raises. Backward and inert rules don't take part.

    A stratum of one linear rule, p <- p q, is closed over classes of members that q relates in both
    directions; of a q that relates the members of blocks, not even its pairs are listed. Such a
    closure has no pair twice, and is marked so: its pairs, which may be far more than the facts, need
    no shuffle to be answered.
    """
    known, apart = dict(facts), {}
    rules = [r for r in rules if r.direction in ("forward", "both")]
    readers = Counter(p for r in rules for p, _ in predicates(r.body))
    for group in strata(rules):
        # Inside a stratum, what no rule of it is read by comes first, as plain plans.
        waiting = list(group)
        while ready := [r for r in waiting if not {p for p, _ in predicates(r.body)} & {_functor(x) for x in waiting}]:
            waiting = [r for r in waiting if not any(r is x for x in ready)]
            for p in dict.fromkeys(map(_functor, ready)):
                parts = [conclude(r, known, rep) for r in ready if _functor(r) == p]
                new = known[p] if p in known else parts.pop(0)
                for x in parts:
                    new = new.unionByName(x)
                new = new.distinct()
                # What relates the members of blocks stays a plan, as its pairs may be far more than its facts.
                known[p] = settled(new) if readers[p] > 1 and not (conclude is conclusions and any(map(_blocks, ready))) else new
        if not waiting:
            continue
        if conclude is conclusions and len(waiting) == 1 and (q := _linear(waiting[0])) in known and len(known[q].columns) == 2:
            p = waiting[0].head[0]
            makers, starts = ([r for r in rules if _functor(r) == x] for x in (q, p))
            block = _blocks(makers[0]) if len(makers) == 1 and q not in facts else None
            copies = p not in facts and len(starts) > 1 and all(r is waiting[0] or (not r.exceptions and r.body == ((q, *r.head[1:]),) and len(set(_vars(r.head[1:]))) == 2) for r in starts)
            if block and copies:
                apart[p] = known[p] = settled(_of_blocks(block, known)) if readers[p] > 2 else _of_blocks(block, known)
                continue
            if p in known and len(known[p].columns) == 2:
                apart[p] = known[p] = _reached(known[p], known[q], most)
                continue
        found: dict[str, list[DataFrame]] = {}
        for r in waiting:
            found.setdefault(_functor(r), []).append(conclude(r, known, rep))
        _close(known, absorbed(known, found), waiting, rep, most, conclude)
    return Closed(known, apart)


def placed(up: DataFrame) -> Conclude:
    """How rules conclude in contexts: facts are (context, arguments ...), up (a, b) says a sees b, reflexive.

    A firing's conclusion is put into the most general contexts that see all its grounds; grounds
    that no context sees together conclude nothing. A head ("ist", context, literal) goes to that
    context. Literals under unknown and aggregates read the facts of all contexts; their first
    argument is the context there.
    """

    def conclude(rule: Rule, facts: Facts, rep: DataFrame | None = None) -> DataFrame:
        grounds, body = [], []
        for lit in rule.body:
            if lit[0] in SPECIAL:
                body.append(lit)
            else:
                grounds.append(f"?ctx{len(grounds)}_")
                body.append((lit[0], grounds[-1], *lit[1:]))
        rows = conjunction(facts, body, rep)
        for e in rule.exceptions:
            rows = rows.join(conjunction(facts, list(e), rep), [column(v) for v in dict.fromkeys(v for x in e for v in _vars(x)) if column(v) in rows.columns], "left_anti")
        directed = rule.head[0] == "ist"
        head = plain(rule.head[2]) if directed else rule.head
        values = [_value(x).alias(f"a{i}") for i, x in enumerate(head[1:], 2)]
        if directed:
            return rows.select(_value(rule.head[1]).alias("a1"), *values).distinct()
        fired = rows.select(F.sha2(F.to_json(F.struct(*rows.columns)), 256).alias("firing"), F.array(*(F.col(column(c)) for c in grounds)).alias("ctxs"), *values)
        places = placement(fired.select("firing", F.explode("ctxs").alias("ctx")), up)
        return fired.join(places, "firing").select(F.col("ctx").alias("a1"), *(f"a{i}" for i in range(2, len(head) + 1))).distinct()

    return conclude


def forward_in(facts: Facts, rules: Iterable[Rule], up: DataFrame, most: int | None = None) -> dict[str, DataFrame]:
    """forward() over facts (context, arguments ...) with visibility and placement by `up`."""
    return forward(facts, rules, None, most, placed(settled(up)))


def sid(predicate: str, args: list) -> F.Column:
    """The content key of a fact: SHA-256 of its text."""
    return F.sha2(F.concat_ws(" ", F.lit(predicate), *(x.cast("string") for x in args)), 256)


def firings(rule: Rule, facts: Facts, rep: DataFrame | None = None) -> DataFrame:
    """Justifications of one rule: (jid, rule, conseq, ante array, s), one for each set of grounds.

    Bindings are made distinct before they get their long keys. Where two bindings may have the same
    grounds (a predicate read twice, texts with spaces, nulls, which keys leave out), their keys are, too.
    """
    rows = spread(conjunction(facts, list(rule.body), rep, whole=False)).distinct()
    read = [x for x in rule.body if x[0] not in SPECIAL]
    grounds = [sid(x[0], [_value(a) for a in x[1:]]) for x in read]
    name = rule.name or rule.head[0]

    def keyed(rows: DataFrame) -> DataFrame:
        made = rows.select(sid(rule.head[0], [_value(a) for a in rule.head[1:]]).alias("conseq"), F.array_sort(F.array(*grounds)).alias("ante"))
        return made.select(F.sha2(F.concat_ws("|", F.lit(name), "conseq", F.concat_ws(",", "ante")), 256).alias("jid"), F.lit(name).alias("rule"), "conseq", "ante", F.lit(1 if rule.default else 2).alias("s"))

    said = {column(v) for x in read for v in _vars(x[1:])}
    plain_words = len({x[0] for x in read}) == len(read) and "..." not in _words(read) and said == set(rows.columns) - {"v_"}
    if not plain_words or not said or any(kind not in ("tinyint", "smallint", "int", "bigint", "boolean", "date", "double") for c, kind in rows.dtypes if c in said):
        return keyed(rows).distinct()
    gaps = " or ".join(f"`{c}` is null" for c in sorted(said))
    return keyed(rows.where(f"not ({gaps})")).union(keyed(rows.where(gaps)).distinct())


def _words(x: object) -> set:
    return {w for y in x for w in _words(y)} if isinstance(x, tuple | list) else {x}


def unfold(goal: tuple | list, rules: Iterable[Rule], depth: int, stored: Iterable[str] | None = None) -> list[list[tuple]]:
    """The conjunctions that a goal (a literal or several) stands for when each literal is expanded by rules up to `depth` deep.

    The goal itself comes first. A goal variable that meets a constant or another variable in a
    head is bound by an `evaluate`; exceptions become `unknown`. With `stored`, the predicates that
    have facts, conjunctions that read others are left out, as they have no answers.
    """
    rules = [r for r in rules if r.direction in ("backward", "both")]
    stored = None if stored is None else set(stored)
    fresh = [0]

    def bodies(lit: tuple, left: int) -> list[list[tuple]]:
        if lit[0] in SPECIAL:
            return [[lit]]
        out = [[lit]] if stored is None or lit[0] in stored else []
        for r in rules if left else ():
            if r.head[0] != lit[0] or len(r.head) != len(lit):
                continue
            fresh[0] += 1
            named = {v: f"{v}_{fresh[0]}" for x in (r.head, *r.body, *r.exceptions) for v in _vars(x)}
            by, ties, terms = {}, [], []
            for h, a in zip(r.head[1:], lit[1:], strict=True):
                if isinstance(h, tuple):
                    terms.append((a, h))
                    continue
                h = named.get(h, h) if is_var(h) else h
                if is_var(h) and h not in by:
                    by[h] = a
                    continue
                h = by.get(h, h)
                if h == a:
                    continue
                if is_var(a):
                    ties.append(("evaluate", a, h))
                elif is_var(h):
                    ties.append(("evaluate", h, a))
                else:
                    break
            else:
                put = lambda x: _renamed(_renamed(x, named), by)  # noqa: E731, B023
                parts = [bodies(put(x), left - 1) for x in r.body]
                more = [*ties, *(("evaluate", a, _made(put(h))) for a, h in terms), *(("unknown", [put(x) for x in e]) for e in r.exceptions)]
                out += [[*(x for p in chosen for x in p), *more] for chosen in product(*parts)]
        return out

    literals = [goal] if isinstance(goal, tuple) and isinstance(goal[0], str) else list(goal)
    return [[x for p in chosen for x in p] for chosen in product(*(bodies(x, depth) for x in plain(literals)))]


def _vars(x: object) -> list[str]:
    if isinstance(x, str):
        return [x] if x.startswith("?") else []
    return [v for y in x for v in _vars(y)] if isinstance(x, tuple | list) else []


def _made(x: object) -> object:
    """A functional term of a head as an expression for `evaluate`."""
    return ("minted", x[0], *map(_made, x[1:])) if isinstance(x, tuple) else x


def _renamed(x: object, names: dict) -> object:
    if isinstance(x, str):
        return names.get(x, x)
    return type(x)(_renamed(y, names) for y in x) if isinstance(x, tuple | list) else x


def definition(kind: str, member: tuple, body: tuple) -> list[Rule]:
    """Rules of a collection's definition: `iff`, `necessary` (members meet it) or `sufficient` (what meets it is a member)."""
    out = []
    if kind in ("iff", "sufficient"):
        out.append(Rule(member, body))
    if kind in ("iff", "necessary"):
        # A literal with variables that only the body has says that something exists; it concludes nothing.
        out += [Rule(lit, (member,)) for lit in body if lit[0] not in SPECIAL and set(_vars(lit[1:])) <= set(_vars(member[1:]))]
    if not out:
        raise ValueError(f"{kind} isn't iff, necessary or sufficient, or it gives no rule")
    return out


def stamped(facts: Facts, condition: tuple, head: tuple, body: tuple, default: bool = False, name: str = "", most: int = 1000) -> list[Rule]:
    """Rules that a rule generator concludes: head and body with the condition's bindings put in, in the order of the bindings.

    Variables may stand for predicates there. Only declarations should match the condition; more
    than `most` of them are refused, none is dropped.
    """
    rows = conjunction(facts, list(condition))
    names = [c for c in rows.columns if c != "v_"]
    found = rows.orderBy(*names).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rules would be made")

    def put(x: object, by: dict) -> object:
        if isinstance(x, str):
            return by.get(x, x)
        return type(x)(put(y, by) for y in x) if isinstance(x, tuple | list) else x

    made = [{f"?{c[2:]}": r[c] for c in names} for r in found]
    return [Rule(put(head, by), put(body, by), default, " ".join([name, *map(str, by.values())]).strip()) for by in made]


def tally(rule: Rule, facts: Facts) -> DataFrame | None:
    """One row (firings, conclusions) of a rule without its firings: sums of products along its join tree.

    A literal whose shared variables all stand in another one is counted by them and multiplied into
    it, until only the literal that has the head's variables is left. None where that can't be said:
    a predicate that is read twice (swapped grounds are one firing), special literals, a cycle, or a
    head over several literals.
    """
    body = [x for x in rule.body if x[0] not in SPECIAL]
    if not body or len(body) < len(rule.body) or len({x[0] for x in body}) < len(body):
        return None
    trees = [(match(facts[x[0]], x[1:]) if x[0] in facts else nothing(facts, x)).distinct().withColumn("_n", F.lit(1).cast("long")) for x in body]
    has = [set(t.columns) - {"_n", "v_"} for t in trees]
    root = next((i for i, c in enumerate(has) if {column(v) for v in _vars(rule.head[1:])} <= c), None)
    if root is None:
        return None
    left = list(range(len(body)))
    while len(left) > 1:
        ear = next(((i, j, on) for i in left if i != root for j in left if j != i and (on := has[i] & set().union(*(has[k] for k in left if k != i))) <= has[j]), None)
        if ear is None:
            return None
        i, j, on = ear
        few = trees[i].groupBy(*sorted(on)).agg(F.sum("_n").alias("_m")).where("_m is not null")
        trees[j] = (trees[j].join(few, sorted(on)) if on else trees[j].crossJoin(few)).withColumn("_n", F.col("_n") * F.col("_m")).drop("_m")
        left.remove(i)
    heads = trees[root].select(*(_value(x).alias(f"a{i}") for i, x in enumerate(rule.head[1:], 1)), "_n")
    by = heads.groupBy(*heads.columns[:-1]).agg(F.sum("_n").alias("_n")).where("_n is not null")
    return by.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("firings"), F.count("*").alias("conclusions"))


def rule_report(rules: Iterable[Rule], facts: Facts) -> DataFrame:
    """(rule, firings, conclusions) of each rule over closed facts; an idle one has zeros."""
    out = None
    for r in rules:
        rows = tally(r, facts)
        if rows is None:
            rows = firings(r, facts).groupBy("conseq").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("firings"), F.count("*").alias("conclusions"))
        rows = rows.select(F.lit(r.name or r.head[0]).alias("rule"), "firings", "conclusions")
        out = rows if out is None else out.union(rows)
    return out
