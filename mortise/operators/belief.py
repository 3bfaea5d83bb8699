"""Belief from recorded justifications: labels, classes, clashes, defeat, explanations.

Tables: premises (sid, s), just (jid, conseq, ante array<sid>, s); s is 2 for monotonic, 1 for default.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortise.operators.loops import grow, rounds, settled


def _links(just: DataFrame) -> DataFrame:
    """Justifications, a row for each antecedent; one without any has a single row with none."""
    return settled(just.select("jid", "conseq", "s", F.size("ante").alias("n"), F.explode_outer("ante").alias("a")))


def _risen(base: DataFrame, links: DataFrame, keep: Callable[[DataFrame], DataFrame], most: int | None) -> DataFrame:
    """The least fixpoint over `base` (sid, s).

    Facts only join and classes only rise, so equal numbers and sums of classes end the loop.
    """
    size = lambda df: tuple(df.agg(F.count("*"), F.sum("s")).first())
    now, was = base, size(base)
    for _ in rounds(most):
        strengths = now.select(F.col("sid").alias("a"), F.col("s").alias("g"))
        held = links.join(strengths, "a", "left").groupBy("jid", "conseq", "s", "n").agg(F.count("g").alias("c"), F.min("g").alias("g")).where("c = n")
        given = held.select(F.col("conseq").alias("sid"), F.least("s", "g").alias("s"))
        new = settled(keep(base.union(given)).groupBy("sid").agg(F.max("s").alias("s")))
        if (is_ := size(new)) == was:
            return new
        now, was = new, is_


def labels(premises: DataFrame, just: DataFrame, defeated: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(sid, s) of all that is believed: the least fixpoint of max over supports of the weakest ground.

    A justification counts when all its antecedents are believed. `defeated` (sid) is kept out.
    """
    keep = (lambda df: df.join(defeated.select("sid"), "sid", "left_anti")) if defeated is not None else (lambda df: df)
    return _risen(settled(keep(premises.groupBy("sid").agg(F.max("s").alias("s")))), _links(just), keep, most)


def relabelled(belief: DataFrame, premises: DataFrame, links: DataFrame, fresh: DataFrame, defeated: DataFrame, most: int | None = None) -> DataFrame:
    """Belief after more facts `fresh` (sid) are defeated: only what rests on them is labelled anew."""
    rests = grow(fresh.select("sid"), lambda delta, _: links.join(delta.select(F.col("sid").alias("a")), "a", "left_semi").select(F.col("conseq").alias("sid")))
    open_ = settled(rests.join(defeated.select("sid"), "sid", "left_anti"))
    stated = premises.join(open_, "sid", "left_semi").groupBy("sid").agg(F.max("s").alias("s"))
    base = settled(belief.join(rests, "sid", "left_anti").select("sid", "s").union(stated))
    return _risen(base, settled(links.join(open_.select(F.col("sid").alias("conseq")), "conseq", "left_semi").select(*links.columns)), lambda df: df, most)


def clashes(facts: DataFrame, belief: DataFrame) -> DataFrame:
    """(pos, neg): believed facts (sid, body, truth) of equal body and opposite truth."""
    held = facts.join(belief.select("sid"), "sid", "left_semi")
    pos, neg = held.where("truth").select(F.col("sid").alias("pos"), "body"), held.where("not truth").select(F.col("sid").alias("neg"), "body")
    return pos.join(neg, "body").select("pos", "neg").distinct()


def decide(nogoods: DataFrame, belief: DataFrame) -> DataFrame:
    """nogoods (nid, sid) -> (nid, verdict, sid): the one weakest member is defeated; a tie of defaults is a dilemma, of monotonic ones a conflict."""
    classed = nogoods.join(belief, "sid")
    low = classed.groupBy("nid").agg(F.min("s").alias("low"))
    tied = classed.join(low, "nid").where("s = low").groupBy("nid", "low").agg(F.count("*").alias("n"), F.min("sid").alias("sid"))
    verdict = F.when(F.col("n") == 1, "defeat").when(F.col("low") == 1, "dilemma").otherwise("conflict")
    return tied.select("nid", verdict.alias("verdict"), F.when(F.col("n") == 1, F.col("sid")).alias("sid"))


def resolve(premises: DataFrame, just: DataFrame, facts: DataFrame, more: DataFrame | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(belief, defeated, open clashes): relabel until no clash has one weakest member.

    Clashes are opposite facts and, if given, further nogoods `more` (nid, sid).
    """
    spark = premises.sparkSession
    defeated = spark.createDataFrame([], premises.select("sid").schema)
    links = _links(just)
    belief = _risen(settled(premises.groupBy("sid").agg(F.max("s").alias("s"))), links, lambda df: df, most)
    for _ in rounds(most):
        pairs = clashes(facts, belief).select(F.concat_ws("|", "pos", "neg").alias("nid"), F.explode(F.array("pos", "neg")).alias("sid"))
        if more is not None:
            whole = more.join(belief.select("sid"), "sid", "left").groupBy("nid").agg(F.count("*").alias("n"))
            alive = more.join(belief.select("sid"), "sid").groupBy("nid").agg(F.count("*").alias("m"))
            pairs = pairs.union(more.join(whole.join(alive, "nid").where("n = m"), "nid", "left_semi").select("nid", "sid"))
        verdicts = settled(decide(pairs, belief))
        fresh = settled(verdicts.where("verdict = 'defeat'").select("sid").distinct().join(defeated, "sid", "left_anti"))
        if fresh.isEmpty():
            return belief, defeated, verdicts.where("verdict <> 'defeat'").select("nid", "verdict")
        defeated = settled(defeated.union(fresh))
        belief = relabelled(belief, premises, links, fresh, defeated, most)


def why(just: DataFrame, belief: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(jid, conseq, ante): the edges of all proofs of `roots` (sid) by believed antecedents, whole or down to `depth` steps."""
    held = belief.select(F.col("sid").alias("a"))
    links = just.select("jid", "conseq", "ante", F.size("ante").alias("n"), F.explode("ante").alias("a"))
    sound = settled(links.join(held, "a").groupBy("jid", "conseq", "n").agg(F.collect_set("a").alias("as")).where("size(as) = n").select("jid", "conseq", F.explode("as").alias("ante")))
    seed = sound.join(roots.select(F.col("sid").alias("conseq")), "conseq", "left_semi").select("jid", "conseq", "ante")
    return grow(seed, lambda delta, _: sound.join(delta.select(F.col("ante").alias("conseq")).distinct(), "conseq", "left_semi").select("jid", "conseq", "ante"), depth=None if depth is None else depth - 1)


def why_not(asked: DataFrame, facts: DataFrame, belief: DataFrame, defeated: DataFrame, excepted: DataFrame, superseded: DataFrame) -> DataFrame:
    """(sid, reason) for asked (sid): not-stored, excepted, superseded, defeated, unsupported or believed."""
    flag = lambda df, n: df.select("sid").distinct().withColumn(n, F.lit(True))
    rows = asked
    for df, n in ((facts, "st"), (belief, "b"), (defeated, "d"), (excepted, "e"), (superseded, "su")):
        rows = rows.join(flag(df, n), "sid", "left")
    reason = F.when(F.col("st").isNull(), "not-stored").when(F.col("e"), "excepted").when(F.col("su"), "superseded").when(F.col("d"), "defeated").when(F.col("b").isNull(), "unsupported").otherwise("believed")
    return rows.select("sid", reason.alias("reason"))


def argue(for_it: DataFrame, against: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, verdict): true, false, unknown, or contradiction unless one side's class is higher; sides are (key, s)."""
    p = for_it.groupBy("key").agg(F.max("s").alias("p"))
    q = against.groupBy("key").agg(F.max("s").alias("q"))
    rows = asked.join(p, "key", "left").join(q, "key", "left")
    up, down = F.coalesce("p", F.lit(0)), F.coalesce("q", F.lit(0))
    return rows.select("key", F.when((up == 0) & (down == 0), "unknown").when(up > down, "true").when(down > up, "false").otherwise("contradiction").alias("verdict"))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a change did to belief: (the columns, change = added | removed)."""
    return after.exceptAll(before).withColumn("change", F.lit("added")).union(before.exceptAll(after).withColumn("change", F.lit("removed")))


def status(asked: DataFrame, facts: DataFrame, belief: DataFrame, excepted: DataFrame) -> DataFrame:
    """(sid, stored, believed, excepted, visible) for asked (sid): visible is believed and not excepted."""
    rows = asked.select("sid").distinct()
    for df, n in ((facts, "stored"), (belief, "believed"), (excepted, "excepted")):
        rows = rows.join(df.select("sid").distinct().withColumn(n, F.lit(True)), "sid", "left").withColumn(n, F.coalesce(n, F.lit(False)))
    return rows.withColumn("visible", F.col("believed") & ~F.col("excepted"))


def dependents(just: DataFrame, of: DataFrame) -> DataFrame:
    """(jid, conseq): the justifications that rest on one of the facts (sid)."""
    return just.select("jid", "conseq", F.explode("ante").alias("sid")).join(of.select("sid"), "sid", "left_semi").select("jid", "conseq").distinct()


def following(metas: DataFrame, gone: DataFrame) -> DataFrame:
    """(sid): facts about facts, metas (sid, target), that go with their targets `gone` (sid), and those about them in turn."""
    seed = metas.join(gone.select(F.col("sid").alias("target")), "target", "left_semi").select("sid")
    return grow(seed, lambda delta, _: metas.join(delta.select(F.col("sid").alias("target")), "target", "left_semi").select("sid"))


def sweep(facts: DataFrame, premises: DataFrame, just: DataFrame) -> DataFrame:
    """Facts (sid, ...) that still have a ground, defeated or not; what lost its last support is swept.

    Belief is computed from what is stated, so a swept fact is there again when its support is.
    """
    return facts.join(labels(premises, just).select("sid"), "sid", "left_semi")


def contradictions(verdicts: DataFrame, nogoods: DataFrame) -> DataFrame:
    """(nid, verdict, sids): open clashes of resolve() with their members in order."""
    members = nogoods.groupBy("nid").agg(F.array_sort(F.collect_set("sid")).alias("sids"))
    return verdicts.join(members, "nid").select("nid", "verdict", "sids")
