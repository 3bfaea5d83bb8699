"""Choice and constraint solving: components split in Spark, each searched in one task."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortise.operators.closure import components

def _search(atoms: list[str], needs: list[set[str]], hard: list[set[str]], soft: list[tuple[set[str], float]]) -> tuple[float, list[frozenset[str]]]:
    """(least cost, all choices with it): branch and bound over the atoms in order; costs are 0 or more.

    A branch ends when what it must still pay exceeds the best: unmet needs without a common atom
    each cost their cheapest atom at least.
    """
    single: dict[str, float] = {}
    for s, c in soft:
        if len(s) == 1:
            single[min(s)] = single.get(min(s), 0.0) + c
    needs = sorted(needs, key=len)

    def still(chosen: frozenset[str], decided: set[str]) -> float:
        used, total = set(), 0.0
        for n in needs:
            if n & chosen:
                continue
            free = n - decided
            if not free:
                return float("inf")
            if not free & used:
                used |= free
                total += min(single.get(a, 0.0) for a in free)
        return total

    best, found, waiting = float("inf"), [], [(0, frozenset())]
    while waiting:
        i, chosen = waiting.pop()
        if any(h <= chosen for h in hard):
            continue
        cost = sum(c for s, c in soft if s <= chosen)
        must = still(chosen, set(atoms[:i]))
        if must == float("inf") or cost + must > best + 1e-9:
            continue
        if i == len(atoms):
            if cost < best - 1e-9:
                best, found = cost, []
            found.append(chosen)
            continue
        waiting += [(i + 1, chosen), (i + 1, chosen | {atoms[i]})]
    return best, found


def label(choices: DataFrame, needs: DataFrame, hard: DataFrame, soft: DataFrame) -> DataFrame:
    """(component, labeling, atom): every optimum of each independent component, by its chosen atoms.

    choices (atom string); needs (atoms array): at least one is chosen; hard (atoms array): not all
    are chosen; soft (atoms array, cost): all chosen costs so much. Atoms that a constraint joins
    are one component, named by its least atom; one without a solution gives no rows. A component of
    any size is searched in one task, and its time may double with each atom that bounds don't
    settle. Costs below 0 raise. Optima are numbered in the order of their sorted atoms.
    """
    rows = needs.select("atoms", F.lit("need").alias("kind"), F.lit(0.0).alias("cost")).union(hard.select("atoms", F.lit("hard"), F.lit(0.0))).union(soft.select("atoms", F.lit("soft"), "cost"))
    links = rows.select(F.element_at("atoms", 1).alias("a"), F.explode("atoms").alias("b"))
    of = components(links).select(F.col("term").alias("atom"), F.col("rep").alias("component"))
    named = choices.join(of, "atom", "left").select("atom", F.coalesce("component", "atom").alias("component"))
    laws = rows.withColumn("atom", F.element_at("atoms", 1)).join(named, "atom").select("component", F.to_json(F.struct("kind", F.array_sort("atoms").alias("atoms"), "cost")).alias("item"))
    table = named.select("component", F.to_json(F.struct(F.lit("atom").alias("kind"), F.array("atom").alias("atoms"), F.lit(0.0).alias("cost"))).alias("item")).union(laws)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        items = [json.loads(x) for x in pdf["item"]]
        by = lambda k: [x for x in items if x["kind"] == k]
        atoms = sorted(x["atoms"][0] for x in by("atom"))
        if any(x["cost"] < 0 for x in items):
            raise ValueError("a cost is below 0")
        _, found = _search(atoms, [set(x["atoms"]) for x in by("need")], [set(x["atoms"]) for x in by("hard")], [(set(x["atoms"]), x["cost"]) for x in by("soft")])
        out = [(pdf["component"].iloc[0], n, a) for n, c in enumerate(sorted(map(sorted, found))) for a in c]
        return pd.DataFrame(out, columns=["component", "labeling", "atom"])

    return table.groupBy("component").applyInPandas(solve, "component string, labeling long, atom string")


def classify(labelings: DataFrame, heads: DataFrame) -> DataFrame:
    """(atom, verdict): forced if chosen in all stored labelings (labeling, atom), excluded if in none, else supportable."""
    total = labelings.agg(F.countDistinct("labeling").alias("n"))
    held = labelings.groupBy("atom").agg(F.countDistinct("labeling").alias("k"))
    rows = heads.join(held, "atom", "left").join(F.broadcast(total), F.lit(True))
    return rows.select("atom", F.when(F.col("k").isNull(), "excluded").when(F.col("k") == F.col("n"), "forced").otherwise("supportable").alias("verdict"))


def settled_dilemmas(nogoods: DataFrame) -> DataFrame:
    """(sid): facts to give up so that no open nogood (nid, sid) holds whole, as few as can be in each independent part.

    Of several least sets the first in the order of their sorted members is committed.
    """
    needs = nogoods.groupBy("nid").agg(F.array_sort(F.collect_set("sid")).alias("atoms")).select("atoms")
    atoms = nogoods.select(F.col("sid").alias("atom")).distinct()
    none = needs.limit(0)
    cost = atoms.select(F.array("atom").alias("atoms"), F.lit(1.0).alias("cost"))
    return label(atoms, needs, none, cost).where("labeling = 0").select(F.col("atom").alias("sid"))


def optima(labelings: DataFrame) -> DataFrame:
    """(component, n): how many optimal labelings each independent part has."""
    return labelings.groupBy("component").agg((F.max("labeling") + 1).alias("n"))
