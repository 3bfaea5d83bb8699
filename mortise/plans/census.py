"""Quality reports over a knowledge base, and its sentences in words."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortise.plans.compile import Facts
from mortise.plans.lang import Rule, predicates
from mortise.plans.program import rule_report


def census(facts: Facts, rules: Iterable[Rule], genl: DataFrame, declared: DataFrame) -> DataFrame:
    """(report, subject, n) in five reports; facts are closed.

    extent: facts of a predicate; idle: rules that never fired (0); chain: how many rules deep the
    longest way to a predicate's conclusions is; taxonomy: direct subtypes of a type, from genl
    (a, b); declaration: facts of each declared predicate (pred), 0 if it holds of nothing.
    """
    rules = list(rules)
    spark = next(iter(facts.values())).sparkSession
    out = None
    for p, df in sorted(facts.items()):
        rows = df.agg(F.count("*").alias("n")).select(F.lit("extent").alias("report"), F.lit(p).alias("subject"), "n")
        out = rows if out is None else out.union(rows)
    extents = out
    if rules:
        out = out.union(rule_report(rules, facts).where("firings = 0").select(F.lit("idle"), "rule", "firings"))
        deep = {r.head[0]: 1 for r in rules}
        for _ in range(len(deep)):
            for r in rules:
                deep[r.head[0]] = max(deep[r.head[0]], 1 + max((deep.get(p, 0) for p, _ in predicates(r.body) if p != r.head[0]), default=0))
        out = out.union(spark.createDataFrame([("chain", p, n) for p, n in sorted(deep.items())], "report string, subject string, n long"))
    out = out.union(genl.groupBy("b").agg(F.countDistinct("a").alias("n")).select(F.lit("taxonomy"), "b", "n"))
    held = declared.select(F.col("pred").alias("subject")).distinct().join(extents.select("subject", "n"), "subject", "left")
    return out.union(held.select(F.lit("declaration"), "subject", F.coalesce("n", F.lit(0))))


def glossed(facts: Facts, templates: dict[str, str]) -> DataFrame:
    """(predicate, sentence): facts in words; {1}, {2}, ... of a predicate's template stand for its arguments.

    A predicate without a template reads "predicate of argument, argument".
    """
    out = None
    for p, df in sorted(facts.items()):
        text = F.lit(templates[p]) if p in templates else F.concat(F.lit(f"{p} of "), F.concat_ws(", ", *(F.col(c).cast("string") for c in df.columns)))
        for i, c in enumerate(df.columns, 1) if p in templates else ():
            text = F.replace(text, F.lit(f"{{{i}}}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
        rows = df.select(F.lit(p).alias("predicate"), text.alias("sentence"))
        out = rows if out is None else out.union(rows)
    return out
