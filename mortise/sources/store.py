"""Knowledge bases as Parquet folders, fact text files, and a seeded generator."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mortise.operators.loops import settled

VERSION = 1
#: Kind -> reader of foreign data: (spark, path) -> {predicate: table}.
READERS: dict[str, Callable[[SparkSession, str], dict[str, DataFrame]]] = {}


def export(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet folder a table, and a _meta folder that names them and the version."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps({"version": VERSION, "tables": sorted(tables)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What export() wrote; another version is refused."""
    meta = json.loads(spark.read.text(f"{path}/_meta").first()[0])
    if meta["version"] != VERSION:
        raise ValueError(f"version {meta['version']} instead of {VERSION}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}


def fork(base: DataFrame, tombs: DataFrame, added: DataFrame, key: str = "sid") -> DataFrame:
    """A frozen table with rows taken out and others put in; base stays as it is."""
    return base.join(tombs.select(key), key, "left_anti").unionByName(added)


def parse(text: str) -> list:
    """Nested lists of symbols, numbers and strings of an s-expression text; ; starts a comment, but not inside a string."""
    stack: list[list] = [[]]
    for t in re.findall(r'"(?:\\.|[^"\\])*"|;[^\n]*|[()]|[^\s()";]+|.', text):
        if t.isspace() or t.startswith(";"):
            continue
        if t == "(":
            stack.append([])
        elif t == ")":
            if len(stack) < 2:
                raise ValueError("a bracket too many")
            done = stack.pop()
            stack[-1].append(done)
        elif t.startswith('"'):
            if len(t) < 2 or not t.endswith('"'):
                raise ValueError("a string has no end")
            stack[-1].append(json.loads(t))
        else:
            stack[-1].append(int(t) if re.fullmatch(r"[+-]?\d+", t) else float(t) if re.fullmatch(r"[+-]?\d*\.\d+(?:[eE][+-]?\d+)?", t) else t)
    if len(stack) > 1:
        raise ValueError("a bracket is missing")
    return stack[0]


def text_of(term: object) -> str:
    """A parsed term as text again; nested terms keep their brackets."""
    return f"({' '.join(map(text_of, term))})" if isinstance(term, list) else str(term)


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(predicate, args array<string>, reason) for every sentence of fact text files: (predicate argument ...), over lines at will.

    A negative fact (not (p ...)) has the predicate "not p"; nested arguments are their text. What is
    no ground fact comes with the reason why it is refused and its text as only argument; a file
    with unbalanced brackets is one such row. Files are parsed where they are read, one at a time.
    """

    @F.arrow_udf("array<struct<predicate:string,args:array<string>,reason:string>>")
    def sentences(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("predicate", pa.string()), ("args", pa.list_(pa.string())), ("reason", pa.string())]))

        def one(x: object) -> dict:
            said, negative = x, False
            while isinstance(said, list) and len(said) == 2 and said[0] == "not" and isinstance(said[1], list):
                said, negative = said[1], not negative
            shown = text_of(x)
            if not isinstance(said, list) or not said or not isinstance(said[0], str):
                return {"predicate": None, "args": [shown], "reason": "no sentence"}
            if re.search(r"(^|[\s(])\?", shown):
                return {"predicate": None, "args": [shown], "reason": "not ground"}
            return {"predicate": f"not {said[0]}" if negative else said[0], "args": [text_of(a) for a in said[1:]], "reason": None}

        def whole(text: str | None) -> list:
            try:
                return [one(x) for x in parse(text or "")]
            except ValueError as e:
                return [{"predicate": None, "args": [text], "reason": str(e)}]

        return pa.array([whole(t) for t in texts.to_pylist()], kind)

    files = spark.read.text(path, wholetext=True)
    return files.select(F.explode(sentences("value")).alias("s")).select("s.*")


def read_facts(spark: SparkSession, path: str, context: str) -> dict[tuple[str, int], DataFrame]:
    """(predicate, number of arguments) -> (ctx, a1, a2, ...) of strings, for the facts of read_sentences().

    A predicate with several numbers of arguments has a table for each; repeated facts count once
    and order doesn't matter. What read_sentences() refuses is only there, with its reason.
    """
    facts = settled(read_sentences(spark, path).where("reason is null").distinct())
    shapes = facts.select("predicate", F.size("args").alias("n")).distinct().collect()
    return {(r.predicate, r.n): facts.where((F.col("predicate") == r.predicate) & (F.size("args") == r.n)).select(F.lit(context).alias("ctx"), *(F.element_at("args", i).alias(f"a{i}") for i in range(1, r.n + 1))) for r in sorted(shapes)}


def generated(spark: SparkSession, types: int, facts: int, seed: int = 0) -> dict[str, DataFrame]:
    """A seeded knowledge base: a type tree (genl), memberships (isa) and a binary relation, all by hashes of row numbers."""
    node = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    pick = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n))
    tree = spark.range(1, types).select(node("t", F.col("id")).alias("a1"), node("t", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("id"))).alias("a2"))
    isa = spark.range(facts).select(node("x", F.col("id")).alias("a1"), node("t", pick(types, 1)).alias("a2"))
    near = spark.range(facts).select(node("x", pick(facts, 2)).alias("a1"), node("x", pick(facts, 3)).alias("a2")).distinct()
    return {"genl": tree, "isa": isa, "relatedTo": near}


def register(kind: str, reader: Callable[[SparkSession, str], dict[str, DataFrame]]) -> None:
    READERS[kind] = reader


def foreign(spark: SparkSession, kind: str, path: str) -> dict[str, DataFrame]:
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}")
    return READERS[kind](spark, path)
