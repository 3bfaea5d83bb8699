"""Shuffles in proportion to their rows: partitions by the bytes read, joins by the pairs that they give."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortise.operators.loops import settled

#: Bytes of input files for which a shuffle gets a partition, pairs that a join's task gives, and partitions at most.
BYTES, PAIRS, MOST = 1 << 22, 1 << 22, 4000
#: Rows of a key that a row of the other side meets at once.
ROWS = 1 << 11


def parts(df: DataFrame) -> int:
    """Partitions for the rows of a plan: by the bytes of the files that it reads, and as many as checkpointed rows have."""
    leaves, total, most = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0, 1
    for i in range(leaves.size()):
        kind = leaves.apply(i).getClass().getSimpleName()
        if kind == "LogicalRelation":
            total += int(str(leaves.apply(i).stats().sizeInBytes()))
        elif kind == "LogicalRDD":
            most = max(most, leaves.apply(i).rdd().getNumPartitions())
    some = min(df.sparkSession.sparkContext.defaultParallelism, ceil(total * 4 / BYTES))
    return min(MOST, max(most, some, ceil(total / BYTES)))


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt by columns (all by default), so that what a task holds does not grow with the input; small inputs stay as they are."""
    n = parts(df)
    return df.repartition(n, *(columns or df.columns)) if n > 1 else df


def minus(df: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of df whose columns are in no row of other; nulls are equal."""
    other = other.select(*(F.col(c).alias(f"_o_{c}") for c in columns)).distinct()
    return df.join(other, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in columns)), "left_anti")


def _dealt(left: DataFrame, right: DataFrame, on: list[str], pairs: int) -> tuple[DataFrame, int, float]:
    """(sizes, partitions, most): rows (_n, _m) and pairs of each key, partitions for about so many pairs each, and the pairs of the largest key."""
    count = lambda df, n: df.groupBy(*on).agg(F.count("*").alias(n))
    sizes = settled(count(left, "_n").join(count(right, "_m"), on).select(*on, "_n", "_m", (F.col("_n").cast("double") * F.col("_m")).alias("_pairs")))
    total = sizes.agg(F.coalesce(F.sum("_pairs"), F.lit(0.0)), F.coalesce(F.max("_pairs"), F.lit(0.0))).first()
    n = max(parts(left), parts(right), ceil(total[0] / pairs))
    return sizes, n if n == 1 else min(MOST, max(n, left.sparkSession.sparkContext.defaultParallelism)), total[1]


def _one(df: DataFrame, chunks: str):
    """A row's chunk, and (below) each of the chunks of its key."""
    return F.pmod(F.xxhash64(*df.columns), F.coalesce(chunks, F.lit(1))).cast("int")


def _every(chunks: str):
    return F.explode(F.sequence(F.lit(0), F.coalesce(chunks, F.lit(1)) - 1))


def met(left: DataFrame, right: DataFrame, on: list[str], pairs: int = PAIRS) -> DataFrame:
    """left join right on columns, in tasks of about so many pairs: the rows of a key that gives more are cut into chunks on the left, each of which meets all of the right."""
    left, right = (df.dropna(subset=on) for df in (left, right))
    sizes, n, most = _dealt(left, right, on, pairs)
    if n == 1:
        return left.join(right, on)
    if most <= pairs:
        return left.repartition(n, *on).join(right.repartition(n, *on), on)
    hot = F.broadcast(sizes.where(F.col("_pairs") > pairs).select(*on, F.least(F.col("_n"), F.ceil(F.col("_pairs") / pairs)).cast("int").alias("_chunks")))
    keys = [*on, "_chunk"]
    left, right = (df.join(hot, on, "left").withColumn("_chunk", c).drop("_chunks").repartition(n, *keys) for df, c in ((left, _one(left, "_chunks")), (right, _every("_chunks"))))
    return left.join(right, keys).drop("_chunk")


def crossed(left: DataFrame, right: DataFrame, on: list[str], same: list[str], pairs: int = PAIRS, rows: int = ROWS) -> DataFrame:
    """left join right on columns, for joins that give far more pairs than rows: the right's rows of equal `same` columns are joined as arrays.

    Conditions on `same` that follow are put before the arrays are unfolded, so they are checked once
    for an array and not for each pair. A key is cut on both sides: on the right into chunks of
    about so many rows, on the left so that two chunks give about so many pairs.
    """
    rest = [c for c in right.columns if c not in (*on, *same)]
    if not rest:
        return met(left, right, on, pairs)
    left, right = (df.dropna(subset=on) for df in (left, right))
    sizes, n, _ = _dealt(left, right, on, pairs)
    if n == 1:
        return left.join(right, on)
    chunks = (F.least(F.col("_n"), F.ceil(F.col("_n").cast("double") * F.least(F.col("_m"), F.lit(rows)) / pairs)), F.ceil(F.col("_m") / rows))
    hot = F.broadcast(sizes.select(*on, *(c.cast("int").alias(name) for c, name in zip(chunks, ("_a", "_b"), strict=True))).where("_a > 1 or _b > 1"))
    keys, columns = [*on, "_i", "_j"], [c for c in left.columns if c not in on]
    left = left.join(hot, on, "left").withColumn("_i", _one(left, "_a")).withColumn("_j", _every("_b")).drop("_a", "_b")
    right = spread(right.join(hot, on, "left").withColumn("_j", _one(right, "_b")).drop("_b"), *on, *same, "_j")
    right = right.groupBy(*on, *same, "_j", "_a").agg(F.collect_list(F.struct(*rest)).alias("_rows")).withColumn("_i", _every("_a"))
    # A column of its own is unfolded faster than structs; it keeps its nulls.
    right = right.select(*keys, *same, (F.col("_rows").getField(rest[0]) if len(rest) == 1 else F.col("_rows")).alias("_rows"))
    # Spark buffers all that one streamed row gives: a merge join streams the left, whose rows meet one chunk each, where a broadcast of the left would stream arrays.
    found = left.repartition(n, *keys).join(right.repartition(n, *keys).hint("merge"), keys)
    return found.select(*on, *columns, *same, F.explode("_rows").alias(rest[0]) if len(rest) == 1 else F.inline("_rows"))
