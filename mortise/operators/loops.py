"""Fixpoint loops over DataFrames: shared checkpoints and the semi-naive driver."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Truncated(RuntimeError):
    """A loop reached the rounds that its caller allowed before a fixpoint."""


def rounds(most: int | None = None) -> Iterator[int]:
    """0, 1, 2, ... without end, as closures over finite tables end by themselves; `most` rounds at most if it is given."""
    for i in count():
        if most is not None and i >= most:
            raise Truncated(f"no fixpoint after {most} rounds")
        yield i


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set, on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="mortise-rounds-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")


def settled(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def grow(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], most: int | None = None, depth: int | None = None) -> DataFrame:
    """Least set that holds `seed` and is closed under step(delta, all): semi-naive rounds.

    Each round anti-joins what is new against what is known, so cycles end; rows are a set. `depth`
    stops after so many steps with what is known by then; `most` raises instead.
    """
    known = delta = settled(seed.distinct())
    columns = seed.columns
    for i in rounds(most):
        if i == depth or delta.isEmpty():
            return known
        same = reduce(lambda a, b: a & b, (F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}")) for c in columns))
        delta = settled(step(delta, known).select(*columns).distinct().alias("new").join(known.alias("old"), same, "left_anti"))
        known = known.union(delta)
