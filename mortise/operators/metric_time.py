"""Metric time: bounds between points by shortest paths, and durations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortise.operators.loops import rounds, settled

TOLERANCE = 1e-9


def bounds(stated: DataFrame, most: int | None = None) -> DataFrame:
    """(ctx, p, q, lo, hi) for all connected points, from stated gaps q - p in [lo, hi].

    All-pairs shortest paths by doubling path lengths. Contexts with a negative cycle are left out.
    """
    ahead = stated.select("ctx", "p", "q", F.col("hi").alias("d"))
    back = stated.select("ctx", F.col("q").alias("p"), F.col("p").alias("q"), (-F.col("lo")).alias("d"))
    now = settled(ahead.union(back).groupBy("ctx", "p", "q").agg(F.min("d").alias("d")))
    for _ in rounds(most):
        on = now.select("ctx", F.col("p").alias("q"), F.col("q").alias("r"), F.col("d").alias("d2"))
        longer = now.join(on, ["ctx", "q"]).select("ctx", "p", F.col("r").alias("q"), (F.col("d") + F.col("d2")).alias("d"))
        new = settled(now.union(longer).groupBy("ctx", "p", "q").agg(F.min("d").alias("d")))
        bad = new.where(f"p = q and d < -{TOLERANCE}").select("ctx").distinct()
        new = settled(new.join(bad, "ctx", "left_anti"))
        old = now.withColumnRenamed("d", "e")
        if new.join(old, ["ctx", "p", "q"], "left").where(f"e is null or d < e - {TOLERANCE}").isEmpty():
            back = new.select("ctx", F.col("q").alias("p"), F.col("p").alias("q"), (-F.col("d")).alias("lo"))
            return new.where("p <> q").join(back, ["ctx", "p", "q"]).select("ctx", "p", "q", "lo", F.col("d").alias("hi"))
        now = new


def total_duration(wanted: DataFrame, lengths: DataFrame) -> DataFrame:
    """(grp, lo, hi): summed lengths of a group's intervals (grp, i); a missing or disagreeing length gives no row. lengths (i, lo, hi)."""
    one = lengths.groupBy("i").agg(F.min("lo").alias("lo"), F.max("lo").alias("lo2"), F.min("hi").alias("hi"), F.max("hi").alias("hi2")).where(f"lo2 - lo <= {TOLERANCE} and hi2 - hi <= {TOLERANCE}")
    rows = wanted.join(one.select("i", "lo", "hi", F.lit(1).alias("has")), "i", "left")
    return rows.groupBy("grp").agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"), F.count("*").alias("n"), F.count("has").alias("m")).where("n = m").select("grp", "lo", "hi")


def overlap(a, b, c, d):
    """Length of the common part of intervals (a, b) and (c, d), 0 if there is none."""
    return F.greatest(F.lit(0.0), F.least(b, d) - F.greatest(a, c))


def overlap_window(spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """(i, j, lo, hi): bounds on the common length of intervals pairs (i, j) whose ends are only known within bounds.

    spans (i, start_lo, start_hi, end_lo, end_hi); lo is certain, hi possible, both 0 at least.
    Pairs with an interval that spans lacks give no row.
    """
    x = spans.select("i", *(F.col(c).alias(f"x_{c}") for c in ("start_lo", "start_hi", "end_lo", "end_hi")))
    y = spans.select(F.col("i").alias("j"), *(F.col(c).alias(f"y_{c}") for c in ("start_lo", "start_hi", "end_lo", "end_hi")))
    both = pairs.select("i", "j").join(x, "i").join(y, "j")
    part = lambda end, start: F.greatest(F.lit(0.0), F.least(f"x_{end}", f"y_{end}") - F.greatest(f"x_{start}", f"y_{start}"))
    return both.select("i", "j", part("end_lo", "start_hi").alias("lo"), part("end_hi", "start_lo").alias("hi"))
