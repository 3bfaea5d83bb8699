"""Measures (lo, hi, unit): normalising to a base unit and comparing with an absolute tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def normalised(rows: DataFrame, units: DataFrame, lo: str = "lo", hi: str = "hi", unit: str = "unit") -> DataFrame:
    """rows with lo and hi in the base unit, and `base`; rows of unknown units are dropped. units (unit, base, factor) is a small declaration table."""
    known = units.select(F.col("unit").alias(unit), "base", "factor")
    return rows.join(known, unit).withColumn(lo, F.col(lo) * F.col("factor")).withColumn(hi, F.col(hi) * F.col("factor")).drop("factor")


def same_quantity(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return (F.abs(lo1 - lo2) <= TOLERANCE) & (F.abs(hi1 - hi2) <= TOLERANCE)


def less_than(hi1: Column, lo2: Column) -> Column:
    """Surely less: the gap is wider than the tolerance."""
    return hi1 < lo2 - TOLERANCE


def less_or_equal(hi1: Column, lo2: Column) -> Column:
    return hi1 <= lo2 + TOLERANCE


def subinterval(inner: Column, outer: Column) -> Column:
    """Whether an ISO datetime of any precision lies in another: its leading fields are those of the other."""
    fields = lambda c: F.split(c, r"[-T:]")
    return F.slice(fields(inner), 1, F.size(fields(outer))) == fields(outer)
