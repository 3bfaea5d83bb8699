"""A bit table of fixed size that tells which keys may be in a set, to keep needless rows out of a shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the table: 8 MB, however large the set. A fuller table only lets more rows through.
BITS = 26


class Membership:
    """may_have(keys): False only for keys that are not in the set."""

    def __init__(self, keys: DataFrame, column: str):
        slot = F.col(column).bitwiseAND((1 << BITS) - 1)
        words = keys.select(F.shiftright(slot, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
        got = words.toArrow()
        table = np.zeros(1 << (BITS - 6), dtype=np.int64)
        table[got.column("w").to_numpy()] = got.column("b").to_numpy()
        self.held = keys.sparkSession.sparkContext.broadcast(table)

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        k = keys.astype(np.int64) & ((1 << BITS) - 1)
        return (self.held.value[k >> 6] >> (k & 63)) & 1 == 1
