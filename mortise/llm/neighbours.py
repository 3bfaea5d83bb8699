"""Each document beside the next one in descending doc_id, over ranges instead of one sorted task."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortise.llm.common import doc_texts

#: Stands for a null doc_id, which comes last.
NO_ID = -(1 << 63)
#: Ranges for each shuffle partition: ranges are dealt by a hash, and more of them come out more even.
RANGES = 16
#: Code points of a text by which the rows of a frequent id are cut into ranges, and texts looked at for each range.
HEAD, LOOKED_AT = 256, 64


class Ranges:
    """Numbers of the ranges, from the top down: by key, and within the keys of many rows by the head of the text."""

    def __init__(self, cuts: list[int], heads: dict[int, list[bytes]]):
        self.cuts, self.heads = np.array(cuts, dtype=np.int64), heads
        self.width = 2 + max(map(len, heads.values()), default=0)
        self.hot = np.array(sorted(heads), dtype=np.int64)

    def of(self, keys: np.ndarray, heads: pd.Series) -> np.ndarray:
        to = (len(self.cuts) - np.searchsorted(self.cuts, keys)) * self.width + self.width - 1
        for i in np.flatnonzero(np.isin(keys, self.hot)).tolist():
            to[i] += bisect_right(self.heads[int(keys[i])], heads.iat[i].encode()) - self.width + 1
        return to


def cut_ranges(texts: DataFrame, ranges: int) -> Ranges:
    """Ranges of the rows (_key, _head) at quantiles of _key; a key of several quantiles is cut at quantiles of its heads.

    Only where there are such keys, a second pass looks at LOOKED_AT of their texts for each range,
    least hash first. Those choose the cuts and nothing else.
    """
    found = texts.agg(F.percentile_approx("_key", [i / ranges for i in range(1, ranges)], 10_000)).first()[0]
    times, heads = Counter(found or []), {}
    hot = [k for k, n in times.items() if n > 1]
    if hot:
        mixed = texts.where(F.col("_key").isin(hot)).select("_key", "_head", F.xxhash64("text").alias("_mix"))
        seen: dict[int, list[bytes]] = {}
        for r in mixed.distinct().orderBy("_mix").limit(LOOKED_AT * ranges).collect():
            seen.setdefault(r["_key"], []).append(r["_head"].encode())
        for k, all_heads in seen.items():
            all_heads.sort()
            heads[k] = sorted({all_heads[i * len(all_heads) // times[k]] for i in range(1, times[k])})
    return Ranges(sorted(times), heads)


def with_next(docs: DataFrame, start: Callable[[str], object], row: Callable[[int | None, str, object, str, object], tuple], schema: pa.Schema, ddl: str) -> DataFrame:
    """row(doc_id, text, state, next text, next state) for every row of `docs`; state = start(text).

    Order: descending doc_id, null ids last, equal ids by text. After the last comes the first, so a
    single row is its own next. Ids are cut into ranges at their quantiles (as many as RANGES times
    the shuffle partitions, so only that many numbers come to the driver), a null or repeated id
    with many rows also by its texts; rows that agree in id and in the first HEAD code points stay
    in one range. The first row of the range below goes along to each range, so texts are shuffled
    once.
    """
    spark = docs.sparkSession
    texts = doc_texts(docs).withColumn("_key", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("_head", F.substring("text", 1, HEAD))
    ranges = cut_ranges(texts, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))

    @F.pandas_udf("long")
    def range_of(keys: pd.Series, heads: pd.Series) -> pd.Series:
        return pd.Series(ranges.of(keys.to_numpy(), heads))

    # ~key: the greatest first. The first row of a range is the guest of the range before, that of the first one of the last.
    first = F.min(F.struct(F.bitwise_not("_key").alias("down"), F.col("_head").alias("head"))).alias("top")
    tops = sorted(tuple(r) for r in texts.withColumn("r", range_of("_key", "_head")).groupBy("r").agg(first).select("r", "top.down", "top.head").collect())
    guests: dict[tuple[int, str], list[int]] = {}
    for i, (_, down, head) in enumerate(tops):
        guests.setdefault((~down, head), []).append(tops[i - 1][0])
    visiting = np.array(sorted({k for k, _ in guests}), dtype=np.int64)

    @F.pandas_udf("array<long>")
    def targets(keys: pd.Series, heads: pd.Series) -> pd.Series:
        """Own range, then those that the row visits, as -1 - range."""
        numbers = keys.to_numpy()
        to = [[r] for r in ranges.of(numbers, heads).tolist()]
        for i in np.flatnonzero(np.isin(numbers, visiting)).tolist():
            to[i] += [-1 - r for r in guests.get((int(numbers[i]), heads.iat[i]), ())]
        return pd.Series(to)

    spread = texts.withColumn("_to", F.explode(targets("_key", "_head")))
    dealt = spread.withColumn("_guest", F.col("_to") < 0).withColumn("_to", F.when(F.col("_to") < 0, -1 - F.col("_to")).otherwise(F.col("_to")))
    ordered = dealt.repartition("_to").sortWithinPartitions("_to", "_guest", F.desc("_key"), "text").select("_to", "_guest", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            out = []
            for to, guest, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if guest and (waiting is None or waiting[0] != to):
                    continue  # one of several rows that begin like the guest: the first has been met
                state = start(text)
                if waiting is not None and waiting[0] == to:
                    out.append(row(*waiting[1:], text, state))
                waiting = None if guest else (to, doc, text, state)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return ordered.mapInArrow(run, ddl)
