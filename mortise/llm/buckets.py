"""Links inside candidate buckets, without emitting pairs and with bounded memory.

Rows (bucket, item, payload) are sorted by bucket and streamed. A bucket of up to `chunk` rows is
linked at once; a larger one is cut into chunks, and every pair of its chunks is linked in a task
of its own, so any size is handled exactly. What comes out is a spanning forest of the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortise.llm.common import settled

CHUNK = 2048
#: Bytes of payloads that are handed to a linker at once, so that small buckets share its start-up.
BYTES = 1 << 18
_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("payload", pa.binary())])
#: payloads -> near(i, others): those positions among `others` (an array) whose payloads link with payload i
Near = Callable[[int, np.ndarray], np.ndarray]
Linker = Callable[[list[bytes]], Near]


def spanning(items: np.ndarray, near: Near, at: int = 0) -> list[tuple[int, int]]:
    """(least item, member) for every member of every component of the links; the items stand from `at` on in near's payloads.

    Only items that have not been reached are compared with the next one, so a group of copies
    costs one comparison a member.
    """
    out, waiting = [], np.argsort(items, kind="stable") + at
    while len(waiting) > 1:
        start, waiting = int(waiting[0]), waiting[1:]
        front = [start]
        while front and len(waiting):
            new = near(front.pop(), waiting)
            if len(new):
                waiting = waiting[~np.isin(waiting, new)] if len(new) < len(waiting) else waiting[:0]
                front += new.tolist()
                out += [(int(items[start - at]), x) for x in items[new - at].tolist()]
    return out


def _groups(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[int, int, bool, np.ndarray, list]]:
    """(bucket, number of chunk, whether it is cut, items, payloads) of the sorted rows; single rows are skipped."""
    bucket, number, items, payloads = None, 0, [], []
    for batch in batches:
        keys = batch.column("bucket").to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])
        ids, column = batch.column("item").to_numpy(zero_copy_only=False), batch.column("payload")
        # Inside a batch, only groups of two and more matter, and those at its ends.
        matter = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(keys)))
        for s, e in zip(starts[matter].tolist(), ends[matter].tolist(), strict=True):
            if keys[s] != bucket:
                if len(items) > 1 or number:
                    yield bucket, number, number > 0, np.array(items, dtype=np.int64), payloads
                bucket, number, items, payloads = int(keys[s]), 0, [], []
            items += ids[s:e].tolist()
            payloads += column.slice(s, e - s).to_pylist()
            while len(items) > chunk:
                yield bucket, number, True, np.array(items[:chunk], dtype=np.int64), payloads[:chunk]
                number, items, payloads = number + 1, items[chunk:], payloads[chunk:]
    if len(items) > 1 or number:
        yield bucket, number, number > 0, np.array(items, dtype=np.int64), payloads


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, _OUT, strict=True)], schema=_OUT)


def bucket_links(rows: DataFrame, linker: Linker, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between items of `rows` (bucket long, item long, payload binary) that `linker` links.

    Items of one component inside a bucket come as a star around the least item. An item may
    stand in many buckets, and once in each. Empty in, empty out.
    """
    schema = "a long, b long, bucket long, chunk long, payload binary"

    def linked(groups: Iterator[tuple]) -> Iterator[tuple[tuple, list[tuple[int, int]]]]:
        """Each group with the star of its links."""
        held, size = [], 0

        def flush():
            near, at = linker([p for *_, payloads in held for p in payloads]), 0
            for group in held:
                yield group, spanning(group[3], near, at)
                at += len(group[4])

        for group in groups:
            held.append(group)
            size += sum(map(len, group[4]))
            if size >= BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (bucket, number, cut, items, payloads), star in linked(_groups(batches, chunk)):
            out += [(a, b, None, None, None) for a, b in star]
            if cut:
                out += [(a, None, bucket, number, p) for a, p in zip(items.tolist(), payloads, strict=True)]
            if len(out) >= 4 * chunk:
                yield _table(out)
                out = []
        yield _table(out)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, star in linked(_groups(batches, 2 * chunk)):
            yield _table([(a, b, None, None, None) for a, b in star])

    found = settled(rows.select("bucket", "item", "payload").repartition("bucket").sortWithinPartitions("bucket", "item").mapInArrow(inside, schema))
    links, cut = found.where("b is not null").select("a", "b"), found.where("b is null")
    chunks = cut.groupBy("bucket").agg((F.max("chunk") + 1).alias("chunks"))
    # Each chunk meets each other one; the pair of them is a bucket again, of two chunks at most.
    others = cut.join(chunks, "bucket").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).where("other <> chunk")
    met = others.select(F.xxhash64("bucket", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("bucket"), F.col("a").alias("item"), "payload")
    return links.union(met.repartition("bucket").sortWithinPartitions("bucket", "item").mapInArrow(across, schema).select("a", "b"))
