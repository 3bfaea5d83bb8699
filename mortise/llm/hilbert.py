"""Shards in Hilbert-curve order: DataFrame functions only.

Metadata dimensions are cut into cells at their quantiles, a row's cells give its place on the
Hilbert curve, rows are ranked along the curve and cut into runs of equal count. Rows near each
other in any dimension share files, so a filter on any of them prunes most files.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mortise.llm.common import settled, with_key

#: Bits of a cell number in each dimension.
BITS = 5


def text_number(column: Column) -> Column:
    """The leading seven bytes of a string as a number, in the order of the strings; null stays null."""
    return F.conv(F.rpad(F.hex(F.substring(column, 1, 7)), 14, "0").substr(1, 14), 16, 10).cast("long")


def cells(df: DataFrame, dimensions: dict[str, Column], bits: int = BITS) -> DataFrame:
    """df with a column 0 to 2^bits - 1 for each dimension: how many of its quantiles lie below the value; null is 0.

    One aggregation finds 2^bits - 1 quantiles of each dimension; only those come to the driver.
    """
    share = [i / (1 << bits) for i in range(1, 1 << bits)]
    names = list(dimensions)
    cuts = df.agg(*(F.percentile_approx(dimensions[n].cast("double"), share, 1000).alias(n) for n in names)).first()
    for n in names:
        below = [F.when(dimensions[n].cast("double") > F.lit(float(c)), 1).otherwise(0) for c in cuts[n] or []]
        df = df.withColumn(n, sum(below, F.lit(0)).cast("long"))
    return df


@lru_cache(maxsize=8)
def steps(dims: int) -> list[int]:
    """The curve as an automaton: entry state * 2^dims + corner holds next state * 2^dims + digit.

    A state is the corner where the curve enters a cell and the axis along which it leaves; corners
    are visited in Gray-code order, turned by the state.
    """
    size = (1 << dims) - 1
    right = lambda x, k: (x >> k | x << dims - k) & size
    left = lambda x, k: (x << k | x >> dims - k) & size
    gray = lambda i: i ^ i >> 1
    order = {gray(i): i for i in range(1 << dims)}
    ones = lambda i: (~i & i + 1).bit_length() - 1  # trailing ones
    out = []
    for enter in range(1 << dims):
        for axis in range(dims):
            for corner in range(1 << dims):
                k = (axis + 1) % dims
                digit = order[right(corner ^ enter, k)]
                start = 0 if digit == 0 else gray(2 * ((digit - 1) // 2))
                along = 0 if digit == 0 else ones(digit - 1 if digit % 2 == 0 else digit) % dims
                state = (enter ^ left(start, k)) * dims + (axis + along + 1) % dims
                out.append(state << dims | digit)
    return out


def hilbert_index(df: DataFrame, names: list[str], out: str, bits: int = BITS) -> DataFrame:
    """df with `out`, the index on the Hilbert curve of the cells in columns `names` (which are used up).

    One look-up in the curve's automaton for each bit, from the leading one down.
    """
    n, state = len(names), with_key(df, "_state")
    table, index = F.lit(steps(n)), F.lit(0).cast("long")
    other = [c for c in df.columns if c not in names]
    df = df.select("*", index.alias(out), F.lit(0).alias(state))
    for b in range(bits - 1, -1, -1):
        corner = sum((F.shiftleft(F.shiftright(F.col(c), b).bitwiseAND(1), j) for j, c in enumerate(names)), F.lit(0).cast("long")).cast("int")
        step = F.get(table, F.col(state) * (1 << n) + corner)
        df = df.select(*other, *names, out, step.alias(state))
        digit = F.col(state).bitwiseAND((1 << n) - 1).cast("long")
        df = df.select(*other, *names, F.shiftleft(F.col(out), n).bitwiseOR(digit).alias(out), F.shiftright(F.col(state), n).alias(state))
    return df.select(*other, out)


def ranked(df: DataFrame, order: list[str], out: str, total: str) -> DataFrame:
    """df with `out`, the rank from 0 of each row in the order of columns `order`, and `total`, the count of rows.

    Rows are range-partitioned by `order` and that table is written; a rank is the count of the
    ranges before (one number a range) and the place within the range. Rows equal in `order` may
    change places with each other.
    """
    part, before = with_key(df, "_range"), with_key(df, "_before")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(part).agg(F.count("*").alias(before))
    # As many rows as ranges.
    starts = sizes.select(part, (F.sum(before).over(Window.orderBy(part)) - F.col(before)).alias(before), F.sum(before).over(Window.partitionBy()).alias(total))
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return dealt.withColumn(out, place.cast("long")).join(F.broadcast(starts), part).withColumn(out, F.col(out) + F.col(before)).drop(part, before)


def document_dimensions() -> dict[str, Column]:
    return {"_source": text_number(F.col("source")), "_lang": text_number(F.col("lang")), "_size": F.col("size"), "_id": F.col("doc_id")}


def shards(docs: DataFrame, count: int = 16, bits: int = BITS) -> DataFrame:
    """Per row of `docs` (doc_id, text, lang, source): its shard 0 to count - 1 and slot in it.

    Rows: doc_id, size (UTF-8 bytes of the text, null none, plus 1), text_crc32, law ("rows": counts
    of shards are at most one apart), shard, slot (gapless from 0, along the curve), grown_shard
    (null under this law), curve. Dimensions are source, lang, size and doc_id; a null lies in cell
    0. Rows of one cell are ordered by a hash of doc_id, so a hot cell spreads over ranges and is
    cut between shards like any other run. Repeated rows each get a slot, an empty table gives none,
    other columns are not read. Two passes over the text column, one shuffle without texts.
    """
    placed = _placed(docs.select(*_measures(docs)), count, bits)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def _measures(docs: DataFrame) -> list[Column]:
    text = F.col("text").cast("string")
    return [F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.col("source"), F.col("lang")]


def _placed(rows: DataFrame, count: int, bits: int) -> DataFrame:
    """Rows of _measures() and further columns, with curve, shard and slot."""
    at = document_dimensions()
    placed = hilbert_index(cells(rows, at, bits).drop("source", "lang"), list(at), "curve", bits)
    mixed = placed.withColumn("_mix", F.xxhash64("doc_id"))
    ordered = ranked(mixed, ["curve", "_mix", "doc_id", "text_crc32", "size"], "_rank", "_total")
    numbered = ordered.withColumn("shard", F.floor(F.expr(f"_rank * {count} div _total")).cast("int"))
    # The first rank r of shard s is the least with r * count >= s * total.
    slot = F.col("_rank") - F.expr(f"(shard * _total + {count - 1}) div {count}")
    return numbered.withColumn("slot", slot.cast("long"))


def write_shards(docs: DataFrame, path: str, count: int = 16, bits: int = BITS) -> None:
    """Writes docs as Parquet under path/shard=N (_shard=N if docs has a column shard), rows in curve order.

    Every row is written once, with all its columns; null and repeated doc_ids are like any other.
    Whole rows travel along the curve, so nothing is joined back.
    """
    placed = _placed(docs.select(*_measures(docs), F.struct(*docs.columns).alias("_row")), count, bits)
    shard, slot = with_key(docs, "shard"), with_key(docs, "_slot")
    out = placed.select("_row.*", F.col("shard").alias(shard), F.col("slot").alias(slot))
    out.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).drop(slot).write.partitionBy(shard).parquet(path)
