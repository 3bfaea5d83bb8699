"""Shared helpers: table access, checkpoints, Arrow row plumbing."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Takes the shared folder that the session names in spark.checkpoint.dir.

    Only where none is named, and only on a local master, a temporary folder is set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="mortise-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder: its lineage ends there and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_key(df: DataFrame, taken: str) -> str:
    """A column name like `taken` that df does not have yet."""
    have = {c.lower() for c in df.columns}
    name = taken
    while name.lower() in have:
        name = f"_{name}"
    return name


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow column; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


#: Rows whose Python values a worker holds at a time.
ROWS_AT_ONCE = 1024


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded length; empty ones are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def map_rows(df: DataFrame, schema: str, rows: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """mapInArrow by a function from a batch to {column: values}; columns follow `schema`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = rows(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def doc_texts(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id long, text string) with null text as empty, and further columns by name."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)
