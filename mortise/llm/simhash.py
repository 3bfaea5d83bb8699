"""SimHash near-duplicates: pigeonhole blocks, Hamming check, distributed union-find."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mortise.llm.buckets import bucket_links
from mortise.llm.common import doc_texts, map_rows, settled, texts_of, with_key
from mortise.llm.graph import components

#: Shingles whose bits are counted at a time.
PART = 1 << 16


def simhash(text: str, words: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint: a bit is set if it is set in over half of the shingles' XXH64 values.

    A-Z become lower case, words are runs without ASCII white space, shingles are `words` words
    joined by a space, repeats included; fewer words are one shingle; no word gives 0.
    """
    parts = text.encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts)] if len(parts) < words else list(map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)))
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), PART):
        h = np.array([digest(x, seed) for x in shingles[at : at + PART]], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint long) of every row; a null text is empty."""

    def rows(batch: pa.RecordBatch) -> dict:
        made = np.array([simhash(t, words) for t in texts_of(batch.column("text"))], dtype=np.uint64)
        return {"doc_id": batch.column("doc_id"), "fingerprint": made.view(np.int64)}

    return map_rows(doc_texts(docs), "doc_id long, fingerprint long", rows)


def block_masks(distance: int, blocks: int) -> list[int]:
    """For each choice of blocks - distance blocks of the 64 bits, the mask of their bits."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def hamming_linker(distance: int):
    def linker(payloads: list[bytes]):
        prints = np.frombuffer(b"".join(payloads), dtype=">u8").astype(np.uint64)
        return lambda i, others: others[np.bitwise_count(prints[others] ^ prints[i]) <= distance]

    return linker


def fingerprint_roots(classes: DataFrame, distance: int = 3, blocks: int = 5) -> DataFrame:
    """`classes`, a row for each distinct fingerprint, with the root of its component, which is never null."""
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(distance, blocks)]
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fingerprint").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)))
    rows = classes.select(F.explode(keys).alias("bucket"), F.col("fingerprint").alias("item"), F.unhex(F.lpad(F.hex("fingerprint"), 16, "0")).alias("payload"))
    roots = components(bucket_links(rows, hamming_linker(distance)))
    return classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))


def fingerprint_components(prints: DataFrame, distance: int = 3, blocks: int = 5) -> DataFrame:
    """(fingerprint, component_id) for each distinct fingerprint of `prints` (doc_id, fingerprint).

    Fingerprints that differ in at most `distance` bits agree in `blocks - distance` of the blocks
    at least, so they meet in the bucket of those; there the Hamming distance decides. More blocks
    make longer keys (5: 25 bits, 10 rows a fingerprint; 6: 32 bits, 20 rows), for any of
    which the links are the same. component_id is the least doc_id of the component.
    """
    classes = settled(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low")))
    joined = fingerprint_roots(classes, distance, blocks).select("fingerprint", "low", "root")
    lows = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    return joined.join(lows, "root").select("fingerprint", "component_id")


def near_duplicates(docs: DataFrame, distance: int = 3, blocks: int = 5, words: int = 3) -> DataFrame:
    """Per row of `docs`: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the least doc_id reachable over links of at most `distance` differing bits.
    Copies share a fingerprint, so they are one item in the buckets. Null texts are empty and, as
    texts without a word, have fingerprint zero, which links like any other. Rows with a null
    doc_id keep it, and take part; a component of such rows alone has a null component_id. Other
    columns are not read; an empty table gives no rows.
    """
    prints = settled(fingerprints(docs, words))
    ids = fingerprint_components(prints, distance, blocks)
    return prints.join(ids, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = 3, blocks: int = 5, words: int = 3) -> DataFrame:
    """One row of `docs` of each component, with all its columns: that with the least doc_id.

    Null ids come last. Of rows that repeat the id, that with the least hash of the text stays; of
    rows that repeat both, any one.
    """
    none, doc, body, place = (with_key(docs, c) for c in ("_none", "_doc", "_body", "_place"))
    number, text = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))

    def rows(batch: pa.RecordBatch) -> dict:
        made = np.array([simhash(t, words) for t in texts_of(batch.column("text"))], dtype=np.uint64)
        return {"doc_id": batch.column("doc_id"), "body": batch.column("body"), "fingerprint": made.view(np.int64)}

    prints = map_rows(doc_texts(docs, text.alias("body")), "doc_id long, body long, fingerprint long", rows)
    least = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc"), "body")
    classes = settled(prints.groupBy("fingerprint").agg(F.min(least).alias("low")))
    lows = fingerprint_roots(classes, distance, blocks).groupBy("root").agg(F.min("low").alias("low"))
    keepers = lows.select(F.col("low.none").alias(none), F.col("low.doc").alias(doc), F.col("low.body").alias(body))
    keyed = docs.withColumn(none, number.isNull()).withColumn(doc, F.coalesce(number, F.lit(0))).withColumn(body, text)
    kept = keyed.join(keepers, [none, doc, body], "left_semi")
    one = Window.partitionBy(none, doc, body).orderBy(F.lit(0))
    return kept.withColumn(place, F.row_number().over(one)).where(F.col(place) == 1).select(*docs.columns)
