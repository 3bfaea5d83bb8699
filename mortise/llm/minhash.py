"""One-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from mortise.llm.common import doc_texts, map_rows, texts_of
from mortise.llm.neighbours import with_next

#: Bins (a power of two), and low-order bits kept of each.
BINS, BITS = 512, 4
WORDS = 5
_ODD = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of unsigned 64-bit numbers (splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(_ODD[0])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_ODD[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_ODD[2])
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """Hashes of the word shingles: runs without white space, `words` at a time, all in one if fewer."""
    parts = text.encode().split()
    if not parts:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(x) for x in parts], dtype=np.uint64)
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(words, len(h))):
        out = out * np.uint64(_ODD[0]) + h[i : i + n]
    return mix(out)


@lru_cache(maxsize=4)
def donor_order(bins: int) -> np.ndarray:
    """For each bin, when it would try each other bin: a random order of its own, the same everywhere."""
    return (mix(np.arange(bins * bins, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32).reshape(bins, bins)


def sketch(hashes: np.ndarray, bins: int = BINS, bits: int = BITS) -> bytes:
    """Packed low-order bits of the least hash of each bin; no hash gives no bytes.

    The leading bits choose the bin. An empty bin takes the value of the filled bin that comes first
    in its own random order: the first hit of a sequence of independent probes.
    """
    if not len(hashes):
        return b""
    h = np.sort(hashes)
    at = (h >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    filled = at[first]
    low = np.zeros(bins, dtype=np.uint8)
    low[filled] = (h[first] & np.uint64((1 << bits) - 1)).astype(np.uint8)
    if len(filled) < bins:
        has = np.zeros(bins, dtype=bool)
        has[filled] = True
        empty = np.flatnonzero(~has)
        low[empty] = low[filled[donor_order(bins)[np.ix_(empty, filled)].argmin(axis=1)]]
    return np.packbits(np.unpackbits(low[:, None], axis=1, bitorder="little")[:, :bits]).tobytes()


def likeness(a: bytes, b: bytes, bins: int = BINS, bits: int = BITS) -> float:
    """Estimated Jaccard similarity: the share of equal bins, freed of chance hits of `bits` bits.

    Two empty sketches are alike (1), an empty and another one are not (0).
    """
    if not a or not b:
        return float(a == b)
    x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    same = 1 - np.unpackbits(x).reshape(bins, bits).any(axis=1).mean()
    chance = 1 / (1 << bits)
    return float(min(1.0, max(0.0, (same - chance) / (1 - chance))))


def fingerprints(docs: DataFrame, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint binary) of each row; a null text is empty and has no bytes."""

    def rows(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "fingerprint": [sketch(shingle_hashes(t, words), bins, bits) for t in texts_of(batch.column("text"))]}

    return map_rows(doc_texts(docs), "doc_id long, fingerprint binary", rows)


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_fingerprints(docs: DataFrame, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness.

    Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited,
    near_next. The next document follows in descending doc_id; after the last comes the first. Null
    texts are empty: their fingerprint is the empty string, alike only to another empty one. Null
    ids come last, repeated ids by text; an empty table gives no rows.
    """
    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = pa.schema([pa.field(x.split()[0], kind) for x, kind in zip(ddl.split(", "), kinds, strict=True)])

    def start(text: str) -> bytes:
        return sketch(shingle_hashes(text, words), bins, bits)

    def row(doc: int | None, text: str, own: bytes, following: str, other: bytes) -> tuple:
        changed = edited(text, following)
        new = start(changed)
        return doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.hex(), new.hex(), likeness(own, new, bins, bits), likeness(own, other, bins, bits)

    return with_next(docs, start, row, schema, ddl)
