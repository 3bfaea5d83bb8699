"""Packing documents into fixed token windows by the online sum-of-squares rule.

A document's tokens are cut at every full window; each rest is placed, one after another, into the
fill level that minimises the sum over levels of the squared count of windows standing at that
level. The state is an array of counts by level. Windows stand in groups of bounded size that are
packed independently, so no task ever holds more than a group.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortise.llm.common import doc_texts, map_rows, texts_of

#: The splitting pattern of byte-level BPE files that state "use_regex".
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents to a packing group: the open windows at a group's end are its only avoidable padding.
GROUP_DOCS = 16384


class ByteBpe:
    """Ids of a byte-level BPE file (tokenizers .json), special strings in a text found as by that library.

    Where the file's merges are numbered in order, as in plain byte-level BPE, the ids come from
    a faster encoder with the same merges; any other file is run by the tokenizers library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(Tokenizer.from_file(path).to_str())
        model, pre, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
        vocab, merges = model.get("vocab", {}), model.get("merges", [])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        own = {x["content"]: x["id"] for x in added}
        plain = (
            model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec["normalizer"] is None
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and not any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
            and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs)) and len([1 for x in vocab if x not in own]) == 256 + len(pairs)
        )
        self.library = Tokenizer.from_file(path)
        self.encoder = None
        if plain:
            import tiktoken

            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            hidden = [b for b in range(256) if b not in set(shown)]
            byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
            ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocab.items() if piece not in own}
            self.encoder = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=own)
            self.special = re.compile("|".join(map(re.escape, own))) if own else None

    def ids(self, text: str) -> np.ndarray:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.encoder is None:
            got = self.library.encode(text, add_special_tokens=False).ids
        elif self.special is not None and self.special.search(text):
            got = self.encoder.encode(text, allowed_special="all")
        else:
            got = self.encoder.encode_ordinary(text)
        return np.asarray(got, dtype="<u4")


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


class SumOfSquares:
    """Level array of windows of `size`; place() says into which window a piece goes, and where."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.windows = 0

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) for a piece of 1 to `size` tokens.

        Moving a window from level h to h + s changes the sum by 2 (N[h+s] - N[h] + 1); a full
        window leaves the count (1 - 2 N[h]), a new one enters it (2 N[s] + 1, none if it is
        full at once). Ties go to the fullest level.
        """
        size, counts = self.size, self.counts
        room = size - length
        best, level = (0 if length == size else 2 * int(counts[length]) + 1), 0
        if room:
            held = counts[1 : room + 1]
            change = 2 * (counts[1 + length : size + 1] - held + 1)
            change[-1] = 1 - 2 * held[-1]
            change[held == 0] = np.iinfo(np.int64).max
            at = room - 1 - int(change[::-1].argmin())
            if change[at] <= best:
                level = at + 1
        if level:
            window = self.open[level].pop()
            counts[level] -= 1
        else:
            window, self.windows = self.windows, self.windows + 1
        if level + length < size:
            self.open[level + length].append(window)
            counts[level + length] += 1
        return window, level


def cut_pieces(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: full windows, then the rest.

    Rows: doc_id, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers),
    doc_tokens, repeat (how many equal pieces came before in the same batch of rows), and with
    keep_ids the ids themselves as bytes.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        bpe, out = byte_bpe(tokenizer), {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "repeat", "ids")}
        end, seen = np.array([end_id], dtype="<u4"), Counter()
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
            ids = np.concatenate([bpe.ids(text), end])
            for start in range(0, len(ids), window):
                piece = ids[start : start + window].tobytes()
                same = doc, start, zlib.crc32(piece)
                for k, v in (("doc_id", doc), ("start", start), ("length", len(piece) // 4), ("ids_crc32", same[2]), ("doc_tokens", len(ids)), ("repeat", seen[same])):
                    out[k].append(v)
                seen[same] += 1
                if keep_ids:
                    out["ids"].append(piece)
        return out

    return map_rows(doc_texts(docs), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, repeat long" + ", ids binary" * keep_ids, rows)


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, keep_ids: bool = False, group_docs: int = GROUP_DOCS) -> DataFrame:
    """cut_pieces() with sequence_id and offset: which window a piece lies in and from where.

    Pieces are dealt by a hash of their content to about one group for `group_docs` documents, and
    come in the order of that hash; so the same table gives the same windows however it is stored
    (repeated rows are told apart by their place in their batch, so that they spread over groups,
    too: tables with such may give other windows when stored otherwise). sequence_id is
    group * 2^32 + number within the group. A null text is empty (only the end id), a null doc_id
    stays null, equal rows are packed each on their own, an empty table gives no row.
    One count of the rows and one shuffle of the piece table (without texts).
    """
    groups = max(1, math.ceil(docs.count() / group_docs))
    pieces = cut_pieces(docs, tokenizer, window, end_id, keep_ids)
    mixed = pieces.withColumn("_order", F.xxhash64("doc_id", "start", "ids_crc32", "repeat"))
    dealt = mixed.withColumn("_group", F.pmod(F.col("_order"), F.lit(groups)))
    ordered = dealt.repartition("_group").sortWithinPartitions("_group", "_order", "doc_id", "start", "ids_crc32")
    names = [c for c in pieces.columns if c != "repeat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer = None, SumOfSquares(window)
        for batch in batches:
            where = []
            for g, length in zip(batch.column("_group").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if g != group:
                    group, packer = g, SumOfSquares(window)
                at, offset = packer.place(length)
                where.append(((g << 32) + at, offset))
            sequence, offset = zip(*where, strict=True) if where else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*names).schema)
    return ordered.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """Token windows from pack(keep_ids=True): sequence_id, n_tokens, ids (bytes, padded unless the fill is a power of two).

    A window holds at most `window` pieces, so the group that one row needs is bounded.
    """
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
    joined = F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))")
    fill = F.when(F.expr("bit_count(n_tokens) = 1"), F.lit(0)).otherwise(F.lit(window) - F.col("n_tokens"))
    pad = F.lit(np.array([pad_id], dtype="<u4").tobytes())
    return parts.select("sequence_id", "n_tokens", F.concat(joined, F.unhex(F.repeat(F.hex(pad), fill.cast("int")))).alias("ids"))
