"""Toxicity by compression distance: which of two zstandard dictionaries packs a text's windows shorter.

The ordinary dictionary is trained on windows of ordinary texts, the toxic one on fragments of
toxic texts that ordinary texts hardly have. A window is compressed with the ordinary dictionary
and with both; what the toxic one saves tells how toxic it is. A document's savings become a score
by a calibrated logistic threshold.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortise.llm.common import ROWS_AT_ONCE, doc_texts, map_rows, texts_of, with_key
from mortise.llm.minhash import shingle_hashes

#: Bytes of a window (whole words) and of the dictionaries.
WINDOW, ORDINARY_BYTES, TOXIC_BYTES = 48, 16384, 4096
#: Match finding: matches of 5 bytes at least, so that chance matches save little.
SEARCH = {"window_log": 15, "chain_log": 15, "hash_log": 14, "search_log": 5, "min_match": 5, "target_length": 8, "strategy": zstandard.STRATEGY_BTLAZY2}
#: Characters of a fragment's parts; a part counts if it is in this share of toxic texts and so many times as frequent there.
GRAM, SHARE, TIMES = 5, 0.02, 8
#: Labelled rows of each class that the model is fitted on, at most (least hash of doc_id first).
TOXIC_ROWS, ORDINARY_ROWS = 2000, 4000
#: Bytes of a text beyond which it is not learned from (scoring has no such bound).
TEXT_BYTES = 1 << 18
#: Min-hashes that tell near copies among them.
MARKS = 16


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """The whole text in lower case, as runs of words of at least `size` bytes."""
    out, held, n = [], [], 0
    for word in text.lower().encode().split():
        held.append(word)
        n += len(word) + 1
        if n >= size:
            out.append(b" %b " % b" ".join(held))
            held, n = [], 0
    if held:
        out.append(b" %b " % b" ".join(held))
    return out


def _grams(text: str) -> tuple[str, set[str]]:
    flat = f" {' '.join(text.lower().split())} "
    return flat, {flat[i : i + GRAM] for i in range(len(flat) - GRAM + 1)}


def apart(texts: Iterable[str]) -> list[str]:
    """texts without copies and near copies of ones kept before, which would make chance parts look frequent.

    A near copy shares at least four fifths of its min-hashes with a single kept text.
    """
    having, out = defaultdict(list), []
    for text in texts:
        h = shingle_hashes(text)
        marks = [(i, int((h * np.uint64(odd)).min())) for i, odd in enumerate(range(0x9E3779B97F4A7C15, 0x9E3779B97F4A7C15 + 2 * MARKS, 2))] if len(h) else []
        shared = Counter(k for m in marks for k in having.get(m, ()))
        if max(shared.values(), default=0) < 0.8 * MARKS:
            for m in marks:
                having[m].append(len(out))
            out.append(text)
    return out


def fragments(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """The parts of toxic texts that are frequent there and rare in ordinary ones, at their full extent."""
    with_it, without = Counter(), Counter()
    for texts, counts in ((toxic, with_it), (ordinary, without)):
        for t in texts:
            counts.update(_grams(t)[1])
    least, scale = max(3, SHARE * len(toxic)), TIMES * len(toxic) / max(1, len(ordinary))
    marked = {g for g, n in with_it.items() if n >= least and n >= scale * (without[g] + 0.5)}
    out = []
    for t in toxic:
        flat, start, end = _grams(t)[0], -1, -1
        for i in range(len(flat) - GRAM + 1):
            if flat[i : i + GRAM] in marked:
                if i > end:
                    if end >= 0:
                        out.append(flat[start:end].encode())
                    start = i
                end = i + GRAM
        if end >= 0:
            out.append(flat[start:end].encode())
    return out


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's content; too few samples stand for themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]


@lru_cache(maxsize=8)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **SEARCH)
    if not content:
        return zstandard.ZstdCompressor(compression_params=how)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


@dataclass(frozen=True)
class Toxicity:
    """Both dictionaries and the weights of the calibrated score."""

    ordinary: bytes
    both: bytes
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    spread: tuple[float, ...]

    def savings(self, text: str) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        plain, more = _compressor(self.ordinary).compress, _compressor(self.both).compress
        return np.array([len(plain(w)) - len(more(w)) for w in windows(text)], dtype=np.float64)

    def features(self, text: str) -> list[float]:
        """Greatest and second saving of a window, mean saving, and share and number of windows that save."""
        s = self.savings(text)
        if not len(s):
            return [0.0] * 5
        top = np.sort(s)[::-1][:2]
        return [float(top[0]), float(top[-1]) if len(s) > 1 else 0.0, float(s.mean()), float((s >= 2).mean()), float(np.log1p((s >= 2).sum()))]

    def score(self, text: str) -> float:
        x = (np.array(self.features(text)) - self.centre) / self.spread
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (intercept first) by Newton's method; a small ridge keeps them finite."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-3] * (x.shape[1] - 1)) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(toxic: Iterable[str], ordinary: Iterable[str]) -> Toxicity:
    """Dictionaries from two thirds of the texts, weights from the rest (from all if there are few).

    Without texts of both classes every score is 0.
    """
    toxic, ordinary = apart(toxic), apart(ordinary)
    if not toxic or not ordinary:
        return Toxicity(b"", b"", (-30.0, 0, 0, 0, 0, 0), (0.0,) * 5, (1.0,) * 5)
    few = min(len(toxic), len(ordinary)) < 30
    own = lambda texts: texts if few else [t for i, t in enumerate(texts) if i % 3]
    held = lambda texts: texts if few else texts[::3]
    plain = dictionary([w for t in own(ordinary) for w in windows(t)], ORDINARY_BYTES)
    extra = dictionary(fragments(own(toxic), own(ordinary)), TOXIC_BYTES)
    model = Toxicity(plain, extra + plain, (), (), ())
    rows = [model.features(t) for part in (held(toxic), held(ordinary)) for t in part]
    x, y = np.array(rows), np.array([1] * len(held(toxic)) + [0] * len(held(ordinary)))
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    w = _logistic((x - centre) / spread, y)
    return Toxicity(plain, extra + plain, tuple(map(float, w)), tuple(map(float, centre)), tuple(map(float, spread)))


def learns(doc_id: str = "doc_id"):
    """Whether a row may be learned from: CRC-32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, text_bytes: int = TEXT_BYTES) -> Toxicity:
    """A model from labelled rows whose fold learns.

    At most toxic_rows and ordinary_rows of them, by the least hash of doc_id: ids are chosen from
    the label table first, so only that many ids are broadcast and that many texts collected. Of
    the texts of a repeated id the least is learned from, and none of over text_bytes bytes. An id
    with both labels is toxic; null ids, null labels and labels without a document teach nothing.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(learns() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, toxic_rows), (0, ordinary_rows))]
    ids = F.broadcast(chosen[0].union(chosen[1]))
    short = doc_texts(docs).where(F.octet_length("text") <= text_bytes)
    rows = short.join(ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return train([r.text for r in rows if r.toxic == 1], [r.text for r in rows if r.toxic == 0])


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """Per row of `docs`: doc_id, held_out (its fold is not learned from), score, predicted.

    A null text is empty, and an empty text scores as one without savings. Null ids and repeated
    rows stay, an empty table gives no rows, other columns are not read. Narrow: no shuffle.
    """
    flagged = docs.select("doc_id", "text", F.coalesce(~learns(), F.lit(False)).alias("held_out"))

    def rows(batch: pa.RecordBatch) -> dict:
        made = [model.score(t) for t in texts_of(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": made, "predicted": [int(x >= 0.5) for x in made]}

    return map_rows(doc_texts(flagged, "held_out"), "doc_id long, held_out boolean, score double, predicted int", rows)


def keep_ordinary(docs: DataFrame, model: Toxicity) -> DataFrame:
    """The rows of `docs`, with all their columns, that `model` does not call toxic."""
    flag = with_key(docs, "_toxic")

    @F.arrow_udf("boolean")
    def toxic(texts: pa.Array) -> pa.Array:
        parts = [[model.score(t) >= 0.5 for t in texts_of(texts.slice(at, ROWS_AT_ONCE))] for at in range(0, len(texts), ROWS_AT_ONCE)]
        return pa.array([x for part in parts for x in part], pa.bool_())

    return docs.withColumn(flag, toxic(F.col("text").cast("string"))).where(~F.col(flag)).drop(flag)
