"""Fuzzy line dedup: character-shingle MinHash, banding, exact Jaccard check, distributed union-find."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from math import ceil, comb, log
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortise.llm.buckets import bucket_links
from mortise.llm.common import ROWS_AT_ONCE, doc_texts, map_rows, settled, slices, texts_of, with_key
from mortise.llm.graph import components
from mortise.llm.membership import Membership
from mortise.llm.minhash import mix

#: Characters of a shingle, least similarity, bands and hashes a band (a pair at 0.8 is missed once in 575). Chance
#: meetings grow with the square of the lines: larger corpora take more hashes a band, and bands by `bands_for`.
CHARS, SIMILAR, BANDS, ROWS = 5, 0.8, 16, 5
#: Most hashes that give a bit to a line's sketch, and how seldom a similar pair's sketches may lie too far apart.
SKETCH, MISS = 58, 1e-5
#: Code points hashed at a time, and for how many times as many the lines are held.
PART, MANY = 1 << 16, 64
#: Lines of a bucket that are checked in one task.
CHUNK = 1024
#: Parcels that band rows are dealt in, band rows that are packed at once, those of a parcel that are sorted in memory, and sorted ones that are looked through at once.
PARCELS, PACKED, SORTED, AT_ONCE = 2048, 1 << 17, 1 << 21, 1 << 14
#: Lines of a bucket whose sketches are compared at once; larger buckets go to the exact check as they are.
SKETCHES = 4096
#: Bits of a line's mark in the exact check, and lines that are marked at once.
MARK, MARKED = 512, 64
#: Stands for a null doc_id, which comes last.
NO_ID = (1 << 63) - 1


def normal(line: str) -> str:
    """What decides whether lines are equal: lower case, runs of white space as one space, none at the ends."""
    return " ".join(line.lower().split())


#: White space other than single spaces between words; str.split() takes the same characters.
_UNEVEN = ("  ", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))


def normal_lines(text: str) -> list[str]:
    """normal() of each line of a text; an evenly spaced text is lower-cased and cut as a whole."""
    uneven = text[:1] == " " or text[-1:] == " " or any(x in text for x in _UNEVEN)
    return list(map(normal, text.split("\n"))) if uneven else text.lower().split("\n")


def line_key(line: str) -> int:
    """Signed 64-bit hash of a normal line."""
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 1) - (1 << 63)


def shingles(lines: list[str], chars: int = CHARS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): the shingle hashes (32 bits) of all lines in a row, and where each line's begin; shorter lines have one."""
    padded = [x if len(x) >= chars else x + "\0" * (chars - len(x)) for x in lines]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(x) for x in padded], dtype=np.int64)
    n = len(points) - chars + 1
    h, part, odd = np.zeros(n, dtype=np.uint64), np.empty(n, dtype=np.uint64), 0x9E3779B97F4A7C15
    for i in range(chars):
        np.multiply(points[i : n + i], np.uint64(odd), out=part)
        h += part
        odd = (odd * 0xD6E8FEB86659FD93 + 2) % (1 << 64)
    np.right_shift(h, np.uint64(29), out=part)
    h ^= part
    h *= np.uint64(0xBF58476D1CE4E5B9)
    low = (h >> np.uint64(32)).astype(np.uint32)
    # The last chars - 1 positions of a line start shingles that reach over its end.
    keep = np.ones(len(points), dtype=bool)
    ends = np.cumsum(lengths)
    for i in range(1, chars):
        keep[ends - i] = False
    return low[keep[:n]], np.concatenate([[0], np.cumsum(lengths - chars + 1)[:-1]])


def signatures(lines: list[str], bands: int = BANDS, rows: int = ROWS, chars: int = CHARS) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sketches) from MinHash signatures of bands * rows hashes.

    keys (lines, bands) are buckets, each equal to its band's number modulo `bands`; a sketch has
    one bit of each of the first SKETCH hashes.
    """
    if not lines:
        return np.empty((0, bands), dtype=np.int64), np.empty(0, dtype=np.int64)
    low, starts = shingles(lines, chars)
    made = np.random.default_rng(20240501)
    odd = made.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    more = made.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    least, turned = np.empty((bands * rows, len(lines)), dtype=np.uint32), np.empty_like(low)
    for i in range(bands * rows):
        np.bitwise_xor(low, more[i], out=turned)
        np.multiply(turned, odd[i], out=turned)
        np.minimum.reduceat(turned, starts, out=least[i])
    bits = (least[:SKETCH] >> np.uint32(8) & np.uint32(1)).astype(np.int64)
    sketch = np.bitwise_or.reduce(bits << np.arange(len(bits))[:, None], axis=0)
    number = np.arange(bands)[:, None]
    keys = np.zeros((bands, len(lines)), dtype=np.uint64)
    for values in least.reshape(bands, rows, -1).transpose(1, 0, 2):
        keys = mix(keys ^ values) + (number + 1).astype(np.uint64)
    # 47 bits are enough to tell buckets apart, and are written shorter.
    return ((keys >> np.uint64(17)).astype(np.int64) // bands * bands + number).T, sketch


def bands_for(rows: int, similar: float = SIMILAR, miss: float = 1 / 550) -> int:
    """Bands of `rows` hashes that miss a pair at the least similarity not more often than `miss`."""
    return ceil(log(miss) / log(1 - similar**rows))


def most_apart(hashes: int, similar: float = SIMILAR) -> int:
    """Bits that sketches of similar lines differ in at most, but for a share of MISS of them.

    Each hash has the same minimum with a probability of the similarity, and else the same bit with
    one of a half.
    """
    differ, tail, d = (1 - similar) / 2, 0.0, hashes
    while d > 0 and (tail := tail + comb(hashes, d) * differ**d * (1 - differ) ** (hashes - d)) <= MISS:
        d -= 1
    return d


#: Bit of a sketch column that says that the line has come before in its batch.
AGAIN = 62


def candidates(batches: Iterator[pa.RecordBatch], bands: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, item, sketch) sorted by bucket and item -> (low, item): who may be similar to another.

    A line stays in a bucket if its sketch differs in at most `most` bits from that of another
    line there; `low` is the least of those that stay, so buckets that share it become one group.
    Lines that occur more than once come out with a null `low`, from the first band. Only the rows
    of one bucket are held, and of a bucket beyond SKETCHES lines one row: its lines all stay.
    """
    empty = np.empty(0, dtype=np.int64)
    held = (empty, empty, empty)
    cut, cut_low = None, 0

    def close(keys, items, sketches, last: bool):
        """Output arrays of the whole buckets among the rows, and the rows that wait for the next batch."""
        nonlocal cut, cut_low
        same = np.concatenate([[False], (keys[1:] == keys[:-1]) & (items[1:] == items[:-1])])
        first = np.flatnonzero(~same)
        more = np.diff(np.append(first, len(keys))) > 1
        again = np.bitwise_or.reduceat(sketches, first) >> AGAIN & 1 == 1
        keys, items, sketches = keys[first], items[first], sketches[first] & ((1 << SKETCH) - 1)
        again |= more
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.append(starts[1:], len(keys))
        lows, members = [], []
        if not last and ends[-1] - starts[-1] <= SKETCHES:
            wait, starts, ends = int(starts[-1]), starts[:-1], ends[:-1]
        else:
            wait = len(keys) if last else len(keys) - 1  # of a cut bucket the last row tells if the next repeats it
        sizes, going = ends - starts, keys[starts] == cut
        two = starts[(sizes == 2) & ~going]
        two = two[np.bitwise_count(sketches[two] ^ sketches[two + 1]) <= most] if len(two) else two
        lows.append(np.repeat(items[two], 2))
        members.append(np.stack([items[two], items[two + 1]], axis=1).ravel() if len(two) else empty)
        for s, e in zip(starts[(sizes > 2) | going].tolist(), ends[(sizes > 2) | going].tolist(), strict=True):
            group, x = items[s:e], sketches[s:e]
            if keys[s] == cut or e - s > SKETCHES:
                if keys[s] != cut:
                    cut, cut_low = int(keys[s]), int(group[0])
                lows.append(np.full(e - s, cut_low))
            else:
                near = np.concatenate([(np.bitwise_count(x[i : i + 256, None] ^ x[None, :]) <= most).sum(axis=1) > 1 for i in range(0, len(x), 256)])
                group = group[near]
                lows.append(np.full(len(group), group[0] if len(group) else 0))
            members.append(group)
        done = np.flatnonzero(again[:wait] & (keys[:wait] % bands == 0))
        out = [pa.concat_arrays([pa.array(np.concatenate(lows)), pa.nulls(len(done), pa.int64())]), pa.array(np.concatenate([*members, items[done]]))]
        rest = slice(wait, None)
        return pa.RecordBatch.from_arrays(out, ["low", "item"]), (keys[rest], items[rest], sketches[rest] | again[rest].astype(np.int64) << AGAIN)

    for batch in batches:
        if batch.num_rows:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            out, held = close(*(np.concatenate(x) for x in zip(held, rows, strict=True)), last=False)
            yield out
    if len(held[0]):
        yield close(*held, last=True)[0]


class Jaccard:
    """(i, others): those of some normal lines whose shingle sets have an exact Jaccard similarity >= `similar` with line i's.

    A shingle is packed into one number, in which each character has its own bits, so sets of
    numbers are sets of shingles; where the characters need too many bits, shingles are numbered.
    Only lines with enough shingles for the similarity are compared, and only where marks allow it: a
    bit of a mark tells whether an odd number of shingles falls on it, so marks differ in at most as
    many bits as sets in shingles, and no similar line is left out.
    """

    def __init__(self, lines: list[bytes], similar: float = SIMILAR, chars: int = CHARS):
        texts = [x.decode("utf-8", "surrogatepass") for x in lines]
        texts = [x if len(x) >= chars else x + "\0" * (chars - len(x)) for x in texts]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if int(points.max()).bit_length() * chars > 64:
            points = np.unique(points, return_inverse=True)[1].astype(np.uint32)
        bits, lengths = int(points.max()).bit_length(), np.array(list(map(len, texts)))
        if bits * chars <= 64:
            codes = np.zeros(len(points) - chars + 1, dtype=np.uint64)
            for i in range(chars):
                codes = codes << np.uint64(bits) | points[i : len(codes) + i]
        else:
            number: dict[str, int] = {}
            joined = "".join(texts)
            codes = np.array([number.setdefault(joined[i : i + chars], len(number)) for i in range(len(joined) - chars + 1)], dtype=np.uint64)
        self.similar = similar
        starts = np.cumsum(lengths) - lengths
        keep = np.ones(len(points), dtype=bool)
        for start, n in zip(starts.tolist(), lengths.tolist(), strict=True):
            codes[start : start + n - chars + 1].sort()
        keep[1 : len(codes)] = codes[1:] != codes[:-1]
        keep[starts] = True
        for i in range(1, chars):
            keep[starts + lengths - i] = False
        self.sizes = np.add.reduceat(keep.astype(np.int64), starts)
        codes, ends = codes[keep[: len(codes)]], np.cumsum(self.sizes)
        self.sets = np.split(codes, ends[:-1])
        bits = ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MARK.bit_length() + 1)).astype(np.int64)
        self.marks = np.empty((len(ends), MARK // 64), dtype=np.uint64)
        for at in range(0, len(ends), MARKED):
            sizes, to = self.sizes[at : at + MARKED], min(at + MARKED, len(ends))
            line = np.repeat(np.arange(0, MARK * len(sizes), MARK), sizes)
            counts = np.bincount(line + bits[ends[at] - self.sizes[at] : ends[to - 1]], minlength=MARK * len(sizes))
            self.marks[at:to] = np.packbits((counts & 1).astype(np.uint8)).view(np.uint64).reshape(-1, MARK // 64)

    def __call__(self, i: int, others: np.ndarray) -> np.ndarray:
        mine, n = self.sets[i], self.sizes[i]
        if len(others) == 1:
            other, m = self.sets[others[0]], self.sizes[others[0]]
            if min(n, m) < self.similar * max(n, m) - 1e-9:
                return others[:0]
            same = np.count_nonzero(mine.take(mine.searchsorted(other), mode="clip") == other)
            return others if same >= self.similar * (n + m - same) - 1e-9 else others[:0]
        sizes = self.sizes[others]
        apart = np.bitwise_count(self.marks[others] ^ self.marks[i]).sum(axis=1, dtype=np.int64)
        others = others[(np.minimum(sizes, n) >= self.similar * np.maximum(sizes, n) - 1e-9) & (apart <= (1 - self.similar) / (1 + self.similar) * (n + sizes) + 1e-6)]
        common = np.empty(len(others))
        for k, j in enumerate(others.tolist()):
            other = self.sets[j]
            common[k] = np.count_nonzero(mine.take(mine.searchsorted(other), mode="clip") == other)
        return others[common >= self.similar * (n + self.sizes[others] - common) - 1e-9]


def _text_key(text: str) -> int:
    """Spark's xxhash64 of the text."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def occurrences(docs: DataFrame, wanted: Membership | None = None, told: Membership | None = None) -> DataFrame:
    """(line, doc, body, number, payload) of lines that are not blank: key of the line, doc_id, key of the text, line number, the normal line.

    With `wanted`, only of lines that it may have; payloads only of lines that `told` may have, at a
    line's first place in some rows.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        line, doc, body, number, payload, seen = [], [], [], [], [], set()
        for i, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
            kept = [(n, x) for n, x in enumerate(normal_lines(text)) if x]
            keys = line_keys([x for _, x in kept])
            if wanted:
                has = np.flatnonzero(wanted.may_have(keys)).tolist()
                kept, keys = [kept[j] for j in has], keys[has]
            if not kept:
                continue
            tell = told.may_have(keys).tolist() if told else [False] * len(kept)
            for k, t, (n, x) in zip(keys.tolist(), tell, kept, strict=True):
                payload.append(x.encode("utf-8", "surrogatepass") if t and k not in seen else None)
                number.append(n)
                seen.add(k)
            line.append(keys)
            doc += [NO_ID if i is None else i] * len(kept)
            body += [_text_key(text)] * len(kept)
        line = np.concatenate(line) if line else np.empty(0, dtype=np.int64)
        return {"line": line, "doc": np.array(doc, dtype=np.int64), "body": np.array(body, dtype=np.int64), "number": np.array(number, dtype=np.int32), "payload": pa.array(payload, pa.binary())}

    return map_rows(doc_texts(docs), "line long, doc long, body long, number int, payload binary", rows)


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[str], dict[str, bool], bool]]:
    """(new, seen, last) of the different lines of the batches, in parts of bounded length.

    seen: the lines up to here, and whether they have come again; it begins anew after `last`, which
    comes with `most` lines, with MANY parts' code points and at the end. new: those that the part adds.
    """
    new, seen, points, total = [], {}, 0, 0
    for batch in slices(batches):
        for text in texts_of(batch.column("text")):
            for line in normal_lines(text):
                if line in seen:
                    seen[line] = True
                elif line:
                    seen[line] = False
                    new.append(line)
                    points += len(line)
            if points >= PART:
                total += points
                full = len(seen) >= most or total >= MANY * PART
                yield new, seen, full
                new, seen, points, total = [], {} if full else seen, 0, 0 if full else total
    if seen:
        yield new, seen, True


def line_keys(lines: list[str]) -> np.ndarray:
    return np.array(list(map(line_key, lines)), dtype=np.int64)


#: A packed row; SKETCH bits of `low` are the sketch, the others and `high` have 38 bits.
ROW = np.dtype([("item", "<i8"), ("low", "<i8"), ("high", "<u4")])


def packed(keys: np.ndarray, items: np.ndarray, sketches: np.ndarray) -> pa.RecordBatch:
    """(parcel, rows) of the band rows of some lines: a bucket's rows go to one parcel, as the bytes of ROW one after the other.

    What of a bucket its parcel doesn't tell, and whether the line has come again, are laid around the sketch.
    """
    bands = keys.shape[1]
    most = keys // bands
    number = (most & (PARCELS - 1)).astype(np.uint16).ravel()
    order = np.argsort(number, kind="stable")
    told = ((most // PARCELS * bands + np.arange(bands)) << 1 | (sketches >> AGAIN & 1)[:, None]).ravel()[order]
    rows = np.empty(len(order), dtype=ROW)
    rows["item"], rows["high"] = items[order // bands], told >> 64 - SKETCH
    rows["low"] = sketches[order // bands] & ((1 << SKETCH) - 1) | told << SKETCH
    counts = np.bincount(number, minlength=PARCELS)
    has = np.flatnonzero(counts)
    ends = np.concatenate([[0], np.cumsum(counts[has])]).astype(np.int32) * np.int32(ROW.itemsize)
    blobs = pa.Array.from_buffers(pa.binary(), len(has), [None, pa.py_buffer(ends), pa.py_buffer(rows)])
    return pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), blobs], ["parcel", "rows"])


def read_back(rows: np.ndarray, number: int, bands: int) -> np.ndarray:
    """(bucket, item, sketch) of the rows of a parcel."""
    told = rows["high"].astype(np.int64) << 64 - SKETCH | (rows["low"] >> SKETCH & (1 << 64 - SKETCH) - 1)
    short = told >> 1
    most = short // bands
    return np.stack([(most * PARCELS + number) * bands + (short - most * bands), rows["item"], rows["low"] & ((1 << SKETCH) - 1) | (told & 1) << AGAIN], axis=1)


def ordered(rows: np.ndarray) -> np.ndarray:
    """Rows (bucket, item, sketch) by bucket and item, without those between the first and the last that are alone in their bucket and haven't come again."""
    rows = rows[np.argsort(rows[:, 0])]
    same = np.concatenate([[True], rows[1:, 0] == rows[:-1, 0], [True]])
    rows = rows[same[1:] | same[:-1] | (rows[:, 2] >> AGAIN & 1 == 1)]
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def merged(runs: list[np.ndarray], most: int) -> Iterator[np.ndarray]:
    """The rows of some sorted runs (3, rows) in order, in pieces of about `most` rows."""

    def place(run: np.ndarray, bucket: int, item: int) -> int:
        lo, hi = np.searchsorted(run[0], bucket), np.searchsorted(run[0], bucket, "right")
        return int(lo + np.searchsorted(run[1][lo:hi], item))

    step = max(1, most // len(runs))
    marks = sorted({(int(run[0][i]), int(run[1][i])) for run in runs for i in range(step, run.shape[1], step)})
    at = [0] * len(runs)
    for mark in [*marks, None]:
        to = [run.shape[1] if mark is None else place(run, *mark) for run in runs]
        piece = np.concatenate([run[:, i:j] for run, i, j in zip(runs, at, to, strict=True)], axis=1).T
        at = to
        if len(piece):
            yield piece


def unpacked(batches: Iterator[pa.RecordBatch], bands: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, item, sketch) by bucket and item, of packed() rows sorted by parcel.

    A parcel's rows are sorted in memory, and where they are many, in runs that lie in temporary
    files and are merged, so what is held doesn't grow with a bucket.
    """
    held: list[np.ndarray] = []
    runs: list[np.ndarray] = []
    done: list[np.ndarray] = []
    number, size = None, 0

    def batch(least: int) -> Iterator[pa.RecordBatch]:
        """The finished rows, if they are as many."""
        if done and sum(map(len, done)) >= least:
            rows = np.concatenate(done)
            done.clear()
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)], ["bucket", "item", "sketch"])

    def kept(folder: str) -> None:
        """The rows held as one more sorted run."""
        nonlocal held, size
        rows = np.concatenate(held)
        name = Path(folder) / f"{len(runs)}.npy"
        np.save(name, np.ascontiguousarray(rows[np.lexsort((rows[:, 1], rows[:, 0]))].T))
        runs.append(np.load(name, mmap_mode="r"))
        held, size = [], 0

    def close(folder: str) -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        if runs:
            if held:
                kept(folder)
            for piece in merged(runs, SORTED):
                done.append(ordered(piece))
                yield from batch(AT_ONCE)
            runs.clear()
        elif held:
            done.append(ordered(np.concatenate(held)))
            yield from batch(AT_ONCE)
            held, size = [], 0

    with tempfile.TemporaryDirectory() as folder:
        for one in batches:
            numbers, blobs = one.column("parcel").to_numpy(), one.column("rows")
            if not len(numbers):
                continue
            ends = np.frombuffer(blobs.buffers()[1], dtype=np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
            starts = np.concatenate([[0], np.flatnonzero(numbers[1:] != numbers[:-1]) + 1, [len(numbers)]])
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if numbers[s] != number:
                    yield from close(folder)
                    number = int(numbers[s])
                held.append(read_back(np.frombuffer(blobs.buffers()[2], dtype=ROW, count=int(ends[e] - ends[s]) // ROW.itemsize, offset=int(ends[s])), number, bands))
                size += len(held[-1])
                if size >= SORTED:
                    kept(folder)
        yield from close(folder)
        yield from batch(1)


def similar_lines(members: DataFrame, texts: DataFrame, similar: float = SIMILAR, chars: int = CHARS) -> DataFrame:
    """(node, root) of the lines that are linked to another one, of members (bucket, item) and texts (item, payload).

    Lines that share a band are one bucket; rows are dealt and sorted by it and streamed, so no
    bucket is held whole. Sketches leave out lines that are far from all others of their bucket;
    buckets with the same least line are one. Only the texts of the others are fetched, compared
    exactly, a bounded number in a task, and joined by a union-find over all verified links.
    """
    return components(bucket_links(members.join(texts, "item"), lambda lines: Jaccard(lines, similar, chars), CHUNK))


def met_lines(docs: DataFrame, similar: float, bands: int, rows: int, chars: int) -> DataFrame:
    """(low, item): candidates() of the band rows, which are packed, dealt by parcel and sorted by bucket."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for new, seen, last in _parts(batches, max(1, PACKED // bands)):
            made.append((*signatures(new, bands, rows, chars), line_keys(new)))
            if last:
                keys, sketches, items = (np.concatenate(x) for x in zip(*made, strict=True))
                yield packed(keys, items, sketches | np.array(list(seen.values()), dtype=np.int64) << AGAIN)
                made = []

    most = most_apart(min(SKETCH, bands * rows), similar)
    band = doc_texts(docs).select("text").mapInArrow(banded, "parcel int, rows binary")
    return band.repartition("parcel").sortWithinPartitions("parcel").mapInArrow(lambda batches: candidates(unpacked(batches, bands), bands, most), "low long, item long")


def repeated_lines(docs: DataFrame, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, chars: int = CHARS) -> DataFrame:
    """(doc, body, drops): for each document with such lines, the numbers of those that repeat an earlier line.

    Equal and similar lines are one component; the first line of it (least doc_id, then text key,
    then line number) stays.
    """
    met = settled(met_lines(docs, similar, bands, rows, chars).distinct())
    members = met.where("low is not null").select(F.col("low").alias("bucket"), "item")
    found = settled(occurrences(docs, Membership(met, "item"), Membership(members, "item")))
    texts = found.where("payload is not null").groupBy(F.col("line").alias("item")).agg(F.min("payload").alias("payload"))
    links, repeated = similar_lines(members, texts, similar, chars), met.where("low is null").select(F.col("item").alias("line"))
    held = settled(repeated.join(links.withColumnRenamed("node", "line"), "line", "full").select("line", F.coalesce("root", "line").alias("root")))
    found = found.drop("payload")
    firsts = found.groupBy("line").agg(F.min(F.struct("doc", "body", "number")).alias("first")).join(held, "line")
    kept = firsts.groupBy("root").agg(F.min("first").alias("kept"))
    keepers = held.join(kept, "root").select("line", "kept")
    drops = found.join(keepers, "line").where((F.col("doc") != F.col("kept.doc")) | (F.col("body") != F.col("kept.body")) | (F.col("number") != F.col("kept.number")))
    return drops.groupBy("doc", "body").agg(F.collect_set("number").alias("drops"))


def dedup_lines(docs: DataFrame, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, chars: int = CHARS, counts: bool = False) -> DataFrame:
    """`docs` with the lines taken out that repeat an earlier line of the table, exactly or nearly.

    Lines are similar at a Jaccard similarity of `similar` over their `chars`-character shingles,
    after lower-casing and joining white space; similarity is followed over chains. All rows and
    columns stay; a document of repeated lines only keeps an empty text, blank lines and null texts
    stay as they are. Rows with the same doc_id and text are one document. Null ids come last.
    With counts, columns n_lines and n_dropped follow (_n_lines, _n_dropped where docs has such).
    Only documents that may have such lines are shuffled.
    """
    drops = settled(repeated_lines(docs, similar, bands, rows, chars))
    hit = Membership(drops.select("body"), "body")
    flag, doc, body, lines = (with_key(docs, c) for c in ("_may", "_doc", "_body", "_drops"))

    def by_slices(function, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
        """function over the Python values of the rows, a bounded number at a time."""
        parts = [pa.array(map(function, *(c.slice(at, ROWS_AT_ONCE).to_pylist() for c in columns)), kind) for at in range(0, len(columns[0]), ROWS_AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    def without(text: str | None, gone: list[int] | None) -> str | None:
        if text is None or not gone:
            return text
        gone = set(gone)
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)

    @F.arrow_udf("boolean")
    def may(bodies: pa.Array) -> pa.Array:
        return pa.array(hit.may_have(bodies.to_numpy(zero_copy_only=False)))

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        return by_slices(without, pa.string(), texts, numbers)

    text = F.col("text").cast("string")
    keyed = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(body, F.xxhash64(F.coalesce(text, F.lit("")))).withColumn(flag, may(F.col(body)))
    joined = keyed.where(F.col(flag)).join(drops.select(F.col("doc").alias(doc), F.col("body").alias(body), F.col("drops").alias(lines)), [doc, body], "left")
    gone = F.when(F.col(lines).isNull(), 0).otherwise(F.size(lines))
    changed, same = joined, keyed.where(~F.col(flag))
    every = [F.col(c) for c in docs.columns]
    if counts:
        total = F.coalesce(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(1))
        n_lines, n_dropped = with_key(docs, "n_lines"), with_key(docs, "n_dropped")
        changed = changed.withColumn(n_lines, total).withColumn(n_dropped, gone)
        same = same.withColumn(n_lines, total).withColumn(n_dropped, F.lit(0))
        every += [F.col(n_lines), F.col(n_dropped)]
    changed = changed.withColumn("text", cleaned(text, F.col(lines)))
    return changed.select(*every).union(same.select(*every))
