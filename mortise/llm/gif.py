"""GIF media columns: LZW decoding, palettes, disposal and transparency, timed frames, histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mortise.llm.common import doc_texts, map_rows, texts_of

#: Fixed values of the format: most bits of a code, block introducers, labels.
MOST_BITS = 12
EXTENSION, IMAGE, TRAILER, CONTROL = 0x21, 0x2C, 0x3B, 0xF9
#: Samples to a row, rows to a frame, and time to a frame of stored byte payloads.
ROW, ROWS, DELAY_MS = 64, 1024, 40
#: Pixels of a canvas or an image beyond which a file counts as broken (a parameter of the readers).
MOST_PIXELS = 1 << 24
#: Histogram: two leading bits of red, green and blue.
BINS = 64


def _unpack(data: np.ndarray, starts: np.ndarray, widths: np.ndarray | int) -> np.ndarray:
    """Codes of up to 12 bits of the given widths at the given bit positions (least bit first); data ends in two spare bytes."""
    at = starts >> 3
    window = data[at] | data[at + 1].astype(np.int64) << 8 | data[at + 2].astype(np.int64) << 16
    return window >> (starts & 7) & ((1 << widths) - 1)


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """Samples of the codes between two clears.

    Entry j of the table is the string of code j and the first sample of code j + 1, so a code's
    string is found by following parents; lengths and first samples come by pointer doubling.
    """
    literal = codes < clear
    if literal.all():
        return codes.astype(np.uint8)
    n = np.arange(len(codes))
    entry = codes - (clear + 2)
    if (~literal & ((entry < 0) | (entry >= n))).any():
        raise ValueError("a code is not in the table")
    parent = np.where(literal, n, entry)
    root, depth = parent.copy(), (~literal).astype(np.int64)
    while not literal[root].all():
        depth += depth[root]
        root = root[root]
    first = codes[root]
    ends = np.cumsum(depth + 1)
    last = np.where(literal, codes, first[np.minimum(entry + 1, len(codes) - 1) * ~literal])
    out = np.empty(int(ends[-1]), dtype=np.uint8)
    at, now = ends - 1, n
    while len(now):
        out[at] = last[now]
        more = ~literal[now]
        at, now = at[more] - 1, parent[now[more]]
    return out


@lru_cache(maxsize=16)
def _places(clear: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and bit positions of the codes after a clear, as long as no other comes."""
    entries = clear + 2 + np.maximum(np.arange(most) - 1, 0)
    widths = np.minimum(np.floor(np.log2(entries)).astype(np.int64) + 1, MOST_BITS)
    return widths, np.cumsum(widths) - widths


def lzw_decode(data: bytes, least_bits: int, size: int) -> np.ndarray:
    """`size` samples of a GIF code stream (least_bits: its minimum code size).

    The widths of codes follow from how many came since the last clear, so codes are cut out in
    bulk: stretches with clears so near that the width never grows at once, others clear by clear.
    """
    clear, width = 1 << least_bits, least_bits + 1
    raw, end = np.frombuffer(data + b"\0\0", dtype=np.uint8), 8 * len(data)
    # Entries are made from the second code on; when they fill a width, the next code is wider.
    short = (1 << width) - (clear + 2)
    out, at, made = [], 0, 0
    while at + width <= end and made < size:
        whole = (end - at) // width
        # Only where a clear comes before the width grows is the rest cut at one width.
        codes = _unpack(raw, at + width * np.arange(min(whole, short + 1)), width)
        if whole > len(codes) and ((codes == clear) | (codes == clear + 1)).any():
            codes = _unpack(raw, at + width * np.arange(whole), width)
        marks = np.flatnonzero((codes == clear) | (codes == clear + 1))
        gaps = np.diff(np.concatenate([[-1], marks])) - 1
        ok = len(gaps) if (gaps <= short).all() else int(np.argmin(gaps <= short))
        ended = np.flatnonzero(codes[marks[:ok]] == clear + 1)
        ok = int(ended[0]) + 1 if len(ended) else ok
        if ok:
            upto = int(marks[ok - 1]) + 1
            if (codes[:upto] < clear + 2).all():
                part = codes[:upto][codes[:upto] < clear].astype(np.uint8)
                out.append(part)
                made += len(part)
            else:
                start = 0
                for mark in marks[:ok].tolist():
                    part = _expand(codes[start:mark], clear) if mark > start else np.empty(0, np.uint8)
                    out.append(part)
                    made, start = made + len(part), mark + 1
            at += upto * width
            if len(ended):
                break
            continue
        # A stretch in which the width grows.
        every = min((end - at) // width + 1, size - made + 2)
        for most in (min(every, (1 << MOST_BITS) + 8), every):  # few streams put a clear off once the table is full
            widths, starts = (x[:most] for x in _places(clear, 1 << max(13, most.bit_length())))
            starts = starts + at
            keep = starts + widths <= end
            starts, widths = starts[keep], widths[keep]
            codes = _unpack(raw, starts, widths)
            marks = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(marks):
                break
        upto = int(marks[0]) if len(marks) else len(codes)
        if not upto:
            break
        part = _expand(codes[:upto], clear)
        out.append(part)
        made += len(part)
        if not len(marks) or codes[upto] == clear + 1:
            break
        at = int(starts[upto] + widths[upto])
    samples = np.concatenate(out) if out else np.empty(0, np.uint8)
    if len(samples) < size:
        raise ValueError("the code stream ends early")
    return samples[:size]


def lzw_encode(samples: bytes) -> bytes:
    """A code stream of 8-bit samples with a growing table of strings, cleared when its 4096 codes are taken."""
    clear, first, full = 256, 258, 1 << MOST_BITS
    codes: list[int] = [clear]
    if samples:
        table: dict[int, int] = {}
        known, put, free, string = table.get, codes.append, first, samples[0]
        for b in samples[1:]:
            key = string << 8 | b
            longer = known(key)
            if longer is not None:
                string = longer
                continue
            put(string)
            string = b
            if free < full:
                table[key] = free
                free += 1
            else:
                put(clear)
                table.clear()
                free = first
        put(string)
    codes.append(clear + 1)
    made = np.array(codes, dtype=np.int64)
    # The width of a code follows from how many came since the last clear, as the decoder has it.
    n = np.arange(len(made))
    since = np.concatenate([[0], n[1:] - np.maximum.accumulate(np.where(made == clear, n, 0))[:-1] - 1])
    widths = np.minimum(np.floor(np.log2(first + np.maximum(since - 1, 0))).astype(np.int64) + 1, MOST_BITS)
    ends = np.cumsum(widths)
    bits = np.zeros(int(ends[-1]), dtype=np.uint8)
    for i in range(MOST_BITS):
        wide = widths > i
        bits[(ends - widths)[wide] + i] = made[wide] >> i & 1
    return np.packbits(bits, bitorder="little").tobytes()


def _blocks(data: bytes) -> bytes:
    """data in sub-blocks of up to 255 bytes, with the ending one."""
    whole = len(data) // 255
    body = np.empty((whole, 256), dtype=np.uint8)
    body[:, 0] = 255
    body[:, 1:] = np.frombuffer(data[: whole * 255], dtype=np.uint8).reshape(whole, 255)
    rest = data[whole * 255 :]
    return body.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def store_bytes(payload: bytes) -> bytes:
    """A GIF whose samples are `payload` (a positive multiple of 64 bytes), LZW-coded: grey palette, frames of up to 64 KiB."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    height = min(ROWS, len(samples) // ROW)
    grey = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
    out = [b"GIF89a", struct.pack("<HHBBB", ROW, height, 0xF7, 0, 0), grey]
    for at in range(0, len(samples), ROW * ROWS):
        part = samples[at : at + ROW * ROWS]
        out += [struct.pack("<BBBBHBB", EXTENSION, CONTROL, 4, 1 << 2, DELAY_MS // 10, 0, 0), struct.pack("<BHHHHB", IMAGE, 0, 0, ROW, len(part) // ROW, 0), b"\x08", _blocks(lzw_encode(part.tobytes()))]
    return b"".join(out) + bytes([TRAILER])


@dataclass
class Frame:
    """A frame as shown: the whole canvas, its time, and the samples that the stream held."""

    start_ms: int
    duration_ms: int
    rgba: np.ndarray
    samples: np.ndarray


def decode_gif(data: bytes, most_pixels: int = MOST_PIXELS) -> list[Frame]:
    """Frames of a GIF with disposal and transparency applied. Broken files raise ValueError."""
    return list(each_frame(data, most_pixels))


def each_frame(data: bytes, most_pixels: int = MOST_PIXELS) -> Iterator[Frame]:
    """decode_gif() one frame at a time, so that one canvas is held; a file that breaks later has given its frames so far."""
    try:
        yield from _decode(data, most_pixels)
    except (IndexError, struct.error) as e:
        raise ValueError("the file ends early") from e


def _decode(data: bytes, most_pixels: int) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > most_pixels:
        raise ValueError("the canvas is too large")
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared, at = _palette(data, at, n), at + 3 * n
    canvas, time = np.zeros((height, width, 4), dtype=np.uint8), 0
    disposal, delay, clear = 0, 0, None

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            if at + 1 + n > len(data):
                raise ValueError("the file ends early")
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    while (kind := data[at]) != TRAILER:
        if kind == EXTENSION:
            label, (body, at) = data[at + 1], blocks(at + 2)
            if label == CONTROL and len(body) >= 4:
                disposal, delay, clear = body[0] >> 2 & 7, 10 * (body[1] | body[2] << 8), body[3] if body[0] & 1 else None
            continue
        if kind != IMAGE:
            raise ValueError("an unknown block")
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        at, palette = at + 10, shared
        if local & 0x80:
            n = 2 << (local & 7)
            palette, at = _palette(data, at, n), at + 3 * n
        if palette is None:
            raise ValueError("no palette")
        least, (stream, at) = data[at], blocks(at + 1)
        if not 1 < least < MOST_BITS - 3:
            raise ValueError("a code size that the format does not have")
        if w * h > most_pixels:
            raise ValueError("an image is too large")
        samples = lzw_decode(stream, least, w * h)
        if samples.size and samples.max() >= len(palette):
            raise ValueError("a sample is not in the palette")
        rows = samples.reshape(h, w)
        if local & 0x40:  # four passes
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            rows, held = np.empty_like(rows), rows
            rows[order] = held
        colours = np.concatenate([palette, np.full((len(palette), 1), 255, np.uint8)], axis=1)
        area = canvas[top : top + h, left : left + w]
        rows = rows[: area.shape[0], : area.shape[1]]
        before = canvas.copy() if disposal == 3 else None
        if clear is None:
            area[...] = colours[rows]
        else:
            seen = rows != clear
            area[seen] = colours[rows[seen]]
        yield Frame(time, delay, canvas.copy(), samples)
        time += delay
        if disposal == 2:
            area[...] = 0
        elif disposal == 3:
            canvas = before
        disposal, delay, clear = 0, 0, None


def _palette(data: bytes, at: int, n: int) -> np.ndarray:
    if at + 3 * n > len(data):
        raise ValueError("the file ends early")
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Counts of the visible pixels by the two leading bits of red, green and blue."""
    flat = rgba.reshape(-1, 4)
    seen = flat[flat[:, 3] > 0] if not flat[:, 3].all() else flat
    return np.bincount((seen[:, 0] >> 6 << 4) | (seen[:, 1] >> 6 << 2) | (seen[:, 2] >> 6), minlength=BINS)


def frames_of(media: DataFrame, column: str = "media", *keys: str, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """A row for each frame of each GIF in `column`: keys, frame, start_ms, duration_ms, width, height, pixels (RGBA), histogram, broken.

    A null or broken file gives a row with broken = its fault and null frame columns, after the
    frames before the fault; canvases and images over `most_pixels` are faults. None is dropped,
    repeated rows each give theirs, an empty table gives none. One frame is held at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(*keys).schema) + ", " if keys else ""
    ddl = fields + "frame int, start_ms long, duration_ms long, width int, height int, pixels binary, histogram array<long>, broken string"
    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def found(data: bytes | None) -> Iterator[tuple]:
        try:
            if data is None:
                raise ValueError("no file")
            for n, f in enumerate(each_frame(data, most_pixels)):
                yield n, f.start_ms, f.duration_ms, f.rgba.shape[1], f.rgba.shape[0], f.rgba.tobytes(), histogram(f.rgba).tolist(), None
        except ValueError as e:
            yield *((None,) * 7), str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                own = [row.column(j) for j in range(len(keys))]
                for values in found(row.column(len(keys))[0].as_py()):
                    made = [pa.array([v], f.type) for v, f in zip(values, list(schema)[len(keys) :], strict=True)]
                    yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(own, schema, strict=False)), *made], schema=schema)

    return media.select(*keys, column).mapInArrow(run, ddl)


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, filled with zeros to a positive multiple of 64, as a GIF.

    Null texts are empty, null ids and repeated rows stay, an empty table gives no rows.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        raw = [t.encode() for t in texts_of(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(x) for x in raw], "media": [store_bytes(padded(x)) for x in raw]}

    return map_rows(doc_texts(docs), "doc_id long, n_bytes long, media binary", rows)


def padded(raw: bytes) -> bytes:
    return raw + bytes(max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def media_digests(media: DataFrame) -> DataFrame:
    """text_media() read back: payload and media digests and the summed histogram of the frames as text."""

    def rows(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for data in batch.column("media").to_pylist():
            digest, size, tail, counts = hashlib.sha256(), 0, b"", np.zeros(BINS, dtype=np.int64)
            for f in each_frame(data):
                part = f.samples.tobytes()
                digest.update(part)
                size, tail = size + len(part), part[-ROW:]
                # The last frame may show less than the canvas; what it does not cover is left as it was.
                counts += histogram(f.rgba)
            values = (size, digest.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), ",".join(map(str, counts.tolist())))
            for k, v in zip(out, values, strict=True):
                out[k].append(v)
        return {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")} | out

    return map_rows(media, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", rows)


def media_features(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: the text stored as a GIF, read back, with digests and colour histogram.

    Null texts are empty (64 zero bytes); equal texts give equal values; repeated rows each give a
    row; an empty table gives none. Narrow: no shuffle.
    """
    return media_digests(text_media(docs))
